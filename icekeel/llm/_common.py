"""What the operators of this subpackage share: tables, shared storage, batches, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icekeel.sources.scratch import shared_dir

#: Rows and bytes (as written) up to which a side of a join is broadcast; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Bytes of a batch between Spark and Python.
BATCH_BYTES = 8 << 20
#: Bytes of text that one step of a Python operator handles together.
CHUNK_BYTES = 1 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and lost executors lose nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, "icekeel")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._icekeel_path = path
    return out


def batched(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches hold BATCH_BYTES at most from here on: long texts don't make large ones."""
    conf = df.sparkSession.conf
    size = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if size.isdigit() and int(size) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def _files(df: DataFrame):
    """(file system, path) of a materialized table."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._icekeel_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def drop(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    fs, path = _files(df)
    fs.delete(path, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, already materialized, with a broadcast hint if it has limit rows and BROADCAST_BYTES on disk at most."""
    if hasattr(df, "_icekeel_path"):
        fs, path = _files(df)
        if fs.getContentSummary(path).getLength() > BROADCAST_BYTES:
            return df
    return F.broadcast(df) if df.count() <= limit else df


def chunks(values: Iterable, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [start, end) of values whose lengths sum to about limit; a longer value gets a range of its own."""
    start, total, end = 0, 0, 0
    for end, v in enumerate(values, 1):
        total += len(v)
        if total >= limit:
            yield start, end
            start, total = end, 0
    if start < end:
        yield start, end


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """The column's strings; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def trim() -> None:
    """Gives free memory of a Python worker back to the system, where the C library can: workers live on."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def release(spark: SparkSession) -> None:
    """The JVM of each executor collects its garbage, so that heap that past steps have grown goes back to the system: executors live on."""
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is one more
    spark.range(0, executors, 1, executors).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that few rows at a time are Python objects; memory goes back to the system between them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        trim()


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finalizer of SplitMix64 over an array of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


#: Bytes that part words, a number for every other byte, the base of places, and bytes that are hashed together.
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_TERM = np.where(_SPACE, U64(0), mix64(np.arange(256, dtype=U64), 77))
_BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 18


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of _BASE and of its inverse, modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(n, U64(x)))]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def word_hashes(raw: bytes, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of raw, which ASCII white space parts: 64-bit hashes of their bytes, alike in every process.

    A word's polynomial in _BASE is a difference of sums over its segment; a word as long as a segment is summed in pieces.
    """
    power, inverse = _powers(segment)
    out, starts, at = [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0
    codes = np.frombuffer(raw, np.uint8)

    def final(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return mix64(h ^ sizes.astype(U64) * U64(0xD6E8FEB86659FD93), 3)

    with np.errstate(over="ignore"):
        while at < len(raw):
            end = min(len(raw), at + segment)
            blanks = np.flatnonzero(_SPACE[codes[at:end]]) if end < len(raw) else None
            if blanks is not None and len(blanks):
                end = at + int(blanks[-1]) + 1
            elif blanks is not None:  # one word as far as the segment goes
                while end < len(raw) and not _SPACE[codes[end : end + segment]].any():
                    end = min(len(raw), end + segment)
                end += int(np.argmax(_SPACE[codes[end : end + segment]])) if end < len(raw) else 0
                h, shift = U64(0), U64(1)
                for k in range(at, end, segment):
                    own = _TERM[codes[k : min(end, k + segment)]]
                    h, shift = h + (own * power[: len(own)]).sum(dtype=U64) * shift, shift * power[segment]
                out.append(final(np.array([h]), np.array([end - at])))
                starts.append(np.array([at]))
                at = end
                continue
            own = codes[at:end]
            edges = np.flatnonzero(np.diff(_SPACE[own], prepend=True, append=True))
            first, last = edges[::2], edges[1::2]
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(_TERM[own] * power[: len(own)], dtype=U64)])
            out.append(final((sums[last] - sums[first]) * inverse[first], last - first))
            starts.append(first + at)
            at = end
    return np.concatenate(out), np.concatenate(starts)


def hash_words(words: list) -> np.ndarray:
    """The hashes of words (bytes or str) that hold no ASCII white space."""
    out = word_hashes(b" ".join([w if isinstance(w, bytes) else w.encode() for w in words]))[0]
    if len(out) != len(words):
        raise ValueError("words must not be empty or hold white space")
    return out


def hashed_texts(raws: list[bytes]) -> Iterator[np.ndarray]:
    """The hashes of each text's words in order, many texts at once."""
    for a, b in chunks(raws):
        hashes, starts = word_hashes(b"\n".join(raws[a:b]))
        edges = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws[a:b])]))
        for k in range(b - a):
            yield hashes[edges[k] : edges[k + 1]]


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one sequence; a shorter sequence is one shingle, an empty one has none."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    m = max(1, n - k + 1)
    out = np.full(m, U64(min(n, k)))
    for i in range(min(n, k)):
        out = mix64(out ^ word_hashes[i : i + m], i + 1)
    return out
