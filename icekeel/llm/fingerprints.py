"""Document fingerprints: SimHash, and permuted block tables for the fingerprints near each other.

Terms are the distinct words and word pairs of a text; each votes on every bit of the fingerprint with
the sign of its hash's bit, weighted by the square root of its count, a pair PAIR times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icekeel.llm._common import batched, chunks, hashed_texts, materialize, mix64, sliced, texts

#: Bits of a fingerprint, and weight of a word pair against a word.
BITS, PAIR = 128, 2.0
#: Rows of a bucket of neighbours, and buckets at most; their largest ids come to the driver.
BUCKET_ROWS, MOST_BUCKETS = 2000, 20_000
#: Parts in which the fingerprints of one block are compared.
SALTS = 8
LEAST = -(1 << 63)


def simhash(words: np.ndarray) -> bytes:
    """The fingerprint of a text from the hashes of its words in order; of no words: zeros."""
    if not len(words):
        return bytes(BITS // 8)
    pairs = mix64(words[:-1], 1) ^ mix64(words[1:], 2)
    terms, weights = [], []
    for t, w in ((words, 1.0), (pairs, PAIR)):
        t, n = np.unique(t, return_counts=True)
        terms.append(t)
        weights.append(w * np.sqrt(n))
    terms, weights = np.concatenate(terms), np.concatenate(weights).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for at in range(0, len(terms), 1 << 14):
        t, w = terms[at : at + (1 << 14)], weights[at : at + (1 << 14)]
        wide = np.stack([mix64(t, 31 + k) for k in range(BITS // 64)], axis=1)
        bits = np.unpackbits(wide.view(np.uint8).reshape(len(t), -1), axis=1)
        votes += 2.0 * (w @ bits.astype(np.float32)) - w.sum(dtype=np.float64)
    return np.packbits(votes > 0).tobytes()


def simhashes(all_texts: list[str]) -> list[bytes]:
    """Fingerprints of texts; words are what ASCII white space separates, after lower-casing A-Z."""
    return [simhash(hashes) for hashes in hashed_texts([t.encode().lower() for t in all_texts])]


def likeness(a: bytes, b: bytes) -> float:
    """The share of bits that agree."""
    return 1.0 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint: hex) of every row; a null text counts as empty. Equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.hex() for f in simhashes(texts(batch.column(1)))], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, fingerprint string")


def within_radius(prints: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """(a, b, distance): all pairs a < b of different fingerprints (hex strings) within radius bits.

    The bits are cut into blocks (radius + 3 by default); some choice of blocks - radius blocks is equal in any such pair, so
    one table for each choice keeps that choice in front as its key, and keys meet in equi-joins.
    Fingerprints that many documents share count once, so copies cost nothing. Null fingerprints are ignored.
    """
    blocks = blocks or radius + 3
    edges = [round(k * BITS / 4 / blocks) for k in range(blocks + 1)]
    parts = [F.substring("fingerprint", edges[k] + 1, edges[k + 1] - edges[k]) for k in range(blocks)]
    keys = [F.concat_ws(":", F.lit(str(n)), *(parts[k] for k in chosen)) for n, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    rows = prints.select("fingerprint").filter("fingerprint is not null").distinct().select(F.col("fingerprint"), F.explode(F.array(*keys)).alias("key"))
    a, b = rows.select("key", F.col("fingerprint").alias("a")), rows.select("key", F.col("fingerprint").alias("b"))
    distance = sum((F.bit_count(F.conv(F.substring("a", k + 1, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("b", k + 1, 8), 16, 10).cast("long"))) for k in range(0, BITS // 4, 8)), F.lit(0))
    return a.join(b, "key").filter("a < b").select("a", "b").distinct().withColumn("distance", distance).filter(F.col("distance") <= radius)


def neighbours(prints: DataFrame, queries: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """(fingerprint, n_within): for each fingerprint of queries, how many rows of prints are within radius bits of it, equal ones too.

    The bits are cut into blocks (radius + 1 by default), of which one at least is equal in any such pair: one table
    for each block has it in front as its key. A pair counts in the first table where it meets, so that
    counts are summed where pairs are found and no pair is moved. Equal fingerprints count as one row with
    their number; the tables' rows are salted, so that a key of many fingerprints is spread over tasks. Null fingerprints are ignored.
    The tables always meet in a shuffle: Spark's estimates don't know by how much the blocks and salts multiply queries, which it would broadcast.
    """
    blocks = blocks or radius + 1
    if blocks <= radius or BITS // 4 % blocks:
        raise ValueError("blocks must be more than radius, and as long as each other")
    size = BITS // 4 // blocks
    words = [F.conv(F.substring("fingerprint", k + 1, 8), 16, 10).cast("long") for k in range(0, BITS // 4, 8)]
    parts = F.array(*(F.substring("fingerprint", k * size + 1, size) for k in range(blocks)))
    rows = prints.filter("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n"))

    def tabled(df: DataFrame, name: str, *columns) -> DataFrame:
        """A row for each block."""
        out = df.select("fingerprint", *columns, F.array(*words).alias("words"), parts.alias("parts"))
        return out.select(F.col("fingerprint").alias(f"f_{name}"), *columns, F.col("words").alias(f"words_{name}"), F.col("parts").alias(f"parts_{name}"), F.posexplode("parts").alias("t", "key"))

    base = tabled(rows, "b", "n").withColumn("salt", (F.xxhash64("f_b") % SALTS + SALTS) % SALTS)
    asked = tabled(queries.filter("fingerprint is not null").select("fingerprint").distinct(), "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    distance = sum((F.bit_count(F.col("words_q")[k].bitwiseXOR(F.col("words_b")[k])) for k in range(len(words))), F.lit(0))
    earlier = F.exists(F.sequence(F.lit(0), F.col("t")), lambda j: (j < F.col("t")) & (F.get("parts_q", j) == F.get("parts_b", j)))
    met = asked.hint("merge").join(base.hint("merge"), ["t", "key", "salt"]).filter((distance <= radius) & ~earlier)
    return met.groupBy(F.col("f_q").alias("fingerprint")).agg(F.sum("n").alias("n_within"))


def _bucket(bounds: np.ndarray, keys):
    """The buckets of ids, in descending order of ids; bounds holds complements, which can't overflow."""
    return np.searchsorted(bounds, ~np.int64(keys) if np.isscalar(keys) else ~keys)


def _dealt(bounds: np.ndarray, heads: dict[int, int]):
    """docs -> rows with fingerprint, compressed text and bucket; a bucket's head also goes to the bucket before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, all_texts = batch.column("doc_id").to_pylist(), texts(batch.column("text"))
            for start, end in chunks(all_texts, 8 << 20):
                rows = []
                for i, t, f in zip(ids[start:end], all_texts[start:end], simhashes(all_texts[start:end]), strict=True):
                    raw, key = t.encode(), LEAST if i is None else i
                    bucket = int(_bucket(bounds, key))
                    row = (i, key, len(t), f, pa.compress(raw, codec="zstd", asbytes=True), len(raw))
                    rows.append((bucket, 0, *row))
                    if key in heads:
                        rows.append((heads[key], 1, *row))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
                names = ["bucket", "extra", "doc_id", "key", "n_chars", "print", "blob", "size"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, extra and descending id -> each row with its successor's part of the result."""

    def text(r: dict) -> str:
        return pa.decompress(r["blob"], decompressed_size=r["size"], codec="zstd", asbytes=True).decode() if r["size"] else ""

    before, pairs, total = None, [], 0

    def done() -> pa.RecordBatch:
        edited = [x for *_, x in pairs]
        prints = simhashes(edited)
        rows = [
            (r["doc_id"], r["n_chars"], hashlib.sha256(e.encode()).hexdigest(), r["print"].hex(), p.hex(), likeness(r["print"], p), likeness(r["print"], n["print"]))
            for (r, n, e), p in zip(pairs, prints, strict=True)
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in sliced(batches):
        for r in batch.to_pylist():
            r["text"] = text(r)
            if before is not None and before["bucket"] == r["bucket"] and not before["extra"]:
                half = before["n_chars"] // 2
                edit = before["text"][: before["n_chars"] - half] + r["text"][:half]
                pairs.append((before, {"print": r["print"]}, edit))
                del before["text"]
                before.pop("blob")
                total += len(edit)
            before = r
            if total > 1 << 20:
                yield done()
                pairs, total = [], 0
    if pairs:
        yield done()


def edits(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document by descending doc_id; after the last comes the first. Only neighbours meet: rows are dealt by
    ranges of ids, and each range also gets the first row of the next. Null texts count as empty; null ids
    come after all others; rows that repeat an id follow each other by fingerprint and text. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(1, min(MOST_BUCKETS, docs.count() // BUCKET_ROWS))
    cuts = docs.select(F.bitwise_not("doc_id").cast("double").alias("x")).filter("x is not null").approxQuantile("x", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = np.array(sorted({int(c) for c in cuts}), np.int64)

    def largest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pc.fill_null(batch.column(0), LEAST).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(bounds, keys)), pa.array(keys)], ["bucket", "key"])

    # The largest id of each bucket: MOST_BUCKETS rows at most.
    largest = sorted(map(tuple, docs.select("doc_id").mapInArrow(largest_ids, "bucket long, key long").groupBy("bucket").agg(F.max("key").alias("key")).collect()))
    heads = {key: largest[k - 1][0] for k, (_, key) in enumerate(largest)}
    rows = docs.mapInArrow(_dealt(bounds, heads), "bucket int, extra int, doc_id long, key long, n_chars long, print binary, blob binary, size long")
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(partitions, "bucket").sortWithinPartitions("bucket", "extra", F.col("key").desc(), F.col("doc_id").desc_nulls_last(), "print", "blob")
    return rows.mapInArrow(_paired, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edits_and_neighbours(docs: DataFrame, radius: int = 3, every: int = 20) -> DataFrame:
    """edits() with n_within: how many other rows have a fingerprint within radius bits, for ids divisible by every (else null)."""
    rows = materialize(edits(docs))
    is_asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    asked, rest = rows.filter(is_asked), rows.filter(~is_asked)
    found = materialize(neighbours(rows.select("fingerprint"), asked.select("fingerprint"), radius))
    # Counts grow with the table, and so are never broadcast; only the rows that asked cross a shuffle.
    counted = asked.join(found.hint("merge"), "fingerprint", "left").select(*rows.columns, (F.col("n_within") - 1).alias("n_within"))
    return counted.unionByName(rest.withColumn("n_within", F.lit(None).cast("long")))
