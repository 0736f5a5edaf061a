"""Token files: ids in blocks, coded by an adaptive context-mixing range coder.

A block holds whole documents and stands alone: its model starts anew, and a checksum covers its ids. Its
ids are dealt to lanes, consecutive runs that are coded side by side, so that every step is a few
array operations. For each id, order 2 and order 1 each predict the id that last proved itself after
the two ids, or the one id, before. How much of the range either prediction gets, and how much is left to
order 0 (adaptive counts of all ids), is mixed by how often predictions as firm as these have held so far.
The table of blocks is written as Parquet with one binary payload a block, which any store that Spark
reaches can hold: blocks are read apart from each other, and a lost task writes its own blocks anew.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icekeel.llm._common import U64, materialize, sliced
from icekeel.llm.bpe import encode_by_unit

MAGIC = b"IKT1"
#: Ids of a block at most (a longer document is a block of its own), and lanes.
BLOCK_IDS, LANES = 1 << 22, 8192
#: Bits of the scales of the mixed weights and of order 0 (32 at most together: a range has as many), and of the table of order 2.
MIX, ZERO, SLOTS = 12, 20, 18
TOP, BOTTOM = U64(1 << 48), U64(1 << 32)
END = 2
#: Rows of a bucket, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 4000, 20_000
LEAST = -(1 << 63)


class _Model:
    """What coder and decoder know alike before each step."""

    def __init__(self, ids: int, lanes: int):
        self.n = ids
        # A prediction and how firm it is, 0 to 3, in one number: id * 4 + firmness.
        self.one, self.two = np.full(ids + 1, -4, np.int32), np.full(1 << SLOTS, -4, np.int32)
        self.edges = np.zeros((32, 4), np.int64)
        self.edges[:, 3] = 1 << MIX
        self.held = np.tile(np.array([2, 1, 3], np.int64), (32, 1))
        self.counts, self.step = np.zeros(ids, np.int64), 0
        self.last, self.mixed = np.full(lanes, ids, np.int64), np.zeros(lanes, U64)

    def look(self) -> None:
        """The predictions of this step, and the edges of the mixed ranges."""
        now = self.last.view(U64) * U64(0x9E3779B97F4A7C15)
        self.slot = ((now ^ self.mixed) * U64(0xD6E8FEB86659FD93) >> U64(64 - SLOTS)).view(np.int64)
        self.mixed = now >> U64(17)
        self.v2, self.v1 = self.two.take(self.slot), self.one.take(self.last)
        self.c2, self.c1 = self.v2 >> 2, self.v1 >> 2
        self.state = (((self.v2 & 3) << 3) | ((self.v1 & 3) << 1) | (self.c1 == self.c2)).astype(np.int64)
        self.edges[:, 1:3] = np.cumsum(self.held[:, :2] * ((1 << MIX) - 3) // self.held.sum(axis=1, keepdims=True) + 1, axis=1)
        s = self.step
        if s < 16 or s % (16 if s < 128 else 32) == 0:
            seen = np.concatenate([[0], np.cumsum(self.counts)])
            # Every id keeps one part of the scale; the rest follows the counts.
            self.zero = seen * ((1 << ZERO) - self.n) // max(1, int(seen[-1])) + np.arange(self.n + 1) if seen[-1] else np.arange(self.n + 1) * ((1 << ZERO) // self.n)
            self.zero[-1] = 1 << ZERO
            self.zero = self.zero.astype(np.int32)

    def learn(self, x: np.ndarray, event: np.ndarray) -> None:
        self.held += np.bincount(self.state * 3 + event, minlength=96).reshape(32, 3)
        fresh = x.astype(np.int32) << 2
        for table, at, v in ((self.two, self.slot, self.v2), (self.one, self.last, self.v1)):
            right = (v ^ fresh) < 4
            right &= v >= 0
            old = np.where(right, np.minimum(v + 1, v | 3), v - 1)
            table[at] = np.where(right | ((v & 3) > 0), old, fresh)
        np.add.at(self.counts, x, 1)
        self.last, self.step = x, self.step + 1


def _ready(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Where a digit is settled, or must be settled because the range gets too narrow."""
    return ((low ^ (low + width)) < TOP) | (width < BOTTOM)


def _narrowed(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Widths cut where a range is narrow but its first digit isn't settled, so that no carry is needed."""
    narrow = ((low ^ (low + width)) >= TOP) & (width < BOTTOM)
    return np.where(narrow, (~low + U64(1)) & (BOTTOM - U64(1)), width) if narrow.any() else width


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // 256))


def pack(ids: np.ndarray) -> bytes:
    """One block of ids below 2 ** 19; a ValueError for others."""
    n, most = len(ids), int(ids.max(initial=0)) + 1
    if most > 1 << (ZERO - 1):
        raise ValueError(f"ids must be below {1 << (ZERO - 1)}")
    lanes = _lanes(n)
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(most, lanes)
    low, width = np.zeros(lanes, U64), np.full(lanes, U64(0xFFFFFFFFFFFFFFFF))
    # The digits of all lanes side by side: lanes are about as far as each other.
    out, at = np.zeros((4 * steps + 8, lanes), "<u2"), np.zeros(lanes, np.int64)
    with np.errstate(over="ignore"):
        for x in grid:
            model.look()
            second, first = x == model.c2, x == model.c1
            event = np.where(second, 0, np.where(first, 1, 2))
            edges, cell = model.edges.ravel(), model.state * 4 + event
            a = edges.take(cell)
            r = width >> U64(MIX)
            low += r * a.view(U64)
            width = r * (edges.take(cell + 1) - a).view(U64)
            # Ids that neither order predicted: their part in order 0.
            y = model.zero.take(x)
            r = width >> U64(ZERO)
            rest = event == 2
            np.copyto(low, low + r * y.astype(U64), where=rest)
            np.copyto(width, r * (model.zero.take(x + 1) - y).astype(U64), where=rest)
            k = np.flatnonzero(_ready(low, width))
            while len(k):
                lk, wk, place = low.take(k), width.take(k), at.take(k)
                wk = _narrowed(lk, wk)
                out[place, k] = lk >> U64(48)
                at[k] = place + 1
                low[k], width[k] = lk, wk = lk << U64(16), wk << U64(16)
                k = k[_ready(lk, wk)]
            model.learn(x, event)
    for k in range(4):
        out[at, np.arange(lanes)] = (low >> U64(48 - 16 * k)).astype(np.uint16)
        at += 1
    rows = np.ascontiguousarray(out[: int(at.max(initial=0))].T)
    body = b"".join([at.astype("<u4").tobytes(), *(rows[i, :m].tobytes() for i, m in enumerate(at.tolist()))])
    return MAGIC + struct.pack("<III", n, most, zlib.crc32(np.ascontiguousarray(ids, "<u4"))) + body


def unpack(block: bytes) -> np.ndarray:
    """The ids of a block; a ValueError if its checksum doesn't hold."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of ids")
    n, most, check = struct.unpack("<III", block[4:16])
    lanes = _lanes(n)
    steps = -(-n // lanes)
    sizes = np.frombuffer(block, "<u4", lanes, 16).astype(np.int64)
    words = np.concatenate([np.frombuffer(block, "<u2", -1, 16 + 4 * lanes), np.zeros(8, np.uint16)])
    at = np.cumsum(sizes) - sizes
    model = _Model(most, lanes)
    low, width, code = np.zeros(lanes, U64), np.full(lanes, U64(0xFFFFFFFFFFFFFFFF)), np.zeros(lanes, U64)
    last = len(words) - 1
    grid, lane, y = np.zeros((steps, lanes), np.uint32), np.arange(lanes), np.zeros(lanes, np.int64)
    with np.errstate(over="ignore", divide="ignore"):
        for _ in range(4):
            code = (code << U64(16)) | words.take(np.minimum(at, last)).astype(U64)
            at += 1
        for t in range(steps):
            model.look()
            edges, cell = model.edges.ravel(), model.state * 4
            r = width >> U64(MIX)
            v = np.minimum((code - low) // r, U64((1 << MIX) - 1)).view(np.int64)
            event = (v >= edges.take(cell + 1)).astype(np.int64) + (v >= edges.take(cell + 2))
            cell += event
            a = edges.take(cell)
            low += r * a.view(U64)
            width = r * (edges.take(cell + 1) - a).view(U64)
            # Order 0 for all lanes; values are looked up in order, which is far quicker.
            r = width >> U64(ZERO)
            v = np.sort(np.minimum((code - low) // r, U64((1 << ZERO) - 1)).view(np.int64) * LANES + lane)
            y[v % LANES] = np.searchsorted(model.zero, (v // LANES).astype(np.int32), side="right") - 1
            a = model.zero.take(y)
            rest = event == 2
            np.copyto(low, low + r * a.astype(U64), where=rest)
            np.copyto(width, r * (model.zero.take(y + 1) - a).astype(U64), where=rest)
            x = np.where(rest, y, np.where(event == 0, model.c2, model.c1))
            if x.min() < 0:
                raise ValueError("a block of ids is damaged")
            k = np.flatnonzero(_ready(low, width))
            while len(k):
                lk, wk, place = low.take(k), width.take(k), at.take(k)
                wk = _narrowed(lk, wk)
                code[k] = (code.take(k) << U64(16)) | words.take(np.minimum(place, last)).astype(U64)
                at[k] = place + 1
                low[k], width[k] = lk, wk = lk << U64(16), wk << U64(16)
                k = k[_ready(lk, wk)]
            grid[t] = x
            model.learn(x, event)
    ids = np.ascontiguousarray(grid.T).ravel()[:n]
    if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != check:
        raise ValueError("a block of ids is damaged")
    return ids


def _bounds(docs: DataFrame) -> np.ndarray:
    """Smallest ids of the buckets after the first, by rough quantiles."""
    n = max(1, min(MOST_BUCKETS, docs.count() // BUCKET_ROWS))
    cuts = docs.select(F.col("doc_id").cast("double").alias("x")).filter("x is not null").approxQuantile("x", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    return np.array(sorted({int(c) for c in cuts}), np.int64)


def _dealt(bounds: np.ndarray):
    """(doc_id, ids) -> rows with the bucket of the id and the ids as bytes: two each where all of a batch are below 2 ** 16, else four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column("ids"), batch.num_rows
            keys = pc.fill_null(batch.column("doc_id"), LEAST).to_numpy(zero_copy_only=False)
            flat, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            width = 2 if flat.max(initial=0) < 1 << 16 else 4
            flat = np.ascontiguousarray(flat.astype(f"<u{width}"))
            blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(flat)])
            buckets = np.searchsorted(bounds, keys, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(keys), batch.column("doc_id"), pa.array(np.full(n, width, np.int32)), blobs], ["bucket", "key", "doc_id", "width", "blob"])

    return run


def _blocks(end: int):
    """Rows sorted by bucket and key -> blocks, with where they start among their bucket's ids."""

    def flush(bucket: int, block: int, offset: int, docs: list) -> pa.RecordBatch:
        ids = np.concatenate([x for _, x in docs])
        columns = [[bucket], [block], [offset], [[i for i, _ in docs]], [[len(x) for _, x in docs]], [pack(ids)]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "block", "first", "doc_ids", "counts", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, block, offset, docs, held = None, 0, 0, [], 0
        for batch in sliced(batches):
            for r in batch.to_pylist():
                raw = np.frombuffer(r["blob"], f"<u{r['width']}")
                ids = np.empty(len(raw) + 1, np.uint32)
                ids[:-1], ids[-1] = raw, end
                if docs and (r["bucket"] != bucket or held + len(ids) > BLOCK_IDS):
                    yield flush(bucket, block, offset, docs)
                    block, offset, docs, held = block + 1, offset + held, [], 0
                if r["bucket"] != bucket:
                    bucket, block, offset = r["bucket"], 0, 0
                docs.append((r["doc_id"], ids))
                held += len(ids)
        if docs:
            yield flush(bucket, block, offset, docs)

    return run


def write(docs: DataFrame, path: str, end: int = END, blanks: bool = False, tails: str = "") -> DataFrame:
    """Encodes docs with the tokenizer file at path and writes their ids, by ascending doc_id, each document ended by the id end.

    Returns the written table of blocks: bucket, block, first (ids before it in its bucket), doc_ids,
    counts, payload; buckets follow each other by id. blanks and tails are those of bpe.encode_by_unit. Null and empty texts have the end id alone; null
    ids come first; rows that repeat an id follow each other. Other columns are ignored; an empty table gives no block.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = _bounds(docs)
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = encode_by_unit(docs, path, blanks, tails, then=_dealt(bounds), schema="bucket int, key long, doc_id long, width int, blob binary")
    rows = dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket", "key", "blob")
    return materialize(rows.mapInArrow(_blocks(end), "bucket int, block long, first long, doc_ids array<long>, counts array<long>, payload binary"))


def read(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document of a written table, decoded and checked; start counts the ids of all documents before it."""
    return _read(blocks, True)


def summary(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a written table, decoded and checked."""
    return _read(blocks, False)


def _read(blocks: DataFrame, ids: bool) -> DataFrame:
    totals = blocks.select("bucket", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    base, at = {}, 0
    for bucket, n in sorted(map(tuple, totals.collect())):  # MOST_BUCKETS + 1 rows at most
        base[bucket], at = at, at + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                flat, counts = unpack(r["payload"]), np.array(r["counts"], np.int64)
                ends = np.cumsum(counts)
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(base[r["bucket"]] + r["first"] + ends - counts)]
                if ids:
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))], ["doc_id", "start", "ids"])
                else:
                    checks = [zlib.crc32(np.ascontiguousarray(flat[b - c : b], "<u4")) for b, c in zip(ends, counts, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(checks, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, "doc_id long, start long, " + ("ids array<int>" if ids else "n_tokens long, ids_crc32 long"))
