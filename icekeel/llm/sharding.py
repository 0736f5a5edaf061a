"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups (equal texts) are ordered by the 64-bit hash of their text. The smallest capacity with
which greedy cutting needs no more than the wanted shards is found by binary search, and the
order is cut there. The search runs on the driver over a bounded summary: the order is held as
intervals with the sum, the count and the largest of their groups, and only the intervals in which a
cut may still fall are split further (by a Spark aggregation each round) until every cut is exact.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icekeel.llm._common import materialize

#: Bits of the order by which the intervals of a round are split.
FIRST_BITS, MORE_BITS = 12, 8
#: Blocks of each shard in which slots are numbered; shards times this many counts come to the driver.
BLOCKS = 256
#: Bytes that a row counts besides its text.
OVERHEAD = 16


def least_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity for which greedy cutting of whole groups needs no more than shards pieces."""
    lo, hi = max(sizes, default=0), sum(sizes)
    while lo < hi:
        c, used, free = (lo + hi) // 2, 1, (lo + hi) // 2
        for s in sizes:
            if s > free:
                used, free = used + 1, c
            free -= s
        lo, hi = (lo, c) if used <= shards else (c + 1, hi)
    return lo


class Intervals:
    """Consecutive intervals of the order: end[i] is the total size up to and with interval i."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        """rows: (first key, bits, sum, groups, largest), each covering 2 ** bits keys."""
        self.rows = sorted(rows)
        self.end = np.cumsum([r[2] for r in self.rows]) if rows else np.zeros(0, np.int64)
        self.ends = self.end.tolist()

    def cuts(self, capacity: int, shards: int, whole: bool) -> list[int] | None:
        """Sizes before each cut, or None if shards pieces don't suffice. whole: intervals count as groups,
        else those of several groups may be cut anywhere."""
        total, at, out = (self.ends or [0])[-1], 0, []
        for _ in range(shards):
            if at + capacity >= total:
                return out
            i = bisect_right(self.ends, at + capacity)
            last = self.ends[i - 1] if i else 0
            at = max(last, at) if whole or self.rows[i][3] == 1 else at + capacity
            out.append(at)
        return None

    def search(self, lo: int, hi: int, shards: int, whole: bool) -> int:
        """The smallest capacity in (lo, hi] that suffices; hi does."""
        while hi - lo > 1:
            c = (lo + hi) // 2
            lo, hi = (lo, c) if self.cuts(c, shards, whole) is not None else (c, hi)
        return hi


def _split(groups: DataFrame, rows: list[tuple], more: int) -> list[tuple]:
    """The intervals that make up rows, each split by more bits."""
    out = []
    for bits in sorted({r[1] for r in rows}):
        starts = [r[0] for r in rows if r[1] == bits]
        left = max(0, bits - more)
        chosen = groups if bits == 64 else groups.filter(F.shiftright("key", bits).isin([s >> bits for s in starts]))
        part = F.shiftleft(F.shiftright("key", left), left) if left < 64 else F.lit(-(1 << 63))
        out += [(r.k, left, r.s, r.n, r.m) for r in chosen.groupBy(part.alias("k")).agg(F.sum("bytes").alias("s"), F.count("*").alias("n"), F.max("bytes").alias("m")).collect()]
    return out


def cut_keys(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, first keys of the shards after the first) for groups (key: long, bytes: long), ordered by key."""
    rows = _split(groups, [(-(1 << 63), 64)], FIRST_BITS)
    while True:
        t = Intervals(rows)
        total, most = int((t.ends or [0])[-1]), max((r[4] for r in rows), default=0)
        # Below floor no way of cutting inside intervals suffices; at hi cutting between them does.
        floor = max(most, -(-total // shards)) - 1
        floor = t.search(floor, max(total, floor + 1), shards, False) - 1
        hi = t.search(floor, max(total, floor + 1), shards, True)
        spans = []
        low, high = t.cuts(floor + 1, shards, False), t.cuts(hi, shards, False)
        pess = t.cuts(hi, shards, True)
        for j in range(shards - 1):
            a = min((c[j] for c in (low, pess) if c and j < len(c)), default=None)
            b = max((c[j] for c in (low, high, pess) if c and j < len(c)), default=None)
            if a is not None:
                spans.append((a - most, b))
        open_ = set()
        for a, b in spans:
            i, j = bisect_right(t.ends, max(0, a)), bisect_right(t.ends, b)
            open_.update(k for k in range(i, min(j + 1, len(rows))) if t.rows[k][3] > 1 and t.rows[k][1] > 0)
        if not open_:
            cuts = t.cuts(hi, shards, True)
            return hi, [t.rows[t.ends.index(c) + 1][0] if c else t.rows[0][0] for c in cuts]
        split = _split(groups, [t.rows[k] for k in sorted(open_)], MORE_BITS)
        rows = [r for k, r in enumerate(t.rows) if k not in open_] + split


def _shard(key: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below key."""
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= key)) if cuts else F.lit(0)


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus OVERHEAD. The law is "bytes": the largest shard is as small as any
    contiguous cut of the ordered groups allows; equal texts share a shard. A null text counts as empty and
    shares the group of empty texts. slot numbers each shard's rows from 0 without gaps; rows that
    repeat an id get slots of their own. With fewer groups than shards the last shards stay empty; null
    ids are allowed. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key")))
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    _, cuts = cut_keys(groups, shards)
    placed = rows.withColumn("shard", _shard(F.col("key"), cuts).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(BLOCKS)).cast("int"))
    # Slots: a running count of blocks (shards * BLOCKS of them at most), and row numbers inside a block.
    counts = {(r.shard, r.block): r["n"] for r in placed.groupBy("shard", "block").agg(F.count("*").alias("n")).collect()}
    base, starts = {}, []
    for s, b in sorted(counts):
        starts.append((s, b, base.get(s, 0)))
        base[s] = base.get(s, 0) + counts[s, b]
    first = F.broadcast(docs.sparkSession.createDataFrame(starts, "shard int, block int, start long"))
    order = Window.partitionBy("shard", "block").orderBy("doc_id", "key")
    slots = placed.withColumn("nth", F.row_number().over(order) - 1).join(first, ["shard", "block"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
