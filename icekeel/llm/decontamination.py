"""Benchmark decontamination: spaced-seed hashing, and verification that tolerates substitutions.

A seed hashes the words that a fixed mask picks out of a window, so that a substituted word at
an ignored position doesn't hide the hit. Seeds of the benchmark meet seeds of the documents; at
every hit the whole item is laid along the document and the best run of agreeing words is
kept. A small benchmark (its seeds are counted) goes to every task; a larger one is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icekeel.llm._common import U64, batched, chunks, hash_words, materialize, mix64, sliced, small_side, texts

#: Masks over windows of words: 1 counts, 0 is ignored. Every run that counts has a window where one of them sees no substitution.
MASKS = ("1101100101", "1010011011", "111001011", "1011111", "111111")
#: Words of a run that counts, or the whole item where that is shorter; and the least share of them that agree.
LEAST_WORDS, LEAST_SHARE = 13, 0.8
#: Seeds of the benchmark up to which they go to every task (8 bytes each, and 16 for item and place).
BOUND_SEEDS = 2_000_000

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Key of a row of documents where they are joined: ids may be null or repeat.
ROW = "icekeel_row"
MATCH_SCHEMA = "doc_id long, item_id long, first_word long, n_words long, n_same long"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _shapes(n: int) -> list[tuple[int, ...]]:
    """Positions of the masks that an item of n words is hashed by.

    An item that counts only as a whole is laid out in groups, two more than the substitutions that it
    may have, and has a mask for each choice of that many groups to ignore.
    """
    if n >= LEAST_WORDS:
        return [tuple(i for i, x in enumerate(m) if x == "1") for m in MASKS]
    spare = int(n * (1 - LEAST_SHARE) + 1e-9)
    return [tuple(i for i in range(n) if i * (spare + 2) // n not in out) for out in combinations(range(spare + 2), spare)] if n else []


def seeds(hashes: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """The seed of every window of one mask."""
    m = len(hashes) - shape[-1]
    if m <= 0:
        return np.zeros(0, U64)
    out = np.full(m, U64(len(shape) * 131 + shape[-1]))
    with np.errstate(over="ignore"):
        for k, i in enumerate(shape):
            out += hashes[i : i + m] * U64((0x9E3779B97F4A7C15 * (2 * k + 3) | 1) & 0xFFFFFFFFFFFFFFFF)
    return mix64(out, len(shape) * 100 + shape[-1])


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """(start, length, agreeing) of the longest run of which LEAST_SHARE agrees; same: which words agree."""
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0 - LEAST_SHARE, -LEAST_SHARE))])
    # The first place from which the sum up to each end isn't negative, among falling minima.
    first = np.searchsorted(-np.minimum.accumulate(total), -total - 1e-9)
    end = int(np.argmax(np.arange(len(total)) - first))
    start = int(first[end])
    return start, end - start, int(same[start:end].sum())


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(first word in doc, words, agreeing words) if item laid at doc[shift] overlaps enough."""
    a, b = max(0, shift), min(len(doc), shift + len(item))
    same = doc[a:b] == item[a - shift : b - shift]
    start, n, agree = best_run(same)
    if n >= min(LEAST_WORDS, len(item)):
        return a + start, n, agree
    return None


class Index:
    """The seeds of a benchmark, looked up in whole arrays."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, hash_words(words_of(t or ""))) for i, t in items]
        self.shapes = sorted({s for _, h in self.items for s in _shapes(len(h))})
        by = [(seeds(h, s)[: 1 if len(h) < LEAST_WORDS else None], k) for k, (_, h) in enumerate(self.items) for s in _shapes(len(h))]
        self.seed = np.concatenate([x for x, _ in by]) if by else np.zeros(0, U64)
        self.item = np.concatenate([np.full(len(x), k) for x, k in by]) if by else np.zeros(0, np.int64)
        self.place = np.concatenate([np.arange(len(x)) for x, _ in by]) if by else np.zeros(0, np.int64)
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.place = self.seed[order], self.item[order], self.place[order]
        self.bits = None

    def matches(self, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item_id, first word, words, agreeing words): the best overlap with every item."""
        if self.bits is None:
            self.bits = np.zeros(1 << 22, bool)
            self.bits[self.seed >> U64(42)] = True
        lays: set[tuple[int, int]] = set()
        for shape in self.shapes:
            found = seeds(doc, shape)
            at = np.flatnonzero(self.bits[found >> U64(42)])
            lo, hi = np.searchsorted(self.seed, found[at], "left"), np.searchsorted(self.seed, found[at], "right")
            for p, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                lays.update((int(self.item[j]), int(p - self.place[j])) for j in range(a, b))
        best: dict[int, tuple[int, int, int]] = {}
        for k, shift in sorted(lays):
            if (o := overlap(doc, self.items[k][1], shift)) and (k not in best or o[2] > best[k][2]):
                best[k] = o
        return [(self.items[k][0], *o) for k, o in best.items()]


def _hashed(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words), hashing many rows at once."""
    all_texts = texts(column)
    for a, b in chunks(all_texts):
        words = [words_of(t) for t in all_texts[a:b]]
        hashes, at = hash_words([w for ws in words for w in ws]), 0
        for i, ws in enumerate(words, a):
            yield i, hashes[at : at + len(ws)]
            at += len(ws)


def _rows(found: list[tuple], names: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in names.split(", ")]
    columns = list(zip(*found, strict=True)) if found else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _n_seeds(benchmark: DataFrame) -> int:
    """An upper bound of the seeds, without looking at words: the bytes of all items and masks."""
    return len(MASKS) * int(benchmark.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0))).first()[0])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long"), F.col("text")).filter("item_id is not null and text is not null").dropDuplicates()


def contaminated(docs: DataFrame, benchmark: DataFrame, bound: int = BOUND_SEEDS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_same) for every document and item that overlap.

    Words are runs of letters, marks and digits, lower-cased. An overlap is a run of words laid
    against the item without insertions: LEAST_WORDS words or more (the whole item if shorter), of
    which LEAST_SHARE agree; the one with most agreeing words is returned. Null or empty texts and items
    match nothing; null ids of documents come back as null, those of items are left out. Repeated rows of
    docs repeat their result, repeated items count once. Other columns are ignored.
    """
    docs, items = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _items(benchmark)
    if _n_seeds(items) > bound:
        return _joined(_keyed(docs), items).drop(ROW)
    index = Index([(r.item_id, r.text) for r in items.collect()])  # bound seeds at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column("doc_id").to_pylist()
            yield _rows([(ids[i], *m) for i, h in _hashed(batch.column("text")) for m in index.matches(h)], MATCH_SCHEMA)

    return docs.mapInArrow(run, MATCH_SCHEMA)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key ROW, written so that it stays the same."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """contaminated() with ROW, for a benchmark of any size: seeds meet in a join, pairs are verified on their texts."""
    items = materialize(items)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for i, h in _hashed(batch.column(1)):
                for s in _shapes(len(h)):
                    out += [(int(x), ids[i], p) for p, x in enumerate(seeds(h, s)[: 1 if len(h) < LEAST_WORDS else None].view(np.int64))]
            yield _rows(out, "seed, item_id, place")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([(n,) for n in {min(len(h), LEAST_WORDS) for _, h in _hashed(batch.column(1))}], "n")

    shapes = sorted({s for r in items.mapInArrow(lengths, "n long").distinct().collect() for s in _shapes(r.n)})  # LEAST_WORDS + 1 rows at most

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column(ROW).to_pylist()
            for i, h in _hashed(batch.column("text")):
                found = [seeds(h, s).view(np.int64) for s in shapes] or [np.zeros(0, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array([ids[i]] * sum(map(len, found)), pa.int64()), pa.array(np.concatenate([np.arange(len(x)) for x in found]))], ["seed", ROW, "at"])

    left = items.mapInArrow(of_items, "seed long, item_id long, place long")
    lays = docs.mapInArrow(of_docs, f"seed long, {ROW} long, at long").join(left, "seed").select(ROW, "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
    lays = materialize(lays)
    hit = materialize(lays.select(ROW).distinct())
    texts_of = docs.join(small_side(hit), ROW, "left_semi").select(ROW, "doc_id", F.col("text").alias("doc"))
    both = lays.groupBy(ROW, "item_id").agg(F.collect_set("shift").alias("shifts")).join(items.select("item_id", F.col("text").alias("item")), "item_id").join(texts_of, ROW)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                best = (0, 0, 0)
                doc, item = hash_words(words_of(r["doc"] or "")), hash_words(words_of(r["item"]))
                for shift in sorted(r["shifts"]):
                    if (o := overlap(doc, item, shift)) and o[2] > best[2]:
                        best = o
                found += [(r[ROW], r["doc_id"], r["item_id"], *best)] if best[1] else []
            yield _rows(found, f"{ROW} long, {MATCH_SCHEMA}")

    return both.mapInArrow(verify, f"{ROW} long, {MATCH_SCHEMA}")


def keep_clean(docs: DataFrame, benchmark: DataFrame, bound: int = BOUND_SEEDS) -> DataFrame:
    """docs without those that overlap an item, with their columns as they are."""
    docs, items = batched(docs), _items(benchmark)
    if _n_seeds(items) > bound:
        rows = _keyed(docs)
        hit = materialize(_joined(rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "text"), items).select(ROW).distinct())
        return rows.join(small_side(hit), ROW, "left_anti").select(docs.columns)
    index = Index([(r.item_id, r.text) for r in items.collect()])  # bound seeds at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array([not index.matches(h) for _, h in _hashed(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
