"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icekeel.llm._common import batched, materialize, sliced

#: Labelled rows that a fit takes at most: the first by hash of doc_id.
FIT_ROWS = 200_000
#: Partitions in which the normal equations are summed.
FIT_PARTITIONS = 12
FEATURES = 256
RIDGE = 1e-4
CUT = 0.3
NAMES = ("log_chars", "word_len", "upper", "digit", "symbol", "bar", "bang", "mark", "distinct", "top", "bigrams", "line_len", "lines", "same_lines", "short", "capital", "long", "wide")

_LETTER = np.array([chr(b).isalpha() or b > 127 for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_SPACE = np.array([b == 32 or 9 <= b < 14 for b in range(256)])


def statistics(text: str) -> list[float]:
    """The statistics NAMES of one text; all finite for the empty one too."""
    raw = text.encode()
    n = max(1, len(raw))
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    letters, spaces = by[_LETTER].sum(), by[_SPACE].sum()
    words, lines = text.split(), text.split("\n")
    w, c = max(1, len(words)), Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
    return [
        np.log1p(len(text)), letters / w, by[_UPPER].sum() / max(1, letters), by[_DIGIT].sum() / n,
        (n - letters - by[_DIGIT].sum() - spaces) / n, by[ord("|")] / w, by[ord("!")] / w, sum(by[ord(x)] for x in "#$%&*@~^") / w,
        len(c) / w, max(c.values(), default=0) / w, pairs, np.log1p(len(text) / len(lines)), np.log1p(len(lines)), len(set(lines)) / len(lines),
        sum(len(x) < 4 for x in words) / w, sum(x[0].isupper() for x in words) / w, max(map(len, words), default=0) / 40, by[128:].sum() / n,
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t or "") for t in column.to_pylist()], float).reshape(-1, len(NAMES))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x: array<double>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_matrix(batch.column(1))), pa.list_(pa.float64()))], ["doc_id", "x"])

    return batched(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing least-squares fit of y on x (pool adjacent violators); equal x are one point."""
    at, of = np.unique(x, return_inverse=True)
    weights = np.bincount(of, minlength=len(at)).astype(float)
    means = np.bincount(of, y, len(at)) / np.maximum(weights, 1)
    blocks: list[list[float]] = []  # mean, weight, sum of x
    for m, w, v in zip(means.tolist(), weights.tolist(), (at * weights).tolist(), strict=True):
        blocks.append([m, w, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, v = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [(p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, p[2] + v]
    return np.array([v / w for _, w, v in blocks]), np.array([m for m, *_ in blocks])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    beta: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def z(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.shift)
        return np.hstack([z, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a thousandth of the raw score so that plateaus stay ordered."""
        raw = self.z(x) @ self.beta
        return np.clip(0.999 * np.interp(raw, self.at, self.level) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _fold(n: int = 5):
    return F.crc32(F.col("doc_id").cast("string")) % n


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, fold) of labels of documents that are there, fold 0 left out: FIT_ROWS rows at most, the first by hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("y is not null and doc_id is not null")
    known = known.withColumn("fold", _fold()).filter("fold <> 0").join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    return materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(FIT_ROWS))


def fit(labelled: DataFrame, seed: int = 3) -> Model | None:
    """A model from statistics and labels (x, y, fold) of FIT_ROWS rows or so; None without any.

    Folds 2 to 4 give the normal equations, fold 1 the calibration.
    """
    rows = materialize(labelled.select("x", "y", "fold").repartition(FIT_PARTITIONS))
    d = len(NAMES)
    moments = rows.select(F.count("*"), *(f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop))).first()
    if not moments[0]:
        return None
    mean, scale = np.array(moments[1::2], float), np.maximum(np.array(moments[2::2], float), 1e-6)
    r = np.random.default_rng(seed)
    start = Model(mean, scale, r.normal(0, 1 / np.sqrt(d), (d, FEATURES)), r.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for batch in batches:
            x, y = np.array(batch.column("x").to_pylist(), float).reshape(-1, d), np.array(batch.column("y").to_pylist(), float)
            z = start.z(x)
            a, b, n = a + z.T @ z, b + z.T @ y, n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()]), pa.array([n])], ["a", "b", "n"])

    parts = rows.filter("fold > 1").mapInArrow(sums, "a binary, b binary, n long").collect()  # FIT_PARTITIONS rows
    a, b = sum(np.frombuffer(p.a) for p in parts).reshape(FEATURES + 1, -1), sum(np.frombuffer(p.b) for p in parts)
    beta = np.linalg.solve(a + (RIDGE * max(1, sum(p.n for p in parts)) + 1e-9) * np.eye(FEATURES + 1), b)
    held = rows.filter("fold = 1").collect() or rows.collect()  # FIT_ROWS rows at most
    x, y = np.array([h.x for h in held], float), np.array([h.y for h in held], float)
    at, level = isotonic(np.round(start.z(x) @ beta, 9), y)  # equal statistics tie, whatever the order of sums
    return Model(mean, scale, start.weights, start.shift, beta, at, level)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= CUT).

    A null text counts as empty and gets that score; without labelled rows every score is 0.5.
    held_out of a null doc_id is null. Contradicting labels of a doc_id all count, and so does each text of an id
    that repeats; rows without a label or doc_id don't. Repeated rows repeat their result; other columns are ignored.
    """
    feats = materialize(features(docs))
    model = fit(feats.join(F.broadcast(sample(docs, labels)), "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(NAMES))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return feats.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", (_fold() == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score is CUT or more, with their columns as they are.

    Rows are judged by their own texts: null ids, null texts (as empty) and repeated ids like all others. Only
    labelled documents are read for the fit.
    """
    known = sample(docs, labels)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fit(features(chosen).join(F.broadcast(known), "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array((model.score(_matrix(batch.column("text"))) >= CUT) if batch.num_rows else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema) if model else docs
