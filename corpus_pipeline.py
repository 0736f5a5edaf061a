"""A corpus pipeline of five stages, each a whole operator of icekeel.llm over all that the stage before kept.

All stages but the last return the columns that they were given, extra ones too, whatever their names. Rows with a null
doc_id go through like others; rows that repeat one are told apart by their texts unless a stage says otherwise.
An empty table gives an empty table.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from icekeel.llm import bpe, decontamination, jaccard_join, quality, secret_scan
from icekeel.llm._common import materialize, release, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null text is judged as an empty one."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Rows without words or id stay. Rows that repeat an id stay or go together; of equal rows with the smallest id all stay.
    """
    return jaccard_join.keep_one(docs, k=5, pct=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, each row by its own text; a null or empty text overlaps nothing."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark, and n_chars follows; null texts stay null."""
    return secret_scan.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of the text, and the text that they decode to, for each row; a null text gives no ids and an empty text.

    All other columns end here.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(docs, path, then=bpe.with_text(path), schema="doc_id long, ids array<int>, text string", unit_bytes=8 << 20)


def _released(stage):
    """stage, before which executors give back the heap that the stages before it have grown: what a stage takes doesn't depend on them."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _released(stage)) for name, stage in [("quality", good), ("near_duplicates", single), ("decontamination", clean), ("secrets", safe), ("bpe", encoded)]]

#: SQL can express neither the classifier nor the join of components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each stage's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
