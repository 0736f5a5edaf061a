"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from icekeel.llm import bpe, decontamination, fingerprints, html_text, license_scan, oracles, quality, secret_scan, sharding, token_files
from icekeel.llm._common import table
from icekeel.llm.jaccard_join import jaccard_components


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, pct=90)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(table(spark, sf_dir, "documents"), path, then=bpe.digests(path), schema=bpe.DIGESTS)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits_and_neighbours(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.summary(token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), tails="!#$%*,.:;?"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_license_scan that SQL can express."""
    return license_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def edited_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7_fingerprints that SQL can express."""
    return fingerprints.edits(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")} | {"pipeline": pipeline, "license_base": license_base, "edited_digests": edited_digests}


def oracle_sql() -> dict[str, str]:
    """For the rest tests/llm has brute force: learnt models, tokenizers and regex engines are beyond SQL."""
    return {"op6_jaccard_join": oracles.JACCARD, "license_base": oracles.LICENSE_BASE, "edited_digests": oracles.EDITED}
