"""Scans, filters, joins and roll-ups over manifest lists, manifests and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXISTING, ADDED, DELETED = 0, 1, 2
DATA, DELETES = 0, 1


def data_manifests(manifests: DataFrame) -> DataFrame:
    """Entries of a manifest list that hold data files."""
    return manifests.filter(F.col("content") != DELETES)


def live_entries(entries: DataFrame, status: str = "status") -> DataFrame:
    """Manifest entries that aren't deleted."""
    return entries.filter(F.col(status) != DELETED)


def data_entries(entries: DataFrame, content: str = "content") -> DataFrame:
    """Entries whose file holds rows, not deletes."""
    return entries.filter(F.col(content) == DATA)


def with_age(entries: DataFrame, snapshots: DataFrame, default: Column) -> DataFrame:
    """entries with added_at: the time of their snapshot (snapshot_id, ts), or default for a null or unknown id.

    The snapshots of a table come from its metadata document, hence are few; the optimizer broadcasts them by size.
    """
    ages = snapshots.select("snapshot_id", F.col("ts").alias("added_at_"))
    return entries.join(ages, "snapshot_id", "left").withColumn("added_at", F.coalesce("added_at_", default)).drop("added_at_")


def manifest_summary(entries: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Counts and sums by status for each manifest_path."""
    when = lambda s, v: F.sum(F.when(F.col("status") == s, v).otherwise(0)).cast("long")
    return entries.groupBy("manifest_path").agg(
        when(ADDED, F.lit(1)).alias("added_files"), when(EXISTING, F.lit(1)).alias("existing_files"), when(ADDED, F.col(size)).alias("added_bytes")
    )


def union_distinct(*keys: DataFrame) -> DataFrame:
    """The set of all paths in one-column frames."""
    return reduce(DataFrame.union, (k.toDF("path") for k in keys)).distinct()


def without(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of left that have no partner in right; each side is shuffled or broadcast as its size allows."""
    return left.join(right, on, "left_anti")
