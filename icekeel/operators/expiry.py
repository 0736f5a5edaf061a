"""Which snapshots expire, and which files only they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestor_ids(parents: dict[int, int], current: int) -> list[int]:
    """current and all before it, up to an unknown id or 0; a cycle ends the walk."""
    seen: dict[int, None] = {}
    while current in parents and current not in seen:
        seen[current] = None
        current = parents[current]
    return list(seen)


def ancestors(snapshots: DataFrame, current: int) -> DataFrame:
    """(id, parent_id) rows of snapshots on the way from current to its root.

    A table's snapshots are in its metadata document, which the driver holds anyway; the walk
    has no depth limit and needs no job for each generation.
    """
    rows = snapshots.select("id", "parent_id").collect()  # one table's metadata
    ids = ancestor_ids({r.id: r.parent_id or 0 for r in rows}, current)
    return snapshots.select("id", "parent_id").filter(F.col("id").isin(ids))


def expired(snapshots: DataFrame, current: int, cutoff: Column, min_keep: int) -> DataFrame:
    """snapshot_id of snapshots (id, parent_id, ts) that expire.

    The current snapshot and its ancestors never do. Of the others older than cutoff, oldest first, as
    many are retained as are needed to keep min_keep in all, and the rest expire.
    """
    free = snapshots.join(ancestors(snapshots, current).select("id"), "id", "left_anti").filter(F.col("ts") < cutoff)
    # One table's metadata: an array in order, of which the end expires.
    total = snapshots.count()
    ordered = free.agg(F.array_sort(F.collect_list(F.struct("ts", "id"))).alias("s"))
    spared = F.greatest(F.lit(min_keep) - (F.lit(total) - F.size("s")), F.lit(0))
    return ordered.select(F.explode(F.slice("s", spared + 1, F.greatest(F.size("s") - spared, F.lit(0)))).alias("s")).select(F.col("s.id").alias("snapshot_id"))


def exclusive_manifests(owners: DataFrame, expired_ids: Column) -> DataFrame:
    """Manifests of (snapshot_id, manifest) that only expired snapshots have."""
    gone, live = owners.filter(expired_ids), owners.filter(~expired_ids)
    return gone.select("manifest").distinct().join(live.select("manifest").distinct(), "manifest", "left_anti")


def garbage_files(owners: DataFrame, files: DataFrame, expired_ids: Column) -> DataFrame:
    """file_id of (manifest, file_id) that exclusive manifests have and no live manifest has."""
    live = owners.filter(~expired_ids).select("manifest").distinct()
    mine = files.join(exclusive_manifests(owners, expired_ids), "manifest", "left_semi").select("file_id").distinct()
    return mine.join(files.join(live, "manifest", "left_semi").select("file_id").distinct(), "file_id", "left_anti")
