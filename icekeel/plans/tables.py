"""A table's files as DataFrames, and the metadata files that a commit writes."""

from __future__ import annotations

import random
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icekeel.operators import metadata
from icekeel.sources import avro_ocf
from icekeel.sources.catalog import current_snapshot
from icekeel.sources.store import Store


class DeletesPresent(Exception):
    """The table has row-level deletes, which rewriting data files alone would undo."""


@dataclass
class TableFiles:
    """The files of some snapshots: lists (snapshot_id, source), owners (source, manifest_path, content), entries."""

    spark: SparkSession
    snapshots: list[dict]

    def owners(self) -> DataFrame:
        """Entries of the manifest lists, with the list that each is from; an unreadable list is an error."""
        return avro_ocf.manifest_lists(self.spark, sorted({s["manifest-list"] for s in self.snapshots if s.get("manifest-list")}))

    def entries(self, manifests: DataFrame) -> DataFrame:
        """Live entries of manifests (manifest_path)."""
        rows = avro_ocf.manifests(self.spark, manifests.select("manifest_path").distinct())
        return rows.select(F.col("source").alias("manifest_path"), "status", "snapshot_id", "data_file.*")


def current_files(spark: SparkSession, meta: dict) -> DataFrame:
    """(file_path, size_bytes, record_count, added_at, manifest_path) of the current snapshot's data files."""
    snap = current_snapshot(meta)
    schema = "file_path string, size_bytes long, record_count long, added_at timestamp, manifest_path string"
    if not snap:
        return spark.createDataFrame([], schema)
    files = TableFiles(spark, [snap])
    owners = files.owners()
    entries = metadata.data_entries(files.entries(metadata.data_manifests(owners)))
    snaps = spark.createDataFrame([(s["snapshot-id"], s["timestamp-ms"]) for s in meta["snapshots"]], "snapshot_id long, ms long").select("snapshot_id", F.timestamp_millis("ms").alias("ts"))
    aged = metadata.with_age(entries, snaps, F.timestamp_millis(F.lit(snap["timestamp-ms"]).cast("long")))
    return aged.select("file_path", F.col("file_size_in_bytes").alias("size_bytes"), "record_count", "added_at", "manifest_path")


def holders(spark: SparkSession, snapshot: dict, paths: list[str]) -> set[str]:
    """The data manifests of a snapshot whose live entries name one of paths; manifests are read by tasks."""
    files = TableFiles(spark, [snapshot])
    entries = files.entries(metadata.data_manifests(files.owners()))
    wanted = spark.createDataFrame([(p,) for p in paths], "file_path string")
    return {r[0] for r in entries.join(wanted, "file_path", "left_semi").select("manifest_path").distinct().collect()}  # one job's inputs at most


def has_deletes(spark: SparkSession, meta: dict) -> bool:
    snap = current_snapshot(meta)
    return bool(snap) and bool(TableFiles(spark, [snap]).owners().filter("content = 1").take(1))


def live_paths(spark: SparkSession, meta: dict) -> DataFrame:
    """(p) of every list, manifest, data and delete file that any snapshot needs; unreadable metadata is an error."""
    files = TableFiles(spark, meta.get("snapshots") or [])
    owners = files.owners()
    entries = files.entries(owners)
    lists = spark.createDataFrame([(s["manifest-list"],) for s in files.snapshots if s.get("manifest-list")], "p string")
    return metadata.union_distinct(lists, owners.select("manifest_path"), entries.select("file_path")).select(F.col("path").alias("p"))


def new_snapshot_id(meta: dict, rand=random.SystemRandom()) -> int:
    taken = {s["snapshot-id"] for s in meta.get("snapshots") or []}
    while (n := rand.getrandbits(63)) in taken or n == 0:
        pass
    return n


def write_manifest(store: Store, location: str, rows: list[dict], sequence: int, snapshot_id: int, like: avro_ocf.Container | None = None, row: dict | None = None) -> dict:
    """Writes a manifest of entries and returns its row for a manifest list, with real counts and length.

    like: a manifest of the table, whose schema and header (partition spec, format version) the new one has, so
    that its entries keep all fields; row: that manifest's row in its list, for the partition spec.
    """
    path = f"{location.rstrip('/')}/metadata/{uuid.uuid4()}-m0.avro"
    schema, meta = (like.schema, like.meta) if like else (avro_ocf.ENTRY_SCHEMA, {"format-version": "1", "content": "data"})
    raw = avro_ocf.encode(schema, rows, meta=meta)
    store.write(path, raw)
    by = lambda s, f=lambda r: 1: sum(f(r) for r in rows if r["status"] == s)
    rows_of = lambda r: r["data_file"]["record_count"]
    least = min((r["sequence_number"] for r in rows if r["status"] == 0 and r.get("sequence_number") is not None), default=sequence)
    return {
        "manifest_path": path, "manifest_length": len(raw), "partition_spec_id": (row or {}).get("partition_spec_id", 0), "content": 0, "sequence_number": sequence, "min_sequence_number": min(least, sequence),
        "added_snapshot_id": snapshot_id, "added_files_count": by(1), "existing_files_count": by(0), "deleted_files_count": by(2),
        "added_rows_count": by(1, rows_of), "existing_rows_count": by(0, rows_of), "deleted_rows_count": by(2, rows_of),
    }


def write_list(store: Store, location: str, rows: list[dict], snapshot_id: int, like: avro_ocf.Container | None = None) -> str:
    """Writes a manifest list with the schema and header of like, a list of the table, so that old rows keep all fields."""
    path = f"{location.rstrip('/')}/metadata/snap-{snapshot_id}-{uuid.uuid4()}.avro"
    schema, meta = (like.schema, like.meta) if like else (avro_ocf.LIST_SCHEMA, {})
    store.write(path, avro_ocf.encode(schema, rows, meta=meta | {"snapshot-id": str(snapshot_id)}))
    return path


def kept_entry(entry: dict, manifest: dict) -> dict:
    """A live entry as it stands in a rewritten manifest: what it took over from its manifest's row is written out."""
    out = entry | {"status": 0, "snapshot_id": entry["snapshot_id"] or manifest["added_snapshot_id"]}
    for name in ("sequence_number", "file_sequence_number"):
        if name in entry and entry[name] is None:
            out[name] = manifest.get("sequence_number") or 0
    return out


def append(store: Store, meta: dict, files: list[dict], now_ms: int) -> dict:
    """A snapshot that adds data files to the current ones: the list of the parent and one more manifest."""
    parent, sid = current_snapshot(meta), new_snapshot_id(meta)
    sequence = (meta.get("last-sequence-number") or 0) + 1
    old = avro_ocf.container(store.read(parent["manifest-list"])) if parent else None
    new = write_manifest(store, meta["location"], [{"status": 1, "snapshot_id": sid, "data_file": f} for f in files], sequence, sid)
    at = write_list(store, meta["location"], [*(old.rows if old else ()), new], sid, old)
    return {"snapshot-id": sid, "parent-snapshot-id": parent["snapshot-id"] if parent else None, "sequence-number": sequence, "timestamp-ms": now_ms, "manifest-list": at, "summary": {"operation": "append"}}
