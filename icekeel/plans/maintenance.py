"""Compaction, snapshot expiry and orphan clean-up of one table, and recovery of broken jobs."""

from __future__ import annotations

import json
import platform
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone
from itertools import chain, groupby
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icekeel.functions.paths import default_fs, plain, plain_path
from icekeel.operators import compaction, expiry, orphans
from icekeel.plans.config import Policy, Retry, enabled, seconds
from icekeel.plans.retry import Conflict, recoverable, retried
from icekeel.plans.tables import DeletesPresent, TableFiles, current_files, has_deletes, holders, kept_entry, live_paths, new_snapshot_id, write_list, write_manifest
from icekeel.sources import avro_ocf, parquet
from icekeel.sources.catalog import Catalog, TableId, Transaction, current_snapshot
from icekeel.sources.scratch import materialize
from icekeel.sources.store import Store

PENDING, UPLOADED, COMMITTED = "pending", "uploaded", "snapshot_committed"
JOURNAL = ".icekeel/recovery"
#: How often a job that lost its executors is tried again in halves.
MOST_SPLITS = 4
#: Bytes in memory for each byte of a Parquet file.
SWELL = 4
#: Hours after which a pending job of another process counts as broken off.
STALE_HOURS = 24


class InputsGone(Exception):
    """Files that a job has merged are no longer part of the table."""


class MixedPartitions(InputsGone):
    """A job's inputs have different partition values, which one file can't have."""


@dataclass
class Candidate:
    partition_dir: str
    files: list[tuple[str, int]]


@dataclass
class CompactionResult:
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    bytes_before: int = 0
    bytes_after: int = 0
    seconds: float = 0.0

    def __add__(self, other: CompactionResult) -> CompactionResult:
        return CompactionResult(self.inputs + other.inputs, self.outputs + other.outputs, self.bytes_before + other.bytes_before, self.bytes_after + other.bytes_after, self.seconds + other.seconds)


@dataclass
class ExpiryResult:
    expired: list[int] = field(default_factory=list)
    deleted_manifests: int = 0
    deleted_data_files: int = 0
    failed: list[str] = field(default_factory=list)


@dataclass
class OrphanResult:
    scanned: int = 0
    deleted: int = 0
    skipped: int = 0
    failed: list[str] = field(default_factory=list)


@dataclass
class Maintainer:
    """Maintenance of tables in one catalog; now is given, never read inside."""

    spark: SparkSession
    catalog: Catalog
    store: Store
    retry: Retry = field(default_factory=Retry)
    eager_delete: bool = False
    #: Bytes that a task of a job may sort, 0 for no limit.
    memory_limit: int = 0
    #: Names this process in journals.
    owner: str = field(default_factory=lambda: f"{platform.node()}-{uuid.uuid4()}")
    sleep: Callable[[float], None] = time.sleep

    def _retried(self, f):
        return retried(f, self.retry.max_attempts, seconds(self.retry.base_delay), seconds(self.retry.max_delay), sleep=self.sleep)

    # Compaction

    def candidates(self, table: TableId, policy: Policy, now: datetime) -> Iterator[Candidate]:
        """Directories with enough small old files, one after the other: the driver holds the paths of one directory."""
        p = policy.compaction
        compaction.checked_strategy(p.strategy or "", list(p.sort_keys or ()), list(p.z_order_columns or ()))
        if not enabled(p):
            return
        meta = self.catalog.load(table)
        if not current_snapshot(meta):
            return
        cutoff = F.lit(now - timedelta(minutes=p.min_file_age_minutes))
        target = p.target_file_size_mb << 20 if p.target_file_size_mb else None
        chosen = compaction.candidate_files(current_files(self.spark, meta), cutoff, p.min_file_count, target)
        rows = chosen.select("partition_dir", "file_path", "size_bytes").orderBy("partition_dir", "file_path").toLocalIterator()
        for name, own in groupby(rows, key=lambda r: r.partition_dir):
            yield Candidate(name, [(r.file_path, r.size_bytes) for r in own])

    def find_candidates(self, table: TableId, policy: Policy, now: datetime) -> list[Candidate]:
        return list(self.candidates(table, policy, now))

    def _rewrite(self, candidate: Candidate, policy: Policy, job: str) -> list[str]:
        """Writes the candidate's rows into files of the target size beside their sources; returns their paths.

        binpack: files go whole into bins of the target size, a written file for each. Sorted layouts have as many files
        as the target size asks, and so many at least that what a task sorts stays within the memory limit.
        """
        p, staging = policy.compaction, f"{candidate.partition_dir}/.{job}"
        target, total = (p.target_file_size_mb or 0) << 20, sum(n for _, n in candidate.files)
        if (p.strategy or "binpack") == "binpack":
            bins, at = {}, 0
            for path, n in candidate.files:
                bins[path], at = (at // target if target else 0), at + n
            parquet.write_bins(self.spark, bins, staging)
        else:
            files = max(1, round(total / target)) if target else 1
            if self.memory_limit:
                files = max(files, -(-total * SWELL // self.memory_limit))
            df = parquet.read_by_name(self.spark, [f for f, _ in candidate.files])
            parquet.write(compaction.laid_out(df, p.strategy, list(p.sort_keys or ()), list(p.z_order_columns or ()), files), staging)
        parts = sorted(path for path, *_ in self.store.rows(staging) if path.endswith(".parquet"))
        moved = []
        for k, part in enumerate(parts):
            new = f"{candidate.partition_dir}/{job}-{k:05d}.parquet"
            self.store.rename(part, new)
            moved.append(new)
        self.store.delete(staging, True)
        return moved

    def _files(self, paths: list[str]) -> list[dict]:
        counts = {r.p: r.n for r in self.spark.read.parquet(*paths).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count("*").alias("n")).collect()}
        strip = lambda p: plain_path(p, default_fs(self.spark))
        counts = {strip(unquote(k)): n for k, n in counts.items()}
        return [{"content": 0, "file_path": p, "file_format": "PARQUET", "record_count": counts.get(strip(p), 0), "file_size_in_bytes": self.store.size(p)} for p in paths]

    def _commit_replace(self, table: TableId, inputs: list[str], outputs: list[dict], snapshot_id: int, now: datetime) -> None:
        """Commits a snapshot with the outputs in place of the inputs and all else as it stands at that moment.

        After a conflict the list is made anew from fresh metadata; inputs that are gone by then end the job.
        """

        def once(_: int) -> None:
            meta = self.catalog.load(table)
            snap = current_snapshot(meta)
            if any(s["snapshot-id"] == snapshot_id for s in meta.get("snapshots") or []):
                return
            if not snap:
                raise InputsGone(str(table))
            # Tasks find the manifests that hold inputs; the driver opens only those.
            old, gone, rest, model, part = set(inputs), set(), [], None, []
            default = default_fs(self.spark)
            held = {plain_path(m, default) for m in holders(self.spark, snap, inputs)} if inputs else set()
            listed = avro_ocf.container(self.store.read(snap["manifest-list"]))
            sequence = (meta.get("last-sequence-number") or 0) + 1
            for m in listed.rows:
                if plain_path(m["manifest_path"], default) not in held:
                    rest.append(m)
                    continue
                opened = avro_ocf.container(self.store.read(m["manifest_path"]))
                rows = [r for r in opened.rows if r["status"] != 2]
                mine = [r["data_file"] for r in rows if r["data_file"]["file_path"] in old]
                gone |= {f["file_path"] for f in mine}
                part += [f.get("partition") for f in mine]
                model = model or (opened, m)
                if m["partition_spec_id"] != model[1]["partition_spec_id"] or any(x != part[0] for x in part):
                    raise MixedPartitions(f"{table}: files of one folder lie in several partitions")
                if kept := [kept_entry(r, m) for r in rows if r["data_file"]["file_path"] not in old]:
                    rest.append(write_manifest(self.store, meta["location"], kept, sequence, snapshot_id, opened, m))
            if gone != old:
                raise InputsGone(", ".join(sorted(old - gone)[:5]))
            added = [{"status": 1, "snapshot_id": snapshot_id, "data_file": ({"partition": part[0]} if part and part[0] is not None else {}) | f} for f in outputs]
            new = write_manifest(self.store, meta["location"], added, sequence, snapshot_id, *(model or ()))
            snapshot = {
                "snapshot-id": snapshot_id, "parent-snapshot-id": snap["snapshot-id"], "sequence-number": sequence, "timestamp-ms": int(now.timestamp() * 1000),
                "manifest-list": write_list(self.store, meta["location"], [*rest, new], snapshot_id, listed), "summary": {"operation": "replace"},
            }
            self.catalog.commit(table, Transaction().current_is(snap["snapshot-id"]).add(snapshot))

        self._retried(once)

    def _journal(self, location: str, job: str, entry: dict) -> str:
        path = f"{location.rstrip('/')}/{JOURNAL}/{job}.json"
        self.store.write(path, json.dumps(entry).encode())
        return path

    def compact(self, table: TableId, candidate: Candidate, policy: Policy, now: datetime, depth: int = 0) -> CompactionResult:
        """Merges a candidate's files and commits: journal, rewrite, journal, commit, journal, clean up.

        A job that starved is tried in two halves, MOST_SPLITS times deep.
        """
        began, meta = time.monotonic(), self.catalog.load(table)
        if has_deletes(self.spark, meta):
            raise DeletesPresent(str(table))
        job, sid = f"compact-{uuid.uuid4()}", new_snapshot_id(meta)
        inputs = [f for f, _ in candidate.files]
        entry = {"job_id": job, "owner": self.owner, "table": str(table), "input_files": inputs, "output_files": [], "parent_snapshot_id": meta.get("current-snapshot-id"), "new_snapshot_id": sid, "state": PENDING, "created_at": now.astimezone(timezone.utc).isoformat()}
        journal = self._journal(meta["location"], job, entry)
        try:
            paths = self._rewrite(candidate, policy, job)
        except Exception as e:
            self.store.delete(journal)
            if recoverable(e) and depth < MOST_SPLITS and len(inputs) > 1:
                mid = len(inputs) // 2
                halves = [Candidate(candidate.partition_dir, part) for part in (candidate.files[:mid], candidate.files[mid:])]
                return self.compact(table, halves[0], policy, now, depth + 1) + self.compact(table, halves[1], policy, now, depth + 1)
            raise
        outputs = self._files(paths)
        entry |= {"state": UPLOADED, "output_files": outputs}
        self._journal(meta["location"], job, entry)
        try:
            self._commit_replace(table, inputs, outputs, sid, now)
        except InputsGone:
            self.store.delete_all(paths)
            self.store.delete(journal)
            raise
        self._journal(meta["location"], job, entry | {"state": COMMITTED})
        if self.eager_delete:
            self.store.delete_all(inputs)
        self.store.delete(journal)
        return CompactionResult(inputs, paths, sum(n for _, n in candidate.files), sum(f["file_size_in_bytes"] for f in outputs), time.monotonic() - began)

    def recover(self, table: TableId, now: datetime) -> dict[str, str]:
        """Finishes or drops jobs that broke off: job id -> what was done.

        A journal of another process, which may be at work still, is left alone until it is STALE_HOURS old.
        """
        location, done = self.catalog.load(table)["location"], {}
        fresh = (now - timedelta(hours=STALE_HOURS)).astimezone(timezone.utc).isoformat()
        for path, *_ in list(self.store.rows(f"{location.rstrip('/')}/{JOURNAL}")):
            if not path.endswith(".json"):
                continue
            e = json.loads(self.store.read(path))
            if e.get("owner") not in (None, self.owner) and e.get("created_at", "") > fresh:
                done[e["job_id"]] = "left"
                continue
            if e["state"] == PENDING:
                done[e["job_id"]] = "dropped"
            elif e["state"] == UPLOADED:
                try:
                    self._commit_replace(table, e["input_files"], e["output_files"], e["new_snapshot_id"], now)
                    done[e["job_id"]] = "committed"
                except InputsGone:
                    self.store.delete_all(f["file_path"] for f in e["output_files"])
                    done[e["job_id"]] = "inputs gone"
            elif e["state"] == COMMITTED:
                done[e["job_id"]] = "cleaned"
            else:
                done[e["job_id"]] = "left"
                continue
            if self.eager_delete and done[e["job_id"]] in ("committed", "cleaned"):
                self.store.delete_all(e["input_files"])
            self.store.delete(path)
        return done

    # Expiry

    def select_expired(self, meta: dict, policy: Policy, now: datetime, protect: str = "ancestors") -> list[int]:
        """Ids to expire, oldest first: never the current snapshot, nor (unless protect is "current") its ancestors."""
        p, snaps = policy.snapshot_expiry, meta.get("snapshots") or []
        if not enabled(p) or not snaps:
            return []
        parents = {s["snapshot-id"]: s.get("parent-snapshot-id") or 0 for s in snaps}
        current = meta.get("current-snapshot-id") or 0
        kept = set(expiry.ancestor_ids(parents, current)) if protect == "ancestors" else {current}
        cutoff = (now - timedelta(hours=p.max_snapshot_age_hours)).timestamp() * 1000
        free = sorted((s["timestamp-ms"], s["snapshot-id"]) for s in snaps if s["snapshot-id"] not in kept and s["timestamp-ms"] < cutoff)
        return [i for _, i in free[max(0, p.min_snapshots_to_keep - (len(snaps) - len(free))) :]]

    def garbage(self, before: dict, after: dict, ids: list[int]) -> tuple[list[str], DataFrame, DataFrame]:
        """Lists, manifests and data files that only the expired snapshots of before need; after holds what lives."""
        gone = TableFiles(self.spark, [s for s in before["snapshots"] if s["snapshot-id"] in set(ids)])
        live = TableFiles(self.spark, after.get("snapshots") or [])
        default = default_fs(self.spark)
        same = lambda df, name: df.select(F.col(name), plain(name, default).alias("p")).dropDuplicates(["p"])
        kept = {plain_path(s["manifest-list"], default) for s in live.snapshots if s.get("manifest-list")}
        lists = sorted({s["manifest-list"] for s in gone.snapshots if s.get("manifest-list") and plain_path(s["manifest-list"], default) not in kept})
        theirs = same(live.owners(), "manifest_path")
        manifests = same(gone.owners(), "manifest_path").join(theirs, "p", "left_anti").select("manifest_path")
        needed = same(live.entries(theirs), "file_path")
        return lists, manifests, same(gone.entries(manifests), "file_path").join(needed, "p", "left_anti").select("file_path")

    def expire(self, table: TableId, policy: Policy, now: datetime) -> ExpiryResult:
        """Removes expired snapshots, selected anew on each attempt, then the files that only they had."""
        state: dict = {}

        def once(_: int) -> list[int]:
            meta = state["before"] = self.catalog.load(table)
            ids = self.select_expired(meta, policy, now)
            if ids:
                self.catalog.commit(table, Transaction().current_is(meta.get("current-snapshot-id")).remove(ids))
            return ids

        ids = self._retried(once)
        if not ids:
            return ExpiryResult()
        try:
            lists, manifests, files = self.garbage(state["before"], self.catalog.load(table), ids)
            # Written before anything goes: what is read can't change under the plan, and needn't fit the driver.
            paths, data = materialize(manifests), materialize(files)
        except Exception as e:  # metadata that can't be read: nothing is deleted
            return ExpiryResult(ids, failed=[str(e)[:200]])
        n_data, bad = self.store.delete_all(r[0] for r in data.toLocalIterator())
        n_meta, worse = self.store.delete_all(chain(lists, (r[0] for r in paths.toLocalIterator())))
        return ExpiryResult(ids, n_meta, n_data, bad + worse)

    # Orphans

    def clean(self, table: TableId, policy: Policy, now: datetime) -> OrphanResult:
        """Deletes files under the table's folder that no snapshot needs and that are older than the grace period."""
        p = policy.orphan_cleanup
        if not enabled(p):
            return OrphanResult()
        meta = self.catalog.load(table)
        default = default_fs(self.spark)
        live = live_paths(self.spark, meta).select(plain("p", default).alias("p"))
        listing = self.store.listing(meta["location"]).filter(~F.contains("path", F.lit(f"/{JOURNAL}/"))).select(plain("path", default).alias("p"), "mtime", "path")
        marked = materialize(orphans.dispositions(listing, live, F.lit(now - timedelta(hours=p.grace_period_hours))))
        counts = {r.disposition: r["count"] for r in marked.groupBy("disposition").count().collect()}
        deleted, failed = self.store.delete_all(r.path for r in marked.filter("disposition = 'deleted'").select("path").toLocalIterator())
        return OrphanResult(sum(counts.values()), deleted, counts.get("skipped", 0), failed)


def as_json(result: CompactionResult | ExpiryResult | OrphanResult) -> str:
    return json.dumps(asdict(result))


__all__ = ["Candidate", "CompactionResult", "Conflict", "ExpiryResult", "InputsGone", "Maintainer", "MixedPartitions", "OrphanResult", "as_json"]
