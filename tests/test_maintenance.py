"""Whole tables in a local store: compaction, expiry, orphans, recovery, conflicts."""

import json
import os
from datetime import datetime, timedelta, timezone

import pytest

from icekeel.plans.config import DEFAULTS, Policy, Compaction, OrphanCleanup, Retry, SnapshotExpiry, merged
from icekeel.plans.maintenance import InputsGone, Maintainer
from icekeel.plans.retry import Conflict, OutOfMemory
from icekeel.plans.tables import DeletesPresent, append, current_files, write_list, write_manifest
from icekeel.sources import avro_ocf
from icekeel.sources.catalog import FileCatalog, TableId, Transaction, current_snapshot
from icekeel.sources.store import Store

NOW = datetime(2026, 1, 10, tzinfo=timezone.utc)
MS = int(NOW.timestamp() * 1000)
T = TableId("db", "events")
HOUR = 3_600_000


def policy(**kw) -> Policy:
    return merged(DEFAULTS, Policy(Compaction(True, min_file_count=2, **kw), SnapshotExpiry(True, 1, 24), OrphanCleanup(True, 24)))


@pytest.fixture
def world(spark, tmp_path):
    store = Store(spark)
    catalog = FileCatalog(store, f"file:{tmp_path}/lake")
    maintainer = Maintainer(spark, catalog, store, Retry(3, "0s", "1ms"), sleep=lambda s: None)
    location = f"file:{tmp_path}/lake/db/events"
    meta = {"format-version": 1, "table-uuid": "u", "location": location, "last-sequence-number": 0, "current-snapshot-id": None, "snapshots": [], "schemas": [{"kept": True}], "refs": {}}
    catalog.create(T, meta)
    return spark, store, catalog, maintainer, location


def add(world, rows, name, age_ms, folder="data/p=1"):
    """Appends a file of rows, committed age_ms before NOW."""
    spark, store, catalog, _, location = world
    path = f"{location}/{folder}/{name}.parquet"
    staged = f"{location}/{folder}/_{name}"
    spark.createDataFrame(rows, "id long, v string").coalesce(1).write.parquet(staged)
    part = next(p for p, *_ in store.rows(staged) if p.endswith(".parquet"))
    store.rename(part, path)
    store.delete(staged, True)
    meta = catalog.load(T)
    file = {"content": 0, "file_path": path, "file_format": "PARQUET", "record_count": len(rows), "file_size_in_bytes": store.size(path)}
    catalog.commit(T, Transaction().current_is(meta["current-snapshot-id"]).add(append(store, meta, [file], MS - age_ms)))
    return path


def table_rows(world):
    spark, _, catalog, *_ = world
    paths = [r.file_path for r in current_files(spark, catalog.load(T)).collect()]
    return sorted((r.id, r.v) for r in spark.read.parquet(*paths).collect()), paths


def test_compaction_keeps_all_else(world):
    _, store, catalog, m, location = world
    a, b = add(world, [(1, "a"), (2, None)], "a", 5 * HOUR), add(world, [(3, "c")], "b", 4 * HOUR)
    young, other = add(world, [(4, "d")], "young", 60_000), add(world, [(5, "e")], "other", 3 * HOUR, "data/p=2")
    (c,) = m.find_candidates(T, policy(), NOW)
    assert c.partition_dir.endswith("data/p=1") and [f for f, _ in c.files] == sorted([a, b])
    r = m.compact(T, c, policy(), NOW)
    rows, paths = table_rows(world)
    assert rows == [(1, "a"), (2, None), (3, "c"), (4, "d"), (5, "e")]
    assert {young, other} < set(paths) and len(paths) == 3 and r.bytes_after > 0 and len(r.outputs) == 1
    meta = catalog.load(T)
    assert meta["schemas"] == [{"kept": True}] and meta["refs"]["main"]["snapshot-id"] == meta["current-snapshot-id"]
    assert store.exists(a) and not list(store.rows(f"{location}/.icekeel"))
    snap = current_snapshot(meta)
    assert snap["summary"] == {"operation": "replace"} and snap["sequence-number"] == 5
    lists = list(avro_ocf.decode(store.read(snap["manifest-list"])))
    assert sum(x["added_rows_count"] for x in lists if x["added_snapshot_id"] == snap["snapshot-id"]) == 3


def test_sort_strategy_and_checks(world):
    spark, *_, m, _ = world
    add(world, [(3, "c"), (1, None)], "a", 5 * HOUR)
    add(world, [(2, "b")], "b", 5 * HOUR)
    for bad in ({"strategy": "sort"}, {"strategy": "z-order"}, {"strategy": "best"}, {"strategy": "sort", "sort_keys": ("id DESC",)}):
        with pytest.raises(ValueError):
            m.find_candidates(TableId("no", "table"), policy(**bad), NOW)
    p = policy(strategy="sort", sort_keys=("v", "id"))
    r = m.compact(T, m.find_candidates(T, p, NOW)[0], p, NOW)
    assert [x.id for x in spark.read.parquet(r.outputs[0]).collect()] == [2, 3, 1]


def test_conflicts_and_vanished_inputs(world, monkeypatch):
    _, _, catalog, m, _ = world
    add(world, [(1, "a")], "a", 5 * HOUR)
    add(world, [(2, "b")], "b", 5 * HOUR)
    (c,) = m.find_candidates(T, policy(), NOW)
    commit, calls = catalog.commit, []

    def racing(table, tx):
        calls.append(1)
        if len(calls) == 1:  # another writer appends first
            monkeypatch.setattr(catalog, "commit", commit)
            add(world, [(3, "late")], "late", 0)
            monkeypatch.setattr(catalog, "commit", racing)
        commit(table, tx)

    monkeypatch.setattr(catalog, "commit", racing)
    m.compact(T, c, policy(), NOW)
    assert len(calls) == 2 and table_rows(world)[0] == [(1, "a"), (2, "b"), (3, "late")]
    monkeypatch.setattr(catalog, "commit", commit)
    with pytest.raises(InputsGone):
        m.compact(T, c, policy(), NOW)
    assert table_rows(world)[0] == [(1, "a"), (2, "b"), (3, "late")]
    monkeypatch.setattr(catalog, "commit", lambda *_: (_ for _ in ()).throw(Conflict("always")))
    add_only = Maintainer(m.spark, catalog, m.store, Retry(3, "0s", "1ms"), sleep=lambda s: None)
    with pytest.raises(Conflict):
        add_only._commit_replace(T, [], [], 77, NOW)


def test_starved_job_is_halved(world, monkeypatch):
    *_, m, _ = world
    for k in range(4):
        add(world, [(k, "x")], f"f{k}", 5 * HOUR)
    (c,) = m.find_candidates(T, policy(), NOW)
    whole, seen = m._rewrite, []

    def rewrite(candidate, *args):
        seen.append(len(candidate.files))
        if len(candidate.files) > 2:
            raise OutOfMemory("too large")
        return whole(candidate, *args)

    monkeypatch.setattr(m, "_rewrite", rewrite)
    r = m.compact(T, c, policy(), NOW)
    assert seen == [4, 2, 2] and len(r.inputs) == 4 and len(r.outputs) == 2
    assert table_rows(world)[0] == [(k, "x") for k in range(4)]


def test_recovery_of_each_state(world):
    _, store, catalog, m, location = world
    a, b = add(world, [(1, "a")], "a", 5 * HOUR), add(world, [(2, "b")], "b", 5 * HOUR)
    (c,) = m.find_candidates(T, policy(), NOW)
    out = m._files(m._rewrite(c, policy(), "compact-x"))
    base = {"table": str(T), "input_files": [a, b], "output_files": out, "new_snapshot_id": 99}
    for job, state in (("p", "pending"), ("u", "uploaded"), ("z", "odd")):
        m._journal(location, job, base | {"job_id": job, "state": state})
    assert m.recover(T, NOW) == {"p": "dropped", "u": "committed", "z": "left"}
    assert catalog.load(T)["current-snapshot-id"] == 99 and table_rows(world)[0] == [(1, "a"), (2, "b")]
    m._journal(location, "again", base | {"job_id": "again", "state": "uploaded"})
    m._journal(location, "done", base | {"job_id": "done", "state": "snapshot_committed"})
    m._journal(location, "stale", base | {"job_id": "stale", "state": "uploaded", "new_snapshot_id": 98, "output_files": []})
    assert m.recover(T, NOW) == {"again": "committed", "done": "cleaned", "stale": "inputs gone", "z": "left"}
    assert table_rows(world)[0] == [(1, "a"), (2, "b")]


def test_deletes_are_refused(world):
    spark, store, catalog, m, location = world
    add(world, [(1, "a")], "a", 5 * HOUR)
    add(world, [(2, "b")], "b", 5 * HOUR)
    meta = catalog.load(T)
    lists = list(avro_ocf.decode(store.read(current_snapshot(meta)["manifest-list"])))
    d = write_manifest(store, location, [{"status": 1, "snapshot_id": 5, "data_file": {"content": 1, "file_path": f"{location}/data/del.parquet", "file_format": "PARQUET", "record_count": 1, "file_size_in_bytes": 1}}], 3, 5)
    snap = {"snapshot-id": 5, "parent-snapshot-id": meta["current-snapshot-id"], "sequence-number": 3, "timestamp-ms": MS, "manifest-list": write_list(store, location, [*lists, d | {"content": 1}], 5), "summary": {}}
    catalog.commit(T, Transaction().add(snap))
    (c,) = m.find_candidates(T, policy(), NOW)
    with pytest.raises(DeletesPresent):
        m.compact(T, c, policy(), NOW)


@pytest.mark.parametrize(
    ("parents", "current", "ages", "keep", "want"),
    [
        ({1: 0, 2: 1, 3: 2}, 3, {1: 90, 2: 80, 3: 70}, 1, []),
        ({1: 0, 2: 0, 3: 0}, 3, {1: 90, 2: 80, 3: 1}, 1, [1, 2]),
        ({1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}, 6, {1: 90, 2: 80, 3: 70, 4: 60, 5: 2, 6: 1}, 5, [4]),
        ({1: 0, 2: 0}, 2, {1: 24, 2: 1}, 1, []),
        ({1: 0, 2: 0}, 2, {1: 90, 2: 1}, 2, []),
        ({1: 2, 2: 1, 3: 0}, 1, {1: 90, 2: 90, 3: 90}, 1, [3]),
        ({}, 0, {}, 1, []),
    ],
)
def test_select_expired(spark, parents, current, ages, keep, want):
    m = Maintainer(spark, None, None)
    meta = {"current-snapshot-id": current, "snapshots": [{"snapshot-id": i, "parent-snapshot-id": p, "timestamp-ms": MS - ages[i] * HOUR} for i, p in parents.items()]}
    p = merged(DEFAULTS, Policy(snapshot_expiry=SnapshotExpiry(True, keep, 24)))
    assert m.select_expired(meta, p, NOW) == want
    assert m.select_expired(meta, DEFAULTS, NOW) == []


def test_deep_ancestry_has_no_limit():
    from icekeel.operators.expiry import ancestor_ids

    assert len(ancestor_ids({i: i - 1 for i in range(1, 5001)}, 5000)) == 5000


def test_expiry_and_garbage(world):
    _, store, catalog, m, location = world
    a = add(world, [(1, "a")], "a", 100 * HOUR)
    meta = catalog.load(T)
    side_file = f"{location}/data/p=1/side.parquet"
    store.write(side_file, b"x")
    side = append(store, meta, [{"content": 0, "file_path": side_file, "file_format": "PARQUET", "record_count": 1, "file_size_in_bytes": 1}], MS - 90 * HOUR)
    catalog.commit(T, Transaction([], [{"action": "add-snapshot", "snapshot": side}]))
    add(world, [(2, "b")], "b", HOUR)
    r = m.expire(T, policy(), NOW)
    assert (r.expired, r.deleted_data_files, r.deleted_manifests, r.failed) == ([side["snapshot-id"]], 1, 2, [])
    assert not store.exists(side_file) and not store.exists(side["manifest-list"]) and store.exists(a)
    assert table_rows(world)[0] == [(1, "a"), (2, "b")]
    assert m.expire(T, policy(), NOW).expired == []


def test_orphans(world, tmp_path):
    _, store, catalog, m, location = world
    live = add(world, [(1, "a")], "a", 100 * HOUR)
    old, new, hidden, doc = (f"{location}/data/{n}" for n in ("old.parquet", "new.parquet", "_x/.y", "old.json"))
    sibling = f"{location}_v2/data/z.parquet"
    for path, hours in ((old, 48), (new, 1), (hidden, 48), (doc, 200), (sibling, 99)):
        store.write(path, b"x")
        t = NOW.timestamp() - hours * 3600
        os.utime(path.removeprefix("file:"), (t, t))
    for path, *_ in list(store.rows(location)):
        if path.replace("file:///", "file:/") not in (new,):
            t = NOW.timestamp() - 48 * 3600
            os.utime(path.removeprefix("file:"), (t, t))
    r = m.clean(T, policy(), NOW)
    assert not store.exists(old) and not store.exists(hidden)
    assert all(map(store.exists, (live, new, doc, sibling))) and r.skipped == 1 and not r.failed
    assert table_rows(world)[0] == [(1, "a")]
    snap = current_snapshot(catalog.load(T))
    store.delete(snap["manifest-list"])
    store.write(old, b"x")
    with pytest.raises(Exception):  # noqa: B017
        m.clean(T, policy(), NOW + timedelta(days=9))
    assert store.exists(old)
    json.dumps(r.__dict__)


#: A manifest as other writers of version 2 make it: partition, sequence numbers and metrics, by id and named types.
RICH = {
    "type": "record", "name": "manifest_entry", "fields": [
        {"name": "status", "type": "int", "field-id": 0}, {"name": "snapshot_id", "type": ["null", "long"], "default": None, "field-id": 1},
        {"name": "sequence_number", "type": ["null", "long"], "default": None, "field-id": 3}, {"name": "file_sequence_number", "type": ["null", "long"], "default": None, "field-id": 4},
        {"name": "data_file", "field-id": 2, "type": {"type": "record", "name": "r2", "fields": [
            {"name": "content", "type": "int", "field-id": 134}, {"name": "file_path", "type": "string", "field-id": 100}, {"name": "file_format", "type": "string", "field-id": 101},
            {"name": "partition", "field-id": 102, "type": {"type": "record", "name": "r102", "fields": [{"name": "p", "type": ["null", "int"], "default": None, "field-id": 1000}]}},
            {"name": "record_count", "type": "long", "field-id": 103}, {"name": "file_size_in_bytes", "type": "long", "field-id": 104},
            {"name": "lower_bounds", "field-id": 125, "default": None, "type": ["null", {"type": "array", "logicalType": "map", "items": {"type": "record", "name": "k126_v127", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "bytes"}]}}]},
            {"name": "key_metadata", "type": ["null", "bytes"], "default": None, "field-id": 131}, {"name": "block_size", "type": "long", "field-id": 105},
        ]}},
    ],
}
RICH_LIST = avro_ocf.LIST_SCHEMA | {"fields": [*avro_ocf.LIST_SCHEMA["fields"], {"name": "key_metadata", "type": ["null", "bytes"], "default": None, "field-id": 519}]}


def rich_table(world, parts):
    """A snapshot with one manifest of files (name, partition) whose entries hold more than jobs know."""
    spark, store, catalog, _, location = world
    entries = []
    for k, (name, p) in enumerate(parts):
        path = f"{location}/data/p={p}/{name}.parquet"
        spark.createDataFrame([(k, name)], "id long, v string").coalesce(1).write.parquet(f"{path}_")
        store.rename(next(x for x, *_ in store.rows(f"{path}_") if x.endswith(".parquet")), path)
        file = {"content": 0, "file_path": path, "file_format": "PARQUET", "partition": {"p": p}, "record_count": 1, "file_size_in_bytes": store.size(path), "lower_bounds": [{"key": 1, "value": bytes([k])}], "key_metadata": b"km", "block_size": 7}
        entries.append({"status": 1, "snapshot_id": None, "sequence_number": None, "file_sequence_number": None, "data_file": file})
    raw = avro_ocf.encode(RICH, entries, meta={"partition-spec-id": "3", "format-version": "2", "content": "data"})
    at = f"{location}/metadata/rich.avro"
    store.write(at, raw)
    row = {"manifest_path": at, "manifest_length": len(raw), "partition_spec_id": 3, "content": 0, "sequence_number": 9, "min_sequence_number": 9, "added_snapshot_id": 1, "key_metadata": b"list"} | {f["name"]: 0 for f in avro_ocf.LIST_SCHEMA["fields"][7:]}
    other = row | {"manifest_path": f"{location}/metadata/other.avro", "key_metadata": b"kept"}
    store.write(other["manifest_path"], avro_ocf.encode(RICH, [entries[0] | {"data_file": entries[0]["data_file"] | {"file_path": f"{location}/data/p=9/elsewhere.parquet"}}], meta={"format-version": "2"}))
    store.write(f"{location}/metadata/l.avro", avro_ocf.encode(RICH_LIST, [row, other], meta={"format-version": "2", "snapshot-id": "1"}))
    snap = {"snapshot-id": 1, "sequence-number": 9, "timestamp-ms": MS - 5 * HOUR, "manifest-list": f"{location}/metadata/l.avro", "summary": {}}
    catalog.commit(T, Transaction().add(snap))
    return [e["data_file"] for e in entries]


def test_rewritten_manifests_keep_what_they_hold(world):
    _, store, catalog, m, location = world
    files = rich_table(world, [("a", 1), ("b", 1), ("c", 2)])
    (c,) = m.find_candidates(T, policy(), NOW)
    r = m.compact(T, c, policy(), NOW)
    listed = avro_ocf.container(store.read(current_snapshot(catalog.load(T))["manifest-list"]))
    rows = list(listed.rows)
    assert listed.meta["format-version"] == b"2" and [x["partition_spec_id"] for x in rows] == [3, 3, 3]
    assert [x["key_metadata"] for x in rows if x["manifest_path"].endswith("other.avro")] == [b"kept"]
    held = {}
    for x in rows:
        opened = avro_ocf.container(store.read(x["manifest_path"]))
        assert opened.schema == RICH
        held |= {e["data_file"]["file_path"]: (e, x) for e in opened.rows}
    entry, row = held[files[2]["file_path"]]
    assert entry == {"status": 0, "snapshot_id": 1, "sequence_number": 9, "file_sequence_number": 9, "data_file": files[2]} and row["min_sequence_number"] == 9 and row["existing_rows_count"] == 1
    entry, row = held[r.outputs[0]]
    assert entry["status"] == 1 and entry["sequence_number"] is None and entry["data_file"]["partition"] == {"p": 1} and entry["data_file"]["record_count"] == 2 and row["sequence_number"] == 10
    assert not {files[0]["file_path"], files[1]["file_path"]} & set(held)


def test_files_of_several_partitions_are_not_merged(world):
    _, store, catalog, m, location = world
    files = rich_table(world, [("a", 1), ("b", 2)])
    sizes = [(f["file_path"], f["file_size_in_bytes"]) for f in files]
    from icekeel.plans.maintenance import Candidate, MixedPartitions

    with pytest.raises(MixedPartitions):
        m.compact(T, Candidate(f"{location}/data/p=1", sizes), policy(), NOW)
    assert catalog.load(T)["current-snapshot-id"] == 1 and not [p for p, *_ in store.rows(f"{location}/data") if "compact-" in p]


def test_files_follow_their_bins(world):
    spark, store, *_, m, location = world
    for k in range(6):
        add(world, [(10 * k + j, "x" * 50) for j in range(10)], f"f{k}", 5 * HOUR)
    (c,) = m.find_candidates(T, policy(), NOW)
    from icekeel.plans.maintenance import Candidate

    sized = Candidate(c.partition_dir, [(f, 1 << 19) for f, _ in c.files])  # as if two made up a megabyte
    r = m.compact(T, sized, policy(target_file_size_mb=1), NOW)
    assert sorted(sorted({x.id // 20 for x in spark.read.parquet(p).collect()}) for p in r.outputs) == [[0], [1], [2]]
    assert len(table_rows(world)[0]) == 60


def test_memory_limit_makes_more_files(world):
    spark, *_, m, _ = world
    for k in range(4):
        add(world, [(j, "y") for j in range(k, 400, 4)], f"f{k}", 5 * HOUR)
    p = policy(strategy="sort", sort_keys=("id",))
    (c,) = m.find_candidates(T, p, NOW)
    m.memory_limit = sum(n for _, n in c.files)
    r = m.compact(T, c, p, NOW)
    assert len(r.outputs) == 4 and table_rows(world)[0] == [(k, "y") for k in range(400)]


def test_journals_of_other_processes_wait(world):
    _, store, _, m, location = world
    add(world, [(1, "a")], "a", HOUR)
    for job, hours in (("young", 1), ("old", 48)):
        m._journal(location, job, {"job_id": job, "owner": "another", "state": "pending", "created_at": (NOW - timedelta(hours=hours)).isoformat(), "input_files": [], "output_files": []})
    assert m.recover(T, NOW) == {"old": "dropped", "young": "left"}
    assert m.recover(T, NOW + timedelta(days=2)) == {"young": "dropped"}


def test_paths_written_in_other_ways_are_the_same(world, tmp_path):
    """A table whose metadata leaves out the scheme, or writes it with an empty authority, loses no live file."""
    _, store, catalog, m, location = world
    a, b = add(world, [(1, "a")], "a", 90 * HOUR), add(world, [(2, "b")], "b", 80 * HOUR)
    snap = current_snapshot(catalog.load(T))
    entry = lambda path: {"content": 0, "file_path": path, "file_format": "PARQUET", "record_count": 1, "file_size_in_bytes": 1}
    side = append(store, catalog.load(T), [entry(a.removeprefix("file:")), entry(b.replace("file:/", "file:///"))], MS - 95 * HOUR)
    catalog.commit(T, Transaction([], [{"action": "add-snapshot", "snapshot": side}]))
    assert m.expire(T, policy(), NOW).deleted_data_files == 0 and store.exists(a) and store.exists(b)
    meta = catalog.load(T)
    bare = meta | {"location": location.removeprefix("file:"), "snapshots": [s | {"manifest-list": s["manifest-list"].removeprefix("file:")} for s in meta["snapshots"]]}
    catalog.load = lambda table: bare
    m.clean(T, policy(), NOW + timedelta(days=3000))
    assert store.exists(a) and store.exists(b) and store.exists(snap["manifest-list"])
