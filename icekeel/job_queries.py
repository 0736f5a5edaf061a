"""Registered queries that write small tables of the format and run sources, catalogs and jobs over them.

Orders are the rows of a table "db.orders" with a data file for each status and each of SLICES slices of customers, a
snapshot for each slice. Each query has its table to itself in the shared folder; moments are fixed.
"""

from __future__ import annotations

import json
import re
import urllib.parse
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icekeel.functions.paths import basename, identifier_like, memory_bytes
from icekeel.operators import compaction
from icekeel.plans.config import Compaction, DEFAULTS, Config, OrphanCleanup, Policy, SnapshotExpiry, merged, parse, policy_for
from icekeel.plans.maintenance import Maintainer
from icekeel.plans.metrics import Registry
from icekeel.plans.retry import Conflict
from icekeel.plans.scheduler import Scheduler
from icekeel.plans.tables import append, current_files, live_paths, write_list, write_manifest
from icekeel.queries import ORACLE, QUERIES, query, table
from icekeel.sources import avro_ocf, parquet
from icekeel.sources.catalog import FileCatalog, GlueCatalog, RestCatalog, TableId, Transaction, apply_updates
from icekeel.sources.scratch import shared_dir
from icekeel.sources.store import Store

SLICES = 6
BASE = datetime(2025, 1, 1, tzinfo=timezone.utc)
NOW = datetime(2025, 3, 1, tzinfo=timezone.utc)
LATER = datetime(2100, 1, 1, tzinfo=timezone.utc)
TABLE = TableId("db", "orders")
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
POLICY = merged(DEFAULTS, Policy(Compaction(True, min_file_count=2), SnapshotExpiry(True, 1, 24), OrphanCleanup(True, 24)))


def _ms(moment: datetime) -> int:
    return int(moment.timestamp() * 1000)


def _lake(spark: SparkSession) -> tuple[Maintainer, str]:
    store, root = Store(spark), shared_dir(spark, "lake")
    catalog, location = FileCatalog(store, root), f"{root}/db/orders"
    catalog.create(TABLE, {"format-version": 1, "location": location, "last-sequence-number": 0, "current-snapshot-id": None, "snapshots": []})
    return Maintainer(spark, catalog, store, sleep=lambda s: None), location


def _orders(spark: SparkSession, sf_dir: str) -> tuple[Maintainer, str]:
    """The table as the module says; slice k is committed k hours after BASE."""
    m, location = _lake(spark)
    staged = f"{location}/staged"
    rows = table(spark, sf_dir, "orders").select(*COLUMNS, F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % SLICES).alias("slice"))
    rows.repartition("status", "slice").write.partitionBy("status", "slice").parquet(staged)
    counts = {(r.status, r.slice): r["count"] for r in rows.groupBy("status", "slice").count().collect()}  # a row for each file
    files: dict[int, list[dict]] = {}
    for path, size, _ in sorted(m.store.rows(staged)):
        if path.endswith(".parquet"):
            status, part = (x.partition("=")[2] for x in path.split("/")[-3:-1])
            to = f"{location}/data/status={status}/slice-{part}.parquet"
            m.store.rename(path, to)
            files.setdefault(int(part), []).append({"content": 0, "file_path": to, "file_format": "PARQUET", "record_count": counts[status, int(part)], "file_size_in_bytes": size})
    m.store.delete(staged, True)
    for part in sorted(files):
        meta = m.catalog.load(TABLE)
        m.catalog.commit(TABLE, Transaction().current_is(meta["current-snapshot-id"]).add(append(m.store, meta, files[part], _ms(BASE + timedelta(hours=part)))))
    return m, location


def _rows(m: Maintainer) -> DataFrame:
    """All rows of the table as its current snapshot has them."""
    paths = [r.file_path for r in current_files(m.spark, m.catalog.load(TABLE)).select("file_path").collect()]
    return parquet.read_by_name(m.spark, paths).select(*COLUMNS)


SLICED = f"s AS (SELECT o_orderstatus AS status, o_custkey % {SLICES} AS slice, count(*) AS n FROM orders GROUP BY 1, 2)"
ALL_ROWS = f"SELECT {', '.join(COLUMNS)} FROM orders"


@query("SELECT 'm' || CAST(o_custkey % 40 AS VARCHAR) AS manifest_path, CASE WHEN o_custkey % 40 < 4 THEN 1 ELSE 0 END AS content, CAST(count(*) AS INT) AS added_files_count, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS added_rows_count, CAST(o_custkey % 40 AS BIGINT) + 1 AS added_snapshot_id FROM orders GROUP BY o_custkey % 40")
def avro_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest list, written as Avro and scanned, delete manifests too."""
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("k")).agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice")).alias("size")).collect()  # 40 rows
    listed = [{"manifest_path": f"m{r.k}", "content": int(r.k < 4), "added_files_count": r.n, "added_rows_count": r["size"], "added_snapshot_id": r.k + 1} for r in rows]
    at = write_list(Store(spark), shared_dir(spark, "avro"), listed, 1)
    return avro_ocf.manifest_lists(spark, [at]).select("manifest_path", "content", "added_files_count", "added_rows_count", "added_snapshot_id")


ENTRIES = """e AS (SELECT o_custkey % 40 AS m, o_orderkey % 50 AS j, count(*) AS record_count, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS file_size_in_bytes FROM orders GROUP BY 1, 2)"""


@query(f"WITH {ENTRIES} SELECT 'f' || CAST(m AS VARCHAR) || '-' || CAST(j AS VARCHAR) AS file_path, CASE WHEN j % 10 < 4 THEN 1 ELSE 0 END AS status, CASE WHEN j % 11 <> 0 THEN j END AS snapshot_id, CASE WHEN j % 13 = 0 THEN 1 ELSE 0 END AS content, record_count, file_size_in_bytes FROM e WHERE j % 10 <> 0")
def avro_manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty manifests, written as Avro and scanned: their live entries."""
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("m"), (F.col("o_orderkey") % 50).alias("j")).agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice")).alias("size")).collect()  # 2000 rows
    store, at, by = Store(spark), shared_dir(spark, "avro"), {}
    for r in rows:
        file = {"content": int(r.j % 13 == 0), "file_path": f"f{r.m}-{r.j}", "file_format": "PARQUET", "record_count": r.n, "file_size_in_bytes": r["size"]}
        by.setdefault(r.m, []).append({"status": 2 if r.j % 10 == 0 else int(r.j % 10 < 4), "snapshot_id": r.j if r.j % 11 else None, "data_file": file})
    paths = [write_manifest(store, at, own, 1, 1)["manifest_path"] for own in by.values()]
    return avro_ocf.manifests(spark, spark.createDataFrame([(p,) for p in paths], "p string") if paths else []).select("data_file.file_path", "status", "snapshot_id", "data_file.content", "data_file.record_count", "data_file.file_size_in_bytes")


@query(f"WITH {SLICED} SELECT 'status=' || status AS folder, 'slice-' || CAST(slice AS VARCHAR) || '.parquet' AS file, n AS record_count, TIMESTAMP '2025-01-01 00:00:00' + slice * INTERVAL 1 HOUR AS added_at FROM s")
def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data files of the current snapshot with the time of the snapshot that added them."""
    m, _ = _orders(spark, sf_dir)
    files = current_files(spark, m.catalog.load(TABLE))
    return files.select(F.element_at(F.split("file_path", "/"), -2).alias("folder"), basename("file_path").alias("file"), "record_count", F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp("added_at", F.current_timezone()), "yyyy-MM-dd HH:mm:ss")).alias("added_at"))


@query(f"WITH {SLICED} SELECT 'data' AS kind, count(*) AS n FROM s UNION ALL SELECT 'list', count(DISTINCT slice) FROM s UNION ALL SELECT 'manifest', count(DISTINCT slice) FROM s")
def live_paths_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many data files, lists and manifests any snapshot of a real table needs."""
    m, _ = _orders(spark, sf_dir)
    kind = F.when(basename("p").startswith("snap-"), "list").when(F.endswith("p", F.lit(".avro")), "manifest").otherwise("data")
    return live_paths(spark, m.catalog.load(TABLE)).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {SLICED} SELECT 'status=' || status AS folder, 'slice-' || CAST(slice AS VARCHAR) || '.parquet' AS file FROM s")
def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, location = _orders(spark, sf_dir)
    return m.store.listing(f"{location}/data").filter("length > 0 and path like '%.parquet'").select(F.element_at(F.split("path", "/"), -2).alias("folder"), basename("path").alias("file"))


@query(ALL_ROWS)
def compaction_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a table after its folders have been compacted and committed."""
    m, _ = _orders(spark, sf_dir)
    for candidate in m.candidates(TABLE, POLICY, NOW):
        m.compact(TABLE, candidate, POLICY, NOW)
    return _rows(m)


@query(f"WITH {SLICED} SELECT 'status=' || status AS folder, CAST(count(*) AS BIGINT) AS files_before, CAST(1 AS BIGINT) AS files_after, CAST(sum(n) AS BIGINT) AS n_rows FROM s GROUP BY status HAVING count(*) >= 2")
def compaction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every folder before and after its compaction, and the rows that metadata count then."""
    m, _ = _orders(spark, sf_dir)
    done = [(c.partition_dir, m.compact(TABLE, c, POLICY, NOW)) for c in m.candidates(TABLE, POLICY, NOW)]
    before = spark.createDataFrame([(d.rpartition("/")[2], len(r.inputs)) for d, r in done], "folder string, files_before long")
    files = current_files(spark, m.catalog.load(TABLE)).withColumn("folder", F.element_at(F.split("file_path", "/"), -2))
    return files.groupBy("folder").agg(F.count("*").alias("files_after"), F.sum("record_count").alias("n_rows")).join(before, "folder")


@query("SELECT o_orderstatus AS status, count(*) AS n_rows, CAST(3 AS BIGINT) AS n_files, CAST(0 AS BIGINT) AS inversions, CAST(0 AS BIGINT) AS overlaps FROM orders GROUP BY 1")
def sort_job_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order inside and between the three files that a sorted compaction writes for each status."""
    m, _ = _orders(spark, sf_dir)
    policy = merged(POLICY, Policy(Compaction(strategy="sort", sort_keys=("o_totalprice", "o_orderkey"))))
    out = None
    for c in m.candidates(TABLE, policy, NOW):
        m.memory_limit = -(-sum(n for _, n in c.files) * 4 // 3)  # three files, that a task sorts less than this
        part = compaction.layout(spark.read.parquet(*m.compact(TABLE, c, policy, NOW).outputs), ["o_totalprice", "o_orderkey"]).select(F.lit(c.partition_dir.rpartition("=")[2]).alias("status"), "*")
        out = part if out is None else out.union(part)
    return out


@query(f"WITH {SLICED} SELECT 'data files deleted' AS what, CAST(count(DISTINCT status) AS BIGINT) AS n FROM s UNION ALL SELECT 'expired', 2 UNION ALL SELECT 'lists and manifests deleted', 4 UNION ALL SELECT 'rows', count(*) FROM orders UNION ALL SELECT 'snapshots', count(DISTINCT slice) FROM s")
def expiry_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots beside the main line expire: one of files that only it has, one that adds none."""
    m, location = _orders(spark, sf_dir)
    meta = m.catalog.load(TABLE)
    statuses = sorted({r.s for r in current_files(spark, meta).select(F.element_at(F.split("file_path", "/"), -2).alias("s")).distinct().collect()})
    own = []
    for s in statuses:
        path = f"{location}/data/{s}/side.parquet"
        m.store.write(path, b"only the side branch needs this")
        own.append({"content": 0, "file_path": path, "file_format": "PARQUET", "record_count": 1, "file_size_in_bytes": 1})
    for files in (own, []):
        m.catalog.commit(TABLE, Transaction([], [{"action": "add-snapshot", "snapshot": append(m.store, meta, files, _ms(BASE))}]))
    r = m.expire(TABLE, POLICY, NOW)
    left = [x for s in statuses for x in [m.store.exists(f"{location}/data/{s}/side.parquet")] if x]
    counts = [("expired", len(r.expired)), ("data files deleted", r.deleted_data_files - len(left)), ("lists and manifests deleted", r.deleted_manifests), ("snapshots", len(m.catalog.load(TABLE)["snapshots"])), ("rows", _rows(m).count())]
    return spark.createDataFrame(counts, "what string, n long")


@query(f"WITH {SLICED} SELECT 'keep-' || r_name || '.json' AS file FROM region UNION ALL SELECT 'status=' || status || '/slice-' || CAST(slice AS VARCHAR) || '.parquet' FROM s")
def orphan_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean-up leaves of a table's data folder, into which files were put that no snapshot needs."""
    m, location = _orders(spark, sf_dir)
    for r in table(spark, sf_dir, "region").collect():  # a handful of rows
        for name in (f"keep-{r.r_name}.json", f"{r.r_name}.parquet", f"_hidden/.{r.r_name}"):
            m.store.write(f"{location}/data/{name}", b"x")
    m.clean(TABLE, POLICY, LATER)
    found = m.store.listing(f"{location}/data").filter("path not like '%.crc'")
    return found.select(F.regexp_replace("path", "^.*/data/", "").alias("file"))


@query(ALL_ROWS)
def recovery_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows after a job that had written its files, but not committed them, has been finished by recovery."""
    m, location = _orders(spark, sf_dir)
    for k, c in enumerate(m.candidates(TABLE, POLICY, NOW)):
        outputs = m._files(m._rewrite(c, POLICY, f"broken-{k}"))
        m._journal(location, f"j{k}", {"job_id": f"j{k}", "table": str(TABLE), "input_files": [f for f, _ in c.files], "output_files": outputs, "new_snapshot_id": 1000 + k, "state": "uploaded"})
    m.recover(TABLE, NOW)
    m.recover(TABLE, NOW)
    return _rows(m)


@query(f"WITH {SLICED} SELECT 'db.orders' AS tbl, CAST(count(DISTINCT status) AS BIGINT) AS jobs, CAST(count(*) AS BIGINT) AS files_merged, CAST(0 AS BIGINT) AS errors FROM s")
def cycle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cycle over all tables of a catalog reports of its compactions."""
    m, _ = _orders(spark, sf_dir)
    status = Scheduler(Config(defaults=POLICY), m, clock=lambda: NOW).cycle()
    return spark.createDataFrame([(t["table"], t["compaction"]["jobs"], t["compaction"]["files_merged"], t["compaction"]["errors"]) for t in status["tables"]], "tbl string, jobs long, files_merged long, errors long")


@query("SELECT lower(r_name) AS namespace, lower(n_name) AS name, CAST(n_nationkey AS BIGINT) AS last_sequence FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces, their tables, and the metadata of each, from a catalog in a store."""
    catalog = FileCatalog(Store(spark), shared_dir(spark, "catalog"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect()  # a handful of rows
    for r in nations:
        catalog.create(TableId(r.r_name.lower(), r.n_name.lower()), {"location": "x", "last-sequence-number": 0, "snapshots": []})
        if r.n_nationkey:
            catalog.commit(TableId(r.r_name.lower(), r.n_name.lower()), Transaction([], [{"action": "add-snapshot", "snapshot": {"snapshot-id": 1, "sequence-number": r.n_nationkey}}]))
    found = [(t.namespace, t.name, catalog.load(t)["last-sequence-number"]) for n in catalog.namespaces() for t in catalog.tables(n)]
    return spark.createDataFrame(found, "namespace string, name string, last_sequence long")


@query("""WITH ns AS (SELECT r_regionkey AS rk, CASE WHEN r_regionkey % 2 = 0 THEN 0 ELSE 8 END AS mfc, CASE WHEN r_regionkey = 1 THEN false END AS en FROM region WHERE r_regionkey < 3),
 tb AS (SELECT n_nationkey AS nk, CASE WHEN n_nationkey % 4 = 0 THEN 12 ELSE 0 END AS mfc, CASE WHEN n_nationkey % 6 = 0 THEN false END AS en FROM nation WHERE n_nationkey % 2 = 0)
 SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '.' || 'n' || CAST(n_nationkey AS VARCHAR) AS tbl, CAST(coalesce(CASE WHEN tb.nk IS NOT NULL THEN nullif(tb.mfc, 0) ELSE nullif(ns.mfc, 0) END, 5) AS BIGINT) AS min_file_count, coalesce(CASE WHEN tb.nk IS NOT NULL THEN tb.en ELSE ns.en END, true) AS enabled
 FROM nation n LEFT JOIN tb ON n.n_nationkey = tb.nk LEFT JOIN ns ON n.n_regionkey = ns.rk""")
def policy_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policies that a configuration (written as JSON, which YAML holds) gives to every table."""
    part = lambda mfc, off: {"compaction": {"min_file_count": mfc} | ({"enabled": False} if off else {})}
    spaces = {f"r{r.r_regionkey}": part(0 if r.r_regionkey % 2 == 0 else 8, r.r_regionkey == 1) for r in table(spark, sf_dir, "region").collect() if r.r_regionkey < 3}
    nations = table(spark, sf_dir, "nation").collect()  # a handful of rows
    tables = {f"r{n.n_regionkey}.n{n.n_nationkey}": part(12 if n.n_nationkey % 4 == 0 else 0, n.n_nationkey % 6 == 0) for n in nations if n.n_nationkey % 2 == 0}
    text = {"catalog": {"type": "filesystem"}, "storage": {"type": "local"}, "maintenance": {"defaults": {"compaction": {"enabled": True}}, "namespaces": spaces, "tables": tables}}
    config = parse(json.dumps(text), zero_unset=True)
    found = [(f"r{n.n_regionkey}.n{n.n_nationkey}", policy_for(config, f"r{n.n_regionkey}", f"n{n.n_nationkey}").compaction) for n in nations]
    return spark.createDataFrame([(t, p.min_file_count, p.enabled) for t, p in found], "tbl string, min_file_count long, enabled boolean")


@query("SELECT p_partkey, regexp_full_match(replace(p_name, ' ', '_'), '[A-Za-z_][A-Za-z0-9_.]*') AS joined, regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_.]*') AS plain FROM part")
def identifier_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", identifier_like(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("joined"), identifier_like("p_name").alias("plain"))


def _laid_out(df: DataFrame, small: int, **layout) -> DataFrame:
    """df from many small files, laid out and written: the written files."""
    spark, at = df.sparkSession, shared_dir(df.sparkSession)
    df.repartition(small).write.parquet(f"{at}/in")
    parquet.write(compaction.laid_out(spark.read.parquet(f"{at}/in"), **layout), f"{at}/out")
    return spark.read.parquet(f"{at}/out")


@query("SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_files, CAST(0 AS BIGINT) AS inversions, CAST(0 AS BIGINT) AS overlaps FROM lineitem")
def compact_sort_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    return compaction.layout(_laid_out(table(spark, sf_dir, "lineitem"), 16, strategy="sort", sort_keys=keys, files=4), keys)


@query("SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_files, CAST(0 AS BIGINT) AS inversions, CAST(0 AS BIGINT) AS overlaps FROM events")
def compact_zorder_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order by the codes that the layout sorted by; equal codes lie in one file."""
    written = _laid_out(table(spark, sf_dir, "events"), 16, strategy="z-order", zorder_columns=["user_id", "ts"], files=4, keep_codes=True)
    return compaction.layout(written, [f"{compaction.CODE}0"])


@query("WITH f AS (SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT k, n, CAST(floor((sum(n) OVER (ORDER BY k) - n) / 20000.0) AS INT) AS bin FROM f) SELECT bin, CAST(sum(n) AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS n_files, min(k) AS first_file, max(k) AS last_file FROM b GROUP BY bin")
def compact_bins_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold a line number's rows each, packed whole into bins of 20,000 rows: what every written file holds."""
    at = shared_dir(spark)
    rows = table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_linenumber"))
    rows.repartition("line").write.partitionBy("line").parquet(f"{at}/in")
    sizes = {r.l_linenumber: r["count"] for r in rows.groupBy("l_linenumber").count().collect()}  # a row for each file
    found = {int(p.split("/line=")[1].split("/")[0]): p for p, *_ in Store(spark).rows(f"{at}/in") if p.endswith(".parquet")}
    bins, start = {}, 0
    for k in sorted(found):
        bins[found[k]], start = int(start // 20_000), start + sizes[k]
    parquet.write_bins(spark, bins, f"{at}/out")
    written = spark.read.parquet(f"{at}/out").withColumn("file", F.col("_metadata.file_path"))
    return written.groupBy(F.col(parquet.BIN).alias("bin")).agg(F.count("*").alias("n_rows"), F.countDistinct("file").alias("n_files"), F.min("l_linenumber").alias("first_file"), F.max("l_linenumber").alias("last_file"))


@query("SELECT r_name AS name, CAST(octet_length(encode(r_name || ' é')) AS BIGINT) AS size, r_name || ' é' AS content, r_regionkey % 2 = 1 AS there, r_regionkey % 2 = 0 AS gone FROM region")
def store_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that were written, measured and read, of which every other one was deleted with one that never was."""
    store, at = Store(spark), shared_dir(spark, "objects")
    regions = table(spark, sf_dir, "region").collect()  # a handful of rows
    for r in regions:
        store.write(f"{at}/{r.r_name}", f"{r.r_name} é".encode())
    read = {r.r_name: (store.size(f"{at}/{r.r_name}"), store.read(f"{at}/{r.r_name}").decode()) for r in regions}
    doomed = [f"{at}/{r.r_name}" for r in regions if r.r_regionkey % 2 == 0]
    deleted, failed = store.delete_all([*doomed, f"{at}/never"])
    if failed or deleted != len(doomed):
        raise OSError(f"{deleted} of {len(doomed)} deleted, failed: {failed}")
    there = {r.r_name: store.exists(f"{at}/{r.r_name}") for r in regions}
    return spark.createDataFrame([(n, *read[n], there[n], not there[n]) for n in read], "name string, size long, content string, there boolean, gone boolean")


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * CAST(pow(1000, p_size % 5) AS BIGINT) END AS bytes FROM part")
def memory_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory limits as they are written in configurations, in bytes; null where one isn't well-formed."""

    def read(text: str) -> int | None:
        try:
            return memory_bytes(text)
        except ValueError:
            return None

    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), (F.col("p_size") % 5 + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 7 == 0, "-").otherwise(" "), unit).alias("text"))
    known = spark.createDataFrame([(r.text, read(r.text)) for r in parts.select("text").distinct().collect()], "text string, bytes long")  # a row for each size
    return parts.join(known, "text").select("p_partkey", "bytes")


@query("SELECT name, tbl, n FROM (SELECT 'compaction_jobs_total' AS name, 't' || CAST(l_suppkey % 20 AS VARCHAR) AS tbl, CAST(count(DISTINCT l_linenumber) AS DOUBLE) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'compaction_files_merged_total', 't' || CAST(l_suppkey % 20 AS VARCHAR), CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY 2) x")
def metrics_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after a job for each table and line number, as read from the metrics' text."""
    registry = Registry()
    for r in table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("t"), "l_linenumber").count().collect():  # 140 rows
        registry.compaction(f"t{r.t}", r["count"], 2, 1, 0.5, True)
    found = re.findall(r'^icekeel_(compaction_(?:jobs|files_merged)_total)\{(?:status="success",)?table="(\w+)"[^}]*\} (\S+)$', registry.text(), re.M)
    return spark.createDataFrame([(n, t, float(v)) for n, t, v in found], "name string, tbl string, n double")


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'conflict' ELSE 'committed' END AS outcome, CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey ELSE 1000 + n_nationkey END AS BIGINT) AS current, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 1 WHEN n_nationkey % 3 = 1 THEN 2 ELSE 1 END AS BIGINT) AS snapshots FROM nation")
def commit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction against each nation's table: a third expects another snapshot, a third also removes the old one."""
    catalog, out = FileCatalog(Store(spark), shared_dir(spark, "catalog")), []
    for n in table(spark, sf_dir, "nation").collect():  # a handful of rows
        k, t = n.n_nationkey, TableId("all", f"n{n.n_nationkey}")
        catalog.create(t, {"location": "x", "current-snapshot-id": k, "snapshots": [{"snapshot-id": k}]})
        tx = Transaction().current_is(k if k % 3 else k + 1).add({"snapshot-id": 1000 + k, "sequence-number": 1})
        try:
            catalog.commit(t, tx.remove([k]) if k % 3 == 2 else tx)
            outcome = "committed"
        except Conflict:
            outcome = "conflict"
        meta = catalog.load(t)
        out.append((k, outcome, meta["current-snapshot-id"], len(meta["snapshots"])))
    return spark.createDataFrame(out, "k int, outcome string, current long, snapshots long")


@query("SELECT 'j' || CAST(n_nationkey AS VARCHAR) AS job, CASE WHEN n_nationkey % 5 = 4 THEN 'left' WHEN n_nationkey % 4 = 0 THEN 'dropped' WHEN n_nationkey % 4 = 1 THEN 'inputs gone' WHEN n_nationkey % 4 = 2 THEN 'cleaned' ELSE 'left' END AS outcome FROM nation")
def journal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recovery makes of a journal for each nation, in all states; every fifth is of a process that may be at work still."""
    m, location = _lake(spark)
    meta = m.catalog.load(TABLE)
    m.catalog.commit(TABLE, Transaction().current_is(None).add(append(m.store, meta, [], _ms(BASE))))
    for n in table(spark, sf_dir, "nation").collect():  # a handful of rows
        k = n.n_nationkey
        entry = {"job_id": f"j{k}", "input_files": ["gone"], "output_files": [], "new_snapshot_id": 1000 + k, "state": ("pending", "uploaded", "snapshot_committed", "odd")[k % 4], "created_at": (NOW - timedelta(hours=1)).isoformat()}
        m._journal(location, f"j{k}", entry | ({"owner": "another"} if k % 5 == 4 else {}))
    return spark.createDataFrame(list(m.recover(TABLE, NOW).items()), "job string, outcome string")


@query("SELECT lower(r_name) AS namespace, lower(n_name) AS name, CAST(n_nationkey + 1 AS BIGINT) AS current FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def glue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases and tables of this format from the Glue protocol, answered in memory, after a commit to each."""
    store, at = Store(spark), shared_dir(spark, "glue")
    entries: dict[str, dict[str, dict]] = {}
    for r in table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect():  # a handful of rows
        path, name = f"{at}/{r.n_name}/metadata/v1.metadata.json", r.n_name.lower()
        store.write(path, json.dumps({"location": at, "current-snapshot-id": None, "snapshots": []}).encode())
        entries.setdefault(r.r_name.lower(), {})[name] = {"Name": name, "VersionId": "0", "Parameters": {"table_type": "ICEBERG" if r.n_nationkey % 2 == 0 else "x", "metadata_location": path, "k": str(r.n_nationkey)}}

    def call(action: str, request: dict) -> dict:
        if action in ("GetDatabases", "GetTables"):
            key, found = ("DatabaseList", [{"Name": n} for n in entries]) if action == "GetDatabases" else ("TableList", list(entries[request["DatabaseName"]].values()))
            k = int(request.get("NextToken", 0))
            return {key: found[k : k + 2]} | ({"NextToken": str(k + 2)} if k + 2 < len(found) else {})
        own = entries[request["DatabaseName"]]
        if action == "UpdateTable":
            own[request["TableInput"]["Name"]] = request["TableInput"] | {"VersionId": str(int(request["VersionId"]) + 1)}
            return {}
        return {"Table": own[request["Name"]]}

    catalog, out = GlueCatalog(call, store), []
    for space in catalog.namespaces():
        for t in catalog.tables(space):
            catalog.commit(t, Transaction().current_is(None).add({"snapshot-id": int(entries[space][t.name]["Parameters"]["k"]) + 1, "sequence-number": 1}))
            out.append((space, t.name, catalog.load(t)["current-snapshot-id"]))
    return spark.createDataFrame(out, "namespace string, name string, current long")


@query("SELECT lower(r_name) || '.deep' AS namespace, lower(n_name) AS name, CASE WHEN n_nationkey % 4 = 1 THEN 'conflict' ELSE 'committed' END AS outcome, CAST(CASE WHEN n_nationkey % 4 = 1 THEN 7 ELSE n_nationkey + 10 END AS BIGINT) AS current FROM nation JOIN region ON n_regionkey = r_regionkey")
def rest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces, tables and commits through the REST protocol, answered in memory page by page; every fourth table has moved on."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect()  # a handful of rows
    keys = {(r.r_name.lower(), r.n_name.lower()): r.n_nationkey for r in nations}
    held = {k: {"current-snapshot-id": 7, "snapshots": [{"snapshot-id": 7}]} for k in keys}

    class InMemory(RestCatalog):
        def _call(self, method: str, path: str, body: dict | None = None) -> dict:
            place, _, page = path.partition("?pageToken=")
            parts, at = [urllib.parse.unquote(x) for x in place.split("/")[2:]], int(page or 0)
            if len(parts) != 4:
                space = parts[1].split("\x1f")[0] if len(parts) > 1 else None
                found = [[s, "deep"] for s in sorted({s for s, _ in keys})] if space is None else [{"namespace": [s, "deep"], "name": n} for s, n in sorted(keys) if s == space]
                return {"namespaces" if space is None else "identifiers": found[at : at + 2]} | ({"next-page-token": str(at + 2)} if at + 2 < len(found) else {})
            key = parts[1].split("\x1f")[0], parts[3]
            if method == "POST":
                if any(r["snapshot-id"] != held[key]["current-snapshot-id"] for r in body["requirements"]):
                    raise Conflict(path)
                held[key] = apply_updates(held[key], Transaction([], body["updates"]))
            return {"metadata": held[key]}

    catalog, out = InMemory("http://memory"), []
    for space in catalog.namespaces():
        for t in catalog.tables(space):
            k = keys[space.split(".")[0], t.name]
            try:
                catalog.commit(t, Transaction().current_is(8 if k % 4 == 1 else 7).add({"snapshot-id": k + 10, "sequence-number": 1}))
                outcome = "committed"
            except Conflict:
                outcome = "conflict"
            out.append((space, t.name, outcome, catalog.load(t)["current-snapshot-id"]))
    return spark.createDataFrame(out, "namespace string, name string, outcome string, current long")
