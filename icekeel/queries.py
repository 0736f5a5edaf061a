"""Registered queries: the operators over metadata that is derived from the tables at hand, with the same in SQL.

Orders stand for data files, order months for snapshots, customers for manifests. Fixed moments are
literals; no query looks at the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from icekeel.functions.backoff import window_ms
from icekeel.functions.morton import interleave
from icekeel.functions.paths import basename, dirname, uri_bucket, uri_key
from icekeel.operators import compaction, expiry, metadata, orphans, rollups
from icekeel.sources import parquet
from icekeel.sources.scratch import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("s3://lake/orders/data/status="), "o_orderstatus", F.lit("/month="), F.substring(F.col("o_orderdate").cast("string"), 1, 7), F.lit("/o"), F.col("o_orderkey").cast("string"), F.lit(".parquet"))
    return table(spark, sf_dir, "orders").select(path.alias("file_path"), F.floor("o_totalprice").cast("long").alias("size_bytes"), F.col("o_orderdate").alias("added_at"), "o_orderkey")


FILES = """files AS (SELECT 's3://lake/orders/data/status=' || o_orderstatus || '/month=' || substr(CAST(o_orderdate AS VARCHAR), 1, 7) || '/o' || CAST(o_orderkey AS VARCHAR) || '.parquet' AS file_path,
 CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderdate AS added_at, o_orderkey FROM orders)"""


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot for each month of orders, numbered by time."""
    months = table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts")).distinct()
    # Months are few, whatever the orders.
    numbers = F.posexplode(F.array_sort(F.collect_set("ts")))
    return months.agg(numbers.alias("k", "ts")).select((F.col("k") + 1).cast("long").alias("snapshot_id"), "ts")


MONTHS = "snaps AS (SELECT CAST(row_number() OVER (ORDER BY ts) AS BIGINT) AS snapshot_id, ts FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts FROM orders) m)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey") % 40
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("m"), cust.cast("string")).alias("manifest_path"), F.when(cust < 4, 1).otherwise(0).alias("manifest_content"),
        F.when(key % 10 == 0, 2).when(key % 10 < 4, 1).otherwise(0).alias("status"), F.when(key % 11 != 0, key % 100).alias("snapshot_id"),
        F.when(key % 13 == 0, 1).otherwise(0).alias("content"), key.alias("file_id"), F.floor("o_totalprice").cast("long").alias("size_bytes"),
    )


ENTRIES = """entries AS (SELECT 'm' || CAST(o_custkey % 40 AS VARCHAR) AS manifest_path, CASE WHEN o_custkey % 40 < 4 THEN 1 ELSE 0 END AS manifest_content,
 CASE WHEN o_orderkey % 10 = 0 THEN 2 WHEN o_orderkey % 10 < 4 THEN 1 ELSE 0 END AS status, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 100 END AS snapshot_id,
 CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS content, o_orderkey AS file_id, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes FROM orders)"""


@query(f"WITH {FILES} SELECT regexp_replace(file_path, '/[^/]*$', '') AS partition_dir, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS bytes_before FROM files WHERE added_at < TIMESTAMP '2001-07-01 00:00:00' GROUP BY 1 HAVING count(*) >= 5")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.candidates(_files(spark, sf_dir), moment("2001-07-01 00:00:00"), 5)


@query(f"WITH {FILES}, old AS (SELECT regexp_replace(file_path, '/[^/]*$', '') AS partition_dir, * FROM files WHERE added_at < TIMESTAMP '2001-07-01 00:00:00' AND size_bytes < 200000) SELECT partition_dir, file_path, size_bytes FROM old WHERE partition_dir IN (SELECT partition_dir FROM old GROUP BY 1 HAVING count(*) >= 5)")
def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.candidate_files(_files(spark, sf_dir), moment("2001-07-01 00:00:00"), 5, 200_000).select("partition_dir", "file_path", "size_bytes")


@query(f"WITH {ENTRIES} SELECT DISTINCT manifest_path FROM entries WHERE manifest_content <> 1")
def data_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.data_manifests(_entries(spark, sf_dir).withColumnRenamed("content", "file_content").withColumnRenamed("manifest_content", "content")).select("manifest_path").distinct()


@query(f"WITH {ENTRIES} SELECT manifest_path, status, snapshot_id, file_id, size_bytes FROM entries WHERE status <> 2")
def live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.live_entries(_entries(spark, sf_dir)).select("manifest_path", "status", "snapshot_id", "file_id", "size_bytes")


@query(f"WITH {MONTHS}, {ENTRIES}, cur AS (SELECT max(ts) AS ts FROM snaps) SELECT e.file_id, e.size_bytes, coalesce(s.ts, c.ts) AS added_at FROM entries e LEFT JOIN snaps s ON e.snapshot_id = s.snapshot_id CROSS JOIN cur c WHERE e.manifest_content <> 1 AND e.status <> 2 AND e.content = 0")
def candidate_age_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = _months(spark, sf_dir)
    current = snaps.agg(F.max("ts")).first()[0]  # one value of the metadata document
    entries = metadata.data_entries(metadata.live_entries(_entries(spark, sf_dir).filter("manifest_content <> 1")))
    return metadata.with_age(entries, snaps, F.lit(current).cast("timestamp_ntz")).select("file_id", "size_bytes", "added_at")


@query(f"WITH {ENTRIES} SELECT manifest_path, CAST(sum(CASE WHEN status = 1 THEN 1 ELSE 0 END) AS BIGINT) AS added_files, CAST(sum(CASE WHEN status = 0 THEN 1 ELSE 0 END) AS BIGINT) AS existing_files, CAST(sum(CASE WHEN status = 1 THEN size_bytes ELSE 0 END) AS BIGINT) AS added_bytes FROM entries GROUP BY manifest_path")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.manifest_summary(_entries(spark, sf_dir))


BIN = """f AS (SELECT o_orderstatus AS part, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS sz FROM orders),
 c AS (SELECT part, k, sz, CAST(sum(sz) OVER (PARTITION BY part ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) - sz AS start_off FROM f)"""


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("part"), F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("long").alias("sz"))


@query(f"WITH {BIN} SELECT part, CAST(floor(start_off / 10000000.0) AS BIGINT) AS bin, count(*) AS n_files, CAST(sum(sz) AS BIGINT) AS bytes FROM c GROUP BY 1, 2")
def binpack_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.bin_totals(compaction.bins(_sized(spark, sf_dir), 10_000_000.0))


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey, CASE WHEN rn <= floor(n / 2.0) THEN 0 ELSE 1 END AS half FROM r")
def split_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.halves(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "half")


@query("SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS size, string_agg('o' || CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS inputs, '' AS output_path FROM orders GROUP BY o_custkey")
def merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("part"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("input"), F.floor("o_totalprice").cast("long").alias("size"))
    return rollups.merged(parts, "o_custkey")


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months as snapshots: every third one on a side branch."""
    i = F.col("id")
    parent = F.when(i % 3 == 0, i - 1).when((i - 1) % 3 == 0, F.greatest(i - 2, F.lit(0))).otherwise(i - 1)
    return _months(spark, sf_dir).select(F.col("snapshot_id").alias("id"), "ts").withColumn("parent_id", parent.cast("long"))


def _current(snapshots: DataFrame) -> int:
    return snapshots.filter("id % 3 <> 0").agg(F.max("id")).first()[0] or 0


BRANCHES = """m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts FROM orders), n AS (SELECT ts, CAST(row_number() OVER (ORDER BY ts) AS BIGINT) AS id FROM m),
 snaps AS (SELECT id, ts, CASE WHEN id % 3 = 0 THEN id - 1 WHEN (id - 1) % 3 = 0 THEN greatest(id - 2, 0) ELSE id - 1 END AS parent_id FROM n), cur AS (SELECT max(id) AS id FROM snaps WHERE id % 3 <> 0),
 anc AS (SELECT s.id, s.parent_id FROM snaps s JOIN cur c ON s.id = c.id UNION ALL SELECT s.id, s.parent_id FROM snaps s JOIN anc a ON s.id = a.parent_id)"""


@query(f"WITH RECURSIVE {BRANCHES} SELECT id, parent_id FROM anc")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = _branches(spark, sf_dir)
    return expiry.ancestors(snaps, _current(snaps))


@query(f"""WITH RECURSIVE {BRANCHES}, expirable AS (SELECT s.id, row_number() OVER (ORDER BY s.ts, s.id) AS rn, count(*) OVER () AS n_exp FROM snaps s LEFT JOIN anc a ON s.id = a.id WHERE a.id IS NULL AND s.ts < TIMESTAMP '2001-01-01 00:00:00'),
 tot AS (SELECT count(*) AS n FROM snaps) SELECT e.id AS snapshot_id FROM expirable e CROSS JOIN tot t WHERE e.rn > greatest(60 - (t.n - e.n_exp), 0)""")
def expired_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = _branches(spark, sf_dir)
    return expiry.expired(snaps, _current(snaps), moment("2001-01-01 00:00:00"), 60)


OWNERS = """sm AS (SELECT DISTINCT o_orderkey % 25 AS snapshot_id, (o_orderkey % 25) * 6 + o_custkey % 30 AS manifest FROM orders), mf AS (SELECT DISTINCT o_custkey % 174 AS manifest, o_orderkey % 9000 AS file_id FROM orders),
 live_m AS (SELECT DISTINCT manifest FROM sm WHERE snapshot_id >= 5), excl_m AS (SELECT DISTINCT s.manifest FROM sm s WHERE s.snapshot_id < 5 AND NOT EXISTS (SELECT 1 FROM live_m l WHERE l.manifest = s.manifest)),
 cand AS (SELECT DISTINCT f.file_id FROM mf f JOIN excl_m e ON f.manifest = e.manifest), live_f AS (SELECT DISTINCT f.file_id FROM mf f JOIN live_m l ON f.manifest = l.manifest)"""


def _owners(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    owners = orders.select((F.col("o_orderkey") % 25).alias("snapshot_id"), (F.col("o_orderkey") % 25 * 6 + F.col("o_custkey") % 30).alias("manifest")).distinct()
    return owners, orders.select((F.col("o_custkey") % 174).alias("manifest"), (F.col("o_orderkey") % 9000).alias("file_id")).distinct()


@query(f"WITH {OWNERS} SELECT manifest FROM excl_m")
def exclusive_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiry.exclusive_manifests(_owners(spark, sf_dir)[0], F.col("snapshot_id") < 5)


@query(f"WITH {OWNERS} SELECT c.file_id FROM cand c WHERE NOT EXISTS (SELECT 1 FROM live_f l WHERE l.file_id = c.file_id)")
def gc_data_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiry.garbage_files(*_owners(spark, sf_dir), F.col("snapshot_id") < 5)


@query(f"WITH {ENTRIES} SELECT DISTINCT path FROM (SELECT 'list-' || CAST(snapshot_id AS VARCHAR) AS path FROM entries WHERE snapshot_id IS NOT NULL UNION ALL SELECT manifest_path FROM entries UNION ALL SELECT 'f' || CAST(file_id AS VARCHAR) FROM entries WHERE status <> 2) x")
def live_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    lists = e.filter("snapshot_id is not null").select(F.concat(F.lit("list-"), F.col("snapshot_id").cast("string")))
    return metadata.union_distinct(lists, e.select("manifest_path"), metadata.live_entries(e).select(F.concat(F.lit("f"), F.col("file_id").cast("string"))))


LISTING = f"""{FILES}, listing AS (SELECT file_path AS p, added_at AS mtime FROM files UNION ALL SELECT 's3://lake/orders/metadata/v' || CAST(o_orderkey AS VARCHAR) || '.metadata.json', o_orderdate FROM orders WHERE o_orderkey % 500 = 0),
 live AS (SELECT file_path AS p FROM files WHERE o_orderkey % 7 <> 0),
 marked AS (SELECT l.p, CASE WHEN v.p IS NOT NULL THEN 'live' WHEN l.p LIKE '%.json' THEN 'protected' WHEN l.mtime > TIMESTAMP '2001-06-01 00:00:00' THEN 'skipped' ELSE 'deleted' END AS disposition FROM listing l LEFT JOIN live v ON l.p = v.p)"""


def _listing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Column]:
    files = _files(spark, sf_dir)
    docs = table(spark, sf_dir, "orders").filter("o_orderkey % 500 = 0").select(F.concat(F.lit("s3://lake/orders/metadata/v"), F.col("o_orderkey").cast("string"), F.lit(".metadata.json")), "o_orderdate")
    listing = files.select(F.col("file_path").alias("p"), F.col("added_at").alias("mtime")).union(docs)
    return listing, files.filter("o_orderkey % 7 <> 0").select(F.col("file_path").alias("p")), moment("2001-06-01 00:00:00")


@query(f"WITH {LISTING} SELECT disposition, count(*) AS n FROM marked GROUP BY 1")
def orphan_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.disposition_counts(*_listing(spark, sf_dir))


@query(f"WITH {LISTING} SELECT p FROM marked WHERE disposition = 'deleted'")
def orphan_delete_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.delete_list(*_listing(spark, sf_dir))


@query("""WITH d AS (SELECT 5 AS mfc, CAST(true AS BOOLEAN) AS en), ns AS (SELECT r_regionkey AS rk, CASE WHEN r_regionkey % 2 = 0 THEN 0 ELSE 8 END AS mfc, CASE WHEN r_regionkey = 1 THEN false END AS en FROM region WHERE r_regionkey < 3),
 tb AS (SELECT n_nationkey AS nk, CASE WHEN n_nationkey % 4 = 0 THEN 12 ELSE 0 END AS mfc, CASE WHEN n_nationkey % 6 = 0 THEN false END AS en FROM nation WHERE n_nationkey % 2 = 0)
 SELECT n.n_name AS tbl, coalesce(CASE WHEN tb.nk IS NOT NULL THEN nullif(tb.mfc, 0) ELSE nullif(ns.mfc, 0) END, d.mfc) AS min_file_count, coalesce(CASE WHEN tb.nk IS NOT NULL THEN tb.en ELSE ns.en END, d.en) AS enabled
 FROM nation n LEFT JOIN tb ON n.n_nationkey = tb.nk LEFT JOIN ns ON n.n_regionkey = ns.rk CROSS JOIN d""")
def policy_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's override, else its namespace's, each merged with the defaults alone; zero and null inherit."""
    k, n = F.col("r_regionkey"), F.col("n_nationkey")
    spaces = table(spark, sf_dir, "region").filter(k < 3).select(k.alias("n_regionkey"), F.when(k % 2 == 0, 0).otherwise(8).alias("ns_mfc"), F.when(k == 1, False).alias("ns_en"))
    own = table(spark, sf_dir, "nation").filter(n % 2 == 0).select("n_nationkey", F.when(n % 4 == 0, 12).otherwise(0).alias("mfc"), F.when(n % 6 == 0, False).alias("en"), F.lit(True).alias("own"))
    both = table(spark, sf_dir, "nation").join(own, "n_nationkey", "left").join(spaces, "n_regionkey", "left")
    pick = lambda a, b: F.when(F.col("own"), F.col(a)).otherwise(F.col(b))
    return both.select(F.col("n_name").alias("tbl"), F.coalesce(F.nullif(pick("mfc", "ns_mfc"), F.lit(0)), F.lit(5)).alias("min_file_count"), F.coalesce(pick("en", "ns_en"), F.lit(True)).alias("enabled"))


@query("SELECT page_id, regexp_replace(url, '^[^:]+://[^/]+/?', '') AS k, regexp_extract(url, '^[^:]+://([^/]+)', 1) AS bucket FROM pages")
def uri_to_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", uri_key("url").alias("k"), uri_bucket("url").alias("bucket"))


@query("SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS dir, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", dirname("url").alias("dir"), basename("url").alias("base"))


@query("SELECT r_name, CAST(a AS INT) AS attempt, least(CAST((r_regionkey + 1) * 100 AS BIGINT) * CAST(pow(2, a) AS BIGINT), CAST(10000 AS BIGINT)) AS window_ms FROM region CROSS JOIN range(12) t(a)")
def backoff_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select("r_name", ((F.col("r_regionkey") + 1) * 100).cast("long").alias("base"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("attempt"))
    return rows.select("r_name", "attempt", F.least(F.col("base") * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("attempt")), F.lit(10_000).cast("long")).alias("window_ms"))


@query("SELECT CAST(a AS INT) AS attempt, least(CAST(200 AS BIGINT) * CAST(pow(2, least(a, 40)) AS BIGINT), CAST(10000 AS BIGINT)) AS window_ms FROM range(64) t(a)")
def backoff_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(64).select(F.col("id").cast("int").alias("attempt"), window_ms(F.col("id"), 200, 10_000).alias("window_ms"))


@query("SELECT le, n FROM (" + " UNION ALL ".join(f"SELECT '{b:g}' AS le, count(*) FILTER (WHERE value <= {b}) AS n FROM events" for b in rollups.BUCKETS) + " UNION ALL SELECT '+Inf', count(value) FROM events) x")
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.histogram(table(spark, sf_dir, "events"), "value")


@query("SELECT 't' || CAST(l_suppkey % 20 AS VARCHAR) AS table_name, count(*) AS jobs, CAST(sum(l_linenumber) AS BIGINT) AS files_merged, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes_before, CAST(sum(CAST(floor(l_extendedprice / 2) AS BIGINT)) AS BIGINT) AS bytes_after, count(*) FILTER (WHERE l_returnflag = 'R') AS errors FROM lineitem GROUP BY 1")
def table_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("files"), F.floor("l_extendedprice").cast("long").alias("bytes_before"), F.floor(F.col("l_extendedprice") / 2).cast("long").alias("bytes_after"), (F.col("l_returnflag") == "R").alias("failed"))
    return rollups.by_table(results, F.concat(F.lit("t"), (F.col("l_suppkey") % 20).cast("string")))


@query(f"WITH {MONTHS} SELECT snapshot_id, ts FROM snaps WHERE snapshot_id NOT IN (SELECT snapshot_id FROM snaps WHERE snapshot_id % 4 = 1)")
def apply_remove_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = _months(spark, sf_dir)
    return metadata.without(snaps, snaps.filter("snapshot_id % 4 = 1").select("snapshot_id"), "snapshot_id")


@query(f"WITH {MONTHS} SELECT snapshot_id, ts FROM snaps UNION ALL SELECT CAST(max(snapshot_id) + 1 AS BIGINT), TIMESTAMP '2002-01-01 00:00:00' FROM snaps")
def apply_add_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = _months(spark, sf_dir)
    return snaps.unionByName(snaps.agg((F.max("snapshot_id") + 1).alias("snapshot_id")).withColumn("ts", moment("2002-01-01 00:00:00")))


def _compacted(df: DataFrame, small: int, **layout) -> DataFrame:
    """df written as many small files, compacted as layout says, and read back."""
    spark, at = df.sparkSession, shared_dir(df.sparkSession)
    df.repartition(small).write.parquet(f"{at}/in")
    parquet.write(compaction.laid_out(spark.read.parquet(f"{at}/in"), **layout), f"{at}/out")
    return spark.read.parquet(f"{at}/out")


@query("SELECT * FROM lineitem")
def compact_binpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(table(spark, sf_dir, "lineitem"), 16, files=2)


@query("SELECT * FROM lineitem")
def compact_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(table(spark, sf_dir, "lineitem"), 16, strategy="sort", sort_keys=["l_shipdate", "l_orderkey"], files=4)


@query("SELECT * FROM events")
def compact_zorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(table(spark, sf_dir, "events"), 16, strategy="z-order", zorder_columns=["user_id", "ts"], files=4)


@query("SELECT * FROM events")
def compact_zorder_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(table(spark, sf_dir, "events"), 16, strategy="z-order", zorder_columns=["user_id", "ts"], files=4, zorder_by="hash")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, NULL AS o_note, CAST(o_orderkey % 100 AS BIGINT) AS o_small FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, NULL, o_orderpriority, CAST(o_orderkey AS BIGINT) FROM orders WHERE o_orderkey % 2 <> 0")
def compact_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, orders = shared_dir(spark), table(spark, sf_dir, "orders")
    orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_orderkey") % 100).cast("int").alias("o_small")).write.parquet(f"{at}/old")
    orders.filter("o_orderkey % 2 <> 0").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("o_note"), F.col("o_orderkey").alias("o_small")).write.parquet(f"{at}/new")
    parquet.write(compaction.laid_out(parquet.read_by_name(spark, [f"{at}/old", f"{at}/new"])), f"{at}/out")
    return spark.read.parquet(f"{at}/out")


_BITS = " | ".join(f"((CAST(x AS BIGINT) & {1 << i}) << {i}) | ((CAST(y AS BIGINT) & {1 << i}) << {i + 1})" for i in range(8))


@query(f"WITH r AS (SELECT event_id, ntile(256) OVER (ORDER BY user_id, event_id) - 1 AS x, ntile(256) OVER (ORDER BY ts, event_id) - 1 AS y FROM events) SELECT event_id, {_BITS} AS z FROM r")
def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 256-tiles of both orders without a window over all rows: ranks come from sorted ranges and their counts."""
    events = table(spark, sf_dir, "events")
    tile = lambda *keys: _tiles(events, list(keys), 256)
    both = tile("user_id", "event_id").withColumnRenamed("tile", "x").join(tile("ts", "event_id").withColumnRenamed("tile", "y"), "event_id")
    return both.select("event_id", interleave([F.col("x"), F.col("y")]).alias("z"))


def _tiles(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(last key, tile) of every row: ntile(n) - 1 by keys, from ranges that are sorted apart and numbered by their counts."""
    ranged = df.select(*keys).repartitionByRange(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys).sortWithinPartitions(*keys)
    path = shared_dir(df.sparkSession)
    ranged.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)  # ranges are drawn anew by each job
    ranged = df.sparkSession.read.parquet(path)
    part, nth = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.p: r.n for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each partition
    total, starts, at = sum(counts.values()), [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    first = F.broadcast(df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long"))
    rank = F.col("_start") + F.col("_nth")
    size, extra = divmod(total, n)
    cut = extra * (size + 1)
    tile = F.when(rank < cut, F.floor(rank / F.lit(size + 1))).otherwise(F.lit(extra) + F.floor((rank - cut) / F.lit(max(1, size))))
    return ranged.withColumn("_part", part).withColumn("_nth", nth).join(first, "_part").select(keys[-1], tile.cast("long").alias("tile"))
