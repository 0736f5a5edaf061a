import json
import threading
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from icekeel.functions import paths
from icekeel.functions.morton import interleave
from icekeel.operators import compaction
from icekeel.operators.running import running
from icekeel.plans.retry import Conflict
from icekeel.sources import avro_ocf, parquet
from icekeel.sources import store as store_module
from icekeel.sources.catalog import FileCatalog, GlueCatalog, GlueError, RestCatalog, TableId, TableNotFound, Tokens, Transaction, apply_updates, check_requirements, is_iceberg, next_metadata_location, opened, rest, signed
from icekeel.sources.store import Store, hadoop_settings

WIDE = {
    "type": "record",
    "name": "r",
    "fields": [
        {"name": "l", "type": "long"}, {"name": "s", "type": ["null", "string"], "default": None}, {"name": "b", "type": "bytes"}, {"name": "d", "type": "double"}, {"name": "t", "type": "boolean"},
        {"name": "a", "type": {"type": "array", "items": "int"}}, {"name": "m", "type": {"type": "map", "values": "string"}}, {"name": "e", "type": {"type": "enum", "name": "e1", "symbols": ["x", "y"]}},
        {"name": "f", "type": {"type": "fixed", "name": "f1", "size": 2}},
    ],
}
ROW = st.fixed_dictionaries({"l": st.integers(-(2**63), 2**63 - 1), "s": st.none() | st.text(), "b": st.binary(), "d": st.floats(allow_nan=False), "t": st.booleans(), "a": st.lists(st.integers(-(2**31), 2**31 - 1)), "m": st.dictionaries(st.text(), st.text()), "e": st.sampled_from("xy"), "f": st.binary(min_size=2, max_size=2)})


@settings(max_examples=60, deadline=None)
@given(st.lists(ROW, max_size=9), st.sampled_from(["null", "deflate"]))
def test_avro_round_trip(rows, codec):
    assert list(avro_ocf.decode(avro_ocf.encode(WIDE, rows, codec, block_rows=4))) == rows


def test_avro_damage_is_an_error():
    raw = avro_ocf.encode(avro_ocf.LIST_SCHEMA, [])
    with pytest.raises(ValueError):
        list(avro_ocf.decode(b"no" + raw))
    full = avro_ocf.encode(WIDE, [{"l": 1, "s": None, "b": b"", "d": 0.0, "t": True, "a": [], "m": {}, "e": "x", "f": b"ab"}])
    for cut in (len(full) - 1, len(full) - 20):
        with pytest.raises(Exception):  # noqa: B017
            list(avro_ocf.decode(full[:cut]))


def entry(status, path, sid=None):
    return {"status": status, "snapshot_id": sid, "data_file": {"content": 0, "file_path": path, "file_format": "PARQUET", "record_count": 1, "file_size_in_bytes": 2}}


def test_manifests_through_spark(spark, tmp_path):
    store = Store(spark)
    for n in ("a", "b"):
        store.write(f"file:{tmp_path}/{n}.avro", avro_ocf.encode(avro_ocf.ENTRY_SCHEMA, [entry(1, n + "1"), entry(2, n + "2", 7), entry(0, n + "3")]))
    got = avro_ocf.manifests(spark, [f"file:{tmp_path}/{n}.avro" for n in ("a", "b")])
    assert sorted(r.data_file.file_path for r in got.collect()) == ["a1", "a3", "b1", "b3"]
    assert avro_ocf.manifests(spark, [f"file:{tmp_path}/a.avro"], deleted=True).filter("status = 2").first().snapshot_id == 7
    assert avro_ocf.manifest_lists(spark, []).collect() == []
    store.write(f"file:{tmp_path}/bad.avro", b"not avro")
    with pytest.raises(Exception):  # noqa: B017
        avro_ocf.manifests(spark, [f"file:{tmp_path}/bad.avro"]).collect()


def test_store(spark, tmp_path):
    s, at = Store(spark), f"file:{tmp_path}/t"
    s.write(f"{at}/_hidden/.x", b"abc")
    s.write(f"{at}_v2/y", b"1")
    assert s.exists(f"{at}/_hidden/.x") and s.size(f"{at}/_hidden/.x") == 3 and s.read(f"{at}/_hidden/.x") == b"abc"
    assert [p.rpartition("/")[2] for p, *_ in s.rows(at)] == [".x"] and s.modified(f"{at}/_hidden/.x").year > 2000
    with pytest.raises(FileExistsError):
        s.write(f"{at}/_hidden/.x", b"", overwrite=False)
    assert s.listing(at).select("length").collect()[0][0] == 3 and s.listing(f"{at}/none").collect() == []
    assert s.delete_all([f"{at}/_hidden/.x", f"{at}/none"]) == (1, [])


@pytest.mark.parametrize(("uri", "key"), [("s3://b/a/c.parquet", "a/c.parquet"), ("gs://b/x", "x"), ("/plain/x", "/plain/x"), ("x", "x"), ("s3://b", None), ("s3://b/", None)])
def test_keys(spark, uri, key):
    if key is None:
        with pytest.raises(ValueError):
            paths.key_of(uri)
    else:
        assert paths.key_of(uri) == key
        df = spark.createDataFrame([(uri,)], "u string").select(paths.uri_key("u"), paths.uri_bucket("u"))
        assert tuple(df.first()) == (key, paths.bucket_of(uri))
    assert paths.as_folder("s3://b/x//") == "s3://b/x/"


def test_names_and_limits():
    for bad in ("1bad", "ts DESC", 'a"; DROP', ""):
        with pytest.raises(ValueError):
            paths.checked_identifier(bad)
    for good in ("4GB", "0.5 TB", "100B"):
        assert paths.checked_memory(good) == good
    for bad in ("4", "GB", "4gb", "-1GB"):
        with pytest.raises(ValueError):
            paths.checked_memory(bad)


def test_updates_are_pure_and_keep_unknown_keys():
    meta = {"current-snapshot-id": 1, "snapshots": [{"snapshot-id": 1}, {"snapshot-id": 2}], "last-sequence-number": 4, "x": {"y": 1}}
    before = json.dumps(meta)
    out = apply_updates(meta, Transaction().add({"snapshot-id": 3, "sequence-number": 9}).remove([2]))
    assert json.dumps(meta) == before and out["x"] == {"y": 1} and out["current-snapshot-id"] == 3 and out["last-sequence-number"] == 9
    assert [s["snapshot-id"] for s in out["snapshots"]] == [1, 3]
    check_requirements({"current-snapshot-id": None}, Transaction().current_is(None))
    with pytest.raises(Conflict):
        check_requirements(meta, Transaction().current_is(2))
    for tx in (Transaction([{"type": "odd"}]), Transaction([], [{"action": "odd"}])):
        with pytest.raises(ValueError):
            check_requirements(meta, tx)
            apply_updates(meta, tx)
    assert next_metadata_location("s3://b/t/metadata/1.json").startswith("s3://b/t/metadata/")
    assert is_iceberg({"table_type": "ICEBERG"}) and not is_iceberg({})


def test_file_catalog(spark, tmp_path):
    c, t = FileCatalog(Store(spark), f"file:{tmp_path}/lake"), TableId("a.b", "t")
    with pytest.raises(TableNotFound):
        c.load(t)
    c.create(t, {"current-snapshot-id": None})
    c.create(TableId("z", "u"), {})
    assert c.namespaces() == ["a.b", "z"] and c.tables("a.b") == [t] and c.tables("none") == []
    c.commit(t, Transaction().current_is(None).add({"snapshot-id": 5}))
    with pytest.raises(Conflict):
        c.commit(t, Transaction().current_is(None).add({"snapshot-id": 6}))
    assert c.load(t)["current-snapshot-id"] == 5


class Fake(BaseHTTPRequestHandler):
    seen: list = []

    def _do(self):
        n = int(self.headers.get("Content-Length") or 0)
        body = self.rfile.read(n)
        self.seen.append((self.command, self.path, dict(self.headers), body))
        code, out = 200, {}
        if self.path.endswith("/oauth/tokens"):
            out = {"access_token": "tok", "expires_in": 3600}
        elif self.path == "/iceberg/v1/namespaces":
            out = {"namespaces": [["a", "b"]], "next-page-token": "p 2"}
        elif self.path == "/iceberg/v1/namespaces?pageToken=p%202":
            out = {"namespaces": [["c"]]}
        elif self.path == "/iceberg/v1/namespaces/a%1Fb/tables":
            out = {"identifiers": [{"namespace": ["a", "b"], "name": "t"}]}
        elif self.path.endswith("/tables/t"):
            out = {"metadata": {"current-snapshot-id": 3}}
            code = 200 if self.command == "GET" else 409
        else:
            code = 404
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    do_GET = do_POST = _do

    def log_message(self, *_):
        pass


def test_rest_catalog():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    c = rest("nessie", f"http://127.0.0.1:{server.server_port}/", client_id="i", client_secret="s")
    assert c.namespaces() == ["a.b", "c"] and c.tables("a.b") == [TableId("a.b", "t")] and c.tables("none") == []
    assert c.load(TableId("a.b", "t")) == {"current-snapshot-id": 3}
    with pytest.raises(Conflict):
        c.commit(TableId("a.b", "t"), Transaction().current_is(3).add({"snapshot-id": 4}))
    with pytest.raises(TableNotFound):
        c.load(TableId("x", "none"))
    calls = [x for x in Fake.seen if "/oauth/" not in x[1]]
    assert len(Fake.seen) - len(calls) == 1 and all(x[2]["Authorization"] == "Bearer tok" for x in calls)
    assert len({x[2]["Idempotency-key"] if "Idempotency-key" in x[2] else x[2]["Idempotency-Key"] for x in calls}) == len(calls)
    body = json.loads(next(x[3] for x in calls if x[0] == "POST"))
    assert body["requirements"][0]["snapshot-id"] == 3 and body["updates"][1]["snapshot-id"] == 4
    server.shutdown()


def test_tokens_are_renewed_early(monkeypatch):
    now, got = [0.0], []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self, *_):
            return b'{"access_token": "t", "expires_in": 100}'

    monkeypatch.setattr("urllib.request.urlopen", lambda *a, **k: got.append(1) or Answer())
    t = Tokens("http://x", "i", "s", clock=lambda: now[0])
    for at, n in ((0, 1), (69, 1), (71, 2)):
        now[0] = at
        assert t.get() == "t" and len(got) == n


def test_written_files(spark, tmp_path):
    df = spark.range(300_000).select((F.col("id") * 7919 % 300_000).alias("k"), F.when(F.col("id") % 10 > 0, F.col("id")).alias("v"))
    parquet.write(compaction.laid_out(df.repartition(5), "sort", ["v", "k"]), f"{tmp_path}/one")
    (file,) = [p for p in tmp_path.joinpath("one").iterdir() if p.suffix == ".parquet"]
    meta = pq.ParquetFile(file).metadata
    assert [meta.row_group(k).num_rows for k in range(meta.num_row_groups)] == [122_880, 122_880, 54_240]
    assert meta.row_group(0).column(0).compression == "ZSTD"
    v = pq.read_table(file)["v"].to_pylist()
    assert v[-30_000:] == [None] * 30_000 and v[:270_000] == sorted(v[:270_000])
    ranged = compaction.laid_out(df, "sort", ["k"], files=4)
    spans = sorted(ranged.groupBy(F.spark_partition_id()).agg(F.min("k"), F.max("k")).collect(), key=lambda r: r[1])
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:], strict=False)) and len(spans) == 4
    z = compaction.laid_out(df.withColumn("w", F.col("k") % 100), "z-order", zorder_columns=["k", "w"], files=2)
    assert z.count() == 300_000


def test_dotted_columns_and_widening(spark, tmp_path):
    spark.range(3).select(F.col("id").cast("int").alias("a.b"), F.lit("x").alias("only")).write.parquet(f"{tmp_path}/i")
    spark.range(5_000_000_000, 5_000_000_002).select(F.col("id").alias("a.b")).write.parquet(f"{tmp_path}/j")
    df = parquet.read_by_name(spark, [f"{tmp_path}/i", f"{tmp_path}/j"])
    rows = compaction.laid_out(df, "sort", ["a.b"]).collect()
    assert [r["a.b"] for r in rows] == [0, 1, 2, 5_000_000_000, 5_000_000_001] and rows[-1]["only"] is None


def test_write_bins(spark, tmp_path):
    spark.range(0, 40, numPartitions=4).withColumn("bin", F.lit("own")).write.parquet(f"{tmp_path}/in")
    files = sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/in").select("_metadata.file_path").distinct().collect())
    parquet.write_bins(spark, {f: k // 2 for k, f in enumerate(files)}, f"{tmp_path}/out")
    found = {p.name: [f for f in p.iterdir() if f.suffix == ".parquet"] for p in tmp_path.joinpath("out").iterdir() if p.is_dir()}
    assert sorted(found) == [f"{parquet.BIN}={k}" for k in (0, 1)] and all(len(f) == 1 for f in found.values())
    assert sorted(pq.read_table(found[f"{parquet.BIN}=0"][0])["id"].to_pylist()) == list(range(20))
    assert spark.read.parquet(f"{tmp_path}/out").filter("bin = 'own'").count() == 40


@given(st.integers(0, 255), st.integers(0, 255))
@settings(max_examples=20, deadline=None)
def test_interleave_orders_like_bits(x, y):
    want = sum(((x >> i) & 1) << (2 * i) | ((y >> i) & 1) << (2 * i + 1) for i in range(8))
    assert want < 1 << 16


def test_interleave(spark):
    df = spark.createDataFrame([(x, y) for x in (0, 1, 5, 200, 255) for y in (0, 3, 128, 255)], "x long, y long")
    for r in df.withColumn("z", interleave([F.col("x"), F.col("y")])).collect():
        assert r.z == sum(((r.x >> i) & 1) << (2 * i) | ((r.y >> i) & 1) << (2 * i + 1) for i in range(8))


def test_rest_kinds():
    assert rest("nessie", "http://h/").url == "http://h/iceberg" and rest("polaris", "http://h").url == "http://h"
    assert isinstance(rest("lakekeeper", "http://h"), RestCatalog)


class FakeGlue:
    """The service in memory: pages of one entry each, and versions that updates must name."""

    def __init__(self, tables):
        self.tables, self.calls, self.fail = tables, [], None

    def __call__(self, action, request):
        self.calls.append(action)
        if action in ("GetDatabases", "GetTables"):
            if action == "GetTables" and request["DatabaseName"] == "none":
                raise GlueError("EntityNotFoundException")
            key, rows = ("DatabaseList", [{"Name": n} for n in ("a", "b")]) if action == "GetDatabases" else ("TableList", list(self.tables.values()))
            at = int(request.get("NextToken", 0))
            return {key: rows[at : at + 1]} | ({"NextToken": str(at + 1)} if at + 1 < len(rows) else {})
        name = request.get("Name") or request["TableInput"]["Name"]
        if name not in self.tables:
            raise GlueError("EntityNotFoundException")
        if action == "GetTable":
            return {"Table": self.tables[name]}
        if self.fail:
            raise self.fail
        if request["VersionId"] != self.tables[name]["VersionId"]:
            raise GlueError("ConcurrentModificationException")
        self.tables[name] = request["TableInput"] | {"VersionId": str(int(request["VersionId"]) + 1)}
        return {}


def test_glue(spark, tmp_path):
    store, at = Store(spark), f"file:{tmp_path}/t/metadata/v1.metadata.json"
    store.write(at, b'{"current-snapshot-id": 1, "snapshots": [{"snapshot-id": 1}], "x": [1]}')
    entry = {"Name": "t", "VersionId": "4", "Owner": "o", "CreateTime": 1.0, "StorageDescriptor": {"Location": "l"}, "Parameters": {"table_type": "ICEBERG", "metadata_location": at, "k": "v"}}
    fake = FakeGlue({"t": entry, "view": {"Name": "view", "Parameters": {}}, "lost": {"Name": "lost", "Parameters": {"table_type": "iceberg"}}})
    c, t = GlueCatalog(fake, store), TableId("a", "t")
    assert c.namespaces() == ["a", "b"] and [x.name for x in c.tables("a")] == ["t", "lost"] and c.tables("none") == []
    assert c.load(t)["x"] == [1]
    with pytest.raises(TableNotFound):
        c.load(TableId("a", "no"))
    with pytest.raises(ValueError):
        c.load(TableId("a", "lost"))
    c.commit(t, Transaction().current_is(1).add({"snapshot-id": 2, "sequence-number": 5}))
    assert c.load(t)["current-snapshot-id"] == 2 and c.load(t)["x"] == [1]
    now = fake.tables["t"]
    assert now["Parameters"]["k"] == "v" and now["Parameters"]["previous_metadata_location"] == at and now["Owner"] == "o" and "CreateTime" not in now and now["VersionId"] == "5"
    with pytest.raises(Conflict):
        c.commit(t, Transaction().current_is(1).remove([1]))
    documents = lambda: sorted(p for p, *_ in store.rows(f"file:{tmp_path}/t/metadata"))
    before = documents()
    for error, raised in ((GlueError("ConcurrentModificationException"), Conflict), (GlueError("AccessDeniedException"), GlueError)):
        fake.fail = error
        with pytest.raises(raised):
            c.commit(t, Transaction().current_is(2).remove([1]))
        assert documents() == before and c.load(t)["current-snapshot-id"] == 2


def test_signature_of_the_published_example():
    when = datetime(2015, 8, 30, 12, 36, tzinfo=timezone.utc)
    got = signed("wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", "AKIDEXAMPLE", "", "us-east-1", "service", "example.amazonaws.com", {}, b"", when)
    assert got["authorization"].endswith("Signature=5da7c1a2acd57cee7505fc6676e4e544621c30862966e37dddb68e92efbe5d6b")


def test_opened_catalogs(spark):
    store = Store(spark)
    assert isinstance(opened({"type": "glue", "region": "eu-west-1"}, store), GlueCatalog)
    assert isinstance(opened({"type": "filesystem", "url": "file:/x"}, store), FileCatalog)
    assert opened({"type": "nessie", "url": "http://h"}, store).url == "http://h/iceberg"


def test_store_settings():
    s3 = hadoop_settings({"type": "s3", "endpoint": "http://m:9000", "path_style": True, "region": "", "access_key_id": "a"})
    assert s3["fs.s3a.endpoint"] == "http://m:9000" and s3["fs.s3a.path.style.access"] == "true" and s3["fs.s3a.access.key"] == "a"
    assert "fs.s3a.endpoint.region" not in s3 and s3["fs.s3.impl"].endswith("S3AFileSystem")
    assert hadoop_settings({"type": "gcs", "project": "p"})["fs.gs.project.id"] == "p"
    azure = hadoop_settings({"type": "azure", "container": "c", "connection_string": "AccountName=acc;AccountKey=k==;EndpointSuffix=core.windows.net"})
    assert azure["fs.azure.account.key.acc.dfs.core.windows.net"] == "k==" and azure["fs.defaultFS"] == "abfss://c@acc.dfs.core.windows.net/"
    assert hadoop_settings({"type": "local"}) == {}


def test_listing_in_runs(spark, tmp_path, monkeypatch):
    store = Store(spark)
    names = [f"d{k % 7}/e{k % 3}/f{k}" for k in range(60)] + ["_h/.x/y", "odd; name/{path=z}", "top"]
    for n in names:
        store.write(f"file:{tmp_path}/l/{n}", n.encode())
    for run in (7, 50_000):
        monkeypatch.setattr(store_module, "RUN", run)
        got = {r.path.split("/l/")[1]: r.length for r in store.listing(f"file:{tmp_path}/l").collect()}
        assert got == {n: len(n) for n in names}
    assert store.listing(f"file:{tmp_path}/none").collect() == []
    assert store.delete_all(f"file:{tmp_path}/l/{n}" for n in [*names, "gone"]) == (len(names), [])


def test_running_sums_in_a_hot_group(spark):
    rows = [("hot" if k % 5 else None, k * 37 % 500, k % 11) for k in range(500)]
    df = spark.createDataFrame(rows, "part string, k long, sz long").repartition(3)
    got = {(r.part, r.k): r.before for r in running(df, "part", "k", F.col("sz")).collect()}
    assert got == {(p, k): sum(s for q, j, s in rows if q == p and j < k) for p, k, s in rows}
    halves = {(r.part, r.k): r.half for r in compaction.halves(df, "part", "k").collect()}
    for p in ("hot", None):
        keys = sorted(k for q, k, _ in rows if q == p)
        assert [halves[p, k] for k in keys] == [0] * (len(keys) // 2) + [1] * (len(keys) - len(keys) // 2)


def test_layout_tells_disorder(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (1, 3, 2, None)], "k long").coalesce(1).write.parquet(f"{tmp_path}/bad")
    spark.createDataFrame([(k,) for k in (2, 5)], "k long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/bad")
    assert tuple(compaction.layout(spark.read.parquet(f"{tmp_path}/bad"), ["k"]).first()) == (6, 2, 1, 1)
    assert tuple(compaction.layout(spark.read.parquet(f"{tmp_path}/bad"), ["k"]).first())[0] == 6


def test_files_whose_types_clash_are_read_in_few_scans(spark, tmp_path):
    for k in range(6):
        spark.range(k, k + 1).select(F.col("id").cast("int" if k < 3 else "long").alias("a"), *([F.lit(k).alias(f"only{k}")] if k % 2 else [])).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    df = parquet.read_by_name(spark, [f"{tmp_path}/{k}" for k in range(6)], "from")
    assert sorted((r.a, r.only3, r["from"].split("/")[-2]) for r in df.collect()) == [(k, 3 if k == 3 else None, str(k)) for k in range(6)]
    assert len(parquet._scans(spark, [f"{tmp_path}/{k}" for k in range(6)])) == 2
