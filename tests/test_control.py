import json
import time
import urllib.error
import urllib.request
from datetime import datetime, timezone

import pytest

from icekeel.functions import backoff
from icekeel.operators.rollups import BUCKETS
from icekeel.plans import config as C
from icekeel.plans.maintenance import CompactionResult, ExpiryResult, OrphanResult
from icekeel.plans.metrics import Registry
from icekeel.plans.retry import Conflict, recoverable, retried
from icekeel.plans.scheduler import Scheduler
from icekeel.sources.catalog import TableId
from icekeel.streaming.trigger import every

YAML = """
catalog: {type: nessie, url: "http://c"}
storage: {type: s3}
maintenance:
  defaults: {compaction: {enabled: true, min_file_count: 7}}
  namespaces:
    raw: {compaction: {enabled: false, strategy: sort, sort_keys: [ts]}, orphan_cleanup: {grace_period_hours: 48}}
  tables:
    raw.clicks: {compaction: {min_file_count: 2}}
scheduler: {interval: 1m30s, retry: {max_attempts: 3}}
"""


def test_policies_merge_with_defaults_only():
    c = C.parse(YAML)
    table, space, other = C.policy_for(c, "raw", "clicks"), C.policy_for(c, "raw", "x"), C.policy_for(c, "web", "x")
    assert (table.compaction.enabled, table.compaction.min_file_count, table.compaction.strategy, table.orphan_cleanup.grace_period_hours) == (True, 2, "binpack", 24)
    assert (space.compaction.enabled, space.compaction.sort_keys, space.compaction.min_file_count, space.orphan_cleanup.grace_period_hours) == (False, ("ts",), 7, 48)
    assert other.compaction.min_file_count == 7 and other.compaction.target_file_size_mb == 512 and C.policy_for(c, "raw.", "x") == space
    assert C.seconds(c.scheduler.interval) == 90 and c.scheduler.retry == C.Retry(3) and not C.enabled(C.Compaction())


def test_zero_is_a_value_unless_asked_otherwise():
    raw = {"compaction": {"min_file_age_minutes": 0}}
    assert C.merged(C.DEFAULTS, C.policy(raw)).compaction.min_file_age_minutes == 0
    assert C.merged(C.DEFAULTS, C.policy(raw, zero_unset=True)).compaction.min_file_age_minutes == 60


@pytest.mark.parametrize(
    "change",
    [("nessie", "odd"), ("type: s3", "type: azure"), ("type: s3", "type: x"), ("1m30s", "soon"), ("max_attempts: 3", "max_delay: 0s"), ("interval: 1m30s", "max_concurrent_jobs: -1"), ("interval: 1m30s", "memory_limit: lots"), ("min_file_count: 7", "min_files: 7"), ("catalog:", "catalog: [")],
)
def test_bad_configurations(change):
    with pytest.raises(ValueError):
        C.parse(YAML.replace(*change))


@pytest.mark.parametrize(("text", "want"), [("5m", 300), ("200ms", 0.2), ("1h30m", 5400), ("-1.5s", -1.5), ("0", 0)])
def test_durations(text, want):
    assert C.seconds(text) == pytest.approx(want)


def test_retry_and_backoff():
    calls, slept = [], []

    def f(k):
        calls.append(k)
        if k < 2:
            raise Conflict
        return "ok"

    assert retried(f, 5, 0.2, 10, sleep=slept.append, rand=lambda: 0.5) == "ok"
    assert calls == [0, 1, 2] and slept == pytest.approx([0.1, 0.2])
    with pytest.raises(Conflict):
        retried(lambda k: (_ for _ in ()).throw(Conflict()), 3, 0, 1, sleep=slept.append)
    with pytest.raises(KeyError):
        retried(lambda k: {}[k], 3, 0, 1)
    assert backoff.bound(500, 0.2, 10) == 10 and backoff.bound(0, 0, 10) == 0
    for k in range(12):
        assert all(0 <= backoff.delay(k, 0.2, 10) <= min(0.2 * 2**k, 10) for _ in range(50))
    assert recoverable(MemoryError()) and recoverable(Exception("ExecutorLostFailure (x)")) and not recoverable(ValueError("x"))


def test_metrics_text():
    r = Registry()
    r.compaction("a.b", 3, 30, 10, 0.3, True)
    r.compaction("a.b", 0, 0, 0, 400, False)
    r.expiry("a.b", 1, 2, 3, 0.1, True)
    r.orphan('q"\n', 9, 1, 2, 0.1, False)
    r.gauge("cycle_tables_total", 2)
    t = r.text()
    assert 'icekeel_compaction_jobs_total{status="success",table="a.b"} 1' in t and 'icekeel_compaction_files_merged_total{table="a.b"} 3' in t
    assert 'icekeel_compaction_duration_seconds_bucket{status="success",table="a.b",le="0.25"} 0' in t
    assert 'icekeel_compaction_duration_seconds_bucket{status="error",table="a.b",le="300"} 0' in t and 'le="+Inf"} 1' in t
    assert 'table="q\\"\\n"' in t and "icekeel_cycle_tables_total 2" in t and len(BUCKETS) == 15


class FakeCatalog:
    def namespaces(self):
        return ["a", "broken"]

    def tables(self, namespace):
        if namespace == "broken":
            raise OSError
        return [TableId("a", "t"), TableId("a", "quiet")]


class FakeMaintainer:
    catalog = FakeCatalog()

    def recover(self, table, now):
        pass

    def candidates(self, table, policy, now):
        return ["c1", "c2"] if table.name == "t" else []

    def compact(self, table, c, policy, now):
        if c == "c2":
            raise OSError("no")
        return CompactionResult(["x", "y"], ["z"], 10, 5, 0.1)

    def expire(self, table, policy, now):
        if table.name == "t":
            raise OSError("down")
        return ExpiryResult()

    def clean(self, table, policy, now):
        return OrphanResult(5, 1 if table.name == "t" else 0, 2)


def test_cycle_status_and_endpoints():
    s = Scheduler(C.parse(YAML), FakeMaintainer(), clock=lambda: datetime(2026, 1, 1, tzinfo=timezone.utc))
    server = s.serve("127.0.0.1:0")
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}", timeout=5).read().decode()
    with pytest.raises(urllib.error.HTTPError) as e:
        get("/status")
    assert e.value.code == 503 and get("/healthz") == "ok"
    s.cycle()
    t, quiet = json.loads(get("/status"))["tables"]
    assert t["compaction"] == {"jobs": 1, "files_merged": 2, "bytes_before": 10, "bytes_after": 5, "errors": 1}
    assert t["expiry"]["error"] == "down" and t["orphan"] == {"scanned_files": 5, "deleted_files": 1, "skipped_files": 2}
    assert quiet == {"table": "a.quiet"} and "cycle_tables_total 2" in get("/metrics")
    server.shutdown()


def test_run_stops():
    s = Scheduler(C.parse(YAML), FakeMaintainer())
    cycle, n = s.cycle, []
    s.cycle = lambda: (cycle(), n.append(1), s.stop())
    s.run()
    assert n == [1]


def test_streaming_trigger(spark, tmp_path):
    n = []
    q = every(spark, "1 second", lambda: n.append(1), f"file:{tmp_path}/cp")
    for _ in range(100):
        if n:
            break
        time.sleep(0.2)
    q.stop()
    assert n
