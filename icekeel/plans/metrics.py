"""Counters, histograms and gauges, shown as Prometheus text."""

from __future__ import annotations

import threading
from collections import defaultdict

from icekeel.operators.rollups import BUCKETS


class Registry:
    def __init__(self, prefix: str = "icekeel"):
        self.prefix, self.lock = prefix, threading.Lock()
        self.counters: dict[tuple[str, tuple], float] = defaultdict(float)
        self.gauges: dict[str, float] = {}
        self.times: dict[tuple[str, tuple], list] = defaultdict(lambda: [[0] * len(BUCKETS), 0.0, 0])

    def count(self, name: str, n: float = 1, **labels: str) -> None:
        with self.lock:
            self.counters[name, tuple(sorted(labels.items()))] += n

    def gauge(self, name: str, value: float) -> None:
        with self.lock:
            self.gauges[name] = value

    def observe(self, name: str, seconds: float, **labels: str) -> None:
        with self.lock:
            h = self.times[name, tuple(sorted(labels.items()))]
            h[0] = [n + (seconds <= b) for n, b in zip(h[0], BUCKETS, strict=True)]
            h[1], h[2] = h[1] + seconds, h[2] + 1

    def compaction(self, table: str, files: int, before: int, after: int, seconds: float, ok: bool) -> None:
        status = "success" if ok else "error"
        self.count("compaction_jobs_total", table=table, status=status)
        self.observe("compaction_duration_seconds", seconds, table=table, status=status)
        if ok:
            for name, n in (("files_merged", files), ("bytes_read", before), ("bytes_written", after)):
                self.count(f"compaction_{name}_total", n, table=table)

    def expiry(self, table: str, snapshots: int, manifests: int, files: int, seconds: float, ok: bool) -> None:
        self.observe("expiry_duration_seconds", seconds, table=table, status="success" if ok else "error")
        for name, n in (("snapshots_expired", snapshots), ("manifests_deleted", manifests), ("data_files_deleted", files)):
            self.count(f"expiry_{name}_total", n, table=table)

    def orphan(self, table: str, scanned: int, deleted: int, skipped: int, seconds: float, ok: bool) -> None:
        self.observe("orphan_duration_seconds", seconds, table=table, status="success" if ok else "error")
        for name, n in (("scanned", scanned), ("deleted", deleted), ("skipped", skipped)):
            self.count(f"orphan_files_{name}_total", n, table=table)

    def text(self) -> str:
        """All values in the text format, by name."""

        def name(n: str, labels: tuple, more: tuple = ()) -> str:
            quoted = ",".join('{}="{}"'.format(k, str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")) for k, v in (*labels, *more))
            return f"{self.prefix}_{n}" + (f"{{{quoted}}}" if quoted else "")

        with self.lock:
            out = [f"{name(n, labels)} {v:g}" for (n, labels), v in self.counters.items()] + [f"{name(n, ())} {v:g}" for n, v in self.gauges.items()]
            for (n, labels), (counts, total, k) in self.times.items():
                out += [f"{name(n + '_bucket', labels, (('le', f'{b:g}'),))} {c}" for b, c in zip(BUCKETS, counts, strict=True)]
                out += [f"{name(n + '_bucket', labels, (('le', '+Inf'),))} {k}", f"{name(n + '_sum', labels)} {total:g}", f"{name(n + '_count', labels)} {k}"]
        return "\n".join(sorted(out)) + "\n"
