"""Cycles over all tables, their status, and the HTTP endpoints that show it."""

from __future__ import annotations

import json
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from icekeel.plans.config import Config, Policy, policy_for, seconds
from icekeel.plans.maintenance import CompactionResult, Maintainer
from icekeel.plans.metrics import Registry
from icekeel.sources.catalog import TableId


class Scheduler:
    """Runs cycles one after the other: the first at once, then every interval; tables side by side up to a limit."""

    def __init__(self, config: Config, maintainer: Maintainer, registry: Registry | None = None, clock=lambda: datetime.now(timezone.utc)):
        self.config, self.maintainer, self.registry, self.clock = config, maintainer, registry or Registry(), clock
        self.status: dict | None = None
        self.stopped = threading.Event()

    def tables(self) -> list[TableId]:
        """Tables of all namespaces; a namespace that fails is left out."""
        out = []
        for space in self.maintainer.catalog.namespaces():
            try:
                out += self.maintainer.catalog.tables(space)
            except Exception:
                self.registry.count("cycle_namespace_errors_total", namespace=space)
        return out

    def cycle(self) -> dict:
        began, now = time.monotonic(), self.clock()
        tables = self.tables()
        with ThreadPoolExecutor(self.config.scheduler.max_concurrent_jobs) as pool:
            done = list(pool.map(lambda t: self.maintain(t, now), tables))
        took = time.monotonic() - began
        self.registry.observe("cycle_duration_seconds", took)
        self.registry.gauge("cycle_tables_total", len(tables))
        self.status = {"started_at": now.isoformat(), "finished_at": self.clock().isoformat(), "duration": f"{took:.3f}s", "tables": done}
        return self.status

    def maintain(self, table: TableId, now: datetime) -> dict:
        """Recovery, compaction, expiry, clean-up; a failure of one doesn't keep the others from running."""
        policy = policy_for(self.config, table.namespace, table.name)
        out: dict = {"table": str(table)}
        try:
            self.maintainer.recover(table, now)
        except Exception as e:
            out["recovery_error"] = str(e)[:500]
        for name, step in (("compaction", self._compaction), ("expiry", self._expiry), ("orphan", self._orphan)):
            if part := step(table, policy, now):
                out[name] = part
        return out

    def _compaction(self, table: TableId, policy: Policy, now: datetime) -> dict | None:
        total, jobs, errors = CompactionResult(), 0, 0
        found = iter(self.maintainer.candidates(table, policy, now))
        while True:
            try:
                candidate = next(found, None)
            except Exception as e:
                return {"jobs": jobs, "files_merged": len(total.inputs), "bytes_before": total.bytes_before, "bytes_after": total.bytes_after, "errors": errors + 1, "error": str(e)[:500]}
            if candidate is None:
                break
            began = time.monotonic()
            try:
                r = self.maintainer.compact(table, candidate, policy, now)
                total, jobs = total + r, jobs + 1
                self.registry.compaction(str(table), len(r.inputs), r.bytes_before, r.bytes_after, r.seconds, True)
            except Exception:
                errors += 1
                self.registry.compaction(str(table), 0, 0, 0, time.monotonic() - began, False)
        return {"jobs": jobs, "files_merged": len(total.inputs), "bytes_before": total.bytes_before, "bytes_after": total.bytes_after, "errors": errors} if jobs or errors else None

    def _expiry(self, table: TableId, policy: Policy, now: datetime) -> dict | None:
        began = time.monotonic()
        try:
            r = self.maintainer.expire(table, policy, now)
        except Exception as e:
            self.registry.expiry(str(table), 0, 0, 0, time.monotonic() - began, False)
            return {"expired_snapshots": 0, "deleted_manifests": 0, "deleted_data_files": 0, "error": str(e)[:500]}
        self.registry.expiry(str(table), len(r.expired), r.deleted_manifests, r.deleted_data_files, time.monotonic() - began, True)
        return {"expired_snapshots": len(r.expired), "deleted_manifests": r.deleted_manifests, "deleted_data_files": r.deleted_data_files} if r.expired else None

    def _orphan(self, table: TableId, policy: Policy, now: datetime) -> dict | None:
        began = time.monotonic()
        try:
            r = self.maintainer.clean(table, policy, now)
        except Exception as e:
            self.registry.orphan(str(table), 0, 0, 0, time.monotonic() - began, False)
            return {"scanned_files": 0, "deleted_files": 0, "skipped_files": 0, "error": str(e)[:500]}
        self.registry.orphan(str(table), r.scanned, r.deleted, r.skipped, time.monotonic() - began, True)
        return {"scanned_files": r.scanned, "deleted_files": r.deleted, "skipped_files": r.skipped} if r.deleted else None

    def run(self) -> None:
        """Cycles until stop(); a cycle that takes longer than the interval is followed by the next at once."""
        interval = seconds(self.config.scheduler.interval)
        while not self.stopped.is_set():
            began = time.monotonic()
            self.cycle()
            self.stopped.wait(max(0.0, interval - (time.monotonic() - began)))

    def stop(self, *_) -> None:
        """Also as a signal handler."""
        self.stopped.set()

    def serve(self, addr: str) -> ThreadingHTTPServer:
        """/metrics, /healthz and /status (503 before the first cycle) at host:port, in a thread."""
        scheduler = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                if self.path == "/healthz":
                    code, kind, body = 200, "text/plain", "ok"
                elif self.path == "/metrics":
                    code, kind, body = 200, "text/plain; version=0.0.4", scheduler.registry.text()
                elif self.path == "/status":
                    code, kind, body = (200, "application/json", json.dumps(scheduler.status)) if scheduler.status else (503, "text/plain", "no cycle has ended yet")
                else:
                    code, kind, body = 404, "text/plain", "not found"
                self.send_response(code)
                self.send_header("Content-Type", kind)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_) -> None:
                pass

        host, _, port = addr.rpartition(":")
        server = ThreadingHTTPServer((host or "0.0.0.0", int(port)), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
