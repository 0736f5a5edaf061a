"""Catalogs: transactions, a catalog in a store, and the REST protocol."""

from __future__ import annotations

import copy
import hashlib
import hmac
import json
import os
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any, Protocol

from icekeel.plans.retry import Conflict
from icekeel.sources.store import Store


@dataclass(frozen=True)
class TableId:
    namespace: str
    name: str

    def __str__(self) -> str:
        return f"{self.namespace}.{self.name}"


class TableNotFound(Exception):
    pass


@dataclass
class Transaction:
    """Requirements that must hold, and updates that are applied together."""

    requirements: list[dict[str, Any]] = field(default_factory=list)
    updates: list[dict[str, Any]] = field(default_factory=list)

    def current_is(self, snapshot_id: int | None) -> Transaction:
        self.requirements.append({"type": "assert-current-snapshot-id", "snapshot-id": snapshot_id})
        return self

    def add(self, snapshot: dict) -> Transaction:
        self.updates += [{"action": "add-snapshot", "snapshot": snapshot}, {"action": "set-snapshot-ref", "ref-name": "main", "snapshot-id": snapshot["snapshot-id"]}]
        return self

    def remove(self, ids: list[int]) -> Transaction:
        self.updates.append({"action": "remove-snapshots", "snapshot-ids": ids})
        return self


class Catalog(Protocol):
    def namespaces(self) -> list[str]: ...
    def tables(self, namespace: str) -> list[TableId]: ...
    def load(self, table: TableId) -> dict: ...
    def commit(self, table: TableId, tx: Transaction) -> None: ...


def current_snapshot(meta: dict) -> dict | None:
    return next((s for s in meta.get("snapshots") or [] if s["snapshot-id"] == meta.get("current-snapshot-id")), None)


def check_requirements(meta: dict, tx: Transaction) -> None:
    """Raises Conflict where the current snapshot is another, ValueError for unknown requirements."""
    for r in tx.requirements:
        if r["type"] != "assert-current-snapshot-id":
            raise ValueError(f"unknown requirement {r['type']!r}")
        if (meta.get("current-snapshot-id") or None) != (r["snapshot-id"] or None):
            raise Conflict(f"current snapshot is {meta.get('current-snapshot-id')}, not {r['snapshot-id']}")


def apply_updates(meta: dict, tx: Transaction) -> dict:
    """New metadata; meta is not changed and keys that are unknown here stay."""
    out = copy.deepcopy(meta)
    for u in tx.updates:
        if u["action"] == "add-snapshot":
            out["snapshots"] = [*(out.get("snapshots") or []), copy.deepcopy(u["snapshot"])]
            out["last-sequence-number"] = max(out.get("last-sequence-number") or 0, u["snapshot"].get("sequence-number") or 0)
        elif u["action"] == "set-snapshot-ref":
            if u["ref-name"] != "main":
                raise ValueError("only main can be set")
            out["current-snapshot-id"] = u["snapshot-id"]
            if "refs" in out:
                out["refs"] = out["refs"] | {"main": {**out["refs"].get("main", {"type": "branch"}), "snapshot-id": u["snapshot-id"]}}
        elif u["action"] == "remove-snapshots":
            gone = set(u["snapshot-ids"])
            out["snapshots"] = [s for s in out.get("snapshots") or [] if s["snapshot-id"] not in gone]
        else:
            raise ValueError(f"unknown update {u['action']!r}")
    return out


def next_metadata_location(location: str) -> str:
    """A new document beside the given one."""
    return f"{location.rpartition('/')[0]}/{uuid.uuid4()}.metadata.json"


class FileCatalog:
    """A catalog in a store: <root>/<namespace>/<table>/metadata/v<n>.metadata.json, the largest n counts.

    A commit creates the next document, which fails if another writer has; that is a conflict.
    """

    def __init__(self, store: Store, root: str):
        self.store, self.root, self.locks, self.guard = store, root.rstrip("/"), {}, threading.Lock()

    def _lock(self, table: TableId) -> threading.Lock:
        with self.guard:
            return self.locks.setdefault(str(table), threading.Lock())

    def location(self, table: TableId) -> str:
        return f"{self.root}/{table.namespace.replace('.', '/')}/{table.name}"

    def _versions(self) -> list[tuple[TableId, int]]:
        out = []
        base = self.store._at(self.root)[1].toUri().getPath().rstrip("/")
        for path, *_ in self.store.rows(self.root):
            parts = path.split(base + "/", 1)[-1].split("/")
            if len(parts) >= 4 and parts[-2] == "metadata" and parts[-1].startswith("v") and parts[-1].endswith(".metadata.json"):
                out.append((TableId(".".join(parts[:-3]), parts[-3]), int(parts[-1][1 : -len(".metadata.json")])))
        return out

    def namespaces(self) -> list[str]:
        return sorted({t.namespace for t, _ in self._versions()})

    def tables(self, namespace: str) -> list[TableId]:
        return sorted({t for t, _ in self._versions() if t.namespace == namespace}, key=str)

    def _last(self, table: TableId) -> int:
        names = [p.rpartition("/")[2] for p, *_ in self.store.rows(f"{self.location(table)}/metadata")]
        return max((int(n[1 : -len(".metadata.json")]) for n in names if n.startswith("v") and n.endswith(".metadata.json")), default=0)

    def create(self, table: TableId, meta: dict) -> None:
        self.store.write(f"{self.location(table)}/metadata/v1.metadata.json", json.dumps(meta).encode(), False)

    def load(self, table: TableId) -> dict:
        n = self._last(table)
        if not n:
            raise TableNotFound(str(table))
        return json.loads(self.store.read(f"{self.location(table)}/metadata/v{n}.metadata.json"))

    def commit(self, table: TableId, tx: Transaction) -> None:
        with self._lock(table):
            n = self._last(table)
            if not n:
                raise TableNotFound(str(table))
            meta = json.loads(self.store.read(f"{self.location(table)}/metadata/v{n}.metadata.json"))
            check_requirements(meta, tx)
            try:
                self.store.write(f"{self.location(table)}/metadata/v{n + 1}.metadata.json", json.dumps(apply_updates(meta, tx)).encode(), False)
            except FileExistsError as e:
                raise Conflict(str(table)) from e


class Tokens:
    """Client-credential tokens, renewed 30 s early; requests run outside the lock."""

    def __init__(self, url: str, client_id: str, secret: str, timeout: float = 30.0, clock=time.monotonic):
        self.url, self.form, self.timeout, self.clock = url, {"grant_type": "client_credentials", "client_id": client_id, "client_secret": secret}, timeout, clock
        self.lock, self.token, self.until = threading.Lock(), "", 0.0

    def get(self) -> str:
        with self.lock:
            if self.token and self.clock() < self.until:
                return self.token
        with urllib.request.urlopen(urllib.request.Request(self.url, urllib.parse.urlencode(self.form).encode()), timeout=self.timeout) as r:
            got = json.load(r)
        with self.lock:
            self.token, self.until = got["access_token"], self.clock() + got.get("expires_in", 0) - 30
            return got["access_token"]


class RestCatalog:
    """The REST catalog protocol: paged listings, typed errors, one idempotency key for each request."""

    def __init__(self, url: str, client_id: str = "", secret: str = "", token_uri: str = "", timeout: float = 30.0):
        self.url, self.timeout = url.rstrip("/"), timeout
        self.tokens = Tokens(token_uri or f"{self.url}/oauth/tokens", client_id, secret, timeout) if client_id else None

    def _call(self, method: str, path: str, body: dict | None = None) -> dict:
        headers = {"Content-Type": "application/json", "Idempotency-Key": str(uuid.uuid4())}
        if self.tokens:
            headers["Authorization"] = f"Bearer {self.tokens.get()}"
        request = urllib.request.Request(self.url + path, json.dumps(body).encode() if body is not None else None, headers, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                raw = r.read()
                return json.loads(raw) if raw else {}
        except urllib.error.HTTPError as e:
            if e.code == 409:
                raise Conflict(path) from e
            if e.code == 404:
                raise TableNotFound(path) from e
            raise OSError(f"{method} {path}: HTTP {e.code}: {e.read(256)!r}") from e

    def _pages(self, path: str, key: str) -> list:
        out, token = [], ""
        while True:
            page = self._call("GET", path + (f"?pageToken={urllib.parse.quote(token, '')}" if token else ""))
            out += page.get(key) or []
            token = page.get("next-page-token") or ""
            if not token:
                return out

    @staticmethod
    def _space(namespace: str) -> str:
        return urllib.parse.quote(namespace.replace(".", "\x1f"), "")

    def namespaces(self) -> list[str]:
        return [".".join(n) for n in self._pages("/v1/namespaces", "namespaces")]

    def tables(self, namespace: str) -> list[TableId]:
        try:
            found = self._pages(f"/v1/namespaces/{self._space(namespace)}/tables", "identifiers")
        except TableNotFound:
            return []
        return [TableId(".".join(t["namespace"]), t["name"]) for t in found]

    def _path(self, table: TableId) -> str:
        return f"/v1/namespaces/{self._space(table.namespace)}/tables/{urllib.parse.quote(table.name, '')}"

    def load(self, table: TableId) -> dict:
        return self._call("GET", self._path(table))["metadata"]

    def commit(self, table: TableId, tx: Transaction) -> None:
        """In the protocol's own form: a reference that must stand, and updates."""
        requirements = [{"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": r["snapshot-id"]} for r in tx.requirements]
        updates = [u | ({"type": "branch"} if u["action"] == "set-snapshot-ref" else {}) for u in tx.updates]
        self._call("POST", self._path(table), {"identifier": {"namespace": table.namespace.split("."), "name": table.name}, "requirements": requirements, "updates": updates})


def rest(kind: str, url: str, **credential: str) -> RestCatalog:
    """A REST catalog as lakekeeper, polaris or nessie serve it; nessie under /iceberg."""
    base = url.rstrip("/") + ("/iceberg" if kind == "nessie" else "")
    return RestCatalog(base, credential.get("client_id", ""), credential.get("client_secret", ""), credential.get("token_uri", ""))


def is_iceberg(parameters: dict[str, str]) -> bool:
    """Whether a catalog entry with these parameters is a table of this format."""
    return parameters.get("table_type", "").lower() == "iceberg"


class GlueError(Exception):
    """An error of the service, with its name."""

    def __init__(self, name: str, message: str = ""):
        super().__init__(f"{name}: {message}")
        self.name = name


class GlueCatalog:
    """Databases of the Glue service as namespaces; metadata documents lie in the store, and an entry points to its last one.

    call(action, request) answers a request of the service's JSON protocol and raises GlueError. An update names
    the version that it was made from, so that the service refuses it after another writer's.
    """

    #: The parameter that points to the document, and what an update may hold of an entry.
    POINTER = "metadata_location"
    INPUT = ("Name", "Description", "Owner", "LastAccessTime", "LastAnalyzedTime", "Retention", "StorageDescriptor", "PartitionKeys", "ViewOriginalText", "ViewExpandedText", "TableType", "Parameters", "TargetTable")
    LATE = ("ConcurrentModificationException", "ConditionCheckFailureException", "VersionMismatchException")

    def __init__(self, call: Callable[[str, dict], dict], store: Store):
        self.call, self.store, self.locks, self.guard = call, store, {}, threading.Lock()

    def _pages(self, action: str, request: dict, key: str) -> Iterator[dict]:
        token: dict = {}
        while True:
            page = self.call(action, request | token)
            yield from page.get(key) or []
            if not page.get("NextToken"):
                return
            token = {"NextToken": page["NextToken"]}

    def namespaces(self) -> list[str]:
        return [d["Name"] for d in self._pages("GetDatabases", {}, "DatabaseList")]

    def tables(self, namespace: str) -> list[TableId]:
        """Tables of this format; none for an unknown database."""
        try:
            return [TableId(namespace, t["Name"]) for t in self._pages("GetTables", {"DatabaseName": namespace}, "TableList") if is_iceberg(t.get("Parameters") or {})]
        except GlueError as e:
            if e.name == "EntityNotFoundException":
                return []
            raise

    def _entry(self, table: TableId) -> tuple[dict, str]:
        try:
            entry = self.call("GetTable", {"DatabaseName": table.namespace, "Name": table.name})["Table"]
        except GlueError as e:
            if e.name == "EntityNotFoundException":
                raise TableNotFound(str(table)) from e
            raise
        at = (entry.get("Parameters") or {}).get(self.POINTER)
        if not at:
            raise ValueError(f"{table} has no {self.POINTER}")
        return entry, at

    def load(self, table: TableId) -> dict:
        return json.loads(self.store.read(self._entry(table)[1]))

    def commit(self, table: TableId, tx: Transaction) -> None:
        with self.guard:
            lock = self.locks.setdefault(str(table), threading.Lock())
        with lock:
            entry, at = self._entry(table)
            meta = json.loads(self.store.read(at))
            check_requirements(meta, tx)
            new = next_metadata_location(at)
            self.store.write(new, json.dumps(apply_updates(meta, tx)).encode(), False)
            updated = {k: entry[k] for k in self.INPUT if k in entry} | {"Parameters": entry["Parameters"] | {self.POINTER: new, f"previous_{self.POINTER}": at}}
            request = {"DatabaseName": table.namespace, "TableInput": updated, "SkipArchive": True} | ({"VersionId": entry["VersionId"]} if entry.get("VersionId") else {})
            try:
                self.call("UpdateTable", request)
            except GlueError as e:
                self.store.delete(new)
                if e.name in self.LATE:
                    raise Conflict(str(table)) from e
                raise


def signed(secret: str, key: str, token: str, region: str, service: str, host: str, headers: dict[str, str], body: bytes, now: datetime) -> dict[str, str]:
    """headers of a POST to / with a version 4 signature."""
    day, moment = now.strftime("%Y%m%d"), now.strftime("%Y%m%dT%H%M%SZ")
    headers = {k.lower(): v for k, v in headers.items()} | {"host": host, "x-amz-date": moment} | ({"x-amz-security-token": token} if token else {})
    names, scope = ";".join(sorted(headers)), f"{day}/{region}/{service}/aws4_request"
    canonical = "\n".join(["POST", "/", "", *(f"{k}:{headers[k].strip()}" for k in sorted(headers)), "", names, hashlib.sha256(body).hexdigest()])
    own = f"AWS4{secret}".encode()
    for part in scope.split("/"):
        own = hmac.digest(own, part.encode(), "sha256")
    signature = hmac.digest(own, "\n".join(["AWS4-HMAC-SHA256", moment, scope, hashlib.sha256(canonical.encode()).hexdigest()]).encode(), "sha256").hex()
    return headers | {"authorization": f"AWS4-HMAC-SHA256 Credential={key}/{scope}, SignedHeaders={names}, Signature={signature}"}


def glue(region: str, store: Store, endpoint: str = "", environment: Mapping[str, str] = os.environ, timeout: float = 30.0) -> GlueCatalog:
    """The service of a region, with credentials from the usual environment variables."""
    url = endpoint or f"https://glue.{region}.amazonaws.com"
    host = urllib.parse.urlsplit(url).netloc

    def call(action: str, request: dict) -> dict:
        body = json.dumps(request).encode()
        headers = {"Content-Type": "application/x-amz-json-1.1", "X-Amz-Target": f"AWSGlue.{action}"}
        credential = [environment.get(f"AWS_{n}", "") for n in ("SECRET_ACCESS_KEY", "ACCESS_KEY_ID", "SESSION_TOKEN")]
        ready = signed(*credential, region, "glue", host, headers, body, datetime.now(timezone.utc))
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, ready, method="POST"), timeout=timeout) as r:
                return json.loads(r.read() or b"{}")
        except urllib.error.HTTPError as e:
            raw = e.read()
            try:
                found = json.loads(raw)
            except ValueError:
                found = {}
            raise GlueError(str(found.get("__type", e.code)).rpartition("#")[2], str(found.get("message") or found.get("Message") or "")) from e

    return GlueCatalog(call, store)


def opened(section: dict[str, Any], store: Store, root: str = "") -> Catalog:
    """The catalog that a section of the configuration names."""
    if section["type"] == "filesystem":
        return FileCatalog(store, root or section.get("url", ""))
    if section["type"] == "glue":
        return glue(section.get("region") or os.environ.get("AWS_REGION", ""), store, section.get("url") or "")
    return rest(section["type"], section["url"], **(section.get("credential") or {}))
