"""Configuration: YAML to dataclasses, defaults, validation, and the policy of a table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from typing import Any

import yaml

from icekeel.functions.paths import checked_memory

CATALOGS, STORES = ("lakekeeper", "polaris", "nessie", "glue", "filesystem"), ("s3", "gcs", "azure", "local")
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(text: str) -> float:
    """A duration such as 1h30m, 200ms or -1.5s."""
    m = re.fullmatch(r"([+-]?)((?:\d+(?:\.\d*)?(?:ns|us|µs|ms|s|m|h))+|0)", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    total = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d*)?)(ns|us|µs|ms|s|m|h)", m[2]))
    return -total if m[1] == "-" else total


@dataclass(frozen=True)
class Compaction:
    enabled: bool | None = None
    strategy: str | None = None
    target_file_size_mb: int | None = None
    min_file_count: int | None = None
    min_file_age_minutes: int | None = None
    sort_keys: tuple[str, ...] | None = None
    z_order_columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class SnapshotExpiry:
    enabled: bool | None = None
    min_snapshots_to_keep: int | None = None
    max_snapshot_age_hours: int | None = None


@dataclass(frozen=True)
class OrphanCleanup:
    enabled: bool | None = None
    grace_period_hours: int | None = None


@dataclass(frozen=True)
class Policy:
    compaction: Compaction = field(default_factory=Compaction)
    snapshot_expiry: SnapshotExpiry = field(default_factory=SnapshotExpiry)
    orphan_cleanup: OrphanCleanup = field(default_factory=OrphanCleanup)


DEFAULTS = Policy(Compaction(False, "binpack", 512, 5, 60, (), ()), SnapshotExpiry(False, 5, 120), OrphanCleanup(False, 24))


@dataclass(frozen=True)
class Retry:
    max_attempts: int = 5
    base_delay: str = "200ms"
    max_delay: str = "10s"


@dataclass(frozen=True)
class Scheduler:
    interval: str = "5m"
    max_concurrent_jobs: int = 4
    memory_limit: str = "4GB"
    metrics_addr: str = ""
    retry: Retry = field(default_factory=Retry)


@dataclass(frozen=True)
class Config:
    debug: bool = False
    catalog: dict[str, Any] = field(default_factory=dict)
    storage: dict[str, Any] = field(default_factory=dict)
    defaults: Policy = DEFAULTS
    namespaces: dict[str, Policy] = field(default_factory=dict)
    tables: dict[str, Policy] = field(default_factory=dict)
    scheduler: Scheduler = field(default_factory=Scheduler)


def _part(kind: type, raw: dict | None, zero_unset: bool) -> Any:
    known = {f.name for f in fields(kind)}
    if unknown := set(raw or {}) - known:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in (raw or {}).items()}
    return kind(**{k: None if zero_unset and k != "enabled" and not v else v for k, v in values.items()})


def policy(raw: dict | None, zero_unset: bool = False) -> Policy:
    """A policy from its keys. Absent means inherit; with zero_unset, so do 0, "" and []."""
    raw = raw or {}
    return Policy(_part(Compaction, raw.get("compaction"), zero_unset), _part(SnapshotExpiry, raw.get("snapshot_expiry"), zero_unset), _part(OrphanCleanup, raw.get("orphan_cleanup"), zero_unset))


def merged(base: Policy, over: Policy) -> Policy:
    """base where over leaves a value unset."""

    def part(a: Any, b: Any) -> Any:
        return replace(a, **{f.name: v for f in fields(a) if (v := getattr(b, f.name)) is not None})

    return Policy(*(part(getattr(base, f.name), getattr(over, f.name)) for f in fields(Policy)))


def policy_for(config: Config, namespace: str, name: str) -> Policy:
    """The table's policy, else its namespace's (a trailing dot aside), each merged with the defaults alone."""
    spaces = {k: v for k, v in config.namespaces.items()}
    over = config.tables.get(f"{namespace}.{name}") or spaces.get(namespace) or spaces.get(namespace.rstrip("."))
    return merged(config.defaults, over) if over else config.defaults


def enabled(part: Any) -> bool:
    return bool(part.enabled)


def parse(text: str, zero_unset: bool = False) -> Config:
    """A configuration from YAML, completed and validated; every error is a ValueError."""
    try:
        raw = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"not YAML: {e}") from e
    m, s = raw.get("maintenance") or {}, dict(raw.get("scheduler") or {})
    unset = lambda kind, d: kind(**{k: v for k, v in d.items() if v not in (None, "", 0)})
    retry = dict(s.pop("retry", None) or {})
    config = Config(
        bool(raw.get("debug", False)), raw.get("catalog") or {}, raw.get("storage") or {}, merged(DEFAULTS, policy(m.get("defaults"), zero_unset)),
        {k: policy(v, zero_unset) for k, v in (m.get("namespaces") or {}).items()}, {k: policy(v, zero_unset) for k, v in (m.get("tables") or {}).items()},
        replace(unset(Scheduler, s), retry=unset(Retry, retry)),
    )
    check(config)
    return config


def check(config: Config) -> None:
    for part, known, name in ((config.catalog, CATALOGS, "catalog"), (config.storage, STORES, "storage")):
        if not part.get("type"):
            raise ValueError(f"{name}.type is required")
        if part["type"] not in known:
            raise ValueError(f"{name}.type {part['type']!r} is not supported")
    if config.storage["type"] == "azure" and not config.storage.get("container"):
        raise ValueError("storage.container is required for azure")
    s = config.scheduler
    if s.max_concurrent_jobs < 1 or s.retry.max_attempts < 1:
        raise ValueError("max_concurrent_jobs and max_attempts must be 1 at least")
    if seconds(s.interval) <= 0 or seconds(s.retry.max_delay) <= 0 or seconds(s.retry.base_delay) < 0:
        raise ValueError("interval and max_delay must be positive, base_delay not negative")
    checked_memory(s.memory_limit)
