"""Control plane: admission, planning, revisions, leases, retention, backoff and metrics text."""

from __future__ import annotations

import hashlib
import json
import time
import tomllib
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import ContractError, Kind, spark_type
from ..functions.values import uuid7
from .commits import Commits, StaleVersion

# Phases of a pipeline and the moves between them.
PHASES = {
    "stopped": {"starting"}, "starting": {"snapshotting", "streaming", "failed", "stopping"}, "snapshotting": {"catching_up", "failed", "stopping"},
    "catching_up": {"streaming", "failed", "stopping", "degraded"}, "streaming": {"degraded", "failed", "stopping"}, "degraded": {"starting", "stopping", "failed"},
    "failed": {"starting", "stopping"}, "stopping": {"stopped", "failed"},
}
# Defaults and hard caps of settings.
LIMITS = {"max_rows": (10_000, 1_000_000), "max_bytes": (16 << 20, 1 << 30), "max_delay_ms": (250, 60_000), "max_changes": (1_000_000, 10_000_000), "retention_s": (10, 3_600), "quarantine_days": (30, 3_650), "gc_tables": (100, 1_000)}
# Fixed value: columns of operations.
OPERATION = "id string, pipeline string, kind string, generation long, state string, at double"


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind
    nullable: bool = True
    key: int | None = None
    generated: str = "none"


@dataclass(frozen=True)
class Table:
    schema: str
    name: str
    columns: tuple[Column, ...]
    kind: str = "ordinary"
    identity: str = "default"
    distribution: tuple[str, ...] = ()

    def keys(self) -> list[str]:
        return [c.name for c in sorted((c for c in self.columns if c.key), key=lambda c: c.key)]


def admit(table: Table) -> str | None:
    """Why a table can't be mirrored, or None."""
    if table.kind not in ("ordinary", "hash_distributed"):
        return f"kind {table.kind}"
    if not table.keys():
        return "no primary key"
    if table.identity != "default":
        return f"replica identity {table.identity}"
    names = [c.name for c in table.columns]
    if len(set(names)) != len(names):
        return "duplicate column"
    if any(c.generated == "virtual" for c in table.columns):
        return "virtual column"
    if not set(table.distribution) <= set(table.keys()):
        return "primary key lacks the distribution key"
    for c in table.columns:
        try:
            spark_type(c.kind)
        except ContractError as e:
            return f"{c.name}: {e}"
    return None


def plan(tables: list[Table], prefix: str, database: str, explicit: dict | None = None) -> dict[str, str]:
    """Source table -> target name; ContractError on a rejected table or a clash."""
    explicit, out = explicit or {}, {}
    unknown = set(explicit) - {f"{t.schema}.{t.name}" for t in tables}
    if unknown:
        raise ContractError(f"unknown tables {sorted(unknown)}")
    for t in tables:
        if reason := admit(t):
            raise ContractError(f"{t.schema}.{t.name}: {reason}")
        source = f"{t.schema}.{t.name}"
        out[source] = explicit.get(source) or f"{shorten('__'.join((prefix, database, t.schema)))}.{shorten(t.name)}"
    if len(set(out.values())) != len(out):
        raise ContractError("two tables share a target")
    return out


def shorten(name: str, limit: int = 63) -> str:
    raw = name.encode()
    if len(raw) <= limit:
        return name
    return raw[: limit - 25].decode("utf-8", "ignore") + "_" + hashlib.sha256(raw).hexdigest()[:24]


def fingerprint(table: Table) -> str:
    """Identity of a schema, free of ids and generations."""
    body = [table.schema, table.name, table.kind, table.identity, [[c.name, repr(c.kind), c.nullable, c.key, c.generated] for c in table.columns], list(table.distribution)]
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def setting(name: str, value: int | None) -> int:
    default, cap = LIMITS[name]
    value = default if value is None else value
    if not 1 <= value <= cap:
        raise ContractError(f"{name} must be between 1 and {cap}")
    return value


def advance(phase: str, to: str) -> str:
    if to not in PHASES[phase]:
        raise ContractError(f"{phase} can't become {to}")
    return to


def backoff(attempt: int, initial: float = 1.0, most: float = 60.0) -> float:
    return min(most, initial * 2 ** min(attempt, 62))


@dataclass
class Control:
    """Sources, targets, pipelines with their revisions, leases, operations and audit; one document, changed as a whole.
    Operations added in bulk lie in tables beside it; it holds the tables' names and up to where their rebuilds are done."""

    sources: dict = field(default_factory=dict)
    targets: dict = field(default_factory=dict)
    pipelines: dict = field(default_factory=dict)
    revisions: list = field(default_factory=list)
    leases: dict = field(default_factory=dict)
    operations: list = field(default_factory=list)
    operation_tables: list = field(default_factory=list)
    audit: list = field(default_factory=list)
    format: int = 2

    def _note(self, action: str, name: str, now: float) -> None:
        self.audit.append({"at": now, "action": action, "name": name})

    def put(self, kind: str, name: str, settings: dict, now: float | None = None) -> None:
        """Add or replace a source or target; secrets are never stored."""
        if kind not in ("sources", "targets") or not name:
            raise ContractError(f"{kind} {name!r}")
        if {"password", "secret", "token"} & {k.lower() for k in settings}:
            raise ContractError("settings must not hold secrets")
        getattr(self, kind)[name] = settings
        self._note(f"put {kind}", name, now or time.time())

    def upsert(self, name: str, definition: dict, revision: int, generation: int, now: float | None = None) -> None:
        old = self.pipelines.get(name)
        if old and not (revision > old["revision"] and generation > old["generation"]):
            raise ContractError("revision and generation must both rise")
        self.pipelines[name] = {"definition": definition, "revision": revision, "generation": generation, "running": bool(old and old["running"])}
        self.revisions.append({"pipeline": name, "revision": revision, "generation": generation, "definition": definition, "at": now or time.time()})
        self._note("upsert", name, now or time.time())

    def desire(self, name: str, running: bool, now: float | None = None) -> None:
        """Whether a pipeline should run; its revision stays."""
        self.pipelines[name]["running"] = running
        self._note("start" if running else "pause", name, now or time.time())

    def request_rebuild(self, name: str, now: float | None = None) -> int:
        p = self.pipelines[name]
        p["generation"] += 1
        self.operations.append({"id": uuid7(), "pipeline": name, "kind": "rebuild", "generation": p["generation"], "state": "requested", "at": now or time.time()})
        self._note("rebuild", name, now or time.time())
        return p["generation"]

    def complete_rebuilds(self, name: str, generation: int) -> int:
        """Finish requested rebuilds up to ``generation``; operations whose generation is no number stay.  Counts those of
        the document; ``ControlStore.complete_rebuilds`` counts those of its tables too."""
        done = [o for o in self.operations if o["pipeline"] == name and o["kind"] == "rebuild" and o["state"] == "requested" and type(o["generation"]) is int and o["generation"] <= generation]
        for o in done:
            o["state"] = "completed"
        for t in self.operation_tables:
            t["completed"][name] = max(generation, t["completed"].get(name, generation))
        return len(done)

    def acquire(self, name: str, holder: str, ttl: float, now: float) -> int | None:
        """Fencing token, or None while another holder's lease is valid; a takeover raises the token."""
        lease = self.leases.get(name)
        if lease and lease["holder"] != holder and lease["until"] > now:
            return None
        token = 1 if not lease else lease["token"] + (lease["holder"] != holder or lease["until"] <= now)
        self.leases[name] = {"holder": holder, "token": token, "until": now + ttl}
        return token

    def renew(self, name: str, holder: str, token: int, ttl: float, now: float) -> bool:
        lease = self.leases.get(name)
        if not lease or (lease["holder"], lease["token"]) != (holder, token) or lease["until"] <= now:
            return False
        lease["until"] = now + ttl
        return True

    def release(self, name: str, holder: str, token: int) -> None:
        lease = self.leases.get(name)
        if lease and (lease["holder"], lease["token"]) == (holder, token):
            lease["until"] = 0

    def due_leases(self, holder: str) -> list[str]:
        """A holder's leases, the nearest deadline first."""
        return [k for _, k in sorted((v["until"], k) for k, v in self.leases.items() if v["holder"] == holder)]


# Document changes by format: each takes the document of the format before it.
MIGRATIONS = {1: lambda d: d, 2: lambda d: d | {"operation_tables": []}}


class ControlStore:
    """A ``Control`` that outlives the process: every change is one compare-and-swap of its document.  Operations added in
    bulk never pass the driver."""

    ATTEMPTS = 8

    def __init__(self, spark, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, f"{self.root}/_control")

    def _load(self) -> tuple[int, Control]:
        found = self.commits.read()
        if not found:
            return 0, Control()
        version, at = found.pop("version"), found.get("format", 0)
        if at > max(MIGRATIONS):
            raise ContractError(f"format {at} is newer than {max(MIGRATIONS)}")
        for n in range(at + 1, max(MIGRATIONS) + 1):
            found = MIGRATIONS[n](found) | {"format": n}
        return version, Control(**found)

    def read(self) -> Control:
        return self._load()[1]

    def change(self, act):
        """``act(control)`` on the newest state, written unless it raises; tried again if another writer was first."""
        for _ in range(self.ATTEMPTS):
            version, control = self._load()
            out = act(control)
            try:
                self.commits.publish(version + 1, asdict(control) | {"version": version + 1})
                return out
            except StaleVersion:
                continue
        raise ContractError("too many writers")

    def add_operations(self, frame: DataFrame) -> None:
        """Append operations (columns of ``OPERATION``) of known pipelines, seen as a whole once the document names their table."""
        name = f"operations-{uuid7()}"
        frame.select(*(F.col(c).cast(kind) for c, kind in map(str.split, OPERATION.split(", ")))).write.parquet(f"{self.root}/{name}")
        added = self.spark.read.schema(OPERATION).parquet(f"{self.root}/{name}")

        def act(c: Control) -> None:
            known = self.spark.createDataFrame([(n,) for n in c.pipelines], "pipeline string")
            if unknown := added.filter("pipeline is not null").join(F.broadcast(known), "pipeline", "left_anti").first():
                raise ContractError(f"unknown pipeline {unknown['pipeline']!r}")
            c.operation_tables.append({"name": name, "completed": {}})

        try:
            self.change(act)
        except ContractError:
            self.commits.fs.delete(self.commits.path(f"{self.root}/{name}"), True)
            raise

    def _stored(self, control: Control) -> DataFrame:
        """The operations of the tables with their present state."""
        tables = control.operation_tables
        done = self.spark.createDataFrame([(i, n, g) for i, t in enumerate(tables) for n, g in t["completed"].items()], "place int, pipeline string, upto long")
        parts = [self.spark.read.schema(OPERATION).parquet(f"{self.root}/{t['name']}").withColumn("place", F.lit(i)) for i, t in enumerate(tables)]
        joined = reduce(DataFrame.unionByName, parts).join(F.broadcast(done), ["place", "pipeline"], "left")
        finished = (F.col("kind") == "rebuild") & (F.col("state") == "requested") & (F.col("generation") <= F.col("upto"))
        return joined.withColumn("state", F.when(finished, "completed").otherwise(F.col("state"))).select("id", "pipeline", "kind", "generation", "state", "at")

    def operations(self) -> DataFrame:
        """All operations, those of the document and those of its tables."""
        control = self.read()
        rows = [(o["id"], o["pipeline"], o["kind"], o["generation"], o["state"], float(o["at"])) for o in control.operations]
        own = self.spark.createDataFrame(rows, OPERATION)
        return own.unionByName(self._stored(control)) if control.operation_tables else own

    def complete_rebuilds(self, names: Iterable[str], generation: int) -> int:
        """Finish requested rebuilds of some pipelines up to ``generation``, in the document and its tables; how many there were."""
        names = list(names)
        chosen = self.spark.createDataFrame([(n,) for n in names], "pipeline string")

        def act(c: Control) -> int:
            due = (F.col("kind") == "rebuild") & (F.col("state") == "requested") & (F.col("generation") <= generation)
            stored = self._stored(c).filter(due).join(F.broadcast(chosen), "pipeline", "left_semi").count() if c.operation_tables else 0
            return stored + sum(c.complete_rebuilds(n, generation) for n in names)

        return self.change(act)

    def listing(self, kind: str):
        """Sources, targets or pipelines by name, or operations, newest first and at most 200, as a DataFrame."""
        if kind == "operations":
            return self.operations().orderBy(F.desc("at"), "id").limit(200)
        rows = [(name, json.dumps(v, sort_keys=True)) for name, v in getattr(self.read(), kind).items()]
        return self.spark.createDataFrame(rows, "name string, settings string").orderBy("name")


def overview(pipelines: DataFrame, runtime: DataFrame) -> DataFrame:
    """(name, display_name, phase, received, applied, lag): pipelines with what their runtime last reported; idle where it reports nothing."""
    joined = pipelines.join(F.broadcast(runtime), "name", "left")  # one row a running pipeline
    lag = F.when(F.col("received").isNotNull(), F.greatest(F.col("received") - F.col("applied"), F.lit(0)))
    return joined.select("name", F.coalesce("title", "name").alias("display_name"), F.coalesce("phase", F.lit("idle")).alias("phase"), "received", "applied", lag.alias("lag"))


def obsolete(owned: DataFrame, defined: DataFrame) -> DataFrame:
    """Running pipelines (name, revision, generation) that are no longer defined as they run."""
    return owned.join(defined, ["name", "revision", "generation"], "left_anti")


def relation_states(managed: DataFrame, present: DataFrame) -> DataFrame:
    """(name, state): managed, managed_object_missing or unmanaged, from what is recorded and what is there."""
    both = managed.select("name", F.lit(True).alias("m")).join(present.select("name", F.lit(True).alias("p")), "name", "full")
    return both.select("name", F.when(F.col("m").isNull(), "unmanaged").when(F.col("p").isNull(), "managed_object_missing").otherwise("managed").alias("state"))


# ---------------------------------------------------------------- settings

# Keys of the settings documents.
SETTINGS = {
    "source": {"include_schemas", "exclude_schemas", "metadata_schema", "max_changes", "retention_s"},
    "target": {"quarantine_days", "gc_tables"},
    "pipeline": {"max_rows", "max_bytes", "max_delay_ms", "tables"},
}


def _no_repeats(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ContractError("a key is repeated")
    return dict(pairs)


def decode_settings(kind: str, text: str) -> dict:
    """Settings from JSON: unknown and repeated keys, wrong types and values out of bounds are refused; limits get their defaults."""
    try:
        found = json.loads(text, object_pairs_hook=_no_repeats)
    except json.JSONDecodeError as e:
        raise ContractError(f"settings are no JSON: {e}") from e
    if not isinstance(found, dict) or (unknown := sorted(set(found) - SETTINGS[kind])):
        raise ContractError(f"unknown settings {unknown if isinstance(found, dict) else found!r}")
    for name in SETTINGS[kind] & set(LIMITS):
        if name in found and type(found[name]) is not int:
            raise ContractError(f"{name} must be a whole number")
        found[name] = setting(name, found.get(name))
    for name in ("include_schemas", "exclude_schemas"):
        if not all(isinstance(x, str) and x for x in found.get(name, [])):
            raise ContractError(f"{name} must list names")
    if tables := found.get("tables"):
        check_mapping(tables)
    return found


def check_mapping(tables: dict[str, str]) -> None:
    """Explicit table names must be a bijection of valid identifiers."""
    if len(set(tables.values())) != len(tables):
        raise ContractError("two sources share a target")
    for name in [*tables, *tables.values()]:
        parts = name.split(".")
        if len(parts) != 2 or not all(0 < len(p.encode()) <= 63 and "\0" not in p for p in parts):
            raise ContractError(f"{name!r} is no qualified name")


# Sections and keys of the bootstrap file, with defaults where they have one.
BOOTSTRAP = {"store": {"root": None}, "engine": {"poll_seconds": 2, "lease_seconds": 30, "renew_seconds": 10, "backoff_seconds": 1, "backoff_most_seconds": 60, "backoff_reset_seconds": 300}, "server": {"listen": "127.0.0.1:8080"}}


def bootstrap(text: str) -> dict[str, dict]:
    """Bootstrap configuration from TOML; unknown names are refused, and renewal takes at most a third of a lease."""
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ContractError(f"bootstrap is no TOML: {e}") from e
    out = {}
    for section, names in BOOTSTRAP.items():
        own = found.pop(section, {})
        if unknown := sorted(set(own) - set(names)):
            raise ContractError(f"unknown names in [{section}]: {unknown}")
        out[section] = names | own
        if missing := sorted(k for k, v in out[section].items() if v is None):
            raise ContractError(f"[{section}] lacks {missing}")
    if found:
        raise ContractError(f"unknown sections {sorted(found)}")
    if 3 * out["engine"]["renew_seconds"] > out["engine"]["lease_seconds"]:
        raise ContractError("renewal must take at most a third of the lease")
    return out


def metrics_text(pipelines: dict[str, dict]) -> str:
    """Prometheus text of pipeline gauges."""
    escape = lambda s: s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    lines = ["# TYPE mirror_pipelines gauge", f"mirror_pipelines {len(pipelines)}"]
    for name in sorted(pipelines):
        lines += [f'mirror_{k}{{pipeline="{escape(name)}"}} {v}' for k, v in sorted(pipelines[name].items())]
    return "\n".join(lines) + "\n"
