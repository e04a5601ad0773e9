"""The source's catalog as DataFrames: tables, types, topology, publications, slots and settings.

Each function takes catalog relations with their usual column names and joins, filters and groups them; what
they refuse raises ContractError on the driver or comes back as a row with its reason.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import quote as percent

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import ContractError

SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")
# Relation kinds of the catalog.
KINDS = {"r": "ordinary", "p": "partitioned", "f": "foreign", "v": "view", "m": "materialized_view"}
IDENTITIES = {"d": "default", "n": "nothing", "f": "full", "i": "index"}


def _named(column: Column, names: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def in_schemas(schema: Column, include: list[str], exclude: list[str] = (), metadata: str = "") -> Column:
    """Whether a schema is mirrored: never a system or the metadata schema, none excluded, all if none is included."""
    asked = schema.isin(list(include)) if include else F.lit(True)
    system = schema.isin([*SYSTEM_SCHEMAS, metadata]) | schema.like("pg\\_temp\\_%") | schema.like("pg\\_toast\\_temp\\_%")
    return asked & ~system & ~schema.isin(list(exclude) or [""])


def int_vector(text: Column) -> Column:
    """Positive integers of ``{1,3,2}``; null for anything else."""
    body = F.transform(F.split(F.substring(text, 2, 1_000_000), ","), lambda x: F.regexp_replace(F.trim(x), "}$", "").cast("int"))
    return F.when(text.rlike(r"^\{\s*[1-9][0-9]*\s*(,\s*[1-9][0-9]*\s*)*\}$"), body)


def table_candidates(classes: DataFrame, namespaces: DataFrame, attributes: DataFrame, types: DataFrame, indexes: DataFrame, scope: Column | None = None) -> DataFrame:
    """(relation_id, schema_name, table_name, kind, identity, columns, key_columns) of persistent tables.

    ``columns`` is JSON, in order of attributes; a column's key ordinal is its place among the key columns (not
    the included ones) of a valid, ready and immediate primary key.
    """
    own = classes.filter(F.col("relkind").isin("r", "p") & (F.col("relpersistence") == "p")).join(namespaces.select(F.col("oid").alias("relnamespace"), "nspname"), "relnamespace")
    own = own.filter(in_schemas(F.col("nspname"), []) if scope is None else scope)
    keys = indexes.filter("indisprimary and indisvalid and indisready and indimmediate").select(F.col("indrelid").alias("oid"), F.slice(int_vector(F.col("indkey")), 1, F.col("indnkeyatts")).alias("key"))
    live = attributes.filter("attnum > 0 and not attisdropped").join(types.select(F.col("oid").alias("atttypid"), "typname"), "atttypid").select(F.col("attrelid").alias("oid"), "attnum", "attname", "typname", "atttypmod", "attnotnull", "attgenerated")
    joined = own.join(live, "oid").join(keys, "oid", "left")
    place = F.when(F.array_contains("key", F.col("attnum")), F.array_position("key", F.col("attnum")).cast("int"))
    column = F.struct(F.col("attnum").alias("attnum"), F.col("attname").alias("name"), F.col("typname").alias("type"), F.col("atttypmod").alias("modifier"), (~F.col("attnotnull")).alias("nullable"), place.alias("key"), F.col("attgenerated").alias("generated"))
    grouped = joined.groupBy(F.col("oid").alias("relation_id"), F.col("nspname").alias("schema_name"), F.col("relname").alias("table_name"), "relkind", "relreplident").agg(F.array_sort(F.collect_list(column)).alias("columns"))
    key_names = F.transform(F.array_sort(F.transform(F.filter("columns", lambda c: c["key"].isNotNull()), lambda c: F.struct(c["key"].alias("key"), c["name"].alias("name")))), lambda c: c["name"])
    return grouped.select("relation_id", "schema_name", "table_name", _named(F.col("relkind"), KINDS, "other").alias("kind"), _named(F.col("relreplident"), IDENTITIES, "other").alias("identity"), F.to_json("columns", {"ignoreNullFields": "false"}).alias("columns"), F.array_join(key_names, ",").alias("key_columns"))


def type_descriptors(types: DataFrame, namespaces: DataFrame, enums: DataFrame, constraints: DataFrame) -> DataFrame:
    """(type_id, schema_name, type_name, form, base_id, labels, n_constraints): labels in their own order, empty where there are none."""
    label = F.struct(F.col("enumsortorder"), F.col("enumlabel"))
    labels = enums.groupBy(F.col("enumtypid").alias("oid")).agg(F.array_sort(F.collect_list(F.when(F.col("enumlabel").isNotNull(), label))).alias("labels"))
    bound = constraints.groupBy(F.col("contypid").alias("oid")).agg(F.count("*").alias("n"))
    joined = types.join(namespaces.select(F.col("oid").alias("typnamespace"), "nspname"), "typnamespace").join(labels, "oid", "left").join(bound, "oid", "left")
    names = F.coalesce(F.transform("labels", lambda x: x["enumlabel"]), F.array().cast("array<string>"))
    base = F.nullif(F.greatest("typbasetype", "typelem"), F.lit(0))
    return joined.select(F.col("oid").alias("type_id"), F.col("nspname").alias("schema_name"), F.col("typname").alias("type_name"), _named(F.col("typtype"), {"b": "base", "e": "enum", "d": "domain"}, "other").alias("form"), base.alias("base_id"), F.array_join(names, ",").alias("labels"), F.coalesce("n", F.lit(0)).cast("long").alias("n_constraints"))


def preflight(settings: DataFrame, slots: DataFrame, version: int = 18) -> DataFrame:
    """(check, passed) over settings (name, value) and the logical slots in use; a missing setting fails."""
    one = settings.agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("server_version_num", "server_encoding", "wal_level", "max_replication_slots", "max_wal_senders")))
    both = one.crossJoin(slots.agg(F.count_if(F.col("slot_type") == "logical").alias("used")))  # two one-row tables
    checks = [
        ("version", F.floor(F.col("server_version_num").cast("int") / 10000) == version),
        ("encoding", F.col("server_encoding") == "UTF8"),
        ("wal_level", F.col("wal_level") == "logical"),
        ("free_slot", F.col("max_replication_slots").cast("int") > F.col("used")),
        ("wal_senders", F.col("max_wal_senders").cast("int") >= 1),
    ]
    return both.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed")) for n, ok in checks))).alias("c")).select("c.*")


def publication_state(publications: DataFrame, members: DataFrame) -> DataFrame:
    """(pubname, complete, members): members in order; complete where inserts, updates, deletes and truncates are all published."""
    listed = members.groupBy("pubname").agg(F.array_sort(F.collect_set(F.concat_ws(".", "schemaname", "tablename"))).alias("members"))
    every = F.col("pubinsert") & F.col("pubupdate") & F.col("pubdelete") & F.col("pubtruncate") & ~F.col("pubviaroot")
    return publications.join(listed, "pubname", "left").select("pubname", every.alias("complete"), F.coalesce("members", F.array().cast("array<string>")).alias("members"))


def same_members(a: Column, b: Column) -> Column:
    """Whether two lists hold the same names, whatever their order."""
    return F.array_sort(a) == F.array_sort(b)


def membership_diff(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pubname, table_name, change): what to add to and drop from each publication, given wanted (pubname, table_name)."""
    have = state.select("pubname", F.explode("members").alias("table_name")).withColumn("have", F.lit(True))
    both = wanted.select("pubname", "table_name").distinct().withColumn("want", F.lit(True)).join(have, ["pubname", "table_name"], "full")
    change = F.when(F.col("have").isNull(), "add").when(F.col("want").isNull(), "drop")
    return both.select("pubname", "table_name", change.alias("change")).filter("change is not null")


def require_publication(state: DataFrame, wanted: DataFrame) -> None:
    """ContractError unless each wanted publication is complete and has exactly the wanted members."""
    asked = wanted.groupBy("pubname").agg(F.array_sort(F.collect_set("table_name")).alias("wanted"))
    bad = asked.join(state, "pubname", "left").filter(~F.coalesce(F.col("complete") & same_members(F.col("members"), F.col("wanted")), F.lit(False))).select("pubname").orderBy("pubname").limit(5).collect()
    if bad:
        raise ContractError(f"publications {[r[0] for r in bad]} differ from what is mirrored")


def slot_state(slots: DataFrame, current_lsn: Column) -> DataFrame:
    """(slot_name, active, retained, safe, status): bytes of log kept for a slot and left before it is lost."""
    lsn = lambda c: c.cast("decimal(20,0)")
    kept = F.greatest(lsn(current_lsn) - lsn(F.col("restart_lsn")), F.lit(0)).cast("decimal(20,0)")
    return slots.select("slot_name", "active", kept.alias("retained"), F.col("safe_wal_size").alias("safe"), F.col("wal_status").alias("status"))


def retention(status: Column, retained: Column, warn: int, rebuild: int, safe: Column | None = None, min_safe: int = 0) -> Column:
    """healthy, warning or rebuild; a lost, unknown or null state fails closed."""
    known = F.coalesce(status.isin("reserved", "extended", "unreserved"), F.lit(False)) & retained.isNotNull()
    tight = F.coalesce(safe < min_safe, F.lit(False)) if safe is not None else F.lit(False)
    return F.when(~known | (retained >= rebuild), "rebuild").when((retained >= warn) | tight | (status == "unreserved"), "warning").otherwise("healthy")


# ---------------------------------------------------------------- distributed sources


def version_at_least(version: Column, major: int, minor: int) -> Column:
    """Whether ``a.b...`` in a version text reaches (major, minor); null where there is none."""
    part = lambda i: F.regexp_extract(version, r"(\d+)\.(\d+)", i).cast("int")
    return F.when(version.rlike(r"\d+\.\d+"), F.struct(part(1).alias("a"), part(2).alias("b")) >= F.struct(F.lit(major).alias("a"), F.lit(minor).alias("b")))


def active_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, group_id, name, port, role) of active primaries, the coordinator (group 0) first."""
    role = F.when(F.col("groupid") == 0, "coordinator").otherwise("worker")
    return nodes.filter(F.col("isactive") & (F.col("noderole") == "primary")).select(F.col("nodeid").alias("node_id"), F.col("groupid").alias("group_id"), F.col("nodename").alias("name"), F.col("nodeport").alias("port"), role.alias("role")).orderBy("group_id", "node_id")


def distribution_attribute(partkey: Column) -> Column:
    """Attribute number in a distribution key's node text; null unless exactly one is named."""
    found = F.regexp_extract_all(partkey, F.lit(r":varattno (-?\d+)"), 1)
    return F.when((F.size(found) == 1) & (F.get(found, F.lit(0)).cast("int") > 0), F.get(found, F.lit(0)).cast("int"))


def table_kinds(classes: DataFrame, partitions: DataFrame) -> DataFrame:
    """(relation_id, kind, attribute) of tables given their distribution (logicalrelid, partmethod, repmodel, partkey); others are unsupported."""
    joined = classes.select(F.col("oid").alias("relation_id")).join(partitions.withColumnRenamed("logicalrelid", "relation_id"), "relation_id", "left")
    attribute, method = distribution_attribute(F.col("partkey")), F.col("partmethod")
    kind = F.when(method.isNull(), "ordinary").when((method == "h") & attribute.isNotNull(), "hash_distributed").when((method == "n") & (F.col("repmodel") == "t"), "reference").when((method == "n") & (F.col("repmodel") == "s"), "local").otherwise("unsupported")
    return joined.select("relation_id", kind.alias("kind"), F.when(method == "h", attribute).alias("attribute"))


def placement_counts(shards: DataFrame, placements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(relation_id, n_shards, n_nodes): shards and the distinct active nodes that hold them."""
    joined = shards.join(placements, "shardid").join(nodes.filter("isactive").select("groupid", "nodeid"), "groupid")
    return joined.groupBy(F.col("logicalrelid").alias("relation_id")).agg(F.count_distinct("shardid").alias("n_shards"), F.count_distinct("nodeid").alias("n_nodes"))


def catalog_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either scan that the other lacks, with ``side``; none means that the catalog stood still."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


# ---------------------------------------------------------------- replication commands and guards


def name_of(pipeline: str, role: str, node: int | None = None) -> str:
    """Slot or publication name of a pipeline: lower-case letters, digits and underscores, at most 63."""
    clean = "".join(c if c.isascii() and c.isalnum() else "_" for c in pipeline.lower())
    out = "_".join(["tw", role, clean, *([str(node)] if node is not None else [])])
    if len(out) > 63:
        raise ContractError(f"{out} is too long")
    return out


def replication_command(slot: str, lsn: str, publication: str, streaming: bool = False, two_phase: bool = False) -> str:
    """START_REPLICATION of protocol version 1 with messages; streamed and two-phase transactions are refused."""
    if streaming or two_phase:
        raise ContractError("streamed and two-phase transactions are not supported")
    if not slot or not all(c.islower() or c.isdigit() or c == "_" for c in slot) or len(slot) > 63:
        raise ContractError(f"{slot!r} is no slot name")
    high, _, low = lsn.partition("/")
    if not (0 < len(high) <= 8 and 0 < len(low) <= 8 and all(c in "0123456789abcdefABCDEF" for c in high + low)):
        raise ContractError(f"{lsn!r} is no position")
    name = '"' + publication.replace('"', '""') + '"'
    return f"START_REPLICATION SLOT {slot} LOGICAL {lsn} (proto_version '1', publication_names '{name.replace(chr(39), chr(39) * 2)}', messages 'true')"


def parse_slot_response(rows: list[tuple]) -> dict[str, str]:
    """The one row of four fields that creating a slot answers with."""
    if len(rows) != 1 or len(rows[0]) != 4 or not all(rows[0]):
        raise ContractError("a new slot answers with one row of four fields")
    return dict(zip(("slot_name", "consistent_point", "snapshot_name", "output_plugin"), rows[0]))


@dataclass
class SnapshotGuard:
    """A new slot's exported snapshot: created, ready once all readers have opened it, then released."""

    readers: int
    state: str = "created"
    seen: set = field(default_factory=set)

    def register(self, reader: str) -> str:
        if self.state == "released" or reader in self.seen:
            raise ContractError(f"{reader} can't open a snapshot that is {self.state}")
        self.seen.add(reader)
        if len(self.seen) > self.readers:
            raise ContractError("more readers than announced")
        self.state = "ready" if len(self.seen) == self.readers else "created"
        return self.state

    def release(self) -> None:
        if self.state != "ready":
            raise ContractError(f"a snapshot that is {self.state} can't be released")
        self.state = "released"


def dsn(user: str, host: str, port: int, database: str, **options: str) -> str:
    """Connection address without a password; parts are percent-encoded."""
    tail = "&".join(f"{percent(k, safe='')}={percent(v, safe='')}" for k, v in sorted(options.items()))
    return f"postgresql://{percent(user, safe='')}@{host}:{port}/{percent(database, safe='')}" + (f"?{tail}" if tail else "")
