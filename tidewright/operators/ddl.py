"""DDL messages: their envelope, scope, notices, and JSON documents about schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVELOPE = "version int, command_tag string, relation_ids array<string>, affected_schemas array<string>, schema_fingerprint string"


def decode_envelope(content: Column) -> Column:
    """Struct (command_tag, relation_ids, affected_schemas, schema_fingerprint, fault) of a message's JSON.

    Ids may be text or numbers; schemas come back sorted and distinct, null where the scope is unknown.
    """
    e = F.from_json(content, ENVELOPE)
    ids = F.transform(e["relation_ids"], lambda x: x.cast("long"))
    fault = (
        F.when(F.coalesce(e["version"], F.lit(0)) != 1, "version")
        .when(F.coalesce(e["command_tag"], F.lit("")) == "", "command_tag")
        .when(F.exists(F.coalesce(e["relation_ids"], F.array().cast("array<string>")), lambda x: ~F.coalesce(x.rlike("^[0-9]+$"), F.lit(False))), "relation_ids")
    )
    schemas = F.array_sort(F.array_distinct(F.filter(e["affected_schemas"], lambda s: s.isNotNull() & (s != ""))))
    return F.struct(e["command_tag"].alias("command_tag"), F.when(fault.isNull(), ids).alias("relation_ids"), schemas.alias("affected_schemas"), e["schema_fingerprint"].alias("schema_fingerprint"), fault.alias("fault"))


def schema_of_identity(identity: Column) -> Column:
    """First part of a qualified name, quoted or not; unquoted ones are lowered."""
    quoted = F.regexp_replace(F.regexp_extract(identity, r'^\s*"((?:[^"]|"")+)"\s*\.', 1), '""', '"')
    plain = F.lower(F.regexp_extract(identity, r"^\s*([A-Za-z_][A-Za-z0-9_$]*)\s*\.", 1))
    return F.nullif(F.when(identity.rlike(r'^\s*"'), quoted).otherwise(plain), F.lit(""))


def notices(commands: DataFrame) -> DataFrame:
    """One message a transaction and tag from commands (xid, command_tag, object_id, identity): the envelope as JSON, and its audit mark.

    Temporary schemas are left out of the scope; commands that touch nothing else give no message.
    """
    own = commands.withColumn("schema", schema_of_identity(F.col("identity"))).filter(~F.coalesce(F.col("schema").like("pg\\_temp%"), F.lit(False)))
    grouped = own.groupBy("xid", "command_tag").agg(F.array_sort(F.collect_set("object_id")).alias("ids"), F.array_sort(F.collect_set("schema")).alias("schemas"), F.array_sort(F.collect_list(F.struct("object_id", "identity"))).alias("objects"))
    mark = F.md5(F.to_json("objects"))
    body = F.struct(F.lit(1).alias("version"), F.col("command_tag"), F.transform("ids", lambda x: x.cast("string")).alias("relation_ids"), F.col("schemas").alias("affected_schemas"), mark.alias("schema_fingerprint"))
    return grouped.select("xid", "command_tag", F.to_json(body).alias("content"), mark.alias("mark"))


def installed(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: whether every wanted object (name, mark) is there with its mark, how many are, and the highest version found."""
    both = wanted.select("name", "mark").join(found.select("name", F.col("mark").alias("have"), "version"), "name", "left")
    return both.agg((F.count_if(F.col("mark").eqNullSafe(F.col("have"))) == F.count("*")).alias("complete"), F.count("have").alias("n_found"), F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def json_set(document: Column, key: str, value: Column) -> Column:
    """A JSON object of scalars with one member set."""
    parsed = F.from_json(document, "map<string,string>")
    rest = F.map_filter(parsed, lambda k, _: k != key)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(rest, F.create_map(F.lit(key), value.cast("string")))))))


def without_keys(document, keys: frozenset[str]):
    """A parsed JSON document without members of these names, at any depth."""
    if isinstance(document, dict):
        return {k: without_keys(v, keys) for k, v in document.items() if k not in keys}
    return [without_keys(v, keys) for v in document] if isinstance(document, list) else document


def portable_fingerprint_text(document: dict) -> str:
    """Canonical text of a schema without what differs between servers and generations."""
    return json.dumps(without_keys(document, frozenset({"relation_id", "oid", "type_oid", "generation"})), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
