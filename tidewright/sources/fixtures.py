"""Catalog relations derived from the test tables, in DataFrames and in equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table

# Each relation as one SELECT that both engines read alike.
RELATIONS = {
    "namespaces": "SELECT 2200 + r_regionkey AS oid, replace(lower(r_name), ' ', '_') AS nspname FROM region",
    "classes": """SELECT 16384 + n_nationkey * 10 AS oid, replace(lower(n_name), ' ', '_') AS relname, 2200 + n_regionkey AS relnamespace,
        CASE n_nationkey % 6 WHEN 5 THEN 'v' WHEN 4 THEN 'p' ELSE 'r' END AS relkind, CASE WHEN n_nationkey % 7 = 6 THEN 'u' ELSE 'p' END AS relpersistence,
        CASE WHEN n_nationkey % 5 = 3 THEN 'f' ELSE 'd' END AS relreplident FROM nation""",
    "attributes": """SELECT 16384 + n_nationkey * 10 AS attrelid, r_regionkey + 1 AS attnum, concat('c', CAST(r_regionkey + 1 AS VARCHAR(9))) AS attname,
        CASE r_regionkey WHEN 0 THEN 20 WHEN 1 THEN 1700 WHEN 2 THEN 1043 WHEN 3 THEN 25 ELSE 50001 END AS atttypid,
        CASE r_regionkey WHEN 1 THEN 4 + 12 * 65536 + 2 WHEN 2 THEN 68 ELSE -1 END AS atttypmod, r_regionkey = 0 AS attnotnull,
        r_regionkey = 3 AND n_nationkey % 3 = 0 AS attisdropped, CASE WHEN r_regionkey = 1 AND n_nationkey % 4 = 0 THEN 's' ELSE '' END AS attgenerated FROM nation CROSS JOIN region""",
    "types": """SELECT p_partkey AS oid, CASE p_partkey WHEN 20 THEN 'int8' WHEN 25 THEN 'text' ELSE concat('t', CAST(p_partkey AS VARCHAR(9))) END AS typname, CAST(2200 + p_partkey % 5 AS INT) AS typnamespace,
        CASE p_partkey % 4 WHEN 1 THEN 'e' WHEN 2 THEN 'd' WHEN 3 THEN 'r' ELSE 'b' END AS typtype, CASE WHEN p_partkey % 4 = 2 THEN 25 ELSE 0 END AS typbasetype, 0 AS typelem FROM part WHERE p_partkey <= 60
        UNION ALL SELECT 1700, 'numeric', 2200, 'b', 0, 0 UNION ALL SELECT 1043, 'varchar', 2200, 'b', 0, 0 UNION ALL SELECT 50001, 'state', 2200, 'e', 0, 0""",
    "indexes": """SELECT 16384 + n_nationkey * 10 AS indrelid, true AS indisprimary, n_nationkey % 9 <> 8 AS indisvalid, true AS indisready, n_nationkey % 8 <> 7 AS indimmediate,
        CASE WHEN n_nationkey % 2 = 0 THEN '{3,1}' ELSE '{1}' END AS indkey, CASE WHEN n_nationkey % 10 = 0 THEN 1 ELSE 2 END AS indnkeyatts FROM nation""",
    "enums": "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 50001 ELSE 1 + 4 * (ascii(o_orderpriority) - 48) END AS enumtypid, CAST(-o_orderkey AS DOUBLE) AS enumsortorder, concat('l', CAST(o_orderkey AS VARCHAR(9))) AS enumlabel FROM orders WHERE o_orderkey % 100 < 5 AND o_orderkey < 1000",
    "constraints": "SELECT p_partkey AS contypid FROM part WHERE p_partkey <= 60 AND p_partkey % 8 = 2",
}
WITH_SQL = "WITH " + ", ".join(f"{name} AS ({text})" for name, text in RELATIONS.items())


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``RELATIONS`` over the test tables."""
    sources = {t: table(spark, sf_dir, t) for t in ("region", "nation", "part", "orders") if f" {t}" in RELATIONS[name]}
    text = RELATIONS[name].replace("{", "{{").replace("}", "}}")
    for t in sources:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **sources)
