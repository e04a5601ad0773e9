"""Registered queries of the mirror engine, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lsn as L
from ..functions import text as X
from ..operators import log as G
from ..operators import reconcile as R
from ..operators.apply import apply_changes, validate
from ..operators.fold import fold, fold_stable, illegal_steps
from ..sources import wire as W
from ..sources.catalog import retention
from ..sources.tables import ADDED, MOVED, orders_log, orders_snapshot, table
from ..streaming import mirror
from .control import Column, Table, admit
from .storage import fresh_path
from .store import Store
from ..functions.types import ContractError, Kind, spark_type

KEYS, DATA = ["o_orderkey"], ["o_custkey", "price", "priority"]

# ---------------------------------------------------------------- SQL shared by the mirror queries

_BASE = "base AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderpriority AS priority FROM orders)"


def _log_sql(moves: bool) -> str:
    none = "CAST(NULL AS BIGINT)"
    rows = [
        ("1", "o_orderkey % 3 = 0", "U", "o_orderkey", none, none, "CAST(price + 1 AS DECIMAL(18,2))", "NULL", "false, true, false"),
        ("2", "o_orderkey % 4 = 0", "U", "o_orderkey", none, none, "NULL", "'9-CHANGED'", "false, false, true"),
        ("3", "o_orderkey % 9 = 0", "U", "o_orderkey", none, none, "NULL", "NULL", "false, false, true"),
        ("5", "o_orderkey % 5 = 0", "D", "o_orderkey", none, none, "NULL", "NULL", "false, false, false"),
        ("6", "o_orderkey % 15 = 0", "I", "o_orderkey", none, "o_custkey", "price", "priority", "true, true, true"),
        ("7", "o_orderkey % 7 = 0", "I", f"o_orderkey + {ADDED}", none, "o_custkey", "price", "priority", "true, true, true"),
    ]
    if moves:
        rows.append(("4", "o_orderkey % 11 = 0 AND o_orderkey % 5 <> 0", "U", f"o_orderkey + {MOVED}", "o_orderkey", none, "NULL", "NULL", "false, false, false"))
    parts = [f"SELECT o_orderkey * 10 + {n}, '{op}', {key}, {old}, {cust}, {price}, {prio}, {sent} FROM base WHERE {when}" for n, when, op, key, old, cust, price, prio, sent in rows]
    head = "log(seq, op, o_orderkey, old_o_orderkey, o_custkey, price, priority, p_o_custkey, p_price, p_priority)"
    return f"{_BASE}, {head} AS ({' UNION ALL '.join(parts)})"


_FOLD = """folded AS (
  SELECT o_orderkey, arg_min(op, seq) AS first_op, arg_max(op, seq) AS last_op,
         arg_max_null(o_custkey, seq) FILTER (WHERE p_o_custkey) AS o_custkey, arg_max_null(price, seq) FILTER (WHERE p_price) AS price,
         arg_max_null(priority, seq) FILTER (WHERE p_priority) AS priority,
         bool_or(p_o_custkey) AS p_o_custkey, bool_or(p_price) AS p_price, bool_or(p_priority) AS p_priority
  FROM log GROUP BY o_orderkey
), staging AS (
  SELECT CASE WHEN last_op = 'D' THEN 'D' ELSE 'U' END AS op, o_orderkey,
         CASE WHEN last_op <> 'D' THEN o_custkey END AS o_custkey, CASE WHEN last_op <> 'D' THEN price END AS price, CASE WHEN last_op <> 'D' THEN priority END AS priority,
         last_op <> 'D' AND p_o_custkey AS p_o_custkey, last_op <> 'D' AND p_price AS p_price, last_op <> 'D' AND p_priority AS p_priority
  FROM folded WHERE NOT (first_op = 'I' AND last_op = 'D')
)"""
_STABLE = f"WITH {_log_sql(False)}, {_FOLD}"
_APPLIED = """applied AS (
  SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN s.p_o_custkey THEN s.o_custkey ELSE t.o_custkey END AS o_custkey,
         CASE WHEN s.p_price THEN s.price ELSE t.price END AS price, CASE WHEN s.p_priority THEN s.priority ELSE t.priority END AS priority
  FROM base t FULL JOIN staging s ON t.o_orderkey = s.o_orderkey WHERE s.op IS NULL OR s.op = 'U'
)"""
# The derived log moves each key once, to a key that has no other event, after its updates.
_MOVE_STATE = f"""WITH {_log_sql(False)}, {_FOLD}, {_APPLIED}
SELECT CASE WHEN o_orderkey < {MOVED} AND o_orderkey % 11 = 0 AND o_orderkey % 5 <> 0 THEN o_orderkey + {MOVED} ELSE o_orderkey END AS o_orderkey, o_custkey, price, priority FROM applied"""

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- fold and apply


@query(f"{_STABLE}, {_APPLIED} SELECT o_orderkey, o_custkey, price, priority FROM applied")
def mirror_orders_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = fold_stable(orders_log(spark, sf_dir, moves=False), KEYS, DATA)
    return apply_changes(orders_snapshot(spark, sf_dir), staging, KEYS, DATA, moves=False)


@query(f"{_STABLE} SELECT op, o_orderkey, o_custkey, price, priority, p_o_custkey, p_price, p_priority FROM staging")
def fold_stable_keys(spark, sf_dir):
    return fold_stable(orders_log(spark, sf_dir, moves=False), KEYS, DATA).drop("old_o_orderkey")


_BIG = 1 << 53


@query(f"""WITH base AS (SELECT o_orderkey + {_BIG} AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderkey % 3 AS r FROM orders)
SELECT 'M' AS op, k * 4 + 2 AS k, k * 4 AS old_k, {_BIG} + k AS big, price FROM base WHERE r = 0
UNION ALL SELECT 'U', k * 4, NULL, {_BIG} + k + 2, price FROM base WHERE r = 1
UNION ALL SELECT 'D', k * 4, NULL, NULL, NULL FROM base WHERE r = 2""")
def fold_wide_keys(spark, sf_dir):
    """Keys and values above 2^53: chains of two moves, changes with a null between, moves that end in a delete."""
    base = orders_snapshot(spark, sf_dir).select((F.col("o_orderkey") + _BIG).alias("k"), "price", (F.col("o_orderkey") % 3).alias("r"))
    k, big = F.col("k") * 4, F.col("k") + _BIG

    def event(n, op, key=k, old=None, value=None, price=None):
        cell = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
        return F.struct((k * 4 + n).alias("seq"), F.lit(op).alias("op"), key.alias("k"), cell(old, "bigint").alias("old_k"), cell(value, "bigint").alias("big"), cell(price, "decimal(18,2)").alias("price"), F.lit(value is not None).alias("p_big"), F.lit(price is not None).alias("p_price"))

    chain = F.array(event(0, "U", k + 1, k, big), event(1, "U", k + 1, None, None, F.col("price")), event(2, "U", k + 2, k + 1))
    plain = F.array(event(0, "U", value=big, price=F.col("price") + 1), event(1, "U", value=F.lit(None).cast("bigint")), event(2, "U", value=big + 2, price=F.col("price")))
    dead = F.array(event(0, "U", k + 1, k), event(1, "D", k + 1))
    log = base.select(F.explode(F.when(F.col("r") == 0, chain).when(F.col("r") == 1, plain).otherwise(dead)).alias("e")).select("e.*")
    return fold(log, ["k"], ["big", "price"]).select("op", "k", "old_k", "big", "price")


@query(f"{_STABLE} SELECT op, count(*) AS n_rows, CAST(sum(CASE WHEN p_price THEN 1 ELSE 0 END) AS BIGINT) AS n_price FROM staging GROUP BY op")
def fold_ops_summary(spark, sf_dir):
    staging = fold_stable(orders_log(spark, sf_dir, moves=False), KEYS, DATA)
    return staging.groupBy("op").agg(F.count("*").alias("n_rows"), F.count_if("p_price").alias("n_price"))


@query(f"""WITH {_log_sql(True)}, m AS (
  SELECT l.o_orderkey, l.old_o_orderkey FROM log l WHERE old_o_orderkey IS NOT NULL)
SELECT 'M' AS op, m.o_orderkey, m.old_o_orderkey, arg_max_null(l.price, l.seq) FILTER (WHERE l.p_price) AS price, arg_max_null(l.priority, l.seq) FILTER (WHERE l.p_priority) AS priority,
       bool_or(l.p_price) AS p_price, bool_or(l.p_priority) AS p_priority
FROM m JOIN log l ON l.o_orderkey IN (m.o_orderkey, m.old_o_orderkey) GROUP BY ALL""")
def fold_key_moves(spark, sf_dir):
    staging = fold(orders_log(spark, sf_dir), KEYS, DATA)
    return staging.filter("op = 'M'").select("op", "o_orderkey", "old_o_orderkey", "price", "priority", "p_price", "p_priority")


@query(_MOVE_STATE)
def apply_move(spark, sf_dir):
    staging = fold(orders_log(spark, sf_dir), KEYS, DATA)
    return apply_changes(orders_snapshot(spark, sf_dir), staging, KEYS, DATA)


@query(f"{_STABLE} SELECT o_orderkey, o_custkey, price, priority FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM staging WHERE op = 'D')")
def apply_delete(spark, sf_dir):
    staging = fold_stable(orders_log(spark, sf_dir, moves=False), KEYS, DATA).filter("op = 'D'")
    return apply_changes(orders_snapshot(spark, sf_dir), staging, KEYS, DATA, moves=False)


@query(f"{_STABLE} SELECT s.o_orderkey, CASE WHEN p_o_custkey THEN s.o_custkey ELSE t.o_custkey END AS o_custkey, CASE WHEN p_price THEN s.price ELSE t.price END AS price, CASE WHEN p_priority THEN s.priority ELSE t.priority END AS priority FROM staging s JOIN base t ON s.o_orderkey = t.o_orderkey WHERE s.op = 'U'")
def apply_update_masked(spark, sf_dir):
    staging = fold_stable(orders_log(spark, sf_dir, moves=False), KEYS, DATA).filter("op = 'U'")
    target = orders_snapshot(spark, sf_dir)
    known = staging.join(target.select("o_orderkey"), "o_orderkey", "left_semi")
    touched = target.join(known.select("o_orderkey"), "o_orderkey", "left_semi")
    return apply_changes(touched, known, KEYS, DATA, moves=False)


@query(f"{_STABLE} SELECT o_orderkey, o_custkey, price, priority FROM staging WHERE op = 'U' AND o_orderkey NOT IN (SELECT o_orderkey FROM base)")
def apply_insert_missing(spark, sf_dir):
    staging = fold_stable(orders_log(spark, sf_dir, moves=False), KEYS, DATA).filter("op = 'U'")
    target = orders_snapshot(spark, sf_dir)
    fresh = staging.join(target.select("o_orderkey"), "o_orderkey", "left_anti")
    return apply_changes(target.limit(0), fresh, KEYS, DATA, moves=False)


@query(_MOVE_STATE)
def apply_replay_idempotent(spark, sf_dir):
    """The batch applied twice."""
    staging = fold(orders_log(spark, sf_dir), KEYS, DATA)
    once = apply_changes(orders_snapshot(spark, sf_dir), staging, KEYS, DATA)
    return apply_changes(once, staging, KEYS, DATA)


@query(f"""{_STABLE} SELECT CAST(0 AS BIGINT) AS bad_op, CAST(0 AS BIGINT) AS null_key, CAST(0 AS BIGINT) AS stray_old_key, CAST(0 AS BIGINT) AS bad_move, CAST(0 AS BIGINT) AS move_conflict,
 (SELECT count(*) FROM staging s LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') b USING (o_orderkey) WHERE s.op = 'U' AND b.o_orderkey IS NULL AND NOT (p_o_custkey AND p_price AND p_priority)) AS partial_insert,
 CAST(0 AS BIGINT) AS duplicate_key, CAST(0 AS BIGINT) AS duplicate_old_key""")
def validate_batch_flags(spark, sf_dir):
    """A batch against a target that lacks the open orders."""
    staging = fold_stable(orders_log(spark, sf_dir, moves=False), KEYS, DATA)
    closed = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'").select("o_orderkey")
    return validate(orders_snapshot(spark, sf_dir).join(closed, "o_orderkey", "left_semi"), staging, KEYS, DATA)


@query(f"{_STABLE} SELECT CASE WHEN NOT p_priority THEN 'unchanged' WHEN priority IS NULL THEN 'null' ELSE 'value' END AS cell, count(*) AS n_rows FROM staging WHERE op = 'U' GROUP BY 1")
def explicit_null_vs_unchanged(spark, sf_dir):
    staging = fold_stable(orders_log(spark, sf_dir, moves=False), KEYS, DATA).filter("op = 'U'")
    cell = F.when(~F.col("p_priority"), "unchanged").when(F.col("priority").isNull(), "null").otherwise("value")
    return staging.groupBy(cell.alias("cell")).agg(F.count("*").alias("n_rows"))


@query("WITH t AS (SELECT i AS id, i % 3 <> 0 AS active, CAST(i AS DECIMAL(18,2)) + CASE WHEN i % 3 = 0 THEN 100 ELSE 0 END AS amount FROM range(1, 257) r(i) WHERE i % 5 <> 0) SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT active) AS inactive, CAST(sum(amount) AS DECIMAL(28,2)) AS amount FROM t")
def crud_convergence(spark, sf_dir):
    """256 inserts, updates of every third, deletes of every fifth."""
    i = spark.range(1, 257).withColumn("old_id", F.lit(None).cast("bigint"))
    sent = lambda v, *c: [F.lit(v).alias(f"p_{x}") for x in c]
    money = lambda e: F.expr(e).cast("decimal(18,2)").alias("amount")
    add = i.select((F.col("id") * 3).alias("seq"), F.lit("I").alias("op"), "id", "old_id", F.lit(True).alias("active"), money("id"), *sent(True, "active", "amount"))
    change = i.filter("id % 3 = 0").select((F.col("id") * 3 + 1).alias("seq"), F.lit("U").alias("op"), "id", "old_id", F.lit(False).alias("active"), money("id + 100"), *sent(True, "active", "amount"))
    drop = i.filter("id % 5 = 0").select((F.col("id") * 3 + 2).alias("seq"), F.lit("D").alias("op"), "id", "old_id", F.lit(None).cast("boolean").alias("active"), F.lit(None).cast("decimal(18,2)").alias("amount"), *sent(False, "active", "amount"))
    staging = fold_stable(add.unionByName(change).unionByName(drop), ["id"], ["active", "amount"])
    target = spark.createDataFrame([], "id bigint, active boolean, amount decimal(18,2)")
    out = apply_changes(target, staging, ["id"], ["active", "amount"], moves=False)
    return out.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("active")).alias("inactive"), F.sum("amount").alias("amount"))


@query("SELECT seq, user_id, op, previous_op FROM (SELECT event_id AS seq, user_id, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op, lag(CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_op FROM events) WHERE (op = 'I' AND previous_op IN ('I', 'U')) OR (op IN ('U', 'D') AND previous_op = 'D')")
def sequence_errors(spark, sf_dir):
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", op.alias("op"))
    return illegal_steps(log, ["user_id"]).select("seq", "user_id", "op", "previous_op")


# ---------------------------------------------------------------- log


def _event_log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when((F.col("event_id") % 10 == 9) & (F.floor(F.col("event_id") / 10) % 7 != 0), "commit").otherwise("row")
    return e.select((F.col("event_id") % 2).cast("int").alias("node_id"), F.floor(F.col("event_id") / 10).alias("xid"), F.col("event_id").alias("lsn"), kind.alias("kind"), "user_id")


_EVENT_LOG = "l AS (SELECT event_id // 10 AS xid, event_id AS lsn, CASE WHEN event_id % 10 = 9 AND (event_id // 10) % 7 <> 0 THEN 'commit' ELSE 'row' END AS kind, user_id FROM events)"


@query(f"WITH {_EVENT_LOG}, c AS (SELECT xid, max(lsn) AS end_lsn FROM l WHERE kind = 'commit' GROUP BY xid) SELECT l.xid, l.lsn, l.user_id, c.end_lsn FROM l JOIN c USING (xid) WHERE l.kind = 'row'")
def assemble_committed_only(spark, sf_dir):
    log = _event_log(spark, sf_dir).withColumn("node_id", F.lit(0))
    return G.committed(log).select("xid", "lsn", "user_id", "end_lsn")


@query("""WITH RECURSIVE t AS (
  SELECT user_id % 8 AS node_id, event_id AS seq, 1 + user_id % 50 AS n_rows, CAST(round(100 + value) AS BIGINT) AS n_bytes, event_type = 'error' AND value > 90 AS barrier,
         row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS i FROM events
), b AS (
  SELECT node_id, seq, n_rows, n_bytes, barrier, i, CAST(0 AS BIGINT) AS batch, n_rows AS r, n_bytes AS z, 1 AS held FROM t WHERE i = 1
  UNION ALL
  SELECT t.node_id, t.seq, t.n_rows, t.n_bytes, t.barrier, t.i, b.batch + CAST(cut AS BIGINT), CASE WHEN cut THEN t.n_rows ELSE b.r + t.n_rows END, CASE WHEN cut THEN t.n_bytes ELSE b.z + t.n_bytes END, CASE WHEN cut THEN 1 ELSE b.held + 1 END
  FROM b JOIN t ON t.node_id = b.node_id AND t.i = b.i + 1, LATERAL (SELECT b.barrier OR t.barrier OR b.r + t.n_rows > 200 OR b.z + t.n_bytes > 20000 OR b.held >= 200 AS cut)
) SELECT node_id, seq, n_rows, n_bytes, barrier, batch FROM b""")
def batch_assignment_greedy(spark, sf_dir):
    """Batches of all events, as the limits on rows and bytes and the barriers cut them."""
    e = table(spark, sf_dir, "events")
    barrier = (F.col("event_type") == "error") & (F.col("value") > 90)
    txns = e.select((F.col("user_id") % 8).alias("node_id"), F.col("event_id").alias("seq"), (1 + F.col("user_id") % 50).alias("n_rows"), F.round(100 + F.col("value"), 0).cast("long").alias("n_bytes"), barrier.alias("barrier"))
    return G.assign_batches(txns, 200, 20_000)


@query("SELECT event_id, upper(to_hex((event_id * 1000003) // 4294967296)) || '/' || lpad(upper(to_hex((event_id * 1000003) % 4294967296)), 8, '0') AS lsn_text, CAST(event_id * 1000003 AS DECIMAL(20,0)) AS parsed FROM events")
def lsn_format(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", L.render((F.col("event_id") * 1000003).cast(L.LSN)).alias("lsn_text"))
    return rows.withColumn("parsed", L.parse(F.col("lsn_text")))


@query("SELECT user_id, CAST(max(event_id) AS DECIMAL(20,0)) AS received, CAST(greatest(max(event_id) - 5000, 0) AS DECIMAL(20,0)) AS lag_bytes FROM events GROUP BY user_id")
def lsn_lag(spark, sf_dir):
    got = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").cast(L.LSN).alias("received"))
    return got.select("user_id", "received", L.lag(F.col("received"), F.lit(5000)).alias("lag_bytes"))


@query("SELECT seq, lsn, previous_lsn FROM (SELECT event_id AS seq, event_id - 20 * CAST(event_id % 17 = 0 AS INT) AS lsn, lag(event_id - 20 * CAST(event_id % 17 = 0 AS INT)) OVER (PARTITION BY event_id % 2 ORDER BY event_id) AS previous_lsn FROM events) WHERE lsn < previous_lsn")
def late_or_regressed_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 2).alias("node_id"), F.col("event_id").alias("seq"), (F.col("event_id") - 20 * (F.col("event_id") % 17 == 0).cast("int")).alias("lsn"))
    return G.regressions(e).select("seq", "lsn", "previous_lsn")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS barrier FROM events WHERE event_type = 'error'")
def ddl_scope_filter(spark, sf_dir):
    """Schemas: none known, one mirrored, one other, two others."""
    k = F.col("event_id") % 4
    schemas = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("sales"), F.lit("z"))).when(k == 2, F.array(F.lit("other"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", G.in_scope(schemas, ["sales"]).alias("barrier"))


@query("SELECT DISTINCT event_type AS payload, event_id // 20 AS xid FROM events")
def dedup_ddl_messages(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("payload"), F.floor(F.col("event_id") / 20).alias("xid")).dropDuplicates(["payload", "xid"])


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def user_latest_event(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("SELECT event_id, user_id, n, n >= 5 AS limited FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error') ")
def login_rate_limit_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-60_000_000, 0)
    return e.select("event_id", "user_id", F.count("*").over(w).alias("n"), (F.count("*").over(w) >= 5).alias("limited"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'inserted' ELSE CASE WHEN user_id = event_id % 100 THEN 'unchanged' WHEN event_id % 100 > user_id THEN 'advanced' ELSE 'regressed' END END AS outcome FROM events")
def checkpoint_advance_outcome(spark, sf_dir):
    stored = F.when(F.col("event_id") % 5 != 0, F.col("user_id"))
    return table(spark, sf_dir, "events").select("event_id", L.checkpoint_outcome(stored, F.col("event_id") % 100).alias("outcome"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'rebuild' WHEN p_size * 10 >= 400 THEN 'rebuild' WHEN p_size * 10 >= 200 THEN 'warning' ELSE 'healthy' END AS state FROM part")
def retention_classifier(spark, sf_dir):
    """Retained bytes against limits of 200 and 400; a lost or unknown slot status fails closed."""
    status, kept = F.when(F.col("p_size") % 7 == 0, "lost").otherwise("reserved"), F.col("p_size") * 10
    return table(spark, sf_dir, "part").select("p_partkey", retention(status, kept, 200, 400).alias("state"))


# ---------------------------------------------------------------- reconciliation

_HEX = "lpad(printf('%X', {}), 16, '0')"
_ROW_HEX = (
    "concat('0000000000000001', '01', " + _HEX.format("octet_length(encode(CAST(o_orderkey AS VARCHAR)))") + ", hex(encode(CAST(o_orderkey AS VARCHAR))), '0000000000000002', '02', "
    + _HEX.format("octet_length(encode(CAST(price AS VARCHAR)))") + ", hex(encode(CAST(price AS VARCHAR))), CASE WHEN priority IS NULL THEN '00' ELSE concat('02', "
    + _HEX.format("octet_length(encode(priority))") + ", hex(encode(priority))) END)"
)


def _digest(rows: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return R.chunk_digest(rows, F.floor(F.col("o_orderkey") / 1000), F.col("o_orderkey"), [text("o_orderkey")], [text("price"), text("priority")])


@query(f"WITH {_BASE} SELECT o_orderkey // 1000 AS chunk, count(*) AS n_rows, sha256(unhex(string_agg({_ROW_HEX}, '' ORDER BY o_orderkey))) AS digest FROM base GROUP BY 1")
def chunk_digest(spark, sf_dir):
    return _digest(orders_snapshot(spark, sf_dir))


def _drifted(rows: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    lost = rows.filter(k % 997 != 1)
    changed = lost.withColumn("priority", F.when(k % 991 == 2, F.lit(None).cast("string")).otherwise(F.col("priority")))
    return changed.unionByName(rows.filter(k % 983 == 3).withColumn("o_orderkey", k + ADDED))


@query(f"WITH {_BASE}, bad AS (SELECT o_orderkey // 1000 AS chunk FROM base WHERE o_orderkey % 997 = 1 OR (o_orderkey % 991 = 2 AND priority IS NOT NULL) UNION SELECT (o_orderkey + {ADDED}) // 1000 FROM base WHERE o_orderkey % 983 = 3) SELECT chunk, CASE WHEN chunk IN (SELECT chunk FROM bad) THEN 'mismatch' ELSE 'match' END AS status FROM (SELECT o_orderkey // 1000 AS chunk FROM base UNION SELECT chunk FROM bad)")
def chunk_compare(spark, sf_dir):
    rows = orders_snapshot(spark, sf_dir)
    return R.compare(_digest(rows), _digest(_drifted(rows)))


@query(f"WITH {_BASE} SELECT o_orderkey, 'source_only' AS kind FROM base WHERE o_orderkey % 997 = 1 UNION ALL SELECT o_orderkey, 'changed' FROM base WHERE o_orderkey % 991 = 2 AND o_orderkey % 997 <> 1 AND priority IS NOT NULL UNION ALL SELECT o_orderkey + {ADDED}, 'target_only' FROM base WHERE o_orderkey % 983 = 3")
def row_diff(spark, sf_dir):
    rows = orders_snapshot(spark, sf_dir)
    return R.row_diff(rows, _drifted(rows), KEYS, DATA)


@query(f"WITH {_BASE} SELECT o_orderkey, o_custkey, price, priority FROM base")
def repair_result(spark, sf_dir):
    rows = orders_snapshot(spark, sf_dir)
    return R.repair(rows, _drifted(rows), KEYS, DATA)


@query(f"WITH {_BASE} SELECT o_orderkey, o_custkey FROM base WHERE (o_custkey, o_orderkey) > (100, 50) ORDER BY o_custkey, o_orderkey LIMIT 101")
def keyset_page(spark, sf_dir):
    """One page after a key, with one row more to tell whether another follows."""
    after = F.struct("o_custkey", "o_orderkey") > F.struct(F.lit(100).cast("bigint").alias("o_custkey"), F.lit(50).cast("bigint").alias("o_orderkey"))
    return orders_snapshot(spark, sf_dir).filter(after).select("o_orderkey", "o_custkey").orderBy("o_custkey", "o_orderkey").limit(101)


# ---------------------------------------------------------------- schema and names

_T = lambda name, *cols, **kw: Table("sales", name, tuple(cols), **kw)
_ID = Column("id", Kind("int8"), False, 1)
FIXTURES = [
    _T("items", _ID, Column("payload", Kind("text"))),
    _T("nokey", Column("id", Kind("int4"))),
    _T("full", _ID, identity="full"),
    _T("parent", _ID, kind="partitioned"),
    _T("accounts", Column("tenant_id", Kind("int8"), False, 1), Column("id", Kind("int8"), False, 2), kind="hash_distributed", distribution=("tenant_id",)),
    _T("spread", _ID, kind="hash_distributed", distribution=("tenant",)),
    _T("virtual", _ID, Column("d", Kind("int4"), generated="virtual")),
    _T("marks", _ID, Column("x", Kind("xml"))),
]


@query("SELECT * FROM (VALUES ('items', CAST(NULL AS VARCHAR)), ('nokey', 'no primary key'), ('full', 'replica identity full'), ('parent', 'kind partitioned'), ('accounts', NULL), ('spread', 'primary key lacks the distribution key'), ('virtual', 'virtual column'), ('marks', 'x: type xml is not supported')) v(table_name, reason)")
def admission_report(spark, sf_dir):
    return spark.createDataFrame([(t.name, admit(t)) for t in FIXTURES], "table_name string, reason string")


@query("SELECT * FROM (VALUES ('bool', 'boolean'), ('numeric(12,2)', 'decimal(12,2)'), ('numeric(40,2)', 'string'), ('numeric(10,12)', 'rejected'), ('varchar(64)', 'string'), ('timestamptz(6)', 'timestamp'), ('timestamp(7)', 'rejected'), ('array', 'array<int>'), ('xml', 'rejected')) v(kind, spark_type)")
def type_map(spark, sf_dir):
    kinds = {"bool": Kind("bool"), "numeric(12,2)": Kind("numeric", 12, 2), "numeric(40,2)": Kind("numeric", 40, 2), "numeric(10,12)": Kind("numeric", 10, 12), "varchar(64)": Kind("varchar", 64), "timestamptz(6)": Kind("timestamptz", 6), "timestamp(7)": Kind("timestamp", 7), "array": Kind("array", inner=Kind("int4")), "xml": Kind("xml")}

    def of(kind: Kind) -> str:
        try:
            return spark_type(kind)
        except ContractError:
            return "rejected"

    return spark.createDataFrame([(k, of(v)) for k, v in kinds.items()], "kind string, spark_type string")


@query("SELECT n_name, 'erp__' || lower(r_name) || '__' || lower(n_name) AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def name_mapping(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_name", X.target_name(F.lit("erp"), F.lower("r_name"), F.lower("n_name")).alias("target"))


@query("SELECT p_partkey, CASE WHEN length(s) <= 63 THEN s ELSE substr(s, 1, 38) || '_' || substr(sha256(s), 1, 24) END AS name FROM (SELECT p_partkey, repeat(replace(lower(p_name), ' ', '_'), 1 + CAST(p_partkey % 7 AS INT)) AS s FROM part)")
def identifier_shorten_ascii(spark, sf_dir):
    long = F.expr("repeat(replace(lower(p_name), ' ', '_'), cast(1 + p_partkey % 7 as int))")
    return table(spark, sf_dir, "part").select("p_partkey", X.shorten(long).alias("name"))


@query("SELECT n_name AS table_name, CASE WHEN n_nationkey % 3 = 0 THEN 'stale' ELSE 'kept' END AS state FROM nation")
def stale_tables(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("table_name"), "n_nationkey")
    asked = n.filter("n_nationkey % 3 <> 0").select("table_name")
    stale = n.join(asked, "table_name", "left_anti").select("table_name", F.lit("stale").alias("state"))
    return stale.unionByName(n.join(asked, "table_name", "left_semi").select("table_name", F.lit("kept").alias("state")))


@query("SELECT o_orderpriority AS label, count(*) AS n_rows, CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN 1 WHEN '1' THEN 2 WHEN '5' THEN 3 WHEN '2' THEN 4 ELSE 5 END AS ordinal FROM orders GROUP BY 1")
def enum_ordinal_sort(spark, sf_dir):
    labels = F.array(*(F.lit(x) for x in "31524"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n_rows"))
    return rows.withColumn("ordinal", F.array_position(labels, F.substring("label", 1, 1)).cast("int")).orderBy("ordinal")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def quarantine_gc_candidates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter((F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "F"))
    return o.orderBy("o_orderdate", "o_orderkey").select("o_orderkey").limit(100)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 200")
def operations_latest_200(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "user_id", "event_type")


@query("SELECT r_regionkey, array_to_string(list(n_name ORDER BY n_name), ',') AS affected FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def affected_schemas_agg(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("affected"))


@query("SELECT c_nationkey, count(*) AS pipelines, count(*) FILTER (WHERE c_acctbal > 0) AS running FROM customer GROUP BY 1")
def metrics_overview_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("pipelines"), F.count_if(F.col("c_acctbal") > 0).alias("running"))


@query("SELECT doc_id, replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r') AS field FROM documents")
def copy_text_encode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.copy_encode(F.col("text")).alias("field"))


@query("SELECT doc_id, text FROM documents")
def copy_text_round_trip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.copy_decode(X.copy_encode(F.col("text"))).alias("text"))


STREAM_FILES = 5


@query(_MOVE_STATE)
def stream_mirror_available_now(spark, sf_dir):
    """Snapshot load into the store, then the log streamed in order, one file a micro-batch, through fold, apply and commit."""
    where = fresh_path(spark, "mirror")
    log = orders_log(spark, sf_dir)
    cuts = log.approxQuantile("seq", [i / STREAM_FILES for i in range(1, STREAM_FILES)], 0.01)
    for lo, hi in zip([None, *cuts], [*cuts, None]):  # files reach the stream in the order of their times
        part = log if lo is None else log.filter(F.col("seq") > int(lo))
        part = part if hi is None else part.filter(F.col("seq") <= int(hi))
        part.coalesce(1).write.mode("append").parquet(f"{where}/log")
    store = Store(spark, f"{where}/store")
    fence = store.activate_fence("orders", 1, 1).fence
    store.register_group("g1", ["orders"], {"0": 0}, fence)
    store.load_shadow("g1", "orders", orders_snapshot(spark, sf_dir), KEYS, fence)
    store.activate_group("g1", fence)
    q = mirror.start(spark, f"{where}/log", log.schema, store, "orders", "0", f"{where}/offsets", fence, {"availableNow": True}, 1)
    q.awaitTermination()
    return store.read("orders").select(*KEYS, *DATA)


# ---------------------------------------------------------------- wire protocol

_ORDERS_ID, _RESHAPED = 16384, 20_000


def _wire_log(spark, sf_dir) -> DataFrame:
    """Binary messages of one transaction an order (every seventh with an unchanged priority, every fifth a delete, every
    eleventh a move); a wider shape begins at order 20000."""
    text = lambda s: F.lit(s.encode() + b"\0")
    column = lambda name, is_key, kind: F.concat(F.lit(bytes([is_key])), text(name), W.integer(F.lit(kind), 4), F.lit(b"\xff\xff\xff\xff"))
    columns = [column("o_orderkey", 1, 20), column("price", 0, 1700), column("priority", 0, 25), column("note", 0, 25)]
    relation = lambda n: F.concat(F.lit(b"R"), W.integer(F.lit(_ORDERS_ID), 4), text("sales"), text("orders"), F.lit(b"d"), W.integer(F.lit(n), 2), *columns[:n])
    shapes = [spark.range(1).select(F.lit(0).alias("node_id"), F.lit(seq).cast("long").alias("seq"), relation(n).alias("payload")) for seq, n in ((0, 3), (_RESHAPED * 10, 4), (_RESHAPED * 10 + 5_000, 4))]
    key, base = F.col("o_orderkey"), F.col("o_orderkey") * 10
    priority = F.when(key % 7 == 0, F.lit(W.UNCHANGED)).otherwise(W.cell(F.col("priority")))
    cells = lambda k: (W.cell(k), W.cell(F.when(key % 3 != 0, F.col("price"))), priority)
    new = lambda k: F.when(key < _RESHAPED, W.row(*cells(k))).otherwise(W.row(*cells(k), W.cell(F.lit("n"))))
    old = F.when(key < _RESHAPED, W.row(W.cell(key), *[F.lit(b"n")] * 2)).otherwise(W.row(W.cell(key), *[F.lit(b"n")] * 3))
    head = lambda tag: F.concat(F.lit(tag), W.integer(F.lit(_ORDERS_ID), 4))
    change = F.when(key % 5 == 0, F.concat(head(b"D"), F.lit(b"K"), old)).when(key % 11 == 0, F.concat(head(b"U"), F.lit(b"K"), old, F.lit(b"N"), new(key + MOVED))).otherwise(F.concat(head(b"U"), F.lit(b"N"), new(key)))
    begin = F.concat(F.lit(b"B"), W.integer(base + 3, 8), W.integer(F.lit(0), 8), W.integer(key, 4))
    commit = F.concat(F.lit(b"C\0"), W.integer(base + 3, 8), W.integer(base + 4, 8), W.integer(F.lit(0), 8))
    items = F.array(*(F.struct((base + n).alias("seq"), payload.alias("payload")) for n, payload in ((1, begin), (2, change), (3, commit))))
    log = orders_snapshot(spark, sf_dir).select(F.explode(items).alias("m")).select(F.lit(0).alias("node_id"), "m.seq", "m.payload")
    for s in shapes:
        log = log.unionByName(s)
    return log


@query(f"""SELECT o_orderkey * 10 + 2 AS seq, o_orderkey AS xid, CAST(CASE WHEN o_orderkey < {_RESHAPED} THEN 1 ELSE 2 END AS BIGINT) AS generation,
CASE WHEN o_orderkey % 5 = 0 THEN 'D' ELSE 'U' END AS op,
CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 11 = 0 THEN o_orderkey + {MOVED} ELSE o_orderkey END AS o_orderkey,
CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 11 = 0 THEN o_orderkey END AS old_o_orderkey,
CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS price,
CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority,
o_orderkey % 5 <> 0 AS p_price, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS p_priority FROM orders""")
def wire_decode_changes(spark, sf_dir):
    """Binary log -> messages -> transactions and shapes in force -> the log that the fold reads."""
    bound = W.with_relations(W.with_transactions(W.decode(_wire_log(spark, sf_dir)), block=4096))
    changes = W.change_log(bound, KEYS, {"o_orderkey": "long", "price": "decimal(18,2)", "priority": "string"})
    return changes.join(bound.select("seq", "xid", "generation"), "seq")


@query(f"""WITH base AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderpriority AS priority FROM orders)
SELECT CASE WHEN k % 11 = 0 THEN k + {MOVED} ELSE k END AS o_orderkey, CASE WHEN k % 3 <> 0 THEN price END AS price, priority FROM base WHERE k % 5 <> 0""")
def wire_to_mirror(spark, sf_dir):
    """Snapshot and binary log to the current state."""
    bound = W.with_relations(W.with_transactions(W.decode(_wire_log(spark, sf_dir))))
    log = W.change_log(bound, KEYS, {"o_orderkey": "long", "price": "decimal(18,2)", "priority": "string"})
    return apply_changes(orders_snapshot(spark, sf_dir).drop("o_custkey"), fold(log, KEYS, ["price", "priority"]), KEYS, ["price", "priority"])


@query("SELECT kind, n FROM (SELECT 'begin' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'commit', count(*) FROM orders UNION ALL SELECT 'row', count(*) FROM orders UNION ALL SELECT 'relation', 3)")
def wire_message_counts(spark, sf_dir):
    return W.decode(_wire_log(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))
