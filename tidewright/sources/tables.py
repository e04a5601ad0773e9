"""Reading snapshots and the change log derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("o_orderpriority").alias("priority"))


#: Events of the derived log: (number, condition, op, key, old key, price sent, priority sent)
MOVED, ADDED = 10_000_000, 20_000_000


def orders_log(spark: SparkSession, sf_dir: str, moves: bool = True) -> DataFrame:
    """Updates, explicit nulls, deletes, re-inserts, new rows and (optionally) moves of ``orders``."""
    o, key = orders_snapshot(spark, sf_dir), F.col("o_orderkey")
    none = lambda t: F.lit(None).cast(t)

    def event(number, when, op, new_key=key, old_key=none("bigint"), cust=none("bigint"), price=none("decimal(18,2)"), priority=none("string"), sent=(False, False, False)):
        return F.when(when, F.struct((key * 10 + number).alias("seq"), F.lit(op).alias("op"), new_key.alias("o_orderkey"), old_key.alias("old_o_orderkey"), cust.alias("o_custkey"), price.alias("price"), priority.alias("priority"), *(F.lit(s).alias(f"p_{c}") for s, c in zip(sent, ("o_custkey", "price", "priority")))))

    full = {"cust": F.col("o_custkey"), "price": F.col("price"), "priority": F.col("priority"), "sent": (True, True, True)}
    plus = (F.col("price") + F.lit(1).cast("decimal(18,2)")).cast("decimal(18,2)")
    events = [
        event(1, key % 3 == 0, "U", price=plus, sent=(False, True, False)),
        event(2, key % 4 == 0, "U", priority=F.lit("9-CHANGED"), sent=(False, False, True)),
        event(3, key % 9 == 0, "U", sent=(False, False, True)),
        event(5, key % 5 == 0, "D"),
        event(6, key % 15 == 0, "I", **full),
        event(7, key % 7 == 0, "I", new_key=key + ADDED, **full),
    ]
    if moves:
        events.append(event(4, (key % 11 == 0) & (key % 5 != 0), "U", new_key=key + MOVED, old_key=key))
    return o.select(F.explode(F.filter(F.array(*events), lambda e: e.isNotNull())).alias("e")).select("e.*")
