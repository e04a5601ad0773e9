"""Shared storage for intermediate tables, so that lost executors never force a long recomputation."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.storage import materialize, shared_dir, sweep

__all__ = ["materialize", "shared_dir", "shuffle_partitions", "sweep"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
