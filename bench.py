"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tidewright.plans.queries import QUERIES  # noqa: E402

HEADLINE = ["mirror_orders_current_state", "fold_stable_keys", "fold_key_moves", "apply_move", "chunk_digest", "row_diff", "repair_result", "validate_batch_flags", "copy_text_encode", "stream_mirror_available_now"]


def main() -> None:
    cpus, where = os.environ.get("BENCH_CPUS", "4"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        begin = time.time()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begin, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(where.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
