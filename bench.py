"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

import json
import os
import time

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.catalogue import QUERIES

NAMES = [
    "set_many_timeline", "set_many_overlapping", "merge_many_sum", "monoid_sum_sweep", "zip_overlap", "zip_all_defaults", "difference_anti", "remove_region",
    "update_region", "diff_actions", "closing_sessions", "multi_values", "cells_2d", "get_at_asof", "tax_brackets", "rules_classify", "json_roundtrip",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["get_at_asof"](spark, sf).count()  # the session and the files are warm from here on
    took, rows = {}, {}
    for name in NAMES:
        begin = time.perf_counter()
        out = QUERIES[name](spark, sf)
        seen = Observation(name)
        out.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()  # all rows are made, none goes through the driver
        took[name] = round(time.perf_counter() - begin, 3)
        rows[name] = seen.get["n"]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows": rows, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
