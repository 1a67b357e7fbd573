"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR: one JSON line, the median of three runs after a warm-up."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from tidemark import catalogue

HEADLINES = ["bucket_second", "rollup_year", "series_query", "quantile_p50_p95_p99_hourly", "quantile_large", "multi_measure_select", "inspect_full_key", "densify_hourly", "variance_merged", "range_total"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found: dict[str, float] = {}
    for name in HEADLINES:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf, "cpus": int(cpus), "shuffle_partitions": int(cpus)}))


if __name__ == "__main__":
    main()
