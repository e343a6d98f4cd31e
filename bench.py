"""Times the headline queries: one JSON line. Each is run once to warm up, then its median of RUNS is taken."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from skarn import workload

RUNS = 5
HEADLINE = ("bench_simple_join", "bench_join_aggregate", "bench_multiple_joins", "bench_join_group", "bench_stress", "flagship_revenue")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = workload.engine(spark, sf_dir)
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            db.sql(workload.SQL[name][0]).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken[1:]), 4)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
