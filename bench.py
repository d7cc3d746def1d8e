"""Times the headline queries: ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]``, one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

HEADLINE = ("q_flagship", "q_join_two_hop", "q_join_reverse", "q_agg_group_by", "q_mile_processing", "q_mile_bitemporal", "q_mile_join_on", "q_win_row_number", "q_win_lag", "q_join_three_hop", "q_topk")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from entityframe.plans import catalog

    known, took = catalog.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first warms up
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(median(runs[1:]), 4)
    began = time.perf_counter()
    for _ in range(20):
        known["q_flagship"](spark, sf_dir)
    plan_only = round((time.perf_counter() - began) / 20, 4)  # of the flagship, on the driver; no query of its own
    print(json.dumps({"metric": "headline queries, warm, median of 3", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "plan_only": plan_only, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
