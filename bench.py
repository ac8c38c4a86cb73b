"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tidewatch.plans import load_all  # noqa: E402
from tidewatch.plans.catalog import QUERIES  # noqa: E402
from tidewatch.sources.tables import forget_handoffs  # noqa: E402

HEADLINE = ("metric_row", "calibrate_threshold", "first_passage", "binary_gaussian", "ewma_trunc_student_t", "failure_probability_summary",
            "survival_metrics", "path_statistics", "returns_from_prices", "cleaning_report", "two_group_loss", "bootstrap_pair")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    QUERIES["source_census"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times = {}
    for q in HEADLINE:
        forget_handoffs()  # every query pays for its own stage tables
        t = time.time()
        QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[q] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
