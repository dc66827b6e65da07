"""Timings of the headline queries: prints one JSON line.

BENCH_SF_DIR names the data folder and BENCH_CPUS the local cores. Each query runs once cold and once
warm; the warm time is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sleuthflow.plans.registry import registered  # noqa: E402

HEADLINE = [
    "score_cases",
    "explain_cases",
    "company_metrics",
    "fifo_holding_time",
    "entity_features",
    "event_gaps",
    "case_hub_metrics",
    "counterparty_network",
    "class_overlap",
    "roc_curve",
    "score_batch_failures",
    "dataset_quality_gate",
    "stream_case_windows",
    "stream_case_state",
    "isotonic_curve",
    "calibration_report",
    "feature_drift",
    "compare_scores",
    "bootstrap_difference",
    "profile_ranges",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    wanted = sys.argv[1:] or HEADLINE
    cold, warm = {}, {}
    for name in wanted:
        for times in (cold, warm):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_warm_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": Path(sf_dir).name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
