"""Headline queries, each from cold: python bench.py. One JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

from tidegauge.catalog import inputs
from tidegauge.catalog.queries import QUERIES
from tidegauge.session import drop_staged, local_session

HEADLINE = (
    "w1_entity_features",
    "w1_entity_features_range",
    "w4_event_index",
    "d1_first_per_id",
    "a7_a8_ks",
    "a20_run_summary",
    "a21_cpu_memory",
    "a4_a6_a9_window_distances",
    "t2_t3_drift_states",
    "t5_threshold_path",
    "c1_scored_output",
    "c1_alerts",
    "c2_drift_report",
    "c3_run_evaluation",
    "c6_threshold_sweep",
    "m2_isolation_forest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="tidegauge-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").agg({"value": "sum"}).collect()  # start the JVM
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    n_lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times: dict[str, float] = {}
    only = sys.argv[1:]
    for name in HEADLINE:
        if only and name not in only:
            continue
        inputs.forget_runs()  # every query pays for all of its own work
        drop_staged(spark)
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total time of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "events": n_events,
        "feature_rows": n_lines,
    }
    if "c1_scored_output" in times:
        result["scored_events_per_sec"] = round(n_events / times["c1_scored_output"], 1)
    if "c2_drift_report" in times:
        result["window_report_rows_per_min"] = round(n_lines / times["c2_drift_report"] * 60)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
