"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores,
BENCH_QUERIES optionally a comma-separated list of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lineguard.plans import catalog
from lineguard.session import local_session

#: One query per stage of the work: scan and gates, duplicates, split, metrics, thresholds,
#: log, reference, drift, window signals, decision, run table, image jobs.
HEADLINE = (
    "agg8_validation_checks",
    "dup6_near_but_not_exact",
    "spl2_build_manifest",
    "smp1_stratified_sample",
    "agg22_classification_metrics",
    "agg25_threshold_max_f1",
    "agg32_latency_summary",
    "jn4_feedback_attach",
    "win1_count_windows",
    "agg11_reference_stats",
    "agg17_feature_drift",
    "agg18_drift_rollup",
    "mon4_scenario_report",
    "mon5_window_report",
    "pol3_gate_decision",
    "pro3_select_best",
    "fea2_image_statistics",
    "fea4_hog_features",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the JVM and the workers
    seconds = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
