"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidegauge.catalog import REGISTRY  # noqa: E402
from tidegauge.session import build_session  # noqa: E402

HEADLINE = [
    "drift_psi_numeric", "drift_psi_categorical", "drift_decision", "drift_min_sample", "prediction_psi",
    "contract_report_raw", "row_validation", "clean_report", "encode_features", "stratified_split",
    "customer_since", "threshold_sweep", "auc_exact", "top_fraction_metrics", "promotion_decision",
    "latest_per_entity", "online_lookup", "asof_features", "latency_histogram", "latency_p95_sliding",
    "error_share", "in_flight", "chunk_windows", "pii_redact", "guardrail_verdict", "keyword_coverage",
    "vector_top_k", "hybrid_retrieval", "bootstrap_sample", "stream_error_share", "stream_latest",
    "stream_drift", "drift_job", "train_metrics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cores}]", int(cores),
        {"spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    # the first job pays for starting the JVM's code paths and the Python workers
    REGISTRY["drift_psi_categorical"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
