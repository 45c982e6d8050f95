"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores.  Each query is built and written to the noop sink, so all rows and columns are
computed and none travels to Python.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from gaugeflow.testing.catalog import QUERIES

HEADLINE = (
    "baseline_deviation",
    "baseline_deviation_lines",
    "baseline_rollup",
    "session_health_score",
    "fuel_trim_drift",
    "fuel_trim_drift_in_runs",
    "airflow_trend",
    "airflow_trend_sampled",
    "dtc_telemetry_correlation",
    "dtc_evidence_panel",
    "session_overview",
    "session_overview_orders",
    "session_baselines",
    "session_focus",
    "session_list",
    "default_session",
    "provenance_records",
    "latest_finding",
    "preferred_band",
    "public_telemetry",
    "public_baselines",
    "class_load_profiles",
    "reference_baselines",
    "session_derived_baselines",
    "health_matrix",
    "performance_concerns",
    "session_report",
    "build_findings",
    "session_fact_summary",
    "quality_checks",
    "fleet_measures",
    "scan_drive_csv",
    "scan_staggered_log",
    "ingest_drives",
    "pick_warm_window",
    "forward_fill_readings",
    "scan_week_export",
    "export_bi_pack",
    "export_session_views",
    "export_dashboard",
    "live_readings_to_samples",
    "stream_samples",
    "stream_dtc_correlation",
    "stream_session_score",
    "stream_rolling_trim",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gaugeflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gaugeflow-bench-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query loads classes and starts the Python side.
    QUERIES["session_health_score"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
