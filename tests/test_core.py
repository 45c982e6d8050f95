"""Control drives: published and hand-checked results."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fixtures import control_fleet, rows_of
from gaugeflow import load_tables, only_sessions, write_tables
from gaugeflow.config import ScoreConfig, load_score_config
from gaugeflow.operators import bands, deviation, faults, sessions, trends
from gaugeflow.plans import report
from gaugeflow.plans.ingest import ingest_counts


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    """Written and loaded again, so every test reads the Parquet layout."""
    root = str(tmp_path_factory.mktemp("tables"))
    write_tables(control_fleet(spark), f"{root}/t")
    return load_tables(spark, f"{root}/t")


@pytest.fixture(scope="module")
def facts(fleet):
    return report.compute_facts(fleet, keep=True)


def test_ingest_counts(fleet):
    assert rows_of(ingest_counts(fleet), "session_id", "telemetry_rows", "dtc_rows") == [
        (1, 12, 1),
        (2, 12, 1),
    ]


def test_ingested_times_do_not_follow_the_session_zone(fleet):
    first = fleet.drive_sessions.filter("session_id = 1").first()
    assert first["started_at"] == datetime(2026, 6, 1, 9, 0, 0)
    assert first["ended_at"] == datetime(2026, 6, 1, 9, 0, 11)


def test_sample_ids_follow_session_and_file_order(fleet):
    ordered = fleet.telemetry_samples.orderBy("session_id", "ts").select("sample_id").collect()
    assert [r["sample_id"] for r in ordered] == list(range(1, 25))


EXPECTED_DEVIATION = [
    (1, "coolant_temp_c", 12, 0, 0.0),
    (1, "engine_load_pct", 12, 5, 41.7),
    (1, "ltft_b1_pct", 12, 4, 33.3),
    (1, "stft_b1_pct", 12, 0, 0.0),
    (1, "timing_adv_deg", 12, 0, 0.0),
    (2, "coolant_temp_c", 12, 2, 16.7),
    (2, "engine_load_pct", 12, 6, 50.0),
    (2, "ltft_b1_pct", 12, 0, 0.0),
    (2, "stft_b1_pct", 12, 0, 0.0),
    (2, "timing_adv_deg", 12, 0, 0.0),
]


@pytest.mark.parametrize("combine_first", [True, False, None])
def test_baseline_deviation(fleet, combine_first):
    got = deviation.baseline_deviation(
        fleet.telemetry_samples, fleet.drive_sessions, fleet.baselines, combine_first=combine_first
    )
    columns = ("session_id", "metric", "sample_count", "out_of_range_samples", "pct_out_of_range")
    assert rows_of(got, *columns) == EXPECTED_DEVIATION


def test_health_score(facts):
    columns = (
        "session_id",
        "health_score",
        "metric_penalty_points",
        "dtc_penalty_points",
        "dtc_count",
    )
    assert rows_of(facts.scores, *columns) == [(1, 81.0, 9.0, 10.0, 1), (2, 74.0, 8.0, 18.0, 1)]


def test_fuel_trim_drift(facts):
    by_session = facts.drift.groupBy("session_id").agg(
        F.min_by("ltft_30s", "ts").alias("first"), F.max_by("ltft_30s", "ts").alias("last")
    )
    assert rows_of(by_session, "session_id", "first", "last") == [(1, 4.1, 8.32), (2, 2.0, 3.59)]


def test_correlation_window(facts):
    counted = facts.correlation.groupBy("session_id", "code").count()
    assert rows_of(counted, "session_id", "code", "count") == [(1, "P0171", 11), (2, "P0301", 11)]


def test_airflow_points(fleet):
    points = trends.airflow_points(fleet.telemetry_samples)
    shown = points.groupBy("session_id").agg(F.count("point").alias("n"), F.max("maf_30s").alias("m"))
    assert rows_of(shown, "session_id", "n", "m") == [(1, 12, 19.58), (2, 12, 23.42)]


def test_session_filter(fleet):
    assert only_sessions(fleet.telemetry_samples, [2]).count() == 12


def test_overview_repeats_samples_per_fault(spark, fleet):
    twice = fleet.dtc_events.unionByName(
        fleet.dtc_events.filter("session_id = 1").withColumn("dtc_id", F.lit(99).cast("bigint"))
    )
    args = (fleet.drive_sessions, fleet.vehicles, fleet.telemetry_samples, twice)
    columns = ("session_id", "telemetry_samples", "dtc_events")
    assert rows_of(sessions.session_overview(*args), *columns) == [(1, 24, 2), (2, 12, 1)]
    true_count = sessions.session_overview(*args, distinct=True)
    assert rows_of(true_count, *columns) == [(1, 12, 2), (2, 12, 1)]


def test_edge_cases_of_the_score(spark, fleet):
    extra = spark.createDataFrame([(7, 1), (8, 1)], "session_id BIGINT, vehicle_id BIGINT")
    odd = spark.createDataFrame(
        [(1, 8, "P1", "odd"), (2, 8, "P2", None)],
        "dtc_id BIGINT, session_id BIGINT, code STRING, status STRING",
    )
    got = deviation.session_health_score(
        extra, fleet.telemetry_samples, odd, fleet.baselines, ScoreConfig()
    )
    columns = ("session_id", "health_score", "dtc_penalty_points", "telemetry_samples", "started_at")
    assert rows_of(got, *columns) == [(7, 100.0, 0.0, 0, None), (8, 80.0, 20.0, 0, None)]


def test_score_stays_within_floor_and_ceiling(spark, fleet):
    config = ScoreConfig(metric_penalty_points=1000.0, score_floor=3.0)
    got = deviation.session_health_score(
        fleet.drive_sessions, fleet.telemetry_samples, fleet.dtc_events, fleet.baselines, config
    )
    assert {r["health_score"] for r in got.collect()} == {3.0}


def test_open_band_counts_as_in_range(spark, fleet):
    open_band = fleet.baselines.withColumn("healthy_max", F.lit(None).cast("double"))
    got = deviation.baseline_deviation(fleet.telemetry_samples, fleet.drive_sessions, open_band)
    high = got.filter("metric = 'engine_load_pct'")
    assert rows_of(high, "session_id", "out_of_range_samples") == [(1, 0), (2, 0)]


def test_missing_readings(spark, fleet):
    sparse = fleet.telemetry_samples.withColumn(
        "coolant_temp_c", F.when(F.col("sample_id") <= 3, F.lit(200.0))
    )
    args = (sparse, fleet.drive_sessions, fleet.baselines)
    plain = deviation.single_metric_deviation(*args, count_nulls=False)
    assert rows_of(plain, "session_id", "pct_out_of_range") == [(1, 100.0)]
    with_nulls = deviation.single_metric_deviation(*args)
    assert rows_of(with_nulls, "session_id", "pct_out_of_range") == [(1, 25.0), (2, 0.0)]


def test_whole_second_window_ignores_fractions(spark):
    fault = spark.createDataFrame(
        [(1, 1, datetime(2026, 1, 1, 0, 0, 10, 900000), "P1", None, None)],
        "dtc_id BIGINT, session_id BIGINT, ts TIMESTAMP_NTZ, code STRING, status STRING, "
        "description STRING",
    )
    times = [(4, 999999), (5, 0), (15, 999999), (16, 0)]
    samples = spark.createDataFrame(
        [(i, 1, datetime(2026, 1, 1, 0, 0, s, us), 1.0, 1.0, 1.0) for i, (s, us) in enumerate(times)],
        "sample_id BIGINT, session_id BIGINT, ts TIMESTAMP_NTZ, rpm DOUBLE, engine_load_pct DOUBLE, "
        "coolant_temp_c DOUBLE",
    )
    got = faults.dtc_telemetry_correlation(fault, samples)
    assert rows_of(got, "sample_id") == [(1,), (2,)]


def test_score_config_needs_every_key(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"label": "x", "score_floor": 0}')
    with pytest.raises(ValueError, match="metric_penalty_points"):
        load_score_config(spark, str(path))
    path.write_text(
        '{"label": "x",\n "metric_penalty_points": 1, "pending_dtc_penalty": 2, '
        '"stored_dtc_penalty": 3, "permanent_dtc_penalty": 4, "score_floor": 5, '
        '"score_ceiling": "60"}'
    )
    assert load_score_config(spark, str(path)) == ScoreConfig("x", 1.0, 2.0, 3.0, 4.0, 5.0, 60.0)


def test_preferred_band_takes_warm_first(fleet):
    idle = fleet.baselines.filter("metric = 'coolant_temp_c'").withColumns(
        {"context": F.lit("idle"), "baseline_id": F.lit(0).cast("bigint")}
    )
    best = bands.preferred_band(fleet.baselines.unionByName(idle)).filter("metric = 'coolant_temp_c'")
    assert {r["context"] for r in best.collect()} == {"warm"}


def test_class_bands(spark, fleet):
    engines = ["LS1 5.7L V8", "4-FI 1.5L", "3.0 l diesel", "V8", "v10 truck", "2.9L", "", None]
    df = spark.createDataFrame([(e,) for e in engines], "engine STRING")
    got = [r[0] for r in df.select(bands.engine_class(F.col("engine"))).collect()]
    assert got == ["heavy", "light", "heavy", "heavy", "heavy", "light", "light", "light"]
    load = fleet.baselines.filter("metric = 'engine_load_pct'").first()
    assert (load["healthy_min"], load["healthy_max"], load["source"]) == (11.4, 38.8, "ved-heavy")


def test_band_sources_without_profiles(spark, fleet):
    none = spark.createDataFrame(
        [], "engine_class STRING, metric STRING, n BIGINT, healthy_min DOUBLE, healthy_max DOUBLE"
    )
    got = bands.engine_load_band(fleet.vehicles, none).first()
    assert (got["load_min"], got["load_max"], got["load_source"]) == (12.0, 35.0, "manual")
    other = spark.createDataFrame(
        [("light", "maf_gps", 20, 1.0, 2.0)],
        "engine_class STRING, metric STRING, n BIGINT, healthy_min DOUBLE, healthy_max DOUBLE",
    )
    got = bands.engine_load_band(fleet.vehicles, other).first()
    assert (got["load_min"], got["load_max"], got["load_source"]) == (12.0, 35.0, "ved-heavy")
