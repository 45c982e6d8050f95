"""Busy keys, ties and plans: what has to hold when one key has a third of all rows."""

import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from fixtures import control_fleet, rows_of
from gaugeflow.functions.rounding import round_sql
from gaugeflow.operators import bands, ordered, trends
from gaugeflow.operators.deviation import baseline_deviation
from gaugeflow.schema import SCHEMAS, load_tables, only_sessions, write_tables


@pytest.fixture(scope="module")
def skewed(spark):
    """One session with half of the rows, many equal timestamps, some NULL readings."""
    rng = random.Random(11)
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(3000):
        session = 1 if i % 2 else rng.randrange(2, 60)
        ts = start + timedelta(seconds=rng.randrange(40))
        maf = None if rng.random() < 0.1 else rng.randrange(1, 400) / 4
        rows.append((i, session, ts, float(rng.randrange(0, 60)), maf, rng.randrange(-80, 80) / 8))
    return spark.createDataFrame(
        rows,
        "sample_id BIGINT, session_id BIGINT, ts TIMESTAMP_NTZ, speed_kph DOUBLE, maf_gps DOUBLE, "
        "ltft_b1_pct DOUBLE",
    ).repartition(7)


def _same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


@pytest.mark.parametrize("limit", [31, 400])
def test_runs_give_the_same_trend(skewed, limit):
    assert _same(trends.fuel_trim_drift(skewed), trends.fuel_trim_drift(skewed, limit=limit))
    assert _same(trends.airflow_trend(skewed), trends.airflow_trend(skewed, limit=limit))
    assert _same(
        trends.airflow_trend_sampled(skewed), trends.airflow_trend_sampled(skewed, limit=limit)
    )


def test_runs_are_bounded(skewed):
    numbered = ordered.number_rows(skewed, ("session_id",), ("ts", "sample_id"))
    runs = ordered._runs(numbered, 50, 30)
    largest = runs.groupBy("session_id", "_run").count().agg(F.max("count")).first()[0]
    assert largest <= 50 + 30


def test_row_numbers_and_offsets(skewed):
    numbered = ordered.number_rows(skewed, (), ("ts", "sample_id"), "n")
    expected = [r["sample_id"] for r in skewed.orderBy("ts", "sample_id").collect()]
    assert [r["sample_id"] for r in numbered.orderBy("n").collect()] == expected
    assert numbered.agg(F.max("n")).first()[0] == 3000
    amounts = ordered.running_offsets(
        skewed.withColumn("amount", F.col("sample_id") % 5), ("ts", "sample_id"), "amount", "before"
    )
    total = 0
    for r in amounts.orderBy("ts", "sample_id").collect():
        assert r["before"] == total
        total += r["amount"]


def test_busy_keys(skewed):
    assert ordered.busy_keys(skewed, ("session_id",), 3000) is None
    assert rows_of(ordered.busy_keys(skewed, ("session_id",), 1000), "session_id") == [(1,)]


def test_an_outlier_leaves_no_large_task(spark):
    """One reading of 1e9 among many small ones: still no task with a fixed share of a group."""
    values = spark.range(20_000).selectExpr("'a' AS g", "id / 7D AS v", "1L AS c")
    counted = values.unionByName(spark.createDataFrame([("a", 1e9, 1)], "g STRING, v DOUBLE, c BIGINT"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = bands.nearest_rank(counted, ["g"], "v", "c", (5, 50, 95))
        assert rows_of(got, "percent", "n", "value") == [
            (5, 20_001, 1000 / 7), (50, 20_001, 10_000 / 7), (95, 20_001, 19_000 / 7),
        ]
        placed = ordered.running_offsets(counted, ["g", "v"], "c", "before")
        most = placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert most < 0.5 * 20_001


def test_nearest_rank_against_sorting(spark):
    rng = random.Random(4)
    data = {
        f"mixed {n}": [rng.choice([1.5, 2.0, rng.random() * 90]) for _ in range(n)]
        for n in (1, 2, 10, 11, 31, 240, 1001)
    }
    data["constant"] = [7.0] * 50
    rows = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g STRING, v DOUBLE")
    counted = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    got = bands.nearest_rank(counted, ["g"], "v", "c", (5, 50, 95))
    found = {(r["g"], r["percent"]): r["value"] for r in got.collect()}
    for g, values in data.items():
        for p in (5, 50, 95):
            assert found[(g, p)] == sorted(values)[round(p / 100 * (len(values) - 1))]


def test_exact_rounding(spark):
    rng = random.Random(2)
    values = [round(rng.uniform(-200, 200), rng.choice([2, 3])) for _ in range(3000)]
    values += [i / 8 for i in range(-60, 60)] + [7.965, 81.25, 12.85, 0.0, -0.05, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    for n in (1, 2):
        got = df.select("x", F.expr(round_sql("x", n)), F.expr(round_sql("x", n, True))).collect()
        unit = Decimal(1).scaleb(-n)
        for x, away, even in got:
            assert away == float(Decimal(x).quantize(unit, ROUND_HALF_UP))
            assert even == round(x, n)


def test_deviation_paths_agree_on_skew(spark, skewed):
    samples = skewed.withColumnRenamed("speed_kph", "coolant_temp_c")
    sessions = spark.range(1, 60).selectExpr("id AS session_id", "id % 5 AS vehicle_id")
    limits = spark.range(5).selectExpr(
        "id AS vehicle_id",
        "stack(3, 'coolant_temp_c', 'warm', 10D, 40D + id, 'ltft_b1_pct', 'cruise', -5D, 5D, "
        "'ltft_b1_pct', 'idle', -1D, 1D) AS (metric, context, healthy_min, healthy_max)",
    )
    metrics = ("coolant_temp_c", "ltft_b1_pct")
    ways = [
        baseline_deviation(samples, sessions, limits, metrics=metrics, combine_first=flag)
        for flag in (True, False)
    ]
    assert _same(*ways)


def test_key_filter_ways_agree(spark, skewed):
    keys = spark.createDataFrame([(1,), (5,), (1000,)], "session_id BIGINT")
    few = ordered.keep_keys(skewed, keys, "session_id", "sample_id")
    many = ordered.keep_keys(skewed, keys, "session_id", "sample_id", broadcast_rows=0)
    assert _same(few, many) and few.filter("session_id NOT IN (1, 5)").isEmpty()
    counted = many.groupBy("session_id").count()
    assert "partial_count" in _plan(counted)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored")) + "/t"
    write_tables(control_fleet(spark), root)
    return load_tables(spark, root)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_is_needed(stored):
    plan = _plan(only_sessions(trends.fuel_trim_drift(stored.telemetry_samples), [1]))
    schemas = [part.split(">")[0] for part in plan.split("ReadSchema: struct<")[1:]]
    assert schemas and all("rpm" not in s and "ltft_b1_pct" in s for s in schemas)
    assert "PushedFilters: [IsNotNull(session_id), EqualTo(session_id,1)]" in plan


def test_no_cartesian_and_no_python_in_the_core(stored):
    frames = [
        baseline_deviation(stored.telemetry_samples, stored.drive_sessions, stored.baselines),
        trends.airflow_trend_sampled(stored.telemetry_samples),
    ]
    for frame in frames:
        plan = _plan(frame)
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_schemas_survive_the_round_trip(stored):
    for name, frame in stored.tables().items():
        assert [(f.name, f.dataType) for f in frame.schema.fields] == [
            (f.name, f.dataType) for f in SCHEMAS[name].fields
        ]
