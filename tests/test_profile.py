"""Axes and concerns on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import profile

SCORES = (
    "session_id BIGINT, health_score DOUBLE, metric_penalty_points DOUBLE, dtc_count BIGINT"
)
DEVIATION = (
    "session_id BIGINT, metric STRING, context STRING, sample_count BIGINT, "
    "out_of_range_samples BIGINT, pct_out_of_range DOUBLE"
)
POINTS = "session_id BIGINT, point INT, speed_kph DOUBLE, maf_30s DOUBLE"

CASES = {
    # session: (score, penalty, faults), deviation rows, (maf, speed) points
    1: ((96.0, 4.0, 0), [("engine_load_pct", "session", 100, 5.0)],
        [(10.0, 25.0), (12.0, 30.0), (11.0, 28.0), (0.0, 0.0)]),
    2: ((100.0, 0.0, 0), [], [(10.0, 20.0), (10.5, 22.0)]),
    3: ((100.0, 0.0, 0), [], [(20.0, 40.0), (2.0, 40.0), (0.0, 0.0)]),
    4: ((85.0, 3.0, 0), [("coolant_temp_c", "a", 10, 60.0), ("coolant_temp_c", "b", 10, 0.0)],
        [(5.0, 5.0), (5.0, 5.0)]),
    5: ((20.0, 30.0, 4), [("coolant_temp_c", "warm", 9, 100.0), ("ltft_b1_pct", "cruise", 9, 50.0)],
        [(9.0, None)]),
    6: ((89.9, 0.0, 0), [("timing_adv_deg", "cruise", 9, 0.0)], [(3.0, 9.0), (3.0, 9.0)]),
    7: ((100.0, 0.0, 0), [], []),
    8: ((80.0, 9.0, 2), [], [(3.0, 9.0), (3.0, 9.0)]),
}


@pytest.fixture(scope="module")
def frames(spark):
    scores = [(s, *case[0]) for s, case in CASES.items()]
    deviation = [(s, m, c, n, 0, pct) for s, case in CASES.items() for m, c, n, pct in case[1]]
    points = [
        (s, i, speed, maf) for s, case in CASES.items() for i, (maf, speed) in enumerate(case[2], 1)
    ]
    return (
        spark.createDataFrame(scores, SCORES),
        spark.createDataFrame(deviation, DEVIATION),
        spark.createDataFrame(points, POINTS),
    )


@pytest.fixture(scope="module")
def axes(frames):
    rows = profile.health_matrix(*frames).collect()
    assert len(rows) == 5 * len(CASES)
    return {(r["session_id"], r["id"]): float(r["value"]) for r in rows}


def test_axes(axes):
    assert axes[1, "drive_health"] == 96.0
    assert axes[1, "baseline_fit"] == 95.0
    assert axes[1, "sensor_balance"] == 95.0
    assert axes[1, "fault_clearance"] == 100.0
    assert axes[1, "airflow"] == round(100 - 100 * (2 / 3) ** 0.5 / 11, 1)


def test_standing_points_do_not_count(axes):
    assert axes[2, "airflow"] > axes[3, "airflow"]
    assert axes[3, "airflow"] == round(100 - 100 * 9 / 11, 1)


def test_fallbacks(axes):
    # Fewer than two moving points, no deviation rows, penalty fallback, clamps.
    assert axes[7, "airflow"] == 50.0 and axes[5, "airflow"] == 50.0
    assert axes[7, "baseline_fit"] == 100.0
    assert axes[8, "sensor_balance"] == 64.0
    assert axes[4, "sensor_balance"] == 88.0
    assert axes[5, "fault_clearance"] == 0.0
    assert axes[8, "fault_clearance"] == 40.0


def test_concerns(frames):
    found = {}
    for r in profile.performance_concerns(*frames).orderBy("session_id", "place").collect():
        found.setdefault(r["session_id"], []).append((r["level"], r["text"]))
    watch = lambda text: ("watch", text)
    fault = lambda n: (
        "fault", f"{profile.CONCERN_FAULT_START}{n}{profile.CONCERN_FAULT_END}"
    )
    assert found[1] == [("ok", profile.CONCERN_NONE)]
    assert found[3] == [watch(profile.CONCERN_AIRFLOW)]
    # The first coolant row by context counts; one concern so far lets the score rule in.
    assert found[4] == [watch(profile.CONCERN_COOLANT), watch(profile.CONCERN_SCORE)]
    assert found[5] == [
        watch(profile.CONCERN_BASELINE),
        watch(profile.CONCERN_COOLANT),
        watch(profile.CONCERN_PENALTY),
    ]
    assert found[6] == [watch(profile.CONCERN_SCORE)]
    assert found[8] == [watch(profile.CONCERN_PENALTY), fault(2)]


def test_ranking_keeps_axis_order_on_ties(frames):
    ranked = profile.axis_ranking(profile.health_matrix(*frames)).filter("session_id = 7")
    assert [r["id"] for r in ranked.orderBy("rank").collect()] == [
        "drive_health", "baseline_fit", "fault_clearance", "sensor_balance", "airflow",
    ]
    assert ranked.agg(F.max("rank")).first()[0] == 5
