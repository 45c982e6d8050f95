"""Five-axis drive profile and rule-based concerns, for all sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.rounding import with_rounded
from gaugeflow.functions.text import clamp, decimal_text, percent_text

# Metrics of the balance axis, axis ids and labels, concern texts.
BALANCE_METRICS = ("ltft_b1_pct", "stft_b1_pct", "engine_load_pct", "timing_adv_deg")
AXES = (
    ("drive_health", "Drive health"),
    ("baseline_fit", "Baseline fit"),
    ("airflow", "Airflow"),
    ("fault_clearance", "Fault clearance"),
    ("sensor_balance", "Sensor balance"),
)
CONCERN_BASELINE = (
    "Several logged metrics sat outside this vehicle's baseline bands for this drive — "
    "check sensors and drive context before assuming normal operation."
)
CONCERN_COOLANT = (
    "Coolant readings mostly sat outside the expected warm band — check the cooling system "
    "or the sensor before assuming normal operation."
)
CONCERN_PENALTY = (
    "Engine load and trim readings added measurable penalty points — the engine may have been "
    "working harder or running less evenly than a clean reference drive."
)
CONCERN_FAULT_START = "This file logged "
CONCERN_FAULT_END = (
    " fault code row(s). Open the fault panel for the code and the RPM, load, and coolant rows "
    "captured around it."
)
CONCERN_AIRFLOW = (
    "Mass airflow varied widely while the vehicle was moving — that can mean stop-and-go "
    "traffic, unstable idle, or a noisy MAF signal on this slice."
)
CONCERN_SCORE = (
    "The SQL health score is moderate for this session — use the airflow chart and fault panel "
    "together before treating the drive as fully healthy."
)
CONCERN_NONE = (
    "No fault codes were logged and nothing major stood out in SQL on this public file."
)


def _mean_share(condition: Column | None = None) -> Column:
    """Plain mean of the rounded percentages; decimals make the sum order-free."""
    share = F.col("pct_out_of_range").cast("decimal(10,1)")
    share = share if condition is None else F.when(condition, share)
    return F.sum(share).cast("double") / F.nullif(F.count(share), F.lit(0))


def deviation_profile(deviation: DataFrame) -> DataFrame:
    """What the axes and rules need to know about a session's deviation rows."""
    coolant = F.col("metric") == "coolant_temp_c"
    first_coolant = F.min_by(
        F.struct("pct_out_of_range", "sample_count"), F.when(coolant, F.struct("context"))
    )
    return (
        deviation.filter((F.col("sample_count") > 0) & F.col("pct_out_of_range").isNotNull())
        .groupBy("session_id")
        .agg(
            _mean_share().alias("mean_pct"),
            _mean_share(F.col("metric").isin(*BALANCE_METRICS)).alias("balance_pct"),
            F.sum("sample_count").alias("checked"),
            F.when(F.max(coolant), first_coolant).alias("_coolant"),
        )
        .select(
            "session_id",
            "mean_pct",
            "balance_pct",
            "checked",
            F.coalesce("_coolant.pct_out_of_range", F.lit(0.0)).alias("coolant_pct"),
            F.coalesce("_coolant.sample_count", F.lit(0)).alias("coolant_checked"),
        )
    )


def baseline_fit(profile_pct: Column, rollup_pct: Column) -> Column:
    return clamp(F.lit(100.0) - F.coalesce(profile_pct, rollup_pct, F.lit(0.0)))


def sensor_balance(balance_pct: Column, metric_penalty: Column) -> Column:
    return clamp(F.lit(100.0) - F.coalesce(balance_pct, metric_penalty * F.lit(4.0)))


def fault_clearance(dtc_count: Column) -> Column:
    return clamp(F.lit(100.0) - dtc_count.cast("double") * F.lit(30.0))


def airflow_stability_score(points: DataFrame) -> DataFrame:
    """100 minus the coefficient of variation of the smoothed flow while moving.

    Works on the display values (two decimals) of at most 26 trend points.  A point
    without a speed shows 0.00 and so counts as standing still.
    """
    flow = decimal_text("maf_30s", 2).cast("double")
    speed = decimal_text("speed_kph", 2).cast("double")
    moving = F.when((flow > 0) & (speed > 0), flow)
    mean = F.avg(moving)
    spread = F.stddev_pop(moving) / mean * F.lit(100.0)
    score = clamp(F.lit(100.0) - F.least(F.lit(85.0), spread))
    return points.groupBy("session_id").agg(
        F.when(F.count(moving) < 2, F.lit(50.0)).otherwise(score).alias("airflow")
    )


def _axis_values(scores: DataFrame, deviation: DataFrame, points: DataFrame) -> DataFrame:
    scored = scores.select("session_id", "health_score", "metric_penalty_points", "dtc_count")
    values = (
        scored.join(deviation_profile(deviation), "session_id", "left")
        .join(airflow_stability_score(points), "session_id", "left")
        .select(
            "session_id",
            F.col("health_score").alias("drive_health"),
            # A session without scored rows has no weighted share either, so 0 applies.
            baseline_fit(F.col("mean_pct"), F.lit(0.0)).alias("baseline_fit"),
            F.coalesce("airflow", F.lit(50.0)).alias("airflow"),
            fault_clearance(F.col("dtc_count")).alias("fault_clearance"),
            sensor_balance(F.col("balance_pct"), F.col("metric_penalty_points")).alias(
                "sensor_balance"
            ),
            "metric_penalty_points",
            "dtc_count",
            F.coalesce("mean_pct", F.lit(0.0)).alias("mean_pct"),
            F.coalesce("checked", F.lit(0)).alias("checked"),
            F.coalesce("coolant_pct", F.lit(0.0)).alias("coolant_pct"),
            F.coalesce("coolant_checked", F.lit(0)).alias("coolant_checked"),
        )
    )
    return with_rounded(values, {f"shown_{axis}": axis for axis, _ in AXES}, 1, True)


def baseline_fit_score(scores: DataFrame, deviation: DataFrame) -> DataFrame:
    joined = scores.select("session_id").join(deviation_profile(deviation), "session_id", "left")
    return joined.select(
        "session_id", baseline_fit(F.col("mean_pct"), F.lit(0.0)).alias("baseline_fit")
    )


def sensor_balance_score(scores: DataFrame, deviation: DataFrame) -> DataFrame:
    joined = scores.select("session_id", "metric_penalty_points").join(
        deviation_profile(deviation), "session_id", "left"
    )
    value = sensor_balance(F.col("balance_pct"), F.col("metric_penalty_points"))
    return joined.select("session_id", value.alias("sensor_balance"))


def fault_clearance_score(scores: DataFrame) -> DataFrame:
    return scores.select("session_id", fault_clearance(F.col("dtc_count")).alias("fault_clearance"))


def _axes() -> Column:
    return F.array(
        *[
            F.struct(
                F.expr(f"'{axis}' AS id"),
                F.expr(f"'{label}' AS label"),
                decimal_text(f"shown_{axis}", 1).alias("value"),
                percent_text(f"shown_{axis}").alias("width_pct"),
            )
            for axis, label in AXES
        ]
    )


def health_matrix(scores: DataFrame, deviation: DataFrame, points: DataFrame) -> DataFrame:
    """Five axis rows per session, in fixed order."""
    values = _axis_values(scores, deviation, points)
    return values.select("session_id", F.posexplode(_axes()).alias("_at", "_axis")).select(
        "session_id", (F.col("_at") + 1).alias("place"), "_axis.*"
    )


def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def _with_concerns(values: DataFrame) -> DataFrame:
    """Add the concerns of each session as an array, in rule order."""

    def when(condition: str, level: str, text: str) -> str:
        return f"CASE WHEN {condition} THEN struct('{level}' AS level, {text} AS text) END"

    fault = f"concat({_text(CONCERN_FAULT_START)}, dtc_count, {_text(CONCERN_FAULT_END)})"
    rules = (
        when("mean_pct >= 50 AND checked > 0", "watch", _text(CONCERN_BASELINE)),
        when("coolant_pct >= 50 AND coolant_checked > 0", "watch", _text(CONCERN_COOLANT)),
        when("metric_penalty_points >= 8", "watch", _text(CONCERN_PENALTY)),
        when("dtc_count > 0", "fault", fault),
        when("shown_airflow < 55", "watch", _text(CONCERN_AIRFLOW)),
    )
    moderate = when("drive_health < 90 AND size(_five) < 2", "watch", _text(CONCERN_SCORE))
    nothing = f"array(struct('ok' AS level, {_text(CONCERN_NONE)} AS text))"
    return (
        values.withColumn("_five", F.expr(f"array_compact(array({', '.join(rules)}))"))
        .withColumn("_found", F.expr(f"array_compact(concat(_five, array({moderate})))"))
        .withColumn(
            "performanceConcerns",
            F.expr(f"slice(CASE WHEN size(_found) > 0 THEN _found ELSE {nothing} END, 1, 3)"),
        )
    )


def performance_concerns(
    scores: DataFrame, deviation: DataFrame, points: DataFrame
) -> DataFrame:
    """Up to three concerns per session in rule order; ``ok`` when no rule applies."""
    found = _with_concerns(_axis_values(scores, deviation, points))
    return found.select(
        "session_id", F.posexplode("performanceConcerns").alias("_at", "_c")
    ).select("session_id", (F.col("_at") + 1).alias("place"), "_c.*")


def profile_arrays(scores: DataFrame, deviation: DataFrame, points: DataFrame) -> DataFrame:
    """Axes and concerns as two arrays per session, for nested reports."""
    return _with_concerns(_axis_values(scores, deviation, points)).select(
        "session_id", _axes().alias("healthMatrix"), "performanceConcerns"
    )


def axis_ranking(matrix: DataFrame) -> DataFrame:
    """Axes by value, highest first; ties keep the axis order.  Five rows per session."""
    order = Window.partitionBy("session_id").orderBy(
        F.col("value").cast("double").desc(), F.col("place")
    )
    return matrix.select(
        "session_id", F.row_number().over(order).alias("rank"), "id", "label", "value"
    )
