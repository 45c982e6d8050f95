"""Healthy bands: engine class, class profiles, reference and derived bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.rounding import with_rounded
from gaugeflow.operators.ordered import running_offsets

# Class limit, fallback band and reference bands.
HEAVY_LITRES = 3.0
FALLBACK_LOAD_BAND = (12.0, 35.0)
FALLBACK_COOLANT_BAND = (15.0, 95.0)
ENGINE_CLASSES = ("heavy", "light")
PROFILE_METRICS = ("engine_load_pct", "maf_gps")
COOLANT_BAND = ("coolant_temp_c", "warm", 82.0, 105.0, "C", "manual")
LTFT_BAND = ("ltft_b1_pct", "cruise", -10.0, 10.0, "%", "manual")
STFT_BAND = ("stft_b1_pct", "cruise", -10.0, 10.0, "%", "manual")
TIMING_BAND = ("timing_adv_deg", "cruise", 10.0, 45.0, "deg", "manual")


def engine_class(engine: Column) -> Column:
    """``heavy`` for V6..V12 or at least 3 litres, else ``light``."""
    litres = F.regexp_extract(engine, r"(?i)(\d+(?:\.\d+)?)\s*L", 1).try_cast("double")
    heavy = engine.rlike(r"(?i)\bV(?:6|8|10|12)\b") | (litres >= HEAVY_LITRES)
    return F.when(heavy, F.lit("heavy")).otherwise(F.lit("light"))


def nearest_rank(
    counted: DataFrame, by: Sequence[str], value: str, count: str, percents: Sequence[int]
) -> DataFrame:
    """Exact nearest-rank percentiles, index = half-even(p / 100 * (n - 1)).

    Input is distinct values with their counts per group.  One range-partitioned sort over
    (group, value) gives each value the number of readings before it, so a group spreads
    over tasks whatever its size and however its values lie.  Output: ``by``, ``n``,
    ``percent``, ``value``.
    """
    by = list(by)
    placed = running_offsets(counted.select(*by, value, count), [*by, value], count, "_ahead")
    groups = placed.groupBy(*by).agg(F.min("_ahead").alias("_first"), F.sum(count).alias("n"))
    index = F.bround(F.col("percent") / F.lit(100.0) * (F.col("n") - F.lit(1)), 0).cast("bigint")
    wanted = groups.withColumn(
        "percent", F.explode(F.array(*[F.lit(int(p)) for p in percents]))
    ).withColumn("_index", F.col("_first") + index)
    return (
        placed.join(wanted, by)
        .filter(F.col("_index").between(F.col("_ahead"), F.col("_ahead") + F.col(count) - 1))
        .select(*by, "n", "percent", F.col(value).alias("value"))
    )


def class_load_profiles(
    samples: DataFrame,
    sessions: DataFrame,
    vehicles: DataFrame,
    metrics: Sequence[str] = PROFILE_METRICS,
    min_readings: int = 10,
) -> DataFrame:
    """P5 / P50 / P95 of load and air flow per engine class; too few readings give no row.

    Readings are combined per (session, metric, value) before the class is looked
    up, so the joins see the combined rows only.
    """
    classes = sessions.select("session_id", "vehicle_id").join(
        vehicles.select("vehicle_id", engine_class(F.col("engine")).alias("engine_class")),
        "vehicle_id",
    )
    readings = (
        samples.select("session_id", *metrics)
        .unpivot("session_id", list(metrics), "metric", "reading")
        .filter(F.col("reading").isNotNull())
        .groupBy("session_id", "metric", "reading")
        .agg(F.count(F.lit(1)).alias("readings"))
        .join(classes, "session_id")
        .groupBy("engine_class", "metric", "reading")
        .agg(F.sum("readings").alias("readings"))
    )
    return _profiles(readings, min_readings)


def _profiles(readings: DataFrame, min_readings: int) -> DataFrame:
    ranked = nearest_rank(
        readings, ["engine_class", "metric"], "reading", "readings", (5, 50, 95)
    )

    def at(percent: int) -> Column:
        return F.max(F.when(F.col("percent") == percent, F.col("value")))

    picked = (
        ranked.filter(F.col("n") >= min_readings)
        .groupBy("engine_class", "metric", "n")
        .agg(at(5).alias("healthy_min"), at(95).alias("healthy_max"), at(50).alias("p50"))
    )
    return with_rounded(picked, {c: c for c in ("healthy_min", "healthy_max", "p50")}, 1, True)


def with_class_band(vehicles: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add engine class, load band and band source to each vehicle.

    Two classes exist, so the lookup table has two rows and is broadcast.  With no
    profile at all the source is ``manual``; a class without one keeps its name but
    takes the fallback band.
    """
    def edge(name: str, column: str) -> Column:
        hit = f"engine_class = '{name}' AND metric = 'engine_load_pct'"
        return F.expr(f"max(CASE WHEN {hit} THEN {column} END)")

    found = profiles.agg(
        F.expr("count(1) > 0").alias("_any"),
        *[
            edge(name, column).alias(f"{name}_{column}")
            for name in ENGINE_CLASSES
            for column in ("healthy_min", "healthy_max")
        ],
    )
    low, high = FALLBACK_LOAD_BAND
    rows = ", ".join(
        f"struct('{name}' AS engine_class, coalesce({name}_healthy_min, {low}D) AS load_min, "
        f"coalesce({name}_healthy_max, {high}D) AS load_max, "
        f"CASE WHEN _any THEN 'ved-{name}' ELSE 'manual' END AS load_source)"
        for name in ENGINE_CLASSES
    )
    classes = found.selectExpr(f"inline(array({rows}))")
    return vehicles.withColumn("engine_class", engine_class(F.col("engine"))).join(
        F.broadcast(classes), "engine_class"
    )


def engine_load_band(vehicles: DataFrame, profiles: DataFrame) -> DataFrame:
    """Class, load band and its source per vehicle."""
    return with_class_band(vehicles, profiles).select(
        "vehicle_id", "engine", "engine_class", "load_min", "load_max", "load_source"
    )


def _band(metric, context, low, high, unit, source) -> str:
    """One band as a SQL struct.  Numbers are literals; SQL text stands for itself."""

    def number(value) -> str:
        return value if isinstance(value, str) else f"{value}D"

    def word(value: str) -> str:
        return value if " " in value or value.endswith("_source") else f"'{value}'"

    return (
        f"struct('{metric}' AS metric, {word(context)} AS context, {number(low)} AS healthy_min, "
        f"{number(high)} AS healthy_max, '{unit}' AS unit, {word(source)} AS source)"
    )


def reference_baselines(vehicles: DataFrame, profiles: DataFrame) -> DataFrame:
    """The five reference bands of each vehicle; the load band is that of its class.

    Band ids are 5 * vehicle_id + 0..4.
    """
    load = ("engine_load_pct", "class", "load_min", "load_max", "%", "load_source")
    bands = (COOLANT_BAND, LTFT_BAND, STFT_BAND, load, TIMING_BAND)
    rows = ", ".join(_band(*band) for band in bands)
    return (
        with_class_band(vehicles, profiles)
        .selectExpr("vehicle_id", f"posexplode(array({rows})) AS (_at, _band)")
        .selectExpr("vehicle_id * 5 + _at AS baseline_id", "vehicle_id", "_band.*")
    )


def session_derived_baselines(sessions: DataFrame, samples: DataFrame) -> DataFrame:
    """Bands taken from a session's own extremes, padded by 12 % (at least 2 units)."""
    extremes = samples.groupBy("session_id").agg(
        *[
            agg(metric).alias(f"{name}_{short}")
            for metric, short in (("engine_load_pct", "load"), ("coolant_temp_c", "coolant"))
            for name, agg in (("lo", F.min), ("hi", F.max))
        ]
    )

    def edges(short: str, floor: float | None = None, ceiling: float | None = None) -> dict:
        low, high = f"lo_{short}", f"hi_{short}"
        pad = f"greatest(2D, greatest(5D, {high} - {low}) * 0.12D)"
        low_edge, high_edge = f"{low} - {pad}", f"{high} + {pad}"
        if floor is not None:
            low_edge = f"greatest({floor}D, {low_edge})"
            high_edge = f"least({ceiling}D, {high_edge})"
        return {f"min_{short}": low_edge, f"max_{short}": high_edge}

    def derived(short: str, metric: str, unit: str, context: str, fallback) -> str:
        def seen(yes: str, no: str) -> str:
            return f"CASE WHEN lo_{short} IS NOT NULL THEN {yes} ELSE {no} END"

        return _band(
            metric,
            seen("'session'", f"'{context}'"),
            seen(f"min_{short}", f"{fallback[0]}D"),
            seen(f"max_{short}", f"{fallback[1]}D"),
            unit,
            seen("'derived'", "'manual'"),
        )

    rows = ", ".join(
        (
            derived("coolant", "coolant_temp_c", "C", "warming", FALLBACK_COOLANT_BAND),
            _band(*LTFT_BAND),
            _band(*STFT_BAND),
            _band(*TIMING_BAND),
            derived("load", "engine_load_pct", "%", "idle", FALLBACK_LOAD_BAND),
        )
    )
    padded = with_rounded(extremes, {**edges("coolant"), **edges("load", 0.0, 100.0)}, 1, True)
    return (
        sessions.select("session_id", "vehicle_id")
        .join(padded, "session_id", "left")
        .selectExpr("session_id", "vehicle_id", f"inline(array({rows}))")
    )


def preferred_band(bands: DataFrame) -> DataFrame:
    """One band per vehicle and metric, context ``warm`` first, then lowest id."""
    rank = F.struct(F.when(F.col("context") == "warm", 0).otherwise(1), F.col("baseline_id"))
    kept = [c for c in bands.columns if c not in ("vehicle_id", "metric")]
    return (
        bands.groupBy("vehicle_id", "metric")
        .agg(F.min_by(F.struct(*kept), rank).alias("_best"))
        .select("vehicle_id", "metric", "_best.*")
    )
