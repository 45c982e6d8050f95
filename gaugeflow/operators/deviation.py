"""Share of readings outside the healthy band, and the session health score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.config import ScoreConfig
from gaugeflow.functions.rounding import with_rounded
from gaugeflow.operators.ordered import has_few_rows
from gaugeflow.schema import SCORED_METRICS

# Penalty points are added as decimals, so the sum does not depend on the order
# in which partial results arrive.
_POINTS = "decimal(38,12)"


def _readings(
    samples: DataFrame, metrics: Sequence[str], keep_missing: bool
) -> DataFrame:
    long = samples.select("session_id", *metrics).unpivot(
        "session_id", list(metrics), "metric", "observed"
    )
    return long if keep_missing else long.filter(F.col("observed").isNotNull())


def deviation_counts(
    samples: DataFrame,
    sessions: DataFrame,
    bands: DataFrame,
    metrics: Sequence[str] = SCORED_METRICS,
    count_nulls: bool = False,
    combine_first: bool | None = None,
) -> DataFrame:
    """Readings and out-of-band readings per session, metric and context.

    Few sessions and bands (both are counted): they are broadcast, bands are looked
    up next to the scan, and only per-session counts are shuffled.  Otherwise (or with
    ``combine_first=True``) readings are first counted per (session, metric, value).  Sensor values come from 8- or
    16-bit codes, so this shrinks a session to a few hundred rows however long it
    is, and the shuffle key spreads a very long session over all tasks.  Each
    later join is followed by a shuffle on other keys, which lets AQE split a
    skewed side.
    """
    owners = sessions.select("session_id", "vehicle_id")
    limits = bands.filter(F.col("metric").isin(list(metrics))).select(
        "vehicle_id", "metric", "context", "healthy_min", "healthy_max"
    )
    if combine_first is None:
        combine_first = not (has_few_rows(owners) and has_few_rows(limits))
    readings = _readings(samples, metrics, count_nulls)
    if combine_first:
        readings = readings.groupBy("session_id", "metric", "observed").agg(
            F.count(F.lit(1)).alias("readings")
        )
    else:
        readings = readings.withColumn("readings", F.lit(1).cast("bigint"))
        owners, limits = F.broadcast(owners), F.broadcast(limits)

    # NULL limits or values leave the comparison NULL, which counts as in band.
    outside = ~F.col("observed").between(F.col("healthy_min"), F.col("healthy_max"))
    return (
        readings.join(owners, "session_id")
        .join(limits, ["vehicle_id", "metric"])
        .groupBy("session_id", "metric", "context")
        .agg(
            F.sum("readings").alias("sample_count"),
            F.sum(F.when(outside, F.col("readings")).otherwise(F.lit(0))).alias(
                "out_of_range_samples"
            ),
        )
    )


def with_pct(counts: DataFrame) -> DataFrame:
    share = "100D * out_of_range_samples / nullif(sample_count, 0)"
    return with_rounded(counts, {"pct_out_of_range": share}, 1)


def baseline_deviation(
    samples: DataFrame, sessions: DataFrame, bands: DataFrame, **options
) -> DataFrame:
    """Per session, metric and context: readings, readings out of band, percentage."""
    return with_pct(deviation_counts(samples, sessions, bands, **options))


def single_metric_deviation(
    samples: DataFrame,
    sessions: DataFrame,
    bands: DataFrame,
    metric: str = "coolant_temp_c",
    count_nulls: bool = True,
) -> DataFrame:
    """Percentage for one metric; by default missing readings stay in the denominator."""
    counts = deviation_counts(samples, sessions, bands, (metric,), count_nulls)
    return with_pct(counts).select("session_id", "metric", "context", "pct_out_of_range")


def baseline_rollup(deviation: DataFrame) -> DataFrame:
    """Sample-weighted total over all metrics of a session."""
    return with_pct(
        deviation.groupBy("session_id").agg(
            F.sum("sample_count").alias("sample_count"),
            F.sum("out_of_range_samples").alias("out_of_range_samples"),
        )
    )


def metric_points(counts: DataFrame, config: ScoreConfig) -> DataFrame:
    """Penalty points per session from unrounded out-of-band rates."""
    rate = F.col("out_of_range_samples") / F.nullif(F.col("sample_count"), F.lit(0))
    points = (rate * F.lit(config.metric_penalty_points)).cast(_POINTS)
    return counts.groupBy("session_id").agg(F.sum(points).alias("metric_points"))


def fault_penalty(config: ScoreConfig) -> Column:
    """Penalty points of a fault; an unknown status costs as pending."""
    points = (
        F.when(F.col("status") == "permanent", F.lit(config.permanent_dtc_penalty))
        .when(F.col("status") == "stored", F.lit(config.stored_dtc_penalty))
        .otherwise(F.lit(config.pending_dtc_penalty))
    )
    return points.cast(_POINTS)


def fault_points(faults: DataFrame, config: ScoreConfig) -> DataFrame:
    """Fault count and penalty points per session."""
    return faults.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("dtc_count"), F.sum(fault_penalty(config)).alias("dtc_points")
    )


def sample_summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("telemetry_samples"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
    )


def score_from_parts(
    sessions: DataFrame,
    metric_part: DataFrame,
    fault_part: DataFrame,
    sample_part: DataFrame,
    config: ScoreConfig = ScoreConfig(),
) -> DataFrame:
    """Join the three per-session summaries onto all sessions and clamp the score."""
    nothing = F.lit(0).cast(_POINTS)
    metric = F.coalesce(F.col("metric_points"), nothing)
    fault = F.coalesce(F.col("dtc_points"), nothing)
    value = F.lit(config.score_ceiling).cast(_POINTS) - metric - fault
    clamped = F.greatest(
        F.lit(config.score_floor), F.least(F.lit(config.score_ceiling), value.cast("double"))
    )
    return (
        sessions.select("session_id")
        .join(metric_part, "session_id", "left")
        .join(fault_part, "session_id", "left")
        .join(sample_part, "session_id", "left")
        .select(
            "session_id",
            F.round(clamped, 1).alias("health_score"),
            F.round(metric.cast("double"), 1).alias("metric_penalty_points"),
            F.round(fault.cast("double"), 1).alias("dtc_penalty_points"),
            F.coalesce("dtc_count", F.lit(0)).alias("dtc_count"),
            F.coalesce("telemetry_samples", F.lit(0)).alias("telemetry_samples"),
            "started_at",
            "ended_at",
            F.lit(config.score_basis).alias("score_basis"),
        )
    )


def session_health_score(
    sessions: DataFrame,
    samples: DataFrame,
    faults: DataFrame,
    bands: DataFrame,
    config: ScoreConfig = ScoreConfig(),
    counts: DataFrame | None = None,
) -> DataFrame:
    """One 0-100 score per session.  ``counts`` reuses an existing deviation result."""
    if counts is None:
        counts = deviation_counts(samples, sessions, bands)
    return score_from_parts(
        sessions,
        metric_points(counts, config),
        fault_points(faults, config),
        sample_summary(samples),
        config,
    )
