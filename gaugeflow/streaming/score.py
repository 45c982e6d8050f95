"""Session scores that follow the stream.

Samples and faults are one stream of rows that count for the groups of their session: one group
a healthy band, and one for what the session has as a whole.  The totals of the groups are
the engine's aggregation state.  Every row counts for every group of its session (if with
nothing), so a micro-batch gives complete totals of the sessions it touched and reads
nothing that earlier ones wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.config import ScoreConfig
from gaugeflow.operators.deviation import fault_penalty, metric_points, score_from_parts
from gaugeflow.operators.ordered import cut_lineage, has_few_rows
from gaugeflow.schema import SCORED_METRICS
from gaugeflow.streaming import tables

_SCORES = (
    "session_id BIGINT, health_score DOUBLE, metric_penalty_points DOUBLE, "
    "dtc_penalty_points DOUBLE, dtc_count BIGINT, telemetry_samples BIGINT, "
    "started_at TIMESTAMP_NTZ, ended_at TIMESTAMP_NTZ, score_basis STRING"
)
# Sessions whose bands are broadcast: an array of bands takes about a kilobyte, and each batch sends it anew.
LIMITED_SESSIONS = 50_000
_LIMIT = "struct<metric: string, context: string, healthy_min: double, healthy_max: double>"


def _session_limits(sessions: DataFrame, bands: DataFrame) -> DataFrame:
    """The bands of each session as one array, and a NULL for the session as a whole."""
    limits = (
        bands.filter(F.col("metric").isin(list(SCORED_METRICS)))
        .groupBy("vehicle_id")
        .agg(
            F.collect_list(
                F.struct("metric", "context", "healthy_min", "healthy_max").cast(_LIMIT)
            ).alias("limits")
        )
    )
    per_session = sessions.select("session_id", "vehicle_id").join(limits, "vehicle_id", "left")
    none = F.array(F.lit(None).cast(_LIMIT))
    per_session = per_session.select(
        "session_id", F.concat(F.coalesce("limits", F.array().cast(f"array<{_LIMIT}>")), none).alias("limits")
    )
    if has_few_rows(per_session, LIMITED_SESSIONS):
        return F.broadcast(per_session)
    # Stored once, since every batch joins them.
    return cut_lineage(per_session)


def _totals(
    samples: DataFrame, faults: DataFrame, limits: DataFrame, config: ScoreConfig
) -> DataFrame:
    """Running totals per session and band; metric and context are NULL for the session."""
    moment, points = F.lit(None).cast("timestamp_ntz"), F.lit(0).cast("decimal(38,12)")
    nothing = [F.lit(None).cast("double").alias(m) for m in SCORED_METRICS]
    rows = samples.select(
        "session_id", F.lit(1).alias("samples"), "ts", *SCORED_METRICS,
        F.lit(0).alias("faults"), points.alias("points"),
    ).unionByName(
        faults.select(
            "session_id", F.lit(0).alias("samples"), moment.alias("ts"), *nothing,
            F.lit(1).alias("faults"), fault_penalty(config).alias("points"),
        )
    )
    each = rows.join(limits, "session_id").withColumn("limit", F.explode("limits"))
    observed = F.coalesce(*[F.when(F.col("limit.metric") == m, F.col(m)) for m in SCORED_METRICS])
    # NULL limits or values leave the comparison NULL, which counts as in band.
    outside = ~F.col("observed").between(F.col("limit.healthy_min"), F.col("limit.healthy_max"))
    return (
        each.withColumn("observed", observed)
        .groupBy("session_id", F.col("limit.metric").alias("metric"), F.col("limit.context").alias("context"))
        .agg(
            F.count("observed").alias("sample_count"),
            F.sum(F.when(outside, 1).otherwise(0)).alias("out_of_range_samples"),
            F.sum("samples").alias("telemetry_samples"),
            F.min("ts").alias("started_at"),
            F.max("ts").alias("ended_at"),
            F.sum("faults").alias("dtc_count"),
            F.sum("points").cast("decimal(38,12)").alias("dtc_points"),
        )
    )


def _scores(sessions: DataFrame, totals: DataFrame, config: ScoreConfig) -> DataFrame:
    whole = totals.filter(F.col("metric").isNull())
    return score_from_parts(
        sessions,
        metric_points(totals.filter(F.col("metric").isNotNull()), config),
        whole.select("session_id", "dtc_count", "dtc_points"),
        whole.select("session_id", "telemetry_samples", "started_at", "ended_at"),
        config,
    )


def current_scores(
    spark: SparkSession, root: str, sessions: DataFrame, config: ScoreConfig = ScoreConfig()
) -> DataFrame:
    """The newest score of each session; one that the stream has not touched has no penalty."""
    written = tables.newest(tables.read(spark, root, "scores", _SCORES), ("session_id",))
    wanted = sessions.select("session_id")
    untouched = wanted.join(written, "session_id", "left_anti")
    none = {"metric_points": "decimal(38,12)", "dtc_points": "decimal(38,12)", "dtc_count": "bigint"}
    none |= {"telemetry_samples": "bigint", "started_at": "timestamp_ntz", "ended_at": "timestamp_ntz"}
    blank = untouched.select("session_id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    return written.join(wanted, "session_id", "left_semi").unionByName(
        score_from_parts(
            untouched,
            blank.select("session_id", "metric_points"),
            blank.select("session_id", "dtc_points", "dtc_count"),
            blank.select("session_id", "telemetry_samples", "started_at", "ended_at"),
            config,
        )
    )


def stream_session_score(
    samples: DataFrame,
    faults: DataFrame,
    sessions: DataFrame,
    bands: DataFrame,
    root: str,
    config: ScoreConfig = ScoreConfig(),
) -> None:
    """Drain both streams into ``{root}/scores``.

    Every batch writes the new scores of the sessions that it touched, to
    ``scores/batch=k``; ``current_scores`` gives those of all.  State is one row a session
    and band.  Rows of unknown sessions are left out, as in the batch query.
    """
    tables.create(samples.sparkSession, root, "scores", _SCORES)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        totals = batch.persist()
        touched = totals.filter(F.col("metric").isNull()).select("session_id")
        tables.put(_scores(touched, totals, config), root, "scores", batch_id)
        totals.unpersist()

    totals = _totals(samples, faults, _session_limits(sessions, bands), config)
    tables.drain(totals, refresh, f"{root}/progress/scores", "update")
