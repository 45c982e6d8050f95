"""Sinks: BI pack, nested session views, findings and class profiles."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.config import ScoreConfig
from gaugeflow.functions.text import iso_text
from gaugeflow.operators import sessions as dim
from gaugeflow.operators.faults import dtc_evidence_panel
from gaugeflow.operators.ordered import cut_lineage, keep_keys, shared_folder
from gaugeflow.operators.profile import profile_arrays
from gaugeflow.operators.sessions import session_focus
from gaugeflow.operators.trends import airflow_points, airflow_trend
from gaugeflow.functions.text import decimal_text, percent_text
from gaugeflow.plans.report import (
    FINDING_KEY,
    TEXT_DTC_ROWS,
    TEXT_NO_DTC,
    Facts,
    build_findings,
    compute_facts,
    replace_findings,
    trace_id,
)
from gaugeflow.schema import SCHEMAS, Fleet, conform

# Texts beside the dashboard's panels.
HEALTH_GUIDE = "Composite SQL score for the selected session."
TREND_GUIDE = (
    "Grams of air per second (mass air flow). "
    "Bars show a rolling SQL average over the logged drive."
)
FAULT_GUIDE = (
    "OBD-II trouble codes logged during the drive. "
    "None logged means no code was stored in this public file."
)

# Exported tables, their columns and row order.
HEALTH_COLUMNS = (
    "dtc_count",
    "dtc_penalty_points",
    "ended_at",
    "health_score",
    "metric_penalty_points",
    "score_basis",
    "session_id",
    "started_at",
    "telemetry_samples",
)
EXPORT_COLUMNS = {
    "baseline_deviation": (
        "session_id",
        "metric",
        "context",
        "sample_count",
        "out_of_range_samples",
        "pct_out_of_range",
    ),
    "fuel_trim_drift": ("session_id", "ts", "ltft_b1_pct", "ltft_30s"),
    "airflow_trend": ("session_id", "ts", "maf_gps", "maf_30s"),
    "dtc_telemetry_correlation": (
        "session_id",
        "code",
        "status",
        "description",
        "fault_ts",
        "ts",
        "rpm",
        "engine_load_pct",
        "coolant_temp_c",
    ),
    "health_scores": HEALTH_COLUMNS,
}
EXPORT_ORDER = {
    "vehicles": ("vehicle_id",),
    "drive_sessions": ("session_id",),
    "telemetry_samples": ("session_id", "ts", "sample_id"),
    "dtc_events": ("dtc_id",),
    "baselines": ("baseline_id",),
    "session_overview": ("session_id",),
    "health_scores": ("session_id",),
    "baseline_deviation": ("session_id", "metric", "context"),
    "fuel_trim_drift": ("session_id", "ts", "sample_id"),
    "airflow_trend": ("session_id", "ts", "sample_id"),
    "dtc_telemetry_correlation": ("session_id", "code", "ts", "dtc_id", "sample_id"),
    "findings": ("finding_id",),
}

# Folders of a stored findings table, and the column that names them.
FINDING_BUCKETS = 64
_BUCKET = "bucket"
# Tables written at the same time: each is a job of its own, and most are too small to fill a cluster.
WRITERS = 4


def _together(spark: SparkSession, writes: Iterable[Callable[[], None]]) -> None:
    """Run independent writes side by side; the first failure is raised once all have ended."""
    with ThreadPoolExecutor(WRITERS) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(write)) for write in writes]:
            done.result()


def public_fleet(fleet: Fleet) -> Fleet:
    """The six tables reduced to public sessions and their vehicles."""
    sessions = fleet.drive_sessions
    return Fleet(
        vehicles=dim.public_vehicles(fleet.vehicles, sessions),
        drive_sessions=sessions.filter(F.col("source") == "public"),
        telemetry_samples=dim.public_telemetry(fleet.telemetry_samples, sessions),
        dtc_events=dim.public_dtc_events(fleet.dtc_events, sessions),
        baselines=dim.public_baselines(fleet.baselines, sessions),
        findings=dim.public_findings(fleet.findings, sessions),
    )


def stored_public_fleet(fleet: Fleet) -> Fleet:
    """The public tables with their samples written once, in (session, time) order.

    All exports read the samples several times; here the semi-join runs once.
    """
    public = public_fleet(fleet)
    spark = fleet.drive_sessions.sparkSession
    path = f"{shared_folder(spark)}/public-samples-{uuid.uuid4().hex}"
    clustered = public.telemetry_samples.repartitionByRange(*EXPORT_ORDER["telemetry_samples"])
    clustered.sortWithinPartitions(*EXPORT_ORDER["telemetry_samples"]).write.parquet(path)
    return replace(public, telemetry_samples=spark.read.parquet(path))


def bi_tables(fleet: Fleet, config: ScoreConfig = ScoreConfig(), **options) -> dict[str, DataFrame]:
    """The twelve tables of the BI pack, public sessions only."""
    public = stored_public_fleet(fleet)
    facts = compute_facts(public, config, keep=True, **options)
    return {
        "vehicles": public.vehicles,
        "drive_sessions": dim.public_drive_sessions(public.drive_sessions, public.vehicles),
        "telemetry_samples": public.telemetry_samples,
        "dtc_events": public.dtc_events,
        "baselines": public.baselines,
        "session_overview": dim.session_overview(
            public.drive_sessions, public.vehicles, public.telemetry_samples, public.dtc_events
        ),
        "health_scores": facts.scores,
        "baseline_deviation": facts.deviation,
        "fuel_trim_drift": facts.drift,
        "airflow_trend": airflow_trend(public.telemetry_samples, options.get("scale", 2)),
        "dtc_telemetry_correlation": facts.correlation,
        "findings": public.findings,
    }


def export_bi_pack(
    fleet: Fleet, out: str, config: ScoreConfig = ScoreConfig(), mode: str = "errorifexists", **options
) -> None:
    """Write each table as a folder of CSV files with a header, range-sorted.

    Times are ISO text in UTC.
    """

    def write(name: str, frame: DataFrame) -> None:
        ordered = frame.orderBy(*EXPORT_ORDER[name])
        columns = EXPORT_COLUMNS.get(name, frame.columns)
        types = {f.name: f.dataType for f in frame.schema.fields}
        ordered.select(
            *[
                iso_text(c).alias(c) if isinstance(types[c], T.TimestampNTZType) else c
                for c in columns
            ]
        ).write.mode(mode).option("header", True).csv(f"{out}/{name}")

    tables = bi_tables(fleet, config, **options)
    spark = fleet.drive_sessions.sparkSession
    _together(spark, [partial(write, name, frame) for name, frame in tables.items()])


def session_views(
    fleet: Fleet, facts: Facts, run_id: str | None = None, scale: int = 2
) -> DataFrame:
    """One nested record per public session.

    All arrays are bounded: 26 trend points, 6 fault rows, 5 axes, 3 concerns.
    """
    run_id = run_id or uuid.uuid4().hex
    public = fleet.drive_sessions.filter(F.col("source") == "public")
    keys = public.select("session_id")
    focus = session_focus(public, fleet.vehicles, facts.scores, facts.rollup)
    samples = keep_keys(fleet.telemetry_samples, keys, "session_id", "sample_id")
    points = airflow_points(samples, scale)
    point = F.struct(
        "point",
        iso_text("ts").alias("ts"),
        decimal_text("speed_kph", 2).alias("speed_kph"),
        decimal_text("maf_gps", 2).alias("maf_gps"),
        decimal_text("maf_30s", 2).alias("maf_30s"),
        percent_text("height").alias("height_pct"),
    )
    trend = points.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(point)), lambda p: p.dropFields("point")).alias(
            "trend"
        )
    )
    panel = dtc_evidence_panel(public, facts.correlation)
    fields = [c for c in panel.columns if c not in ("session_id", "place")]
    evidence = panel.groupBy("session_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", *fields))), lambda p: p.dropFields("place")
        ).alias("dtcEvidence")
    )
    summary = F.when(F.col("dtc_count").cast("bigint") > 0, TEXT_DTC_ROWS).otherwise(TEXT_NO_DTC)
    shown = [
        iso_text(c).alias(c) if c in ("started_at", "ended_at") else F.col(c)
        for c in focus.columns
    ]
    heads = focus.select(
        "session_id", F.struct(*shown).alias("focus"), summary.alias("dtcSummary")
    )
    profile = profile_arrays(facts.scores, facts.deviation, points)
    no_trend = F.from_json(F.lit("[]"), trend.schema["trend"].dataType.simpleString())
    return (
        heads.join(trend, "session_id", "left")
        .join(evidence, "session_id", "left")
        .join(profile, "session_id")
        .select(
            "session_id",
            "focus",
            F.coalesce("trend", no_trend).alias("trend"),
            "dtcEvidence",
            "healthMatrix",
            "performanceConcerns",
            trace_id(run_id, F.col("session_id")).alias("agentTraceId"),
            "dtcSummary",
        )
    )


def export_session_views(
    fleet: Fleet,
    out: str,
    config: ScoreConfig = ScoreConfig(),
    mode: str = "errorifexists",
    run_id: str | None = None,
    **options,
) -> None:
    """JSON lines, one public session per line.

    ``run_id`` is the one that the sessions' findings were built with; their trace ids
    are the same then.
    """
    public = stored_public_fleet(fleet)
    facts = compute_facts(public, config, keep=True, **options)
    views = session_views(public, facts, run_id, scale=options.get("scale", 2))
    views.write.mode(mode).option("ignoreNullFields", False).json(out)


def dashboard_index(fleet: Fleet, facts: Facts) -> dict[str, DataFrame]:
    """What a dashboard shows around the session views, one table each.

    ``index`` has the session to open first (no row if none is public), ``sessions`` the
    list to choose from, ``entries`` and ``records`` where the data come from.
    """
    public = fleet.drive_sessions.filter(F.col("source") == "public")
    first = dim.default_session(public, facts.scores, fleet.telemetry_samples)
    return {
        "index": first.select(
            F.col("session_id").alias("defaultSessionId"),
            F.lit(HEALTH_GUIDE).alias("healthGuide"),
            F.lit(TREND_GUIDE).alias("trendGuide"),
            F.lit(FAULT_GUIDE).alias("faultGuide"),
        ),
        "sessions": dim.session_list(public, fleet.vehicles, facts.scores, facts.rollup),
        "entries": dim.public_source_entries(public),
        "records": dim.provenance_records(public, fleet.vehicles),
    }


def export_dashboard(
    fleet: Fleet,
    out: str,
    config: ScoreConfig = ScoreConfig(),
    mode: str = "errorifexists",
    run_id: str | None = None,
    first_finding_id: int = 1,
    **options,
) -> None:
    """Renew the findings of the public sessions and write them, the views and the index.

    ``{out}/findings`` (Parquet) holds the fleet's findings with the public sessions' own
    renewed, ``{out}/views`` the session views with the trace ids of those findings, and
    ``{out}/index``, ``sessions``, ``entries``, ``records`` the tables around them.
    """
    run_id = run_id or uuid.uuid4().hex
    public = stored_public_fleet(fleet)
    facts = compute_facts(public, config, keep=True, **options)
    fresh = build_findings(public, facts, run_id, first_finding_id)
    lines = {
        "views": session_views(public, facts, run_id, scale=options.get("scale", 2)),
        **dashboard_index(public, facts),
    }

    def write(name: str, frame: DataFrame) -> None:
        frame.write.mode(mode).option("ignoreNullFields", False).json(f"{out}/{name}")

    _together(
        fleet.drive_sessions.sparkSession,
        [
            partial(write_findings, replace_findings(fleet.findings, fresh), f"{out}/findings"),
            *[partial(write, name, frame) for name, frame in lines.items()],
        ],
    )


def _in_buckets(findings: DataFrame) -> DataFrame:
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(FINDING_BUCKETS)).cast("int")
    return conform(findings, "findings").withColumn(_BUCKET, bucket)


def _put_findings(findings: DataFrame, path: str, mode: str) -> None:
    """One file a folder, several where a folder has much more than the others."""
    (
        _in_buckets(findings)
        .hint("rebalance", _BUCKET)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(_BUCKET)
        .parquet(path)
    )


def _stored_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*SCHEMAS["findings"], T.StructField(_BUCKET, T.IntegerType())])).parquet(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """Append findings to a Parquet table with ``FINDING_BUCKETS`` folders by session."""
    _put_findings(findings, path, "append")


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table written by ``write_findings``."""
    return _stored_findings(spark, path).drop(_BUCKET)


def renew_findings(path: str, fresh: DataFrame, key: str = FINDING_KEY) -> None:
    """``replace_findings`` in place: the folders of the sessions in ``fresh`` are written anew.

    All other folders are neither read nor touched, and a repeated run leaves the same rows.
    The new files are complete before the first old one goes.  Fresh rows of no session take
    their own folder along and replace nothing; without fresh rows nothing happens.
    """
    fresh = cut_lineage(conform(fresh, "findings"))
    # At most FINDING_BUCKETS rows.
    touched = [row[0] for row in _in_buckets(fresh).select(_BUCKET).distinct().collect()]
    if touched:
        stored = _stored_findings(fresh.sparkSession, path).filter(F.col(_BUCKET).isin(touched))
        _put_findings(replace_findings(stored, fresh, key), path, "overwrite")


def write_profiles(profiles: DataFrame, out: str, mode: str = "errorifexists") -> None:
    """Class profiles as JSON lines (at most four rows)."""
    profiles.coalesce(1).write.mode(mode).json(out)


def read_profiles(spark, path: str) -> DataFrame:
    return spark.read.schema(
        "engine_class STRING, metric STRING, n BIGINT, healthy_min DOUBLE, healthy_max DOUBLE, "
        "p50 DOUBLE"
    ).json(path)
