"""Report over all sessions: summaries, findings with evidence, checks, measures."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gaugeflow.config import ScoreConfig
from gaugeflow.functions.moments import epoch_millis
from gaugeflow.functions.rounding import with_rounded
from gaugeflow.functions.text import decimal_text, number_text
from gaugeflow.operators.deviation import (
    baseline_rollup,
    deviation_counts,
    session_health_score,
    with_pct,
)
from gaugeflow.operators.faults import dtc_telemetry_correlation
from gaugeflow.operators.ordered import cut_lineage, number_rows
from gaugeflow.operators.sessions import session_baselines, session_exists
from gaugeflow.operators.trends import ROWS_BEFORE, fuel_trim_drift
from gaugeflow.schema import Fleet, conform

# Report texts.
TEXT_DTC_ROWS = "Logged DTC rows are available. Use their source descriptions and SQL evidence."
TEXT_NO_DTC = "No DTC rows were logged for this session."
TEXT_CORRELATED = "SQL returned telemetry rows around logged DTC events."
TEXT_NOT_CORRELATED = "No DTC correlation rows were returned by SQL."
TEXT_RECOMMENDATION = (
    "Review the SQL health score, baseline rows, and DTC evidence before diagnosis."
)
TEXT_EXPECTED_RANGE = "directional editable scoring config"
TEXT_FIX = "Inspect SQL evidence and confirm mechanically before repair."
TEXT_NO_CODES = "No fault codes to correlate"
FINDING_KEY = "sql_analysis"

_KEEP_NULLS = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"}


@dataclass(frozen=True)
class Facts:
    """Results several reports share.  The small ones are checkpointed once."""

    deviation: DataFrame
    rollup: DataFrame
    scores: DataFrame
    drift: DataFrame
    correlation: DataFrame


def compute_facts(
    fleet: Fleet,
    config: ScoreConfig = ScoreConfig(),
    half_window: int = 5,
    scale: int = 2,
    keep: bool = False,
) -> Facts:
    """Evaluate the core queries.  ``keep`` stores the per-session results for reuse."""
    counts = deviation_counts(fleet.telemetry_samples, fleet.drive_sessions, fleet.baselines)
    counts = cut_lineage(counts) if keep else counts
    scores = session_health_score(
        fleet.drive_sessions,
        fleet.telemetry_samples,
        fleet.dtc_events,
        fleet.baselines,
        config,
        counts,
    )
    deviation = with_pct(counts)
    return Facts(
        deviation=deviation,
        rollup=baseline_rollup(deviation),
        scores=cut_lineage(scores) if keep else scores,
        drift=fuel_trim_drift(fleet.telemetry_samples, scale),
        correlation=dtc_telemetry_correlation(
            fleet.dtc_events, fleet.telemetry_samples, half_window
        ),
    )


def trace_id(run_id: str, session: Column) -> Column:
    """``agent-`` plus 32 hex digits; a pure function of run and session, so a retried
    task writes the same id."""
    return F.concat(
        F.lit("agent-"), F.md5(F.concat_ws(":", F.lit(run_id), session.cast("string")))
    )


def session_report(
    fleet: Fleet, facts: Facts, requested: DataFrame | None = None
) -> DataFrame:
    """One row per session: score, row counts per fact, and the summary texts.

    ``requested`` (ids) adds an error row for each unknown session.
    """
    known = fleet.drive_sessions.select("session_id")
    ids = requested.select("session_id") if requested is not None else known
    n_bands = (
        session_baselines(fleet.drive_sessions, fleet.baselines)
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("baseline_rows"))
    )
    n_near = facts.correlation.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("correlation_rows")
    )
    n_dev = facts.deviation.groupBy("session_id").agg(F.count(F.lit(1)).alias("deviation_rows"))
    scores = facts.scores.select(
        "session_id",
        "health_score",
        F.col("telemetry_samples").alias("drift_rows"),
        F.col("dtc_count").alias("dtc_rows"),
    )
    ok = F.col("status") == "ok"

    def text(rows: str, some: str, none: str) -> Column:
        return F.when(ok, F.when(F.coalesce(rows, F.lit(0)) > 0, some).otherwise(none))

    counts = ("deviation_rows", "drift_rows", "correlation_rows", "dtc_rows", "baseline_rows")
    return (
        session_exists(ids, fleet.drive_sessions)
        .join(scores, "session_id", "left")
        .join(n_dev, "session_id", "left")
        .join(n_near, "session_id", "left")
        .join(n_bands, "session_id", "left")
        .select(
            "session_id",
            "status",
            "error",
            "health_score",
            *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
            text("dtc_rows", TEXT_DTC_ROWS, TEXT_NO_DTC).alias("dtc_summary"),
            text("correlation_rows", TEXT_CORRELATED, TEXT_NOT_CORRELATED).alias(
                "correlation_summary"
            ),
            F.when(ok, F.lit(TEXT_RECOMMENDATION)).alias("recommendation"),
        )
    )


_SCORE_FIELDS = (
    "session_id",
    "health_score",
    "metric_penalty_points",
    "dtc_penalty_points",
    "dtc_count",
    "telemetry_samples",
    "started_at",
    "ended_at",
    "score_basis",
)
_FACT_FIELDS = {
    "baseline_deviation": (
        "metric",
        "context",
        "sample_count",
        "out_of_range_samples",
        "pct_out_of_range",
    ),
    "fuel_trim_drift": ("ts", "ltft_b1_pct", "ltft_30s"),
    "dtc_telemetry_correlation": (
        "code",
        "status",
        "description",
        "fault_ts",
        "ts",
        "rpm",
        "engine_load_pct",
        "coolant_temp_c",
    ),
}
_FACT_ORDER = {
    "baseline_deviation": ("metric", "context"),
    "fuel_trim_drift": ("ts", "sample_id"),
    "dtc_telemetry_correlation": ("code", "ts", "dtc_id", "sample_id"),
}


def _fact_frames(facts: Facts) -> dict[str, DataFrame]:
    return {
        "baseline_deviation": facts.deviation,
        "fuel_trim_drift": facts.drift,
        "dtc_telemetry_correlation": facts.correlation,
    }


def finding_evidence(facts: Facts, run_id: str) -> DataFrame:
    """Every fact row behind a finding, one JSON row each.

    Long form, so a session of any length stays spread over tasks.  ``sort_key``
    orders the rows of one fact within a session.
    """
    parts = []
    for fact, frame in _fact_frames(facts).items():
        parts.append(
            frame.select(
                trace_id(run_id, F.col("session_id")).alias("agent_trace_id"),
                "session_id",
                F.lit(fact).alias("fact"),
                F.to_json(F.struct(*_FACT_ORDER[fact]), _KEEP_NULLS).alias("sort_key"),
                F.to_json(F.struct(*_FACT_FIELDS[fact]), _KEEP_NULLS).alias("row_json"),
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def build_findings(
    fleet: Fleet, facts: Facts, run_id: str | None = None, first_id: int = 1
) -> DataFrame:
    """One ``sql_analysis`` finding per session with JSON evidence, of one shape at every size.

    ``sql_facts`` holds what is bounded: the score and one row per band.  The rows of the
    rolling trim and of the fault correlation grow with the session; ``evidence_rows``
    counts them, and ``finding_evidence`` has them all under the same trace id.
    """
    run_id = run_id or uuid.uuid4().hex
    fact = "baseline_deviation"
    entry = F.struct(
        F.struct(*_FACT_ORDER[fact]).alias("k"), F.struct(*_FACT_FIELDS[fact]).alias("v")
    )
    # One row per band of the session's vehicle.
    bands = facts.deviation.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias(fact)
    )
    no_bands = F.from_json(F.lit("[]"), bands.schema[fact].dataType.simpleString())
    # Only the ids are sorted to be numbered.
    ids = number_rows(fleet.drive_sessions.select("session_id"), (), ("session_id",), "finding_id")
    joined = (
        session_report(fleet, facts)
        .join(
            facts.scores.select("session_id", F.struct(*_SCORE_FIELDS).alias("session_health_score")),
            "session_id",
        )
        .join(bands, "session_id", "left")
        .join(ids, "session_id")
    )
    evidence = F.struct(
        F.struct(F.coalesce(fact, no_bands).alias(fact), "session_health_score").alias("sql_facts"),
        "dtc_summary",
        "correlation_summary",
        F.array("recommendation").alias("recommendations"),
        F.struct("deviation_rows", "drift_rows", "correlation_rows").alias("evidence_rows"),
    )
    found = joined.select(
        (F.col("finding_id") + F.lit(first_id - 1)).alias("finding_id"),
        "session_id",
        F.lit("info").alias("severity"),
        F.lit("session").alias("category"),
        F.lit(FINDING_KEY).alias("metric_or_code"),
        F.to_json("session_health_score", _KEEP_NULLS).alias("observed"),
        F.lit(TEXT_EXPECTED_RANGE).alias("expected_range"),
        F.col("dtc_summary").alias("likely_cause"),
        F.lit(TEXT_FIX).alias("recommended_fix"),
        F.lit(None).cast("double").alias("confidence"),
        F.to_json(evidence, _KEEP_NULLS).alias("evidence_json"),
        trace_id(run_id, F.col("session_id")).alias("agent_trace_id"),
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
        .cast("timestamp_ntz")
        .alias("created_at"),
    )
    return conform(found, "findings")


def replace_findings(findings: DataFrame, fresh: DataFrame, key: str = FINDING_KEY) -> DataFrame:
    """Drop earlier ``key`` findings of the sessions in ``fresh``, then add ``fresh``.

    Write the result to a new path; it reads the old table.
    """
    renewed = fresh.select("session_id", F.lit(key).alias("metric_or_code")).distinct()
    kept = findings.join(renewed, ["session_id", "metric_or_code"], "left_anti")
    return conform(kept, "findings").unionByName(conform(fresh, "findings"))


def session_fact_summary(facts: Facts, samples: DataFrame, scale: int = 2) -> DataFrame:
    """One line per query and session: the headline number of each.

    The last rolling trim needs only the last 31 rows of a session, so the rank
    limit cuts each task's output before the shuffle.
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("sample_id"))
    last_trim = (
        samples.select("session_id", "sample_id", "ts", "ltft_b1_pct")
        .withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= ROWS_BEFORE + 1)
        .groupBy("session_id")
        .agg(F.avg("ltft_b1_pct").alias("last_trim"))
    )
    last_trim = with_rounded(last_trim, {"last_trim": "last_trim"}, scale)
    lead = facts.deviation.groupBy("session_id").agg(
        F.min_by(
            F.struct("pct_out_of_range", "metric", "context"), F.struct("metric", "context")
        ).alias("_lead")
    )
    near = facts.correlation.groupBy("session_id").agg(F.count(F.lit(1)).alias("_near"))

    def shown(number: str) -> Column:
        return F.coalesce(number_text(number), F.lit("None"))

    lines = F.array(
        F.struct(
            F.lit("session_health_score").alias("query"),
            F.concat(
                F.lit("Score "),
                shown("health_score"),
                F.lit("; metric penalties "),
                shown("metric_penalty_points"),
                F.lit("; fault penalties "),
                shown("dtc_penalty_points"),
            ).alias("output"),
        ),
        F.when(
            F.col("_lead").isNotNull(),
            F.struct(
                F.lit("baseline_deviation").alias("query"),
                F.concat(
                    shown("_lead.pct_out_of_range"),
                    F.lit("% outside band for "),
                    F.col("_lead.metric"),
                    F.lit(" ("),
                    F.coalesce("_lead.context", F.lit("None")),
                    F.lit(")"),
                ).alias("output"),
            ),
        ),
        F.when(
            F.col("telemetry_samples") > 0,
            F.struct(
                F.lit("fuel_trim_drift").alias("query"),
                F.concat(F.lit("Latest rolling trim "), shown("last_trim"), F.lit("%")).alias(
                    "output"
                ),
            ),
        ),
        F.struct(
            F.lit("dtc_telemetry_correlation").alias("query"),
            F.coalesce(
                F.concat(F.col("_near").cast("string"), F.lit(" correlated sensor rows")),
                F.lit(TEXT_NO_CODES),
            ).alias("output"),
        ),
    )
    return (
        facts.scores.join(lead, "session_id", "left")
        .join(last_trim, "session_id", "left")
        .join(near, "session_id", "left")
        .select("session_id", F.inline(F.array_compact(lines)))
    )


def quality_checks(
    fleet: Fleet,
    expected_counts: dict[str, int],
    allowed_sources: Sequence[str] = ("csv", "emulator", "public"),
    control_words: Sequence[str] = ("Synthetic",),
) -> DataFrame:
    """Checks as rows: name, expected, actual, ok.

    ``expected_counts`` may name any table, or ``public_sessions`` and
    ``public_samples``.  Control words must not show up in public sessions or
    their vehicles.
    """
    public = fleet.drive_sessions.filter(F.col("source") == "public")
    counted = {
        **fleet.tables(),
        "public_sessions": public,
        "public_samples": fleet.telemetry_samples.join(
            public.select("session_id"), "session_id", "left_semi"
        ),
    }

    def row(name: str, expected: str, frame: DataFrame, actual: Column) -> DataFrame:
        return frame.agg(actual.cast("string").alias("actual")).select(
            F.lit(name).alias("check"), F.lit(expected).alias("expected"), "actual"
        )

    def mentions(*columns: str) -> Column:
        text = F.concat_ws(" ", *columns)
        hit = F.lit(False)
        for word in control_words:
            hit = hit | text.contains(word)
        return F.count_if(hit)

    vehicles = fleet.vehicles.join(
        public.select("vehicle_id").distinct(), "vehicle_id", "left_semi"
    )
    orphans = fleet.telemetry_samples.select("session_id").distinct().join(
        fleet.drive_sessions, "session_id", "left_anti"
    )
    rows = [
        row(f"rows in {name}", str(n), counted[name], F.count(F.lit(1)))
        for name, n in expected_counts.items()
    ]
    rows += [
        row(
            "sessions with an unknown source",
            "0",
            fleet.drive_sessions,
            F.count_if(~F.coalesce(F.col("source").isin(*allowed_sources), F.lit(False))),
        ),
        row(
            "session sources",
            ",".join(sorted(allowed_sources)),
            fleet.drive_sessions,
            F.array_join(F.array_sort(F.collect_set("source")), ","),
        ),
        row("control rows among public sessions", "0", public, mentions("notes")),
        row("control rows among public vehicles", "0", vehicles, mentions("make", "model", "notes")),
        row("samples of unknown sessions", "0", orphans, F.count(F.lit(1))),
    ]
    result = rows[0]
    for other in rows[1:]:
        result = result.unionByName(other)
    return result.withColumn("ok", F.col("expected") == F.col("actual"))


def export_checks(
    spark: SparkSession,
    pack: str,
    dashboard: str,
    tables: Sequence[str],
    control_words: Sequence[str] = ("Synthetic",),
    silent: Sequence[str] = ("dtc_telemetry_correlation",),
) -> DataFrame:
    """Checks of written exports as rows: name, expected, actual, ok.

    Every table of the BI pack must have a file with a header, and no file but those of
    ``silent`` may hold a control word.  The dashboard must open with a public session
    that has a view, list as many entries and records as sessions, and each view must have
    1 to 26 trend points if the session has air flow, five axes, a concern, a trace id and
    a score that says it is directional.
    """

    def row(name: str, expected: str, frame: DataFrame, actual: Column) -> DataFrame:
        return frame.agg(actual.cast("string").alias("actual")).select(
            F.lit(name).alias("check"), F.lit(expected).alias("expected"), "actual"
        )

    lines = spark.read.text([f"{pack}/{name}" for name in tables]).select(
        "value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("table")
    )
    holds = F.lit(False)
    for word in control_words:
        holds = holds | F.col("value").contains(word)
    views = spark.read.json(f"{dashboard}/views")
    listed = {n: spark.read.json(f"{dashboard}/{n}") for n in ("index", "sessions", "entries", "records")}
    first = listed["index"].select(F.col("defaultSessionId").alias("session_id"))
    sound = (
        (F.size("trend") <= 26)
        & (F.size("healthMatrix") == 5)
        & (F.size("performanceConcerns") > 0)
        & F.col("agentTraceId").startswith("agent-")
        & F.col("focus.score_basis").contains("directional")
    )
    count = F.count(F.lit(1))
    rows = [
        row("exported tables with a header", str(len(set(tables))), lines, F.count_distinct("table")),
        row(
            "lines with control words",
            "0",
            lines.filter(~F.col("table").isin(*silent)),
            F.count_if(holds),
        ),
        row("views that break a rule", "0", views, F.count_if(~F.coalesce(sound, F.lit(False)))),
        row("opening sessions with a view and a trend", "1",
            views.filter(F.size("trend") > 0).join(first, "session_id"), count),
        row("listed sessions that are not public", "0", listed["sessions"],
            F.count_if(F.col("source") != "public")),
        row("listed sessions with control words", "0", listed["sessions"],
            F.count_if(F.to_json(F.struct("*")).rlike("|".join(control_words)))),
    ]
    for name in ("sessions", "entries", "records"):
        missing = views.select("session_id").join(listed[name], "session_id", "left_anti")
        rows.append(row(f"views missing among {name}", "0", missing, count))
    result = rows[0]
    for other in rows[1:]:
        result = result.unionByName(other)
    return result.withColumn("ok", F.col("expected") == F.col("actual"))


def fleet_measures(scores: DataFrame, overview: DataFrame) -> DataFrame:
    """Average score, total samples and total fault events, with the score label."""
    mean = scores.agg(
        (
            F.sum(F.col("health_score").cast("decimal(20,1)")).cast("double") / F.count("health_score")
        ).alias("average_health_score")
    )
    totals = overview.agg(
        F.sum("telemetry_samples").alias("total_telemetry_samples"),
        F.sum("dtc_events").alias("logged_dtc_events"),
    )
    names = ("average_health_score", "total_telemetry_samples", "logged_dtc_events")
    # Two one-row results put side by side.
    both = mean.unionByName(totals, allowMissingColumns=True)
    return both.agg(*[F.max(n).alias(n) for n in names]).withColumn(
        "score_label", F.lit("Directional editable scoring config")
    )


def drive_window(scores: DataFrame) -> DataFrame:
    """Drive length in seconds and as text, and seconds per row."""
    millis = epoch_millis(F.col("ended_at")) - epoch_millis(F.col("started_at"))
    seconds = F.coalesce(
        F.when(millis > 0, F.floor(millis / F.lit(1000.0) + F.lit(0.5)).cast("bigint")), F.lit(0)
    )
    minutes = F.expr("duration_sec div 60")
    rest = F.col("duration_sec") % 60
    text = F.when(
        minutes > 0,
        F.concat(
            minutes.cast("string"), F.lit("m "), F.lpad(rest.cast("string"), 2, "0"), F.lit("s")
        ),
    ).otherwise(F.concat(rest.cast("string"), F.lit("s")))
    pace = F.concat(
        decimal_text("try_divide(duration_sec, telemetry_samples)", 1),
        F.lit("s per row"),
    )
    return (
        scores.select("session_id", "telemetry_samples", seconds.alias("duration_sec"), (millis > 0).alias("_runs"))
        .select(
            "session_id",
            "duration_sec",
            F.when(F.col("_runs"), text).otherwise("—").alias("duration"),
            F.when((F.col("telemetry_samples") > 0) & (F.col("duration_sec") > 0), pace)
            .otherwise("—")
            .alias("sample_pace"),
        )
    )


def trend_axes(sessions: DataFrame, points: DataFrame) -> DataFrame:
    """Axis labels of the trend chart: elapsed start and end, highest smoothed flow."""
    spans = points.groupBy("session_id").agg(
        (epoch_millis(F.max_by("ts", "point")) - epoch_millis(F.min_by("ts", "point"))).alias("_ms"),
        F.max(decimal_text("maf_30s", 2).cast("double")).alias("_top"),
    )
    spans = with_rounded(spans, {"_shown": "_top"}, 1)
    total = F.greatest(F.lit(0), F.floor(F.col("_ms") / F.lit(1000.0) + F.lit(0.5))).cast("bigint")
    clock = F.concat(
        F.floor(total / 60).cast("string"), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0")
    )
    return sessions.select("session_id").join(spans, "session_id", "left").select(
        "session_id",
        F.lit("0:00").alias("start"),
        F.coalesce(clock, F.lit("0:00")).alias("end"),
        F.when(F.col("_shown").isNull(), "0").otherwise(decimal_text("_shown", 1)).alias("max_g"),
    )


__all__ = [
    "Facts",
    "build_findings",
    "compute_facts",
    "drive_window",
    "export_checks",
    "finding_evidence",
    "fleet_measures",
    "quality_checks",
    "replace_findings",
    "session_fact_summary",
    "session_report",
    "trend_axes",
]
