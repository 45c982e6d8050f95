"""Session dimension queries: overviews, provenance, public extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.text import between_markers, clean_source_file, decimal_text, percent_text
from gaugeflow.operators.ordered import keep_keys



def _public(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("source") == "public")


def session_baselines(sessions: DataFrame, bands: DataFrame) -> DataFrame:
    """Bands of the vehicle of each session."""
    return (
        sessions.select("session_id", "vehicle_id")
        .join(bands, "vehicle_id")
        .select(
            "session_id", "metric", "context", "healthy_min", "healthy_max", "unit", "source"
        )
    )


def session_overview(
    sessions: DataFrame,
    vehicles: DataFrame,
    samples: DataFrame,
    faults: DataFrame,
    public_only: bool = False,
    distinct: bool = False,
) -> DataFrame:
    """Sample and fault counts per session.

    Joining both child tables at once repeats every sample per fault, and the
    published numbers include that.  Both sides are counted first, so the repeat
    is a multiplication here; ``distinct=True`` gives the true sample count.
    """
    chosen = _public(sessions) if public_only else sessions
    n_samples = samples.groupBy("session_id").agg(F.count("sample_id").alias("n_samples"))
    n_faults = faults.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_faults"))
    repeat = F.lit(1) if distinct else F.greatest(F.coalesce("n_faults", F.lit(0)), F.lit(1))
    return (
        chosen.join(vehicles.select("vehicle_id", "make", "model"), "vehicle_id")
        .join(n_samples, "session_id", "left")
        .join(n_faults, "session_id", "left")
        .select(
            "session_id",
            "make",
            "model",
            "source",
            "started_at",
            "ended_at",
            (F.coalesce("n_samples", F.lit(0)) * repeat).cast("bigint").alias("telemetry_samples"),
            F.coalesce("n_faults", F.lit(0)).alias("dtc_events"),
        )
    )


def raw_source_file(notes: Column) -> Column:
    return between_markers(notes, "source_file=", "; drive_label=")


def drive_label(notes: Column) -> Column:
    return between_markers(notes, "drive_label=", "; license=")


def license_slice(notes: Column) -> Column:
    """The license as the published records show it.

    Their slice starts two characters before the value and stops two characters
    before the end of the notes (``license=CC BY 4.0.`` gives ``e=CC BY 4.``).
    """
    at = F.instr(notes, "; license=")
    return F.when(
        at > 0, F.substr(notes, at + F.lit(8), F.greatest(F.length(notes) - at - F.lit(9), F.lit(0)))
    )


def license_text(notes: Column) -> Column:
    """The license itself, without the closing full stop."""
    return F.nullif(F.regexp_extract(notes, r"; license=(.*?)\.?$", 1), F.lit(""))


def dataset_name(notes: Column) -> Column:
    # Names of the public archives.
    return (
        F.when(notes.contains("KIT/RADAR"), "KIT/RADAR Automotive OBD-II Dataset")
        .when(notes.contains("carOBD"), "carOBD (Toyota Etios)")
        .when(notes.contains("OBD2 panel Opel"), "OBD2 panel Opel 2012")
        .otherwise("Public OBD-II archive")
    )


def _vehicle_label() -> Column:
    return F.concat(F.col("make"), F.lit(" "), F.col("model"))


def provenance_records(
    sessions: DataFrame, vehicles: DataFrame, clean_license: bool = False
) -> DataFrame:
    """Vehicle, label, source file, license and archive of each public session."""
    notes = F.col("session_notes")
    chosen = _public(sessions).select(
        "session_id", "vehicle_id", F.col("notes").alias("session_notes")
    )
    return chosen.join(vehicles.select("vehicle_id", "make", "model"), "vehicle_id").select(
        "session_id",
        _vehicle_label().alias("vehicle"),
        drive_label(notes).alias("drive_label"),
        clean_source_file(raw_source_file(notes)).alias("source_file"),
        (license_text(notes) if clean_license else license_slice(notes)).alias("license"),
        dataset_name(notes).alias("dataset_name"),
    )


def public_source_entries(sessions: DataFrame) -> DataFrame:
    """Cleaned source file of each public session."""
    return _public(sessions).select(
        "session_id", clean_source_file(raw_source_file(F.col("notes"))).alias("source_file")
    )


def _labelled(
    sessions: DataFrame, vehicles: DataFrame, scores: DataFrame, rollup: DataFrame
) -> DataFrame:
    notes = F.col("notes")
    return (
        sessions.select("session_id", "vehicle_id", "source", "notes")
        .join(vehicles.select("vehicle_id", "make", "model"), "vehicle_id")
        .join(scores, "session_id")
        .join(rollup, "session_id", "left")
        .withColumn("vehicle", _vehicle_label())
        .withColumn("source_file", clean_source_file(raw_source_file(notes)))
        .withColumn("drive_label", drive_label(notes))
    )


def session_focus(
    sessions: DataFrame, vehicles: DataFrame, scores: DataFrame, rollup: DataFrame
) -> DataFrame:
    """Score, weighted out-of-band share and labels of each session, numbers as text."""
    return _labelled(sessions, vehicles, scores, rollup).select(
        "session_id",
        "vehicle",
        "source",
        "notes",
        "source_file",
        "drive_label",
        "started_at",
        "ended_at",
        decimal_text("health_score", 1).alias("health_score"),
        percent_text("health_score").alias("health_score_width"),
        decimal_text("metric_penalty_points", 1).alias("metric_penalty_points"),
        decimal_text("dtc_penalty_points", 1).alias("dtc_penalty_points"),
        F.col("dtc_count").cast("string").alias("dtc_count"),
        F.col("telemetry_samples").cast("string").alias("telemetry_samples"),
        "score_basis",
        decimal_text("pct_out_of_range", 1).alias("pct_out_of_range"),
        percent_text("pct_out_of_range").alias("baseline_width"),
        F.col("out_of_range_samples").cast("string").alias("out_of_range_samples"),
        F.col("sample_count").cast("string").alias("sample_count"),
    )


def session_list(
    sessions: DataFrame, vehicles: DataFrame, scores: DataFrame, rollup: DataFrame
) -> DataFrame:
    """Short form of ``session_focus`` for public sessions."""
    return session_focus(_public(sessions), vehicles, scores, rollup).select(
        "session_id",
        "vehicle",
        "source",
        "notes",
        "source_file",
        "drive_label",
        "health_score",
        "health_score_width",
        "telemetry_samples",
        "dtc_count",
        "pct_out_of_range",
        "baseline_width",
    )


def default_session(sessions: DataFrame, scores: DataFrame, samples: DataFrame) -> DataFrame:
    """The public session with the lowest score among those with any air-flow reading."""
    with_airflow = samples.filter(F.col("maf_gps").isNotNull()).select("session_id").distinct()
    return (
        scores.select("session_id", "health_score")
        .join(_public(sessions).select("session_id"), "session_id", "left_semi")
        .join(with_airflow, "session_id", "left_semi")
        .orderBy("health_score", "session_id")
        .limit(1)
    )


def latest_finding(findings: DataFrame) -> DataFrame:
    """Newest finding of each session."""
    shown = (
        "severity",
        "category",
        "metric_or_code",
        "expected_range",
        "likely_cause",
        "recommended_fix",
        "agent_trace_id",
    )
    return (
        findings.groupBy("session_id")
        .agg(F.max_by(F.struct("finding_id", *shown), "finding_id").alias("_newest"))
        .select("session_id", "_newest.*")
    )


def sessions_by_label(sessions: DataFrame, label: str) -> DataFrame:
    """Public sessions whose notes carry this drive label."""
    return _public(sessions).filter(F.col("notes").contains(f"drive_label={label};"))


def _of_public_vehicles(df: DataFrame, sessions: DataFrame) -> DataFrame:
    keys = _public(sessions).select("vehicle_id").distinct()
    return df.join(keys, "vehicle_id", "left_semi").select(*df.columns)


def _of_public_sessions(df: DataFrame, sessions: DataFrame) -> DataFrame:
    keys = _public(sessions).select("session_id")
    return keep_keys(df, keys, "session_id", df.columns[0])


def public_vehicles(vehicles: DataFrame, sessions: DataFrame) -> DataFrame:
    return _of_public_vehicles(vehicles, sessions)


def public_baselines(bands: DataFrame, sessions: DataFrame) -> DataFrame:
    return _of_public_vehicles(bands, sessions)


def public_telemetry(samples: DataFrame, sessions: DataFrame) -> DataFrame:
    return _of_public_sessions(samples, sessions)


def public_dtc_events(faults: DataFrame, sessions: DataFrame) -> DataFrame:
    return _of_public_sessions(faults, sessions)


def public_findings(findings: DataFrame, sessions: DataFrame) -> DataFrame:
    return _of_public_sessions(findings, sessions)


def public_drive_sessions(sessions: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Public sessions with the main vehicle columns."""
    described = vehicles.select("vehicle_id", "make", "model", "year", "engine")
    return (
        _public(sessions)
        .join(described, "vehicle_id")
        .select(
            "session_id",
            "vehicle_id",
            "make",
            "model",
            "year",
            "engine",
            "started_at",
            "ended_at",
            "source",
            "ambient_c",
            "notes",
        )
    )


def session_exists(requested: DataFrame, sessions: DataFrame) -> DataFrame:
    """Status per requested id: ``ok``, or ``error`` with a message for unknown ids."""
    known = sessions.select("session_id", F.lit(True).alias("_known"))
    missing = F.col("_known").isNull()
    return requested.join(known, "session_id", "left").select(
        "session_id",
        F.when(missing, "error").otherwise("ok").alias("status"),
        F.when(
            missing, F.concat(F.lit("Session not found: "), F.col("session_id").cast("string"))
        ).alias("error"),
    )
