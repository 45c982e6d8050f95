"""Drive rows plus a table of sources to the six tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.text import text_or_null
from gaugeflow.operators.bands import reference_baselines
from gaugeflow.operators.ordered import cut_lineage, number_in_splits, number_rows, running_offsets
from gaugeflow.schema import SCHEMAS, Fleet, conform
from gaugeflow.sources.csv_files import PLACE, SOURCE

# Labels of sessions recorded with the emulator.
EMULATOR_SOURCE = "emulator"
EMULATOR_AMBIENT_C = 22.0
EMULATOR_NOTES = "Synthetic no-hardware ELM327-emulator scenario CSV."

_BLOCK, _LINE = PLACE


def explode_dtc_codes(rows: DataFrame, by: str = SOURCE) -> DataFrame:
    """One row per fault code in a cell such as ``p0171; P0301|p0171``.

    Codes are split on ``;``, ``|`` and ``,``, stripped of white space and upper-cased.  Of equal
    (source, ts, code, status) the first in file order stays; the choice is made by
    a combinable aggregate, not by sorting a group.
    """
    codes = F.filter(
        F.transform(F.split("dtc_code", r"[;|,]"), lambda c: F.upper(text_or_null(c))), lambda c: c.isNotNull()
    )
    singles = rows.filter(F.col("dtc_code").isNotNull()).select(
        by,
        *PLACE,
        "ts",
        F.coalesce("dtc_status", F.lit("stored")).alias("status"),
        F.col("dtc_description").alias("description"),
        F.posexplode(codes).alias("_at", "code"),
    )
    return (
        singles.groupBy(by, "ts", "code", "status")
        .agg(F.min(F.struct(*PLACE, "_at", "description")).alias("_first"))
        .select(by, "ts", "code", "status", "_first.description", f"_first.{_BLOCK}",
                f"_first.{_LINE}", "_first._at")
    )


def by_file_name(rows: DataFrame) -> DataFrame:
    """Name sources by file name instead of full path."""
    return rows.withColumn(SOURCE, F.substring_index(F.col(SOURCE), "/", -1))


def tag_source(
    sources: DataFrame,
    source: str = EMULATOR_SOURCE,
    ambient_c: float | None = EMULATOR_AMBIENT_C,
    notes: str = EMULATOR_NOTES,
) -> DataFrame:
    """Source table for emulator recordings: fixed label and ambient, default note."""
    given = F.col("session_notes") if "session_notes" in sources.columns else F.lit(None)
    return (
        sources.withColumn("source", F.lit(source))
        .withColumn("ambient_c", F.lit(ambient_c).cast("double"))
        .withColumn("session_notes", F.coalesce(F.nullif(given.cast("string"), F.lit("")), F.lit(notes)))
    )


def ingest_drives(
    rows: DataFrame,
    sources: DataFrame,
    profiles: DataFrame,
    first_vehicle_id: int = 1,
    first_session_id: int = 1,
    first_sample_id: int = 1,
    first_dtc_id: int = 1,
) -> Fleet:
    """Number sources, samples and faults and fill the six tables.

    ``sources`` has one row per file: ``source_file`` (as in ``rows``), vehicle
    columns ``vin make model year engine vehicle_notes`` and session columns
    ``source ambient_c session_notes``; an optional ``source_order`` sets the order
    of ids, else the file name does.  Each source gets its own vehicle and session.
    Session start and end are those of the first and last file row.  A source
    without rows stops the job.

    Ids are dense.  Only per-source and per-split tables are sorted as a whole; rows as a
    scan gives them are numbered without being moved (``number_in_splits``).
    """
    rank = "source_order" if "source_order" in sources.columns else SOURCE
    numbered = number_rows(sources, (), (rank,), "_n").withColumn("_n", F.col("_n") - 1)
    keyed = numbered.withColumn("session_id", F.col("_n") + F.lit(first_session_id)).withColumn(
        "vehicle_id", F.col("_n") + F.lit(first_vehicle_id)
    )
    ids = keyed.select(SOURCE, "session_id")

    splits = rows.groupBy(SOURCE, _BLOCK).agg(
        F.count(F.lit(1)).alias("_lines"),
        F.min(_LINE).alias("_low"),
        F.max(_LINE).alias("_high"),
        F.min_by("ts", _LINE).alias("_first_ts"),
        F.max_by("ts", _LINE).alias("_last_ts"),
    )
    unlisted = F.concat(F.lit("no source entry for "), F.col(SOURCE))
    listed = F.when(F.col("session_id").isNull(), F.raise_error(unlisted).cast("bigint"))
    splits = splits.join(ids, SOURCE, "left").withColumn("session_id", listed.otherwise(F.col("session_id")))
    splits = cut_lineage(running_offsets(splits, ("session_id", _BLOCK), "_lines", "_before"))
    extent = splits.groupBy("session_id").agg(
        F.min_by("_first_ts", _BLOCK).alias("started_at"),
        F.max_by("_last_ts", _BLOCK).alias("ended_at"),
    )
    no_rows = F.concat(F.lit("no telemetry rows in "), F.col(SOURCE))
    sessions = (
        keyed.join(extent, "session_id", "left")
        .withColumn(
            "started_at",
            F.when(
                F.col("started_at").isNull(), F.raise_error(no_rows).cast("timestamp_ntz")
            ).otherwise(F.col("started_at")),
        )
        .withColumn("notes", F.col("session_notes"))
    )
    vehicles = keyed.withColumn("notes", F.col("vehicle_notes"))

    offsets = splits.select(SOURCE, "session_id", _BLOCK, "_before", "_lines", "_low", "_high")
    samples = number_in_splits(rows, offsets, (SOURCE, _BLOCK), _LINE, "_in").withColumn(
        "sample_id", F.col("_before") + F.col("_in") + F.lit(first_sample_id)
    )
    faults = number_rows(
        explode_dtc_codes(rows).join(ids, SOURCE),
        (),
        ("session_id", *PLACE, "_at"),
        "dtc_id",
    ).withColumn("dtc_id", F.col("dtc_id") + F.lit(first_dtc_id - 1))

    vehicles = conform(vehicles, "vehicles")
    none = rows.sparkSession.createDataFrame([], SCHEMAS["findings"])
    return Fleet(
        vehicles=vehicles,
        drive_sessions=conform(sessions, "drive_sessions"),
        telemetry_samples=conform(samples, "telemetry_samples"),
        dtc_events=conform(faults, "dtc_events"),
        baselines=conform(reference_baselines(vehicles, profiles), "baselines"),
        findings=none,
    )


def ingest_tagged_source(rows: DataFrame, sources: DataFrame, profiles: DataFrame, **first_ids) -> Fleet:
    """``ingest_drives`` for emulator recordings."""
    return ingest_drives(rows, tag_source(sources), profiles, **first_ids)


def ingest_counts(fleet: Fleet) -> DataFrame:
    """Sample and fault rows loaded per session."""
    samples = fleet.telemetry_samples.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("telemetry_rows")
    )
    faults = fleet.dtc_events.groupBy("session_id").agg(F.count(F.lit(1)).alias("dtc_rows"))
    return (
        fleet.drive_sessions.select("vehicle_id", "session_id")
        .join(samples, "session_id", "left")
        .join(faults, "session_id", "left")
        .select(
            "vehicle_id",
            "session_id",
            F.coalesce("telemetry_rows", F.lit(0)).alias("telemetry_rows"),
            F.coalesce("dtc_rows", F.lit(0)).alias("dtc_rows"),
        )
    )
