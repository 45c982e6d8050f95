"""The six tables, their schemas, and the loader / writer for a Parquet layout.

Timestamps are ``TIMESTAMP_NTZ`` holding UTC, so no result depends on the time
zone of the Spark session.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAUGES = (
    "rpm",
    "speed_kph",
    "engine_load_pct",
    "coolant_temp_c",
    "intake_temp_c",
    "maf_gps",
    "throttle_pct",
    "stft_b1_pct",
    "ltft_b1_pct",
    "timing_adv_deg",
    "fuel_press_kpa",
    "o2_b1s1_v",
)

# The gauges that healthy bands exist for.
SCORED_METRICS = (
    "coolant_temp_c",
    "engine_load_pct",
    "ltft_b1_pct",
    "stft_b1_pct",
    "timing_adv_deg",
)


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _struct(key: str, columns: str) -> T.StructType:
    """A schema from ``name TYPE`` pairs; ``key`` is the required first column."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType(
        [T.StructField(key, T.LongType(), nullable=False)]
        + [T.StructField(name, _TYPES[kind]) for name, kind in pairs]
    )


SCHEMAS: dict[str, T.StructType] = {
    "vehicles": _struct(
        "vehicle_id", "vin STRING, make STRING, model STRING, year INT, engine STRING, notes STRING"
    ),
    "drive_sessions": _struct(
        "session_id",
        "vehicle_id BIGINT, started_at TIMESTAMP_NTZ, ended_at TIMESTAMP_NTZ, source STRING, "
        "ambient_c DOUBLE, notes STRING",
    ),
    "telemetry_samples": _struct(
        "sample_id",
        "session_id BIGINT, ts TIMESTAMP_NTZ, " + ", ".join(f"{gauge} DOUBLE" for gauge in GAUGES),
    ),
    "dtc_events": _struct(
        "dtc_id",
        "session_id BIGINT, ts TIMESTAMP_NTZ, code STRING, status STRING, description STRING",
    ),
    "baselines": _struct(
        "baseline_id",
        "vehicle_id BIGINT, metric STRING, context STRING, healthy_min DOUBLE, "
        "healthy_max DOUBLE, unit STRING, source STRING",
    ),
    "findings": _struct(
        "finding_id",
        "session_id BIGINT, severity STRING, category STRING, metric_or_code STRING, "
        "observed STRING, expected_range STRING, likely_cause STRING, recommended_fix STRING, "
        "confidence DOUBLE, evidence_json STRING, agent_trace_id STRING, "
        "created_at TIMESTAMP_NTZ",
    ),
}


@dataclass(frozen=True)
class Fleet:
    """The six tables as DataFrames."""

    vehicles: DataFrame
    drive_sessions: DataFrame
    telemetry_samples: DataFrame
    dtc_events: DataFrame
    baselines: DataFrame
    findings: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {field.name: getattr(self, field.name) for field in fields(self)}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of ``table``, in schema order and type; absent ones become NULL."""
    have = {f.name: f.dataType for f in df.schema.fields}

    def column(f: T.StructField):
        if have.get(f.name) == f.dataType:
            return f.name
        value = F.col(f.name) if f.name in have else F.lit(None)
        return value.cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in SCHEMAS[table].fields])


def load_tables(spark: SparkSession, root: str, register: bool = False) -> Fleet:
    """Read the six Parquet tables under ``root`` with their fixed schemas."""
    frames = {
        name: spark.read.schema(schema).parquet(f"{root}/{name}")
        for name, schema in SCHEMAS.items()
    }
    if register:
        for name, frame in frames.items():
            frame.createOrReplaceTempView(name)
    return Fleet(**frames)


# Columns each table is range-clustered by on disk.  A long session spans many
# files, and min/max statistics let a filter on session_id or ts skip the rest.
CLUSTERING = {
    "vehicles": ("vehicle_id",),
    "drive_sessions": ("session_id",),
    "telemetry_samples": ("session_id", "ts", "sample_id"),
    "dtc_events": ("session_id", "ts", "dtc_id"),
    "baselines": ("vehicle_id", "baseline_id"),
    "findings": ("session_id", "finding_id"),
}


def write_tables(fleet: Fleet, root: str, mode: str = "errorifexists") -> None:
    """Write the six tables as Parquet, each clustered by its leading keys."""
    for name, frame in fleet.tables().items():
        keys = CLUSTERING[name]
        (
            conform(frame, name)
            .repartitionByRange(*keys)
            .sortWithinPartitions(*keys)
            .write.mode(mode)
            .parquet(f"{root}/{name}")
        )


def only_sessions(df: DataFrame, session_ids: Iterable[int]) -> DataFrame:
    """Rows of the given sessions; the filter reaches the Parquet scan."""
    return df.filter(F.col("session_id").isin([int(s) for s in session_ids]))
