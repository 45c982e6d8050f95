"""The six tables derived from general test tables (customers and an event stream).

One session per customer, two sessions per vehicle; samples are the customer's
events.  Customers without events give sessions without samples.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.moments import epoch_second
from gaugeflow.operators.bands import reference_baselines
from gaugeflow.operators.ordered import shared_folder
from gaugeflow.schema import GAUGES, SCHEMAS, conform
from gaugeflow.sources.drive_logs import STAGGERED_COLUMNS
from gaugeflow.streaming.live import COMMAND_GAUGES

# Published class profiles (P5 / P50 / P95).
PROFILE_ROWS = [
    ("heavy", "engine_load_pct", 240, 11.4, 38.8, 18.8),
    ("heavy", "maf_gps", 240, 5.9, 38.4, 9.1),
    ("light", "engine_load_pct", 240, 14.5, 81.2, 24.3),
    ("light", "maf_gps", 240, 2.9, 24.3, 5.8),
]

def profiles(spark: SparkSession) -> DataFrame:
    rows = ", ".join(str(row) for row in PROFILE_ROWS)
    names = "engine_class, metric, n, healthy_min, healthy_max, p50"
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})").select(
        "engine_class",
        "metric",
        F.col("n").cast("bigint").alias("n"),
        *[F.col(c).cast("double").alias(c) for c in ("healthy_min", "healthy_max", "p50")],
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder."""
    return f"{shared_folder(spark)}/gaugeflow-{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number inside ``props``."""
    return with_k(spark.read.parquet(f"{sf_dir}/events.parquet"))


def with_k(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "event_id", "ts", "user_id", "event_type", "value",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
    )


FAULT_STATUS = (
    "CASE (k div 10) % 5 WHEN 0 THEN 'stored' WHEN 1 THEN 'pending' WHEN 2 THEN 'permanent' "
    "WHEN 3 THEN 'unknown' END"
)
CODE = "concat('P0', lpad(CAST(k AS STRING), 3, '0'))"
_GAUGE = {
    "rpm": "value * 10 + 600",
    "speed_kph": "CASE WHEN k < 10 THEN NULL WHEN k < 20 THEN 0D ELSE value END",
    "engine_load_pct": "CASE WHEN value <= 300 THEN value / 2 END",
    "coolant_temp_c": "CASE WHEN k % 25 != 0 THEN k / 2 + 60 END",
    "intake_temp_c": "k % 30 + 10",
    "maf_gps": "CASE WHEN value <= 300 AND user_id % 7 != 3 THEN value / 4 END",
    "throttle_pct": "k",
    "stft_b1_pct": "CASE WHEN k % 10 != 0 THEN value / 10 - 6 END",
    "ltft_b1_pct": "CASE WHEN value <= 300 THEN value / 8 - 5 END",
    "timing_adv_deg": "CASE WHEN user_id % 5 != 4 THEN k * 0.5D END",
    "fuel_press_kpa": "k + 300",
    "o2_b1s1_v": "k / 100",
}


def samples_of(ev: DataFrame) -> DataFrame:
    """Telemetry samples from events (batch or stream)."""
    return ev.selectExpr(
        "event_id AS sample_id",
        "user_id AS session_id",
        "ts",
        *[f"CAST({_GAUGE[g]} AS DOUBLE) AS {g}" for g in GAUGES],
    )


def faults_of(ev: DataFrame) -> DataFrame:
    return ev.filter("event_type = 'error'").selectExpr(
        "event_id AS dtc_id",
        "user_id AS session_id",
        "ts",
        f"{CODE} AS code",
        f"{FAULT_STATUS} AS status",
        "CASE WHEN k % 20 != 0 THEN concat('Fault ', k) END AS description",
    )


def vehicles_of(customers: DataFrame) -> DataFrame:
    return customers.selectExpr(
        "c_custkey AS vehicle_id",
        "concat('VIN', lpad(CAST(c_custkey AS STRING), 9, '0')) AS vin",
        "c_mktsegment AS make",
        "c_name AS model",
        "CAST(c_nationkey + 2000 AS INT) AS year",
        "CASE c_custkey % 3 WHEN 0 THEN '6.0L V8' WHEN 1 THEN '4-FI 1.5L' END AS engine",
        "concat('Vehicle of nation ', c_nationkey) AS notes",
    )


def _entry(name: str, before: str, after: str) -> str:
    return f"concat('{name} real OBD-II entry; source_file={before}', session_id, '{after}')"


_NOTES = f"""
CASE WHEN session_id % 3 != 0 THEN concat('Synthetic control drive ', session_id)
  WHEN session_id % 4 = 0 THEN {_entry("KIT/RADAR Automotive OBD-II Dataset", "drive_",
    ".csv; drive_label=Traffic Jam Log; license=CC BY 4.0.")}
  WHEN session_id % 4 = 1 THEN {_entry("carOBD (Toyota Etios)", "carOBD live",
    ".csv (Toyota Etios 2014); drive_label=City Commute Log; license=Open / cite author.")}
  WHEN session_id % 4 = 2 THEN {_entry("OBD2 panel Opel 2012", "dataset.CSV (Opel); trip_ref=",
    "; drive_label=Mixed Roads Log; license=see Kaggle data card.")}
  ELSE {_entry("Open archive", "log ", ".txt; trip_ref=9; drive_label=Night Log; license=CC0.")}
END AS notes"""


def sessions_of(customers: DataFrame, ev: DataFrame) -> DataFrame:
    extent = ev.groupBy("user_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")
    )
    return (
        customers.selectExpr("c_custkey AS session_id")
        .join(extent.withColumnRenamed("user_id", "session_id"), "session_id", "left")
        .selectExpr(
            "session_id",
            "session_id - session_id % 2 AS vehicle_id",
            "started_at",
            "ended_at",
            "CASE session_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'csv' ELSE 'emulator' END"
            " AS source",
            "CAST(session_id % 40 AS DOUBLE) AS ambient_c",
            _NOTES,
        )
    )


def bands_of(vehicles: DataFrame) -> DataFrame:
    """Reference bands, an idle coolant band for some vehicles, an open-ended timing band."""
    extra = vehicles.filter("vehicle_id % 4 = 0").selectExpr(
        "vehicle_id",
        """inline(filter(array(
          struct(vehicle_id * 2 + 1000000000 AS baseline_id, 'coolant_temp_c' AS metric,
            'idle' AS context, 60D AS healthy_min, 100D AS healthy_max, 'C' AS unit,
            'manual' AS source),
          struct(vehicle_id * 2 + 1000000001 AS baseline_id, 'timing_adv_deg' AS metric,
            'idle' AS context, 10D AS healthy_min, CAST(NULL AS DOUBLE) AS healthy_max,
            'deg' AS unit, 'manual' AS source)
        ), b -> b.metric = 'coolant_temp_c' OR vehicle_id % 8 = 0))""",
    )
    return reference_baselines(vehicles, profiles(vehicles.sparkSession)).unionByName(extra)


def findings_of(ev: DataFrame) -> DataFrame:
    return ev.filter("event_type = 'purchase'").selectExpr(
        "event_id AS finding_id",
        "user_id AS session_id",
        "'info' AS severity",
        "'session' AS category",
        f"CASE WHEN k % 2 = 0 THEN 'sql_analysis' ELSE {CODE} END AS metric_or_code",
        "concat('k=', k) AS observed",
        "'band' AS expected_range",
        "concat('cause ', k) AS likely_cause",
        "'fix' AS recommended_fix",
        "k / 100 AS confidence",
        "'{}' AS evidence_json",
        "concat('agent-', event_id) AS agent_trace_id",
        "ts AS created_at",
    )


class DerivedFleet:
    """The six tables, each built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._events = events(spark, sf_dir)
        self._customers = spark.read.parquet(f"{sf_dir}/customer.parquet")

    @cached_property
    def vehicles(self) -> DataFrame:
        return conform(vehicles_of(self._customers), "vehicles")

    @cached_property
    def drive_sessions(self) -> DataFrame:
        return conform(sessions_of(self._customers, self._events), "drive_sessions")

    @cached_property
    def telemetry_samples(self) -> DataFrame:
        return conform(samples_of(self._events), "telemetry_samples")

    @cached_property
    def dtc_events(self) -> DataFrame:
        return conform(faults_of(self._events), "dtc_events")

    @cached_property
    def baselines(self) -> DataFrame:
        return conform(bands_of(self.vehicles), "baselines")

    @cached_property
    def findings(self) -> DataFrame:
        return conform(findings_of(self._events), "findings")

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}


_PLANS: dict[tuple[str, str], DerivedFleet] = {}


def fleet(spark: SparkSession, sf_dir: str) -> DerivedFleet:
    """The tables of one folder; their logical plans are kept per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANS:
        _PLANS[key] = DerivedFleet(spark, sf_dir)
    return _PLANS[key]


# -- raw logs derived from the events ----------------------------------------------------


def day_of(ts: Column) -> Column:
    """Day number since 2024-01-01, used as the file split of a derived log."""
    return F.floor((epoch_second(ts) - F.lit(1_704_067_200)) / 86400).cast("bigint")


_FILE = "concat('drive_', user_id, '.csv') AS source_file"


def raw_rows(ev: DataFrame) -> DataFrame:
    """Events as rows of one drive file per user: split = day, line = event id."""
    return ev.select(
        F.expr(_FILE),
        day_of(F.col("ts")).alias("block_start"),
        F.col("event_id").alias("line_no"),
        "ts",
        "user_id",
        "event_type",
        "value",
        "k",
    )


def drive_rows(ev: DataFrame) -> DataFrame:
    """Typed drive rows with fault fields, as ``scan_drive_csv`` gives them."""
    faulty = "event_type = 'error'"
    return raw_rows(ev).selectExpr(
        "source_file",
        "block_start",
        "line_no",
        "ts",
        *[f"CAST({_GAUGE[g]} AS DOUBLE) AS {g}" for g in GAUGES],
        f"CASE WHEN {faulty} THEN concat(' p0', k, '; P0171|p0', k) END AS dtc_code",
        f"CASE WHEN {faulty} THEN {FAULT_STATUS} END AS dtc_status",
        f"CASE WHEN {faulty} THEN concat('Fault ', k) END AS dtc_description",
    )


def drive_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source entry per user with events, ordered by user."""
    fl = fleet(spark, sf_dir)
    users = events(spark, sf_dir).select("user_id").distinct()
    described = fl.vehicles.withColumnRenamed("notes", "vehicle_notes")
    return (
        users.join(fl.drive_sessions, users.user_id == fl.drive_sessions.session_id)
        .selectExpr(
            _FILE,
            "user_id AS source_order",
            "user_id AS vehicle_id",
            "source",
            "ambient_c",
            "notes AS session_notes",
        )
        .join(described, "vehicle_id")
        .drop("vehicle_id")
    )


def staggered_rows(ev: DataFrame) -> DataFrame:
    """Sparse log: each row has one of the six readings; hour-coarse times."""
    cells = [
        f"CASE WHEN k % 6 = {at} THEN CAST(k + block_start"
        f"{' + 55' if name == 'coolant_temp_c' else ''} AS STRING) "
        f"WHEN k % 6 = {(at + 1) % 6} THEN '  ' END AS {name}"
        for at, name in enumerate(STAGGERED_COLUMNS)
    ]
    return raw_rows(ev).selectExpr(
        "source_file",
        "block_start",
        "line_no",
        "CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS ts",
        *cells,
    )


def warm_rows(ev: DataFrame) -> DataFrame:
    """Rows whose coolant rises over the days, for the warm-window search."""
    return raw_rows(ev).selectExpr(
        "source_file",
        "block_start",
        "line_no",
        "CAST(k AS STRING) AS rpm",
        "CASE WHEN k % 50 != 0 THEN CAST(block_start + k % 10 + 60 AS STRING) END"
        " AS coolant_temp_c",
    )


def readings_of(ev: DataFrame) -> DataFrame:
    """Narrow live readings: twelve gauge commands per event."""
    entries = ", ".join(
        f"struct('{command}' AS command, {gauge} AS value)"
        for command, gauge in COMMAND_GAUGES.items()
    )
    return samples_of(ev).selectExpr("session_id", "ts", f"inline(array({entries}))")


def fault_readings_of(ev: DataFrame) -> DataFrame:
    """Fault, identity and stray commands, from the error events."""
    command = (
        "CASE k % 4 WHEN 0 THEN 'GET_DTC' WHEN 1 THEN 'GET_CURRENT_DTC' WHEN 2 THEN 'VIN' "
        "ELSE CASE WHEN k % 8 = 3 THEN 'CLEAR_DTC' ELSE 'RPM' END END"
    )
    return ev.filter("event_type = 'error'").selectExpr(
        "user_id AS session_id",
        "ts",
        f"{command} AS command",
        "value",
        "CASE WHEN k % 4 = 2 THEN concat(' VIN', user_id) END AS text_value",
        f"CASE WHEN k % 4 < 2 THEN {CODE} END AS code",
        "CASE WHEN k % 4 < 2 THEN concat('Fault ', k) END AS description",
    )
