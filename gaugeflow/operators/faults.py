"""Fault codes and the sensor rows around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.moments import epoch_second
from gaugeflow.functions.text import decimal_text, iso_text

_SENSORS = ("rpm", "engine_load_pct", "coolant_temp_c")


def session_dtc_events(faults: DataFrame) -> DataFrame:
    """Faults of each session."""
    return faults.select("session_id", "code", "status", "description", "ts")


def dtc_telemetry_correlation(
    faults: DataFrame,
    samples: DataFrame,
    half_window: int = 5,
    whole_second: Callable[[Column], Column] = epoch_second,
) -> DataFrame:
    """Sensor rows within +-``half_window`` whole seconds of each fault, same session.

    Time is cut into slots one half-window long.  A fault is copied to its slot
    and both neighbours, a sample stays in its own, and the equi-join on (session,
    slot) splits a long session over many tasks.  Each sample has one slot, so no
    pair appears twice.  Spark broadcasts the faults when they are small.
    """
    width = max(1, int(half_window))
    slot = F.floor(F.col("_at") / F.lit(width))
    around = (
        faults.select(
            "session_id",
            "dtc_id",
            "code",
            "status",
            "description",
            F.col("ts").alias("fault_ts"),
            whole_second(F.col("ts")).alias("_at"),
        )
        .withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1)))
        .withColumnRenamed("_at", "_fault_at")
    )
    readings = samples.select(
        "session_id", "sample_id", "ts", *_SENSORS, whole_second(F.col("ts")).alias("_at")
    ).withColumn("_slot", slot)
    near = F.abs(F.col("_at") - F.col("_fault_at")) <= F.lit(int(half_window))
    return (
        readings.join(around, ["session_id", "_slot"])
        .filter(near)
        .select(
            "session_id",
            "dtc_id",
            "sample_id",
            "code",
            "status",
            "description",
            "fault_ts",
            "ts",
            *_SENSORS,
        )
    )


def dtc_evidence_panel(
    sessions: DataFrame, correlation: DataFrame, rows: int = 6
) -> DataFrame:
    """First rows by time for each session as text; one placeholder row if there are none.

    The rank filter is applied before the shuffle as well, so each task passes on
    at most ``rows`` rows per session.
    """
    order = Window.partitionBy("session_id").orderBy("ts", "code", "dtc_id", "sample_id")
    first = correlation.withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= rows
    )
    shown = first.select(
        "session_id",
        "place",
        "code",
        "status",
        "description",
        iso_text("fault_ts").alias("fault_ts"),
        iso_text("ts").alias("ts"),
        decimal_text("rpm", 0).alias("rpm"),
        decimal_text("engine_load_pct", 1).alias("engine_load_pct"),
        decimal_text("coolant_temp_c", 1).alias("coolant_temp_c"),
    )
    # The row shown when a drive has no fault.
    placeholder = {
        "code": "none logged",
        "status": "none",
        "description": "No diagnostic trouble code was logged in this real public entry.",
        "fault_ts": "",
        "ts": "",
        "rpm": "n/a",
        "engine_load_pct": "n/a",
        "coolant_temp_c": "n/a",
    }
    empty = F.col("place").isNull()
    return (
        sessions.select("session_id")
        .join(shown, "session_id", "left")
        .select(
            "session_id",
            F.coalesce("place", F.lit(1)).alias("place"),
            *[
                F.when(empty, F.lit(text)).otherwise(F.col(name)).alias(name)
                for name, text in placeholder.items()
            ],
        )
    )
