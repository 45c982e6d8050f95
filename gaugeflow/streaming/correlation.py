"""Sensor rows around faults as a stream-stream join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.moments import as_instant, from_instant
from gaugeflow.operators.faults import dtc_telemetry_correlation


def stream_dtc_correlation(
    faults: DataFrame, samples: DataFrame, half_window: int = 5, delay: str = "10 minutes"
) -> DataFrame:
    """``dtc_telemetry_correlation`` on two streams.

    Both sides are watermarked and their times are tied to each other, so Spark
    drops join state once no partner can arrive any more.  The tie is one second
    wider than the window because the window compares whole seconds.
    """
    reach = F.expr(f"INTERVAL {int(half_window) + 1} SECONDS")
    sides = [
        df.withColumn("ts", as_instant(F.col("ts"))).withWatermark("ts", delay)
        for df in (faults, samples)
    ]
    pairs = dtc_telemetry_correlation(*sides, half_window, F.unix_seconds)
    tied = pairs.filter(
        (F.col("ts") >= F.col("fault_ts") - reach) & (F.col("ts") <= F.col("fault_ts") + reach)
    )
    return tied.withColumns({c: from_instant(F.col(c)) for c in ("ts", "fault_ts")})
