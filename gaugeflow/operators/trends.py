"""Rolling means over the readings of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.rounding import with_rounded
from gaugeflow.functions.text import decimal_text, percent_text
from gaugeflow.operators.ordered import BUSY_ROWS, rolling

# The frame is 30 preceding rows and the current one, whatever time they span.
ROWS_BEFORE = 30
_ORDER = ("ts", "sample_id")


def _mean(value: str, scale: int):
    return lambda df, **options: with_rounded(
        rolling(df, ("session_id",), _ORDER, ROWS_BEFORE, {"_mean": F.avg(value)}, **options),
        {"_mean": "_mean"},
        scale,
    )


def fuel_trim_drift(samples: DataFrame, scale: int = 2, limit: int = BUSY_ROWS) -> DataFrame:
    """Long-term trim and its mean over 31 rows, per session in time order."""
    slim = samples.select("session_id", "sample_id", "ts", "ltft_b1_pct")
    return _mean("ltft_b1_pct", scale)(slim, limit=limit).select(
        "session_id", "sample_id", "ts", "ltft_b1_pct", F.col("_mean").alias("ltft_30s")
    )


def airflow_trend(samples: DataFrame, scale: int = 2, limit: int = BUSY_ROWS) -> DataFrame:
    """Air flow and its mean over 31 rows that have a reading."""
    slim = samples.select("session_id", "sample_id", "ts", "maf_gps").filter(
        F.col("maf_gps").isNotNull()
    )
    return _mean("maf_gps", scale)(slim, limit=limit).select(
        "session_id", "sample_id", "ts", "maf_gps", F.col("_mean").alias("maf_30s")
    )


def airflow_points(samples: DataFrame, scale: int = 2, limit: int = BUSY_ROWS) -> DataFrame:
    """About 24 evenly spaced trend points per session (at most 26), as numbers.

    First row, last row and every step-th row are kept, step = rows div 24.  The
    bar height relates to the highest mean among the kept rows, taken before the
    cut to 26.  After the spacing filter a session has fewer than 50 rows, so the
    last windows are small for any session.
    """
    slim = samples.select("session_id", "sample_id", "ts", "speed_kph", "maf_gps").filter(
        F.col("maf_gps").isNotNull()
    )
    marked = _mean("maf_gps", scale)(slim, limit=limit, with_position=True)
    step = F.greatest(F.lit(1), F.expr("total_rows div 24"))
    spaced = marked.filter(
        (F.col("position") == 1)
        | (F.col("position") == F.col("total_rows"))
        | ((F.col("position") - 1) % step == 0)
    )
    session = Window.partitionBy("session_id")
    top = F.max("_mean").over(session)
    height = F.when(top.isNull() | (top == 0), F.lit(8.0)).otherwise(
        F.lit(14.0) + F.lit(70.0) * F.col("_mean") / top
    )
    return (
        spaced.withColumn("height", height)
        .withColumn("point", F.row_number().over(session.orderBy("position")))
        .filter(F.col("point") <= 26)
        .select(
            "session_id",
            "point",
            "ts",
            "speed_kph",
            "maf_gps",
            F.col("_mean").alias("maf_30s"),
            "height",
        )
    )


def airflow_trend_sampled(
    samples: DataFrame, scale: int = 2, limit: int = BUSY_ROWS
) -> DataFrame:
    """The spaced trend points as display text; a missing speed prints as 0.00."""
    return airflow_points(samples, scale, limit).select(
        "session_id",
        "point",
        "ts",
        decimal_text("speed_kph", 2).alias("speed_kph"),
        decimal_text("maf_gps", 2).alias("maf_gps"),
        decimal_text("maf_30s", 2).alias("maf_30s"),
        percent_text("height").alias("height_pct"),
    )
