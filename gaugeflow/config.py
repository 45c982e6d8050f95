"""Scoring configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoreConfig:
    # Default score settings.
    score_basis: str = "directional editable scoring config"
    metric_penalty_points: float = 12.0
    pending_dtc_penalty: float = 10.0
    stored_dtc_penalty: float = 18.0
    permanent_dtc_penalty: float = 22.0
    score_floor: float = 0.0
    score_ceiling: float = 100.0


_NUMBERS = (
    "metric_penalty_points",
    "pending_dtc_penalty",
    "stored_dtc_penalty",
    "permanent_dtc_penalty",
    "score_floor",
    "score_ceiling",
)


def load_score_config(spark: SparkSession, path: str) -> ScoreConfig:
    """Read one JSON object; every key is required and numbers become doubles.

    The file holds seven settings, so one row on the driver is its whole content.
    """
    raw = spark.read.option("multiLine", True).json(path)
    missing = sorted({"label", *_NUMBERS} - set(raw.columns))
    if missing:
        raise ValueError(f"score config is missing: {missing}")
    row = raw.select(
        F.col("label").cast("string"), *[F.col(n).cast("double") for n in _NUMBERS]
    ).first()
    if row is None or any(row[n] is None for n in _NUMBERS):
        raise ValueError("score config has empty settings")
    return ScoreConfig(score_basis=row["label"], **{n: row[n] for n in _NUMBERS})
