"""Live readings, one (session, ts, command, value) row each, to samples and faults.

Every function takes a batch or a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.moments import epoch_millis
from gaugeflow.functions.text import text_or_null
from gaugeflow.operators.ordered import has_few_rows
from gaugeflow.streaming import tables

# Read-only command names and what they feed.
COMMAND_GAUGES = {
    "RPM": "rpm",
    "SPEED": "speed_kph",
    "ENGINE_LOAD": "engine_load_pct",
    "COOLANT_TEMP": "coolant_temp_c",
    "INTAKE_TEMP": "intake_temp_c",
    "MAF": "maf_gps",
    "THROTTLE_POS": "throttle_pct",
    "SHORT_FUEL_TRIM_1": "stft_b1_pct",
    "LONG_FUEL_TRIM_1": "ltft_b1_pct",
    "TIMING_ADVANCE": "timing_adv_deg",
    "FUEL_PRESSURE": "fuel_press_kpa",
    "O2_B1S1": "o2_b1s1_v",
}
FAULT_COMMANDS = {"GET_DTC": "stored", "GET_CURRENT_DTC": "pending"}
IDENTITY_COMMANDS = ("VIN",)
FORBIDDEN_COMMANDS = ("CLEAR_DTC",)
LIVE_SOURCE = "live"

_SAMPLE = (
    "session_id BIGINT, ts TIMESTAMP_NTZ, "
    + ", ".join(f"{g} DOUBLE" for g in COMMAND_GAUGES.values())
    + ", kind STRING"
)
_CLOCK = "newest TIMESTAMP"


def read_only_guard(readings: DataFrame) -> DataFrame:
    """Mark rows whose command is forbidden or unknown; those go to quarantine."""
    known = [*COMMAND_GAUGES, *FAULT_COMMANDS, *IDENTITY_COMMANDS]
    command = F.col("command")
    reason = (
        F.when(command.isin(*FORBIDDEN_COMMANDS), "forbidden command")
        .when(~F.coalesce(command.isin(*known), F.lit(False)), "unknown command")
        .otherwise(F.lit(None))
    )
    return readings.withColumn("quarantine", reason)


def missing_commands(readings: DataFrame) -> DataFrame:
    """Sessions and the required commands they never sent."""
    required = [*COMMAND_GAUGES, *FAULT_COMMANDS, *IDENTITY_COMMANDS]
    seen = readings.groupBy("session_id").agg(
        *[F.max((F.col("command") == c).cast("int")).alias(c) for c in required]
    )
    absent = [F.when(F.coalesce(c, F.lit(0)) == 0, F.lit(c)) for c in required]
    return seen.select("session_id", F.explode(F.array_compact(F.array(*absent))).alias("command"))


def _gauge_rows(readings: DataFrame) -> DataFrame:
    """Gauge readings with ``_at``: watermarks have millisecond precision, so the event time is
    cut to that; the exact poll time stays in ``ts``."""
    return readings.filter(F.col("command").isin(*COMMAND_GAUGES)).withColumn(
        "_at", F.timestamp_millis(epoch_millis(F.col("ts")))
    )


def _gauge_columns() -> list[Column]:
    return [
        F.when(F.col("command") == command, F.col("value")).alias(gauge)
        for command, gauge in COMMAND_GAUGES.items()
    ]


def live_readings_to_samples(readings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One sample per (session, poll time).  A gauge without an answer stays NULL.

    On a stream a poll is released once, when the watermark (``delay`` behind the newest
    reading) passes it, and later readings of it are left out; ``stream_samples`` keeps those.
    The key is (session, ts), so one long session spreads over all tasks.
    """
    rows = _gauge_rows(readings)
    if rows.isStreaming:
        rows = rows.withWatermark("_at", delay)
    return (
        rows.select("session_id", "ts", "_at", *_gauge_columns())
        .groupBy("session_id", "ts", "_at")
        .agg(*[F.max(gauge).alias(gauge) for gauge in COMMAND_GAUGES.values()])
        .drop("_at")
    )


def stream_samples(readings: DataFrame, root: str, delay: str = "10 minutes") -> None:
    """Drain a stream of readings into samples that are written once, and late readings.

    ``{root}/samples/batch=k/kind=closed`` has the polls that the watermark passed, each
    complete; ``kind=late`` has the readings that came when it had passed them, which the
    engine's aggregation leaves out (all but those of the very batch that closes their poll;
    being there twice does not matter to the largest value).  ``read_samples`` puts them
    together, so no reading is too late.
    Polls of the last ``delay`` are state until newer readings come.  A batch reads its own
    rows and one row of the batch before (``clock``: the newest event time so far, from which
    the engine's watermark of this batch follows).
    """
    spark = readings.sparkSession
    closed = live_readings_to_samples(readings, delay).select(
        "session_id", "ts", *COMMAND_GAUGES.values(),
        F.lit(None).cast("timestamp").alias("_at"), F.lit("closed").alias("kind"),
    )
    raw = _gauge_rows(readings).select(
        "session_id", "ts", *_gauge_columns(), "_at", F.lit("late").alias("kind")
    )
    tables.create(spark, root, "samples", _SAMPLE, ("kind",))
    tables.create(spark, root, "clock", _CLOCK)

    def store(batch: DataFrame, batch_id: int) -> None:
        clock = batch.sparkSession.read.schema(_CLOCK).parquet(f"{root}/clock/batch={batch_id - 1}")
        before = clock.agg(F.max("newest")).first()[0]
        watermark = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        seen = Observation(f"clock-{batch_id}")
        kept = batch.observe(seen, F.max("_at").alias("newest")).filter(
            (F.col("kind") == "closed") | (F.col("_at") <= watermark)
        )
        # One action: the rows of a batch are computed (and its state moved on) once.
        tables.put(kept.drop("_at"), root, "samples", batch_id, ("kind",))
        newest = max((t for t in (before, seen.get["newest"]) if t is not None), default=None)
        tables.put(batch.sparkSession.createDataFrame([(newest,)], _CLOCK), root, "clock", batch_id)

    tables.drain(closed.unionByName(raw), store, f"{root}/progress/samples")


def read_samples(spark: SparkSession, root: str) -> DataFrame:
    """One sample per (session, poll time); ``parts`` above 1 tells that readings came late.

    Closed polls are read as they are; only those that late readings belong to are put
    together with them.
    """
    gauges, keys = list(COMMAND_GAUGES.values()), ["session_id", "ts"]
    written = tables.read(spark, root, "samples", _SAMPLE)
    closed = written.filter("kind = 'closed'").select(*keys, *gauges, F.lit(1).alias("parts"))
    late = (
        written.filter("kind = 'late'")
        .groupBy(*keys)
        .agg(*[F.max(g).alias(g) for g in gauges], F.countDistinct("batch").alias("parts"))
    )
    polls = late.select(*keys)
    if has_few_rows(polls):
        polls = F.broadcast(polls)
    merged = (
        closed.join(polls, keys, "left_semi")
        .unionByName(late)
        .groupBy(*keys)
        .agg(*[F.max(g).alias(g) for g in gauges], F.sum("parts").alias("parts"))
    )
    return closed.join(polls, keys, "left_anti").unionByName(merged)


def live_readings_to_faults(readings: DataFrame) -> DataFrame:
    """Fault rows: stored codes and current (pending) codes."""
    status = F.when(F.col("command") == "GET_DTC", "stored").otherwise("pending")
    return readings.filter(F.col("command").isin(*FAULT_COMMANDS)).select(
        "session_id", "ts", "code", status.alias("status"), "description"
    )


def live_sessions(readings: DataFrame, vehicles: DataFrame | None = None) -> DataFrame:
    """Start and end of each live session (end = last poll) and the VIN it reported."""
    vin = text_or_null(F.col("text_value"))
    result = readings.groupBy("session_id").agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.min_by(vin, F.when((F.col("command") == "VIN") & vin.isNotNull(), F.col("ts"))).alias(
            "vin"
        ),
        F.lit(LIVE_SOURCE).alias("source"),
    )
    if vehicles is None:
        return result
    declared = vehicles.select("session_id", F.col("vin").alias("_declared"))
    return (
        result.join(declared, "session_id", "left")
        .withColumn("vin", F.coalesce("vin", "_declared"))
        .drop("_declared")
    )


def run_to_parquet(
    stream: DataFrame, out: str, checkpoint: str, columns: Sequence[str] | None = None
) -> None:
    """Process everything available now and append it to ``out``."""
    chosen = stream.select(*columns) if columns else stream
    writer = (
        chosen.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    with tables.state_on_disk(chosen.sparkSession):
        query = writer.start()
    query.awaitTermination()
