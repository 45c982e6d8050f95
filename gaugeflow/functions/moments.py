"""UTC moments as TIMESTAMP_NTZ, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def utc_moment(text: Column) -> Column:
    """ISO text to a UTC moment; text without an offset is taken as UTC, junk gives NULL."""
    has_offset = text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")
    instant = F.try_to_timestamp(F.when(has_offset, text).otherwise(F.concat(text, F.lit("Z"))))
    return moment_from_micros(F.unix_micros(instant))


def moment_from_micros(micros: Column) -> Column:
    seconds = (micros.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast(
        "decimal(18,6)"
    )
    zero = F.lit(0)
    return F.expr(_EPOCH) + F.make_dt_interval(zero, zero, zero, seconds)


def epoch_exact(ts: Column) -> Column:
    """Seconds since the epoch with microseconds, as an 18-digit (long-backed) decimal."""
    return (ts - F.expr(_EPOCH)).cast("interval second").cast("decimal(18,6)")


def epoch_second(ts: Column) -> Column:
    """Whole second of a moment: fractions are dropped, as the fault window needs."""
    return F.floor(epoch_exact(ts)).cast("bigint")


def epoch_millis(ts: Column) -> Column:
    return F.floor(epoch_exact(ts) * F.lit(1000)).cast("bigint")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def as_instant(ts: Column) -> Column:
    """The moment as TIMESTAMP, which event-time watermarks require."""
    return F.timestamp_micros((epoch_exact(ts) * F.lit(1_000_000)).cast("bigint"))


def from_instant(instant: Column) -> Column:
    return moment_from_micros(F.unix_micros(instant))
