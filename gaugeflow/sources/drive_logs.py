"""Readers for the four kinds of raw drive logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.functions.moments import plus_seconds, utc_moment
from gaugeflow.functions.text import first_number, text_or_null
from gaugeflow.operators.ordered import cut_lineage, number_in_splits
from gaugeflow.schema import GAUGES
from gaugeflow.sources.csv_files import PLACE, SOURCE, scan
from gaugeflow.sources.headers import (
    DRIVE_ALIASES,
    FUZZY_FRAGMENTS,
    match_aliases,
    match_exact,
    match_fragments,
)

BLOCK, LINE = PLACE
FAULT_FIELDS = ("dtc_code", "dtc_status", "dtc_description")

# Columns of the staggered log and of the week export.
STAGGERED_COLUMNS = {
    "rpm": "Engine RPM [RPM]",
    "speed_kph": "Vehicle Speed Sensor [km/h]",
    "coolant_temp_c": "Engine Coolant Temperature [°C]",
    "intake_temp_c": "Intake Air Temperature [°C]",
    "maf_gps": "Air Flow Rate from Mass Flow Sensor [g/s]",
    "throttle_pct": "Absolute Throttle Position [%]",
}
WEEK_KEYS = {"veh_id": "VehId", "trip": "Trip", "day_num": "DayNum", "ms": "Timestamp(ms)"}
WEEK_COLUMNS = {
    "rpm": "Engine RPM[RPM]",
    "speed_kph": "Vehicle Speed[km/h]",
    "engine_load_pct": "Absolute Load[%]",
    "maf_gps": "MAF[g/sec]",
    "intake_temp_c": "OAT[DegC]",
    "stft_b1_pct": "Short Term Fuel Trim Bank 1[%]",
    "ltft_b1_pct": "Long Term Fuel Trim Bank 1[%]",
}
WEEK_REQUIRED = ("rpm", "speed_kph", "engine_load_pct", "maf_gps")
WEEK_EPOCH = "2017-11-01"
# Defaults of the slicing steps.
ROWS_PER_DRIVE = 240
WARM_WINDOW_C = 80.0
WARM_START_C = 82.0
REGRID_START = "2018-06-01 10:00:00"
# Rows of a file that one task looks through for its warm window.
STRETCH_ROWS = 100_000


# -- canonical drive CSV -------------------------------------------------------------


def normalise_drive_rows(raw: DataFrame) -> DataFrame:
    """Text columns of a drive log to typed samples with fault fields.

    A blank or unreadable timestamp stops the job, since such a row has no place
    in its drive.
    """
    ts_text = text_or_null(F.col("ts"))
    moment = utc_moment(ts_text)
    problem = F.concat(
        F.lit("drive log row has no readable timestamp: "),
        F.col(SOURCE),
        F.lit(" "),
        F.coalesce(ts_text, F.lit("(blank)")),
    )
    return raw.select(
        SOURCE,
        *PLACE,
        F.when(moment.isNull(), F.raise_error(problem).cast("timestamp_ntz"))
        .otherwise(moment)
        .alias("ts"),
        *[first_number(F.col(g)).alias(g) for g in GAUGES],
        *[text_or_null(F.col(f)).alias(f) for f in FAULT_FIELDS],
    )


def scan_drive_csv(
    spark: SparkSession, paths: str | Sequence[str], multiline: bool = False
) -> DataFrame:
    """Drive CSVs with any accepted header names as typed rows; a timestamp column is required."""
    return normalise_drive_rows(
        scan(spark, paths, list(DRIVE_ALIASES), match_aliases, multiline, required=("ts",))
    )


# -- arbitrary OBD CSV -----------------------------------------------------------------


def scan_fuzzy_csv(
    spark: SparkSession, paths: str | Sequence[str], multiline: bool = False
) -> DataFrame:
    """OBD CSVs with unknown headers, matched by fragments; values stay text."""
    raw = scan(spark, paths, list(FUZZY_FRAGMENTS), match_fragments, multiline)
    return blank_missing(raw, FUZZY_FRAGMENTS)


def blank_missing(raw: DataFrame, columns) -> DataFrame:
    # Texts that mean "no reading".
    missing = ("", "nan", "NaN", "None")

    def cell(name: str) -> Column:
        text = F.btrim(F.col(name), F.lit(" \t\n\r\x0b\x0c"))
        return F.when(~text.isin(*missing), text).alias(name)

    kept = [c for c in raw.columns if c not in columns]
    return raw.select(*kept, *[cell(c) for c in columns])


def file_positions(rows: DataFrame, by: str = SOURCE) -> DataFrame:
    """Add the 0-based ``position`` in the file and the file's row count.

    One row per file split gives the rows before it; see ``number_in_splits`` for the
    numbers inside a split.  A huge file is numbered by many tasks.
    """
    splits = rows.groupBy(by, BLOCK).agg(
        F.count(F.lit(1)).alias("_lines"), F.min(LINE).alias("_low"), F.max(LINE).alias("_high")
    )
    earlier = Window.partitionBy(by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    splits = cut_lineage(
        splits.select(
            "*",
            F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_lines").over(Window.partitionBy(by)).alias("file_rows"),
        )
    )
    return (
        number_in_splits(rows, splits, (by, BLOCK), LINE, "_in")
        .withColumn("position", F.col("_before") + F.col("_in"))
        .drop("_in", "_before")
    )


def pick_warm_window(
    rows: DataFrame,
    rows_wanted: int = ROWS_PER_DRIVE,
    warm_c: float = WARM_WINDOW_C,
    by: str = SOURCE,
) -> DataFrame:
    """The first run of ``rows_wanted`` rows of each file that is mostly warm.

    A start qualifies when 90 % of its run has coolant at or above ``warm_c``;
    starts go up to, but not including, the last full run.  Without one the file's
    first rows are taken.  Files are cut into stretches, and the head of each is copied
    to the one before, whose last runs reach into it: one window per stretch counts the
    warm rows ahead, and no task sees a whole file.
    """
    placed = file_positions(rows, by)
    warm = F.coalesce(F.col("coolant_temp_c").try_cast("double"), F.lit(0.0)) >= F.lit(warm_c)
    size = max(STRETCH_ROWS, rows_wanted)
    own = F.expr(f"position div {size}")
    head = (F.col("position") % size < F.lit(rows_wanted - 1)) & (own > 0)
    ahead = (
        Window.partitionBy(by, "_stretch")
        .orderBy("position")
        .rowsBetween(0, rows_wanted - 1)
    )
    first = (
        placed.select(by, "position", "file_rows", warm.cast("int").alias("_warm"))
        .withColumn("_stretch", F.explode(F.when(head, F.array(own, own - 1)).otherwise(F.array(own))))
        .withColumn("_ahead", F.sum("_warm").over(ahead))
        .filter((F.col("_stretch") == own) & (F.col("_ahead") >= F.lit(int(0.9 * rows_wanted))))
        .filter(F.col("position") < F.col("file_rows") - F.lit(rows_wanted))
        .groupBy(by)
        .agg(F.min("position").alias("_start"))
    )
    begin = F.coalesce(F.col("_start"), F.lit(0))
    return (
        placed.join(first, by, "left")
        .filter(
            (F.col("position") >= begin) & (F.col("position") < begin + F.lit(rows_wanted))
        )
        .withColumn("window_row", F.col("position") - begin)
        .drop("_start", "file_rows")
    )


def regrid_1hz(window: DataFrame, start: str = REGRID_START) -> DataFrame:
    """Give the rows of a window one timestamp per second from ``start``."""
    begin = F.to_timestamp_ntz(F.lit(start))
    return window.withColumn("ts", plus_seconds(begin, F.col("window_row")))


# -- staggered log ---------------------------------------------------------------------


def scan_staggered_log(
    spark: SparkSession, paths: str | Sequence[str], multiline: bool = False
) -> DataFrame:
    """Sparse rows, one reading at a time; the date comes from the file name."""
    wanted = {"time": "Time", **STAGGERED_COLUMNS}
    raw = scan(spark, paths, list(wanted), lambda names: match_exact(names, wanted), multiline)
    return timestamp_from_filename(raw)


def timestamp_from_filename(raw: DataFrame, by: str = SOURCE) -> DataFrame:
    """ts = <date before the first underscore of the file name>T<Time>Z.

    A time that can't be read stops the job, since such a row has no second of its own.
    """
    day = F.substring_index(F.substring_index(F.col(by), "/", -1), "_", 1)
    time = F.coalesce(text_or_null(F.col("time")), F.lit("(blank)"))
    moment = utc_moment(F.concat(day, F.lit("T"), time, F.lit("Z")))
    problem = F.concat(F.lit("log row has no readable time: "), F.col(by), F.lit(" "), time)
    checked = F.when(moment.isNull(), F.raise_error(problem).cast("timestamp_ntz")).otherwise(moment)
    return raw.withColumn("ts", checked).drop("time")


def forward_fill_readings(
    rows: DataFrame, columns: Sequence[str] = tuple(STAGGERED_COLUMNS), by: str = SOURCE
) -> DataFrame:
    """Carry the last non-blank value of each column; keep rows where all are known.

    Values are carried inside a file split first; the last value of each split is
    handed to the splits after it through a small per-split table.
    """
    columns = list(columns)
    typed = rows.select(
        *[text_or_null(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns]
    )
    last_of_split = typed.groupBy(by, BLOCK).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(LINE))).alias(c) for c in columns]
    )
    earlier = Window.partitionBy(by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of_split.select(
        by, BLOCK, *[F.last(c, True).over(earlier).alias(f"_carried_{c}") for c in columns]
    )
    upto = Window.partitionBy(by, BLOCK).orderBy(LINE).rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        typed.select(
            *[c for c in typed.columns if c not in columns],
            *[F.last(c, True).over(upto).alias(c) for c in columns],
        )
        .join(carried, [by, BLOCK])
        .select(
            *[
                F.coalesce(c, f"_carried_{c}").alias(c) if c in columns else F.col(c)
                for c in typed.columns
            ]
        )
    )
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return filled.filter(complete)


def warm_start_gate(rows: DataFrame, min_c: float | None, by: str = SOURCE) -> DataFrame:
    """Drop the rows of each file before its first one with coolant >= ``min_c``."""
    if min_c is None:
        return rows
    warm = F.col("coolant_temp_c").try_cast("double") >= F.lit(min_c)
    splits = rows.groupBy(by, BLOCK).agg(F.min(F.when(warm, F.col(LINE))).alias("_first"))
    earlier = Window.partitionBy(by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn(
        "_open", F.coalesce(F.max(F.col("_first").isNotNull()).over(earlier), F.lit(False))
    )
    return (
        rows.join(splits, [by, BLOCK])
        .filter(F.col("_open") | (F.col(LINE) >= F.col("_first")))
        .drop("_first", "_open")
    )


def one_row_per_second(rows: DataFrame, by: str = SOURCE) -> DataFrame:
    """Keep the first row of each file and whole second; combined before the shuffle.

    Rows without a time share no second, so each of them stays.
    """
    second = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    own = F.when(F.col("ts").isNull(), F.struct(*PLACE))
    columns = [c for c in rows.columns if c != by]
    return (
        rows.groupBy(by, second.alias("_second"), own.alias("_own"))
        .agg(F.min_by(F.struct(*columns), F.struct(*PLACE)).alias("_row"))
        .select(by, "_row.*")
        .select(*rows.columns)
    )


def head_per_file(rows: DataFrame, max_rows: int = ROWS_PER_DRIVE, by: str = SOURCE) -> DataFrame:
    """The first ``max_rows`` rows of each file; the rank limit also runs before the shuffle."""
    order = Window.partitionBy(by).orderBy(*PLACE)
    return (
        rows.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= F.lit(int(max_rows)))
        .drop("_rank")
    )


def staggered_drives(
    rows: DataFrame, min_warm_c: float | None = None, max_rows: int = ROWS_PER_DRIVE, by: str = SOURCE
) -> DataFrame:
    """Staggered log to one complete row per second: fill, warm start, thin out, cut."""
    filled = forward_fill_readings(rows, by=by)
    return head_per_file(one_row_per_second(warm_start_gate(filled, min_warm_c, by), by), max_rows, by)


# -- week export -----------------------------------------------------------------------


def scan_week_export(
    spark: SparkSession, paths: str | Sequence[str], multiline: bool = False
) -> DataFrame:
    """Rows of a week export as text."""
    wanted = {**WEEK_KEYS, **WEEK_COLUMNS}
    return scan(spark, paths, list(wanted), lambda names: match_exact(names, wanted), multiline)


def week_trips(
    raw: DataFrame,
    trips: Sequence[tuple[str, str]] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Rows of all (or the given) trips with rpm, speed, load and air flow present.

    ``NA`` and blank are missing.  The text ``NaN`` is present here and becomes
    NULL when the values are parsed.
    """

    def cell(name: str) -> Column:
        text = text_or_null(F.col(name))
        return F.when(F.upper(text) != "NA", text).alias(name)

    days = (F.col("day_num").cast("double") - F.lit(1.0)) * F.lit(86400)
    # Whole milliseconds on top of a day offset that may have a fraction.
    seconds = F.round(days, 6).cast("decimal(18,6)") + (
        F.col("ms").cast("double").cast("bigint").cast("decimal(18,6)") / F.lit(1000)
    )
    ts = plus_seconds(F.to_timestamp_ntz(F.lit(WEEK_EPOCH)), seconds)
    rows = raw.select(
        SOURCE,
        *PLACE,
        "veh_id",
        "trip",
        F.date_trunc("millisecond", ts).cast("timestamp_ntz").alias("ts"),
        *[cell(c) for c in WEEK_COLUMNS],
    )
    if trips is not None:
        wanted = F.lit(False)
        for veh, trip in trips:
            wanted = wanted | ((F.col("veh_id") == veh) & (F.col("trip") == trip))
        rows = rows.filter(wanted)
    for c in WEEK_REQUIRED:
        rows = rows.filter(F.col(c).isNotNull())
    if max_rows is None:
        return rows
    order = Window.partitionBy("veh_id", "trip").orderBy(SOURCE, *PLACE)
    return (
        rows.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= F.lit(int(max_rows)))
        .drop("_rank")
    )


def as_samples(rows: DataFrame) -> DataFrame:
    """Text readings to the twelve gauges; absent ones become NULL."""
    present = set(rows.columns)
    kept = [c for c in rows.columns if c not in GAUGES]
    return rows.select(
        *kept,
        *[
            (first_number(F.col(g)) if g in present else F.lit(None).cast("double")).alias(g)
            for g in GAUGES
        ],
    )
