"""Ordered work on keys of any size.

A plain ``Window.partitionBy(key)`` sorts one key in one task.  That is right for
ordinary sessions and fatal when one session holds a third of a 100 TB table.
So keys above ``BUSY_ROWS`` are numbered by a range-partitioned sort and cut into
runs of bounded length, each carrying the few rows its frame looks back on.  The
result is exact either way, and no row is dropped.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key with more rows than this is cut into runs of at most this length.
BUSY_ROWS = 2_000_000
# Row limit for the small sides that may be broadcast (about 100 bytes a row).
BROADCAST_ROWS = 1_000_000
# The same for a single BIGINT column.
ID_ROWS = 10_000_000

_BLOCK, _SLOT = "_block", "_slot"
_SLOT_MASK = (1 << 33) - 1


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, named in ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def local_shared_folder(spark: SparkSession) -> None:
    """For test sessions: where none is configured, a local session gets a temporary folder."""
    context = spark.sparkContext
    unset = not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None
    if unset and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gaugeflow-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and fixes row placement."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def has_few_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``limit`` rows, by counting no further than that."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table whose row count has been measured."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def busy_keys(df: DataFrame, by: Sequence[str], limit: int = BUSY_ROWS) -> DataFrame | None:
    """Keys with more than ``limit`` rows and their row counts, or None.

    Reads the key columns only and combines on the map side.  There can be no
    more than (rows / limit) such keys.
    """
    found = (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > F.lit(limit))
    )
    return None if found.isEmpty() else cut_lineage(found)


def keep_keys(
    df: DataFrame,
    keys: DataFrame,
    by: str,
    spread_on: str,
    broadcast_rows: int = ID_ROWS,
    salts: int = 32,
) -> DataFrame:
    """Rows of a large table whose ``by`` is among ``keys`` (one column, unique).

    The keys are counted and broadcast up to ``broadcast_rows``.  Beyond that both
    sides are joined on (key, salt): a busy key spreads over tasks, and since the
    result is not partitioned by the key alone, a later aggregation combines rows
    before its shuffle instead of taking a whole key into one task.
    """
    if keys.count() <= broadcast_rows:
        return df.join(F.broadcast(keys), by, "left_semi").select(*df.columns)
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(spread_on), F.lit(salts)).cast("int")
    return (
        df.withColumn("_salt", salt)
        .join(salted, [by, "_salt"], "left_semi")
        .select(*df.columns)
    )


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """Exact 1-based row numbers per key without a task per key.

    Rows are range-partitioned on (key, order), so a large key spreads over many
    tasks.  One row per (key, range) gives the offsets.  Meant for few keys: all
    rows of a table (``by=()``) or the busy keys.
    """
    keys = [*by, *order]
    placed = cut_lineage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_BLOCK, F.spark_partition_id())
        .withColumn(_SLOT, F.monotonically_increasing_id().bitwiseAND(F.lit(_SLOT_MASK)))
    )
    spans = placed.groupBy(*by, _BLOCK).agg(
        F.min(_SLOT).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(_BLOCK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # Sorted ranges give at most (keys + ranges) spans, and the keys are few by contract.
    offsets = F.broadcast(
        spans.select(
            *by, _BLOCK, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
        )
    )
    return (
        placed.join(offsets, [*by, _BLOCK])
        .withColumn(name, F.col("_before") + F.col(_SLOT) - F.col("_first") + F.lit(1))
        .drop(_BLOCK, _SLOT, "_before", "_first")
    )


def number_in_splits(
    rows: DataFrame, splits: DataFrame, keys: Sequence[str], line: str, name: str
) -> DataFrame:
    """Rows joined with their file split and numbered from 0 inside it, in order of ``line``.

    ``splits`` has one row per split with ``_lines``, ``_low`` and ``_high``: its rows, first
    and last line.  Where the lines of every split are consecutive, as a scan gives them, the
    number is the distance to the first one and wide rows are not moved; a table that lost
    rows on the way is numbered by sorting each split.  The splits are counted for both.
    """
    count, gaps = splits.agg(
        F.count(F.lit(1)),
        F.count_if(F.col("_high") - F.col("_low") + F.lit(1) != F.col("_lines")),
    ).first()
    if gaps:
        inside = Window.partitionBy(*keys).orderBy(line)
        rows = rows.withColumn(name, F.row_number().over(inside).cast("bigint") - F.lit(1))
    joined = rows.join(broadcast_if_few(splits, count), [*keys])
    if not gaps:
        joined = joined.withColumn(name, F.col(line) - F.col("_low"))
    return joined.drop("_lines", "_low", "_high")


def running_offsets(df: DataFrame, order: Sequence[str], amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` over all earlier rows in a total order, computed by ranges."""
    placed = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_BLOCK, F.spark_partition_id())
    )
    starts = placed.groupBy(_BLOCK).agg(F.sum(amount).alias("_n"))
    earlier = (
        Window.partitionBy(F.lit(0)).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = starts.select(_BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = (
        Window.partitionBy(_BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    within = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    # One row per range partition, so the starts are always few.
    return (
        placed.join(F.broadcast(starts), _BLOCK)
        .withColumn(name, F.col("_start") + within)
        .drop(_BLOCK, "_start")
    )


def _runs(numbered: DataFrame, size: int, look_back: int) -> DataFrame:
    """Cut numbered rows into runs; the tail of each run is copied to the next one."""
    slot = F.col("position") - F.lit(1)
    run = F.expr(f"(position - 1) div {size}")
    tail = (slot % F.lit(size)) >= F.lit(size - look_back)
    copies = F.when(tail, F.array(run, run + F.lit(1))).otherwise(F.array(run))
    return numbered.withColumn("_own", run).withColumn("_run", F.explode(copies))


def rolling(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    rows_before: int,
    frame_columns: dict[str, Column],
    limit: int = BUSY_ROWS,
    with_position: bool = False,
) -> DataFrame:
    """Evaluate aggregates over (``rows_before`` preceding rows + current row) per key.

    ``frame_columns`` maps an output name to an aggregate.  ``with_position`` adds
    ``position`` (1-based) and ``total_rows`` per key.
    """
    limit = max(limit, rows_before + 1)
    busy = busy_keys(df, by, limit)
    usual = df
    if busy is not None:
        busy_list = broadcast_if_few(busy, busy.count())
        usual = df.join(busy_list.select(*by), [*by], "left_anti")

    ordered = Window.partitionBy(*by).orderBy(*order)
    frame = ordered.rowsBetween(-rows_before, 0)
    result = usual.select(
        "*", *[agg.over(frame).alias(name) for name, agg in frame_columns.items()]
    )
    if with_position:
        result = result.select(
            "*",
            F.row_number().over(ordered).cast("bigint").alias("position"),
            F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("total_rows"),
        )
    if busy is None:
        return result

    large = df.join(busy_list.select(*by), [*by], "left_semi")
    runs = _runs(number_rows(large, by, order), limit, rows_before)
    frame = Window.partitionBy(*by, "_run").orderBy("position").rowsBetween(-rows_before, 0)
    cut = runs.select(
        "*", *[agg.over(frame).alias(name) for name, agg in frame_columns.items()]
    ).filter(F.col("_run") == F.col("_own"))
    if with_position:
        cut = cut.join(busy_list.withColumnRenamed("_rows", "total_rows"), [*by])
    return result.unionByName(cut.select(*result.columns))
