"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gaugeflow.operators.ordered import cut_lineage

# Rows a broadcast side may have where no tighter bound is known (8 to 100 bytes each).
BROADCAST_ROWS = 500_000


_shipped: set[str] = set()


# Rows of an Arrow batch: with long texts the default of 10000 takes hundreds of megabytes.
BATCH_ROWS = 1024


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each Spark application, and batches they can hold."""
    context = spark.sparkContext
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % folds


def materialized(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, so that several readers share one computation."""
    return cut_lineage(df)


# Rows of a narrow stored table that are worth a task of their own.
ROWS_A_TASK = 100_000


def compacted(df: DataFrame) -> DataFrame:
    """``materialized`` for tables of a few narrow columns, read by as many tasks as its rows need.

    Steps on it then don't write files for each of the many, almost empty partitions that a
    shuffle leaves; a large table keeps its partitions.
    """
    stored = materialized(df)
    return stored.coalesce(stored.count() // ROWS_A_TASK + 1)


Columns = dict[str, Any]

# Only functions of this module may touch it: a function sent to a worker gets a copy of
# the globals that it names.
_held: dict[Any, Any] = {}


def held(name: Any, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps between tasks under a name: one thing at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    _held.clear()


def batchwise(
    work: Callable[[Iterator[Columns]], Iterator[Columns]], ddl: str, keeps: bool = False
) -> Callable[[DataFrame], DataFrame]:
    """``df.transform(batchwise(work, ddl))``: work on Arrow batches as lists of Python values.

    Unlike a pandas frame, lists keep NULL apart from NaN and 64-bit ids exact.  Work that
    ``keeps`` nothing between tasks lets go of what another operator kept in the worker.
    """

    def transform(df: DataFrame) -> DataFrame:
        schema = to_arrow_schema(StructType.fromDDL(ddl))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not keeps:
                let_go()
            lists = (
                {name: batch.column(name).to_pylist() for name in batch.schema.names}
                for batch in batches
            )
            for made in work(lists):
                yield pa.RecordBatch.from_pydict(made, schema=schema)

        return df.mapInArrow(run, ddl)

    return transform


def slices(texts: Sequence[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each; a longer text has a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def in_blocks(df: DataFrame, key: list[str], row: str, most: int) -> DataFrame:
    """Rows of each key in pairs of blocks: columns side (a row's block), low and high (the pair).

    A key with at most ``most`` rows is one block.  The rows of a longer one are spread over
    blocks by hash and repeated for each other block, so that every two rows meet in exactly
    one (low, high), a diagonal one if they share their side.
    """
    long_keys = (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > most)
        .select(*key, F.ceil(F.col("rows") / most).cast("int").alias("blocks"))
    )
    return paired_blocks(
        df.join(long_keys, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))),
        row,
        "blocks",
    )


def paired_blocks(df: DataFrame, row: str, blocks: str) -> DataFrame:
    """``in_blocks`` where each row has its key's number of blocks, which is dropped."""
    return (
        df.withColumn("side", F.pmod(F.xxhash64(row), F.col(blocks)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
        .withColumn("low", F.least("side", "other"))
        .withColumn("high", F.greatest("side", "other"))
        .drop("other", blocks)
    )


def whole(values: Iterable[str | None]) -> list[str]:
    return ["" if v is None else v for v in values]


def label_sample(
    labels: DataFrame, target: str, folds: int, held_out: int, rows: int
) -> DataFrame:
    """At most ``rows`` labelled ids of the learning folds with their label, chosen by hash of the id.

    A NULL label is no label; an id that is labelled twice counts with its lower label.
    """
    return (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
        .where(fold("doc_id", folds) != held_out)
        .groupBy("doc_id")
        .agg(F.min(target).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
