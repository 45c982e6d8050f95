"""Parquet tables that a stream's micro-batches write, one folder per batch.

A repeated batch overwrites its own folder.  What has to be remembered between batches is
the engine's keyed state; these tables are results, and where a batch brings a row anew, the
newest batch counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# State lives in RocksDB files of the executors and the checkpoint, not in their heaps; a batch
# commits what it changed rather than all files.
_STATE = "spark.sql.streaming.stateStore"
_ON_DISK = {
    f"{_STATE}.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    # One store for both sides of a join rather than four.
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def put(
    df: DataFrame, root: str, name: str, batch_id: int, by: Sequence[str] = ()
) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{root}/{name}/batch={batch_id}")


def create(
    spark: SparkSession, root: str, name: str, schema: str, by: Sequence[str] = ()
) -> None:
    """An empty first batch, so that the table can be read before any stream has written."""
    put(spark.createDataFrame([], schema), root, name, -1, by)


def read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All rows of all batches, with the ``batch`` they came in."""
    return spark.read.schema(f"{schema}, batch BIGINT").parquet(f"{root}/{name}")


def newest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key the row of its newest batch; combined before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
        .select(*keys, "_row.*")
    )


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A query takes its settings when it starts; the session's own are put back."""
    before = {name: spark.conf.get(name, None) for name in _ON_DISK}
    for name, value in _ON_DISK.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def drain(
    stream: DataFrame,
    handler: Callable[[DataFrame, int], None],
    progress: str,
    mode: str = "append",
) -> None:
    """Hand everything available now to ``handler``, batch by batch."""
    writer = (
        stream.writeStream.foreachBatch(handler)
        .outputMode(mode)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
    )
    with state_on_disk(stream.sparkSession):
        query = writer.start()
    query.awaitTermination()
