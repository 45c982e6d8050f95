"""CSV files whose headers differ from file to file, read as text columns.

All files are read once.  Each record is kept as its whole text in a Parquet table in the
shared folder, with its place in the file: (``block_start``, ``line_no``), the offset of its
file split and an id that is consecutive inside the split.  The first record of a file is
its header, which says which position feeds which wanted column; cells are taken out of the
stored records by the layout of their file.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators.ordered import broadcast_if_few, cut_lineage, shared_folder
from gaugeflow.sources.headers import header_cells

SOURCE = "source_file"
PLACE = ("block_start", "line_no")

Match = Callable[[Column], dict[str, Column]]


def stored_records(spark: SparkSession, paths: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """Every record of the files, headers too, as ``record`` with its place; stored as Parquet.

    Read as one column, a record of several cells is one that does not fit, and the reader
    hands out its whole text; a single cell is written as a quoted one.  Lines without
    anything are no records; with ``multiline`` a line of blanks is one, as the reader has it.
    """
    rows = (
        spark.read.schema("first STRING, whole STRING")
        .option("columnNameOfCorruptRecord", "whole")
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(paths)
    )
    single = F.concat(F.lit('"'), F.replace("first", F.lit('"'), F.lit('""')), F.lit('"'))
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    rows.select(
        F.col("_metadata.file_path").alias(SOURCE),
        F.col("_metadata.file_block_start").alias(PLACE[0]),
        F.monotonically_increasing_id().alias(PLACE[1]),
        F.coalesce("whole", single, F.lit("")).alias("record"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def file_headers(records: DataFrame) -> DataFrame:
    """The first record of each file: its place ``head`` and its names.

    Only first splits are looked at, and each task gives one record a file.
    """
    return (
        records.filter(F.col(PLACE[0]) == 0)
        .groupBy(SOURCE)
        .agg(F.min(PLACE[1]).alias("head"), F.min_by("record", PLACE[1]).alias("header"))
        .select(SOURCE, "head", header_cells(F.col("header")).alias("names"))
    )


def scan(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str],
    match: Match,
    multiline: bool = False,
    required: Sequence[str] = (),
) -> DataFrame:
    """All files with the wanted columns as text; a column no header offers is NULL.

    ``match`` gives for each column its position in an array of header names, NULL if it
    has none.  A file without one of the ``required`` columns stops the job.  The stored
    records stay in the shared folder for as long as the result is used.
    """
    records = stored_records(spark, paths, multiline)
    names = file_headers(records)
    found = match(F.col("names"))
    heads = cut_lineage(
        names.select(
            SOURCE, "head", F.size("names").alias("width"), F.array(*[found[c] for c in columns]).alias("at")
        )
    )
    missing = F.lit(False)
    for c in required:
        missing = missing | F.get("at", F.lit(list(columns).index(c))).isNull()
    files, width, layouts, layout, bad = heads.agg(
        F.count(F.lit(1)),
        F.max("width"),
        F.count_distinct("at"),
        F.first("at"),
        F.min(F.when(missing, F.col(SOURCE))),
    ).first()
    if not files:
        raise ValueError(f"no header line found in {paths}")
    if bad is not None:
        raise ValueError(f"{bad} has no column for one of: {', '.join(required)}")

    per_file = broadcast_if_few(heads.select(SOURCE, "head", "at"), files)
    unknown = F.concat(F.lit("no header line found in "), F.col(SOURCE))
    known = F.when(F.col("head").isNull(), F.raise_error(unknown).cast("bigint")).otherwise(F.col("head"))
    schema = ", ".join(f"c{at} STRING" for at in range(width))
    cells = F.from_csv("record", schema, {"escape": '"', "maxColumns": str(max(width, 20480))})
    rows = records.join(per_file, SOURCE, "left").filter(F.col(PLACE[1]) != known)
    if layouts == 1:
        rows = rows.select(SOURCE, *PLACE, cells.alias("cells"))
        wanted = [F.lit(None).cast("string") if at is None else F.col(f"cells.c{at}") for at in layout]
    else:
        rows = rows.select(SOURCE, *PLACE, "at", cells.alias("cells")).withColumn(
            "cells", F.array(*[f"cells.c{at}" for at in range(width)])
        )
        wanted = [F.expr(f"get(cells, get(at, {n}))") for n in range(len(columns))]
    return rows.select(SOURCE, *PLACE, *[cell.alias(c) for c, cell in zip(columns, wanted)])
