"""Line deduplication by overlapping three-line windows, in DataFrame operations only.

Every three non-blank lines of a text that follow each other, whatever blank lines part them,
are hashed to 128 bits.  Windows that occur more than once in the corpus keep their first
occurrence, by (id, place in the text); the lines of all later ones are removed, from the first
to the last with the blank lines between them.  Only hashes and places are shuffled to find the
windows; texts move once, to meet the ranges to remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import text_or_empty

WINDOW = 3


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row as it is, its text, and a key that equal (id, text) share."""
    doc_id, text = F.col(id_col), text_or_empty(text_col)
    return docs.select(
        F.struct("*").alias("row"),
        doc_id.alias("doc_id"),
        text.alias("text"),
        F.xxhash64(doc_id, text).alias("k1"),
        F.xxhash64(F.lit("second"), text, doc_id).alias("k2"),
    )


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def covered_ranges(keyed: DataFrame) -> DataFrame:
    """Per document key, the merged ranges [first, last] of lines that later occurrences cover."""
    hashed = keyed.select(
        "doc_id",
        "k1",
        "k2",
        F.filter(
            F.transform(
                _lines(F.col("text")),
                lambda line, i: F.when(
                    line.rlike(r"\S"),
                    F.struct(
                        F.xxhash64(line).alias("a"),
                        F.xxhash64(F.lit("b"), line).alias("b"),
                        i.alias("at"),
                    ),
                ),
            ),
            lambda line: line.isNotNull(),
        ).alias("h"),
    ).where(F.size("h") >= WINDOW)
    many = F.size("h") - (WINDOW - 1)
    windows = (
        hashed.select(
            "doc_id",
            "k1",
            "k2",
            F.posexplode(
                F.arrays_zip(*[F.slice("h", i + 1, many).alias(f"h{i}") for i in range(WINDOW)])
            ).alias("place", "w"),
        )
        .select(
            "doc_id",
            "k1",
            "k2",
            "place",
            F.col("w.h0.at").alias("start"),
            F.col(f"w.h{WINDOW - 1}.at").alias("stop"),
            F.xxhash64(*[F.col(f"w.h{i}.a") for i in range(WINDOW)]).alias("w1"),
            F.xxhash64(*[F.col(f"w.h{i}.b") for i in range(WINDOW)]).alias("w2"),
        )
    )
    at = F.struct("doc_id", "k1", "k2", "place")
    repeated = (
        windows.groupBy("w1", "w2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
        .where("n > 1")
        .drop("n")
    )
    same = [F.col(f"first.{c}").eqNullSafe(F.col(c)) for c in ("k1", "k2", "place")]
    later = windows.join(repeated, ["w1", "w2"]).where(~(same[0] & same[1] & same[2]))
    # Windows of one document; at most one for each of its lines.  Those that share a line merge.
    places = later.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.struct("place", "start", "stop"))).alias("p")
    )
    apart = lambda x, y: x["place"] - y["place"] >= WINDOW
    return places.select(
        "k1",
        "k2",
        F.transform(
            F.filter("p", lambda x, i: (i == 0) | apart(x, F.get("p", i - 1))),
            lambda x: x["start"],
        ).alias("first"),
        F.transform(
            F.filter("p", lambda x, i: (i == F.size("p") - 1) | apart(F.get("p", i + 1), x)),
            lambda x: x["stop"],
        ).alias("last"),
    )


def _cleaned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    marked = keyed.join(covered_ranges(keyed), ["k1", "k2"], "left").withColumn(
        "lines", _lines(F.col("text"))
    )
    # What lies between the ranges: after one's last line, before the next one's first.
    kept = F.flatten(
        F.transform(
            F.arrays_zip(
                F.concat(F.array(F.lit(-1)), F.col("last")).alias("after"),
                F.concat(F.col("first"), F.array(F.size("lines"))).alias("before"),
            ),
            lambda gap: F.slice("lines", gap["after"] + 2, gap["before"] - gap["after"] - 1),
        )
    )
    return marked.select(
        "row",
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("first").isNull(), F.col("lines")).otherwise(kept).alias("kept"),
        F.col("text").alias("whole"),
    ).select(
        "row",
        "doc_id",
        "n_lines",
        (F.col("n_lines") - F.size("kept")).alias("n_removed"),
        F.when(F.size("kept") == F.col("n_lines"), F.col("whole"))
        .otherwise(F.array_join("kept", "\n"))
        .alias("text"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without repeated three-line windows: doc_id, n_lines, n_removed, text.

    One row per input row.  A NULL text counts as empty: one blank line.  Blank lines are
    passed over, and go where they lie inside a window that goes.  A text of fewer than three
    other lines has no window.  Rows with equal id and text are one document: they get the same result.
    Of equal windows the one with the smallest id (NULL first) and place stays; where
    windows overlap each other, all lines of the later ones go.
    """
    return _cleaned(docs, id_col, text_col).drop("row")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with their own columns, ``text`` cleaned and ``n_chars`` counted anew.

    A document goes where removal left no text at all; one that was blank before stays.
    """
    cleaned = _cleaned(docs, "doc_id", "text")
    row = F.col("row").withField(
        "text", F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("row.text"))
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField(
            "n_chars",
            F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(
                F.col("row.n_chars")
            ),
        )
    return (
        cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
        .select(row.alias("row"))
        .select("row.*")
    )
