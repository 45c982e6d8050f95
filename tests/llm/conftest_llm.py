import pytest

from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} line" + ("\n" if i % 9 == 0 else "") for i in range(40_000))

# Column names that the operators use inside, besides those of documents.
EXTRA = ("row", "node", "score", "label", "k1", "lines", "found", "list")


@pytest.fixture(scope="session")
def doc_schema():
    return T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            *[T.StructField(c, T.StringType()) for c in EXTRA],
        ]
    )


@pytest.fixture(scope="session")
def make_docs(spark, doc_schema):
    """Documents from (doc_id, text) pairs, with other columns filled in."""

    def make(rows):
        return spark.createDataFrame(
            [
                (i, t, "en", None if i is None else f"src{i % 3}", len(t or ""), *["x"] * len(EXTRA))
                for i, t in rows
            ],
            doc_schema,
        )

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t \n"),
    (4, "Short."),
    (4, "Short."),
    (5, "same five words in here now\nand a second line\nand a third"),
    (6, "same five words in here now\nand a second line\nand a third"),
    (None, "a row without an id that says some words"),
    (7, LONG),
    (-8, "ünïcode 你好 👍 text with 1234 numbers"),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def labels(spark):
    schema = "doc_id long, quality int, toxic int, score string"
    return spark.createDataFrame(
        [(5, 1, 0, ""), (7, 1, 0, ""), (7, 0, None, ""), (4, 0, 1, ""), (None, 1, 1, ""), (3, None, 0, ""), (99, 1, 1, "")],
        schema,
    )



