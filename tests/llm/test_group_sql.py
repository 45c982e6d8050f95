"""The SQL of the two similarity joins against the operators, on tables that hold links of every kind."""

import math

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from gaugeflow.llm.common import ship
from gaugeflow.llm.pivot_index import near_vectors
from gaugeflow.llm.queries import ORACLE
from gaugeflow.llm.set_join import shingle_groups


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def sql_rows(name, table, rows):
    db = duckdb.connect()
    db.register(table, rows)
    found = db.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    return {tuple(sorted(zip(names, row))) for row in found.fetchall()}


def spark_rows(df):
    return {tuple(sorted(r.asDict().items())) for r in df.collect()}


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    vectors = [(c + rng.normal(size=24) * 0.18).tolist() for c in centres for _ in range(20)]
    rows = [(i, v, i % 3 if i % 17 else None) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 24, [math.nan] * 24, [math.inf] + [1.0] * 23, [1.0, None] * 12, [1.0, 2.0], vectors[0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    got = spark_rows(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")))
    ids, vectors, labels = zip(*rows)
    arrow = pa.table(
        {
            "vec_id": pa.array(ids, pa.int64()),
            "embedding": pa.array(vectors, pa.list_(pa.float32())),
            "label": pa.array(labels, pa.int32()),
        }
    )
    assert got == sql_rows("op4_near_vectors", "embeddings", arrow)
    assert sum(dict(r)["n_links"] > 0 for r in got) > 100


def test_documents(spark, make_docs):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 4000, 80)) for _ in range(30)]
    near = []
    for k, text in enumerate(texts[:20]):
        for changes in (0, 1, 2, 3):
            words = text.split()
            for place in rng.choice(80, changes, replace=False):
                words[place] = "Changed"
            near.append(" ".join(words) if k % 2 else "\n".join(words).upper())
    odd = [None, "", " \t\n", "one", "ONE", "one two three four", "one two\x0bthree four", "É é five six seven eight"]
    rows = list(enumerate(texts + near + odd))
    got = spark_rows(shingle_groups(make_docs(rows)).select("doc_id", "n_shingles", "component_id"))
    table = pd.DataFrame(rows, columns=["doc_id", "text"])
    assert got == sql_rows("op6_jaccard_join", "documents", table)
    assert sum(dict(r)["doc_id"] != dict(r)["component_id"] for r in got) > 30
