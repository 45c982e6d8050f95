"""The five stages, alone and one after the other."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from conftest_llm import ODD
from gaugeflow.llm.edit_matching import normalized

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.columns == columns
        assert {r.doc_id for r in docs.collect()} <= set(before)
    sql = duckdb.connect()
    kept = {r.doc_id: r.text for r in docs.collect()}
    good = dict(sql.execute(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    assert sum(good.get(i) == 0 for i in kept) <= 1
    items = [normalized(t) for (t,) in sql.execute(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    assert not any(item in normalized(text) for text in kept.values() for item in items)
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    whole = {r.doc_id: r.doc_tokens for r in packed}
    assert set(whole) == set(kept)
    held = Counter()
    for r in packed:
        held[r.doc_id] += r.length
    assert held == whole


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_with_odd_rows(spark, odd_docs, no_docs, name, stage):
    out = stage(spark, odd_docs, FOLDER)
    ids = Counter(r.doc_id for r in out.collect())
    assert set(ids) <= {i for i, _ in ODD}
    if name != "packing":
        assert out.columns == odd_docs.columns
        assert {1, 2, 3} <= set(ids)
    assert stage(spark, no_docs, FOLDER).collect() == []
