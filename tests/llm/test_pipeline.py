from __future__ import annotations

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, rows = [docs.count()], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, SF).write.parquet(str(tmp_path / str(k)))
        rows = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert rows.columns == docs.columns
            sizes.append(rows.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4]
    assert rows.select("doc_id").distinct().count() == sizes[4]
    assert corpus_pipeline.run(spark, SF).count() == rows.count()


@pytest.mark.parametrize("k", range(5))
def test_odd_documents(spark, odd_docs, no_docs, k):
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (odd_docs, no_docs):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        assert out.count() <= max(docs.count() * 30, 0)


@pytest.mark.parametrize("k", [0, 1, 2, 4])
def test_python_stages_bound_their_batches_in_bytes(spark, k):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    try:
        corpus_pipeline.STAGES[k][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
        largest = spark.range(0, 4_000, 1, 1).selectExpr("repeat('word ', 2000) as text").mapInArrow(lambda batches: (b.select(["text"]).slice(0, 0) if b.nbytes < 9_000_000 else b for b in batches), "text string")
        assert largest.count() == 0
    finally:
        spark.conf.unset(name)
