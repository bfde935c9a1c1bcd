"""Plans of the queries, and vectors that can't be compared."""

from __future__ import annotations

import pytest

from sparkwell.operators import retrieval
from sparkwell.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("threshold", ["-1", "10m"])
@pytest.mark.parametrize("name", ["q30_target_match", "q34_target_events_ordered", "q51_recommend_routes"])
def test_events_meet_targets_without_a_product(spark, name, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    if threshold == "-1":
        assert "Broadcast" not in plan


def test_vectors_that_cannot_be_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0, 0.0]), (8, [0.0, 0.0]), (9, [0.9, 0.1])]
    corpus = spark.createDataFrame(rows, "article_id long, embedding array<double>")
    got = retrieval.nearest(corpus, corpus.withColumnRenamed("article_id", "question_id"), 3).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["question_id"], []).append((r["article_id"], round(r["distance"], 3)))
    assert by == {1: [(1, 0.0), (9, 0.006), (8, 1.0)], 7: [(7, 0.0)], 8: [(1, 1.0), (8, 1.0), (9, 1.0)], 9: [(9, 0.0), (1, 0.006), (8, 1.0)]}
    assert retrieval.nearest(corpus.limit(0), corpus.withColumnRenamed("article_id", "question_id")).count() == 0
