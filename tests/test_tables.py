"""Tables that write what a change touches, their rules, numbers that don't come back, and the saved search index."""

from __future__ import annotations

import json
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwell.operators import constraints, retrieval, store
from sparkwell.operators.cells import CellIndex
from sparkwell.operators.tables import Folder, PartitionedTable, SnapshotTable
from sparkwell.plans import ingest as flows
from sparkwell.schema import ARTICLES, STRUCTURED_EVENTS
from sparkwell.sources import views

AT = datetime(2024, 1, 1)
BARE = [f.name for f in ARTICLES if f.name != "article_id"]


def bare(spark, *urls):
    rows = [(k, "news", "t", None, "c" * 60, u, AT, None, AT) for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, "ord long, source string, title string, description string, content string, url string, published_at timestamp, summary string, fetched_at timestamp")


def event(event_id, article_id, direction="Positive"):
    return (event_id, article_id, "Company", direction, "High", "Both", "MSFT", "r", "e", AT)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


@pytest.fixture
def articles(spark, tmp_path):
    return PartitionedTable(spark, str(tmp_path / "articles"), ARTICLES, parts=8, blooms=("url",))


def test_numbers_do_not_come_back(spark, articles):
    new, seen = articles.insert(bare(spark, "a", "b", "c"), "ord")
    assert seen["n"] == 3 and sorted(r.article_id for r in new.collect()) == [1, 2, 3]
    assert articles.delete(spark.createDataFrame([(3,), (99,)], "article_id long")) == 1
    assert sorted(r.article_id for r in articles.insert(bare(spark, "d"), "ord")[0].collect()) == [4]
    assert articles.delete(articles.read().select("article_id")) == 3 and articles.read().count() == 0
    assert [r.article_id for r in articles.insert(bare(spark, "e"), "ord")[0].collect()] == [5]
    assert articles.insert(bare(spark, "x").limit(0), "ord")[1]["n"] == 0 and articles.greatest() == 5


def test_a_change_writes_what_it_touches(spark, articles, tmp_path):
    articles.insert(bare(spark, *map(str, range(200))), "ord")
    before = files(tmp_path / "articles" / "rows")
    assert len({p.split("/")[0] for p in before}) == 8
    articles.insert(bare(spark, "one more"), "ord")
    added = {p: t for p, t in files(tmp_path / "articles" / "rows").items() if before.get(p) != t}
    assert len(added) == 1 and set(before) < set(files(tmp_path / "articles" / "rows"))
    before = files(tmp_path / "articles" / "rows")
    new = spark.createDataFrame([(7, "seven")], "article_id long, summary string")
    seen = articles.change(new, lambda old: store.update_summaries(old, new).withColumnRenamed("updated", "_seen"), {"updated": F.count_if(F.col("_seen"))}, ["summary"])
    after = files(tmp_path / "articles" / "rows")
    assert seen["updated"] == 1 and len({p.split("/")[0] for p in set(before.items()) ^ set(after.items()) for p in [p[0]]}) == 1
    assert [(r.article_id, r.summary) for r in articles.read().filter("summary is not null").collect()] == [(7, "seven")] and articles.read().count() == 201
    assert not (tmp_path / "articles" / "pending").exists()


def test_one_row_into_a_large_table(spark, tmp_path):
    t = PartitionedTable(spark, str(tmp_path / "t"), ARTICLES, blooms=("url",))
    own = views.articles(spark, "/root/testdata/sf0.1").withColumn("fetched_at", F.lit(AT)).withColumn("source", F.lit("news"))
    t.append(own.filter("title is not null and content is not null"))
    before = files(tmp_path / "t")
    new, _ = t.insert(bare(spark, "new"), "ord")
    after = files(tmp_path / "t")
    assert len(before) >= 64 and len(set(after) - set(before)) == 1 and all(after[p] == m for p, m in before.items())
    assert new.first()["article_id"] == 10_001


def test_an_interrupted_change_is_finished(spark, articles, tmp_path, monkeypatch):
    articles.insert(bare(spark, *map(str, range(40))), "ord")
    ids = spark.createDataFrame([(k,) for k in range(1, 21)], "article_id long")
    with monkeypatch.context() as m:
        m.setattr(PartitionedTable, "_finish", lambda self: None)
        articles.delete(ids)
    assert (tmp_path / "articles" / "pending").exists()
    assert sorted(r.article_id for r in articles.read().collect()) == list(range(21, 41))
    assert not (tmp_path / "articles" / "pending").exists()
    # the rows aside without their mark are no change
    Folder(spark, str(tmp_path / "articles")).replace("pending/rows", {})
    assert articles.read().count() == 20


def test_lookups_leave_out_files(spark, articles):
    articles.insert(bare(spark, *(f"u{k}" for k in range(400))), "ord")
    assert [r.url for r in articles.of_key(17).collect()] == ["u16"] and articles.of_key(1000).count() == 0
    plan = articles.of_key(17)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "(part" in plan.split("PartitionFilters")[1].split("]")[0]

    def rows_read(df):
        df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()

    found = articles.where_equal("url", "u33")
    assert [r.article_id for r in found.collect()] == [34]
    # the filter of the other partitions' files says no, so their row groups aren't read
    assert rows_read(articles.where_equal("url", "u33")) < 130
    assert rows_read(articles.of_key(17)) < 100
    urls = spark.createDataFrame([("u1",), ("u399",), ("u399",), ("none",)], "url string")
    assert sorted(r.article_id for r in articles.of_values("url", urls).collect()) == [2, 400]
    ids = spark.createDataFrame([(1,), (400,), (400,), (999,)], "article_id long")
    assert sorted(r.article_id for r in articles.of_keys(ids).collect()) == [1, 400]


def test_rules_of_a_table(spark, articles, tmp_path):
    articles.insert(bare(spark, "a", "b"), "ord")
    events = PartitionedTable(spark, str(tmp_path / "events"), STRUCTURED_EVENTS, parts=4, parents={"articles": articles})

    def frame(*rows):
        return spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in STRUCTURED_EVENTS]))

    assert events.append(frame(event("e1", 1), event("e2", 1))) == 2
    with pytest.raises(constraints.ConstraintError, match=r"invalid direction \(1\); repeated event_id \(1\); unknown article_id \(2\)"):
        events.append(frame(event("e3", 1, "Up"), event("e4", 2), event("e4", 9), event("e5", 10)))
    with pytest.raises(constraints.ConstraintError, match=r"^repeated event_id \(1\)$"):
        events.append(frame(event("e1", 2)))
    with pytest.raises(constraints.ConstraintError, match="no direction"):
        events.append(frame(event("e6", 1, None)))
    with pytest.raises(constraints.ConstraintError, match=r"^repeated url \(1\)$"):
        articles.insert(bare(spark, "c", "a"), "ord")
    assert events.read().count() == 2 and articles.read().count() == 2
    new = frame(event("e1", 1), event("e7", 1))
    events.change(new, lambda old: store.replace_events(old, new))
    assert sorted(r.event_id for r in events.read().collect()) == ["e1", "e7"]
    with pytest.raises(constraints.ConstraintError):
        bad = frame(event("e1", 2))
        events.change(bad, lambda old: store.replace_events(old, bad))
    assert events.read().count() == 2
    bad = frame(event("e8", 1, "Up"), event(None, 1))
    assert sorted((r.event_id or "", r.reasons) for r in constraints.bad_rows(bad, STRUCTURED_EVENTS).collect()) == [("", ["no event_id"]), ("e8", ["invalid direction"])]
    t = SnapshotTable(spark, str(tmp_path / "s"), STRUCTURED_EVENTS)
    with pytest.raises(constraints.ConstraintError, match="repeated event_id"):
        t.write(frame(event("e1", 1), event("e1", 1)))
    with pytest.raises(constraints.ConstraintError, match="unknown article_id"):
        t.write(frame(event("e1", 7)), parents={"articles": articles.read()})
    assert t.read().count() == 0


def test_deletion_takes_events_and_vectors_along(spark, tmp_path):
    db = flows.Store.open(spark, str(tmp_path / "db"))
    text = "{} reports growth. Its profit rose again this year. The outlook is stable for now."
    raw = spark.createDataFrame([(k, "news", text.format(n)) for k, n in enumerate(("Alpha", "Beta", "Gamma"))], "row_ord long, source string, raw_text string")
    flows.ingest(db, raw, F.lit(AT))
    flows.structure_stored(db, F.lit(AT))
    flows.build_cells(db, cells=2)
    ids = spark.createDataFrame([(3,)], "article_id long")
    assert flows.remove(db, ids) == {"events": 2, "vectors": 1, "articles": 1}
    for t in (db.articles.read(), db.events.read(), db.index.read(), db.cells.rows()):
        assert {r.article_id for r in t.collect()} == {1, 2}
    more = spark.createDataFrame([(9, "news", text.format("Delta"))], "row_ord long, source string, raw_text string")
    assert flows.ingest(db, more, F.lit(AT))["saved"] == 1
    assert {r.article_id for r in db.articles.read().collect()} == {1, 2, 4} == {r.article_id for r in db.cells.rows().collect()}
    asked = spark.createDataFrame([(1, "Delta reports growth")], "question_id long, question string")
    assert [r.article_id for r in flows.search(db, asked, 1).collect()] == [r.article_id for r in flows.search(db, asked, 1, exact=True).collect()] == [4]


def grouped(rng, n, groups=40, size=16):
    middle = rng.normal(size=(groups, size))
    x = middle[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, size))
    return [(k, [float(v) for v in np.float32(row)]) for k, row in enumerate(x)]


def test_cells_find_neighbours_in_few_folders(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = grouped(rng, 3000)
    corpus = spark.createDataFrame([*rows, (5000, None), (5001, []), (5002, [1.0]), (5003, [float("nan")] * 16)], "article_id long, embedding array<float>").repartition(5)
    index = CellIndex(spark, str(tmp_path / "cells"))
    about = index.build(corpus, recall=0.98, sample=1500)
    assert about["cells"] == 55 and about["recall"] >= 0.98 and about["probes"] <= 5
    asked = corpus.filter("article_id % 20 = 0").withColumnRenamed("article_id", "question_id")
    exact = {(r.question_id, r.article_id) for r in retrieval.nearest(corpus, asked, 5).collect() if r.question_id < 5000}
    found = index.search(asked, 5)
    got = found.collect()
    assert len(got) == 5 * 150 and len(exact & {(r.question_id, r.article_id) for r in got}) >= 0.95 * len(exact)
    assert sorted((r.question_id, r["rank"], r.article_id) for r in index.search(asked, 5, probes=10**6).collect()) == sorted((r.question_id, r["rank"], r.article_id) for r in retrieval.nearest(corpus.filter("article_id < 5000"), asked.filter("question_id < 5000"), 5).collect())
    # one question: under a tenth of the folders are read
    one = index.search(asked.filter("question_id = 40"), 5)
    assert one.orderBy("rank").first()["article_id"] == 40
    filters = re.findall(r"PartitionFilters: \[(.*)\]", one._jdf.queryExecution().executedPlan().toString())
    read = {x for f in filters for x in re.findall(r"\d+", re.sub(r"part#\d+", "", f))}
    assert 0 < len(read) <= 5


def test_cells_follow_changes(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = grouped(rng, 400, groups=8)
    index = CellIndex(spark, str(tmp_path / "cells"))
    assert not index.built()
    with pytest.raises(ValueError, match="no vector"):
        index.build(spark.createDataFrame([(1, None)], "article_id long, embedding array<float>"))
    index.build(spark.createDataFrame(rows, "article_id long, embedding array<float>"), cells=8)
    before = files(tmp_path / "cells")
    new = spark.createDataFrame([(0, rows[1][1]), (900, rows[2][1]), (3, None)], "article_id long, embedding array<float>")
    assert index.upsert(new) == 2
    after = files(tmp_path / "cells")
    changed = {p.split("part=")[1].split("/")[0] for p, _ in set(before.items()) ^ set(after.items()) if "part=" in p}
    assert 0 < len(changed) <= 4
    own = {r.article_id: r.embedding for r in index.rows().collect()}
    assert len(own) == 400 and own[0] == own[1] and own[900] == own[2] and 3 not in own
    asked = spark.createDataFrame([(1, rows[2][1])], "question_id long, embedding array<float>")
    assert sorted(r.article_id for r in index.search(asked, 2).collect()) == [2, 900]
    assert index.delete(spark.createDataFrame([(2,), (12345,)], "article_id long")) == 1
    assert [r.article_id for r in index.search(asked, 1).collect()] == [900]
    assert json.loads((tmp_path / "cells" / "CURRENT").read_text())["cells"] == 8
