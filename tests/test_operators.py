from __future__ import annotations

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkwell.functions import text as X
from sparkwell.operators import events as E
from sparkwell.operators import models, retrieval, signals, store, tables, validation
from sparkwell.plans import recommend, reports
from sparkwell.schema import ARTICLES
from sparkwell.sources import collect
from sparkwell.streaming.inbox import ingest_stream, read_inbox, windowed_counts

EXOTIC = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_text_rules_follow_python(spark):
    rnd = random.Random(1)
    values = ["".join(rnd.choice(EXOTIC + "abc.-* é") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k")
    assert one(df, X.clean(F.col("v"))) == [" ".join(v.split()) for v in values]
    assert one(df, X.strip(F.col("v"))) == [v.strip() for v in values]
    assert one(df, X.truncate(F.col("v"), 10)) == [v if len(v) <= 10 else v[:10].rstrip() + "..." for v in values]
    assert one(df, X.clean_bullet(F.col("v"))) == [v.strip().lstrip("-* ").strip() for v in values]


def test_validation_looks_at_the_source_first(spark):
    raw = spark.createDataFrame([("rss", "x"), (None, "y" * 60), ("news", "x" * 49), ("news", "x" * 50), ("api", None)], "source string, raw_text string")
    valid, rejected = E.validate(raw)
    assert valid.count() == 1
    assert sorted(one(rejected, "reason")) == ["invalid_source", "invalid_source", "invalid_text", "invalid_text"]
    with pytest.raises(Exception, match="invalid_source"):
        E.validate(raw, strict=True)[0].collect()


def test_insert_keeps_the_first_and_goes_on_with_ids(spark):
    old = spark.createDataFrame([(7, "u1")], "article_id long, url string")
    new = spark.createDataFrame([(1, "u1", "t"), (2, "u2", "a"), (3, "u2", "b"), (4, "u3", None), (250_000, "u4", "c")], "ord long, url string, title string")
    got = {r["url"]: (r["article_id"], r["title"]) for r in E.insert_or_skip(old, new, "ord").collect()}
    assert got == {"u2": (8, "a"), "u4": (9, "c")}
    assert E.insert_or_skip(old, new.limit(0), "ord").count() == 0


def article(spark, k):
    return spark.createDataFrame([(k, "news", "t", None, "c", f"u{k}", datetime(2024, 1, 1), None, None)], ARTICLES)


def test_limits_before_and_after_the_anti_join(spark):
    a = spark.createDataFrame([(k, f"2024-01-0{k}") for k in range(1, 6)], "article_id long, published_at string")
    e = spark.createDataFrame([(5,), (4,)], "article_id long")
    assert one(store.structuring_backlog(a, e, 3), "article_id") == [3]
    assert one(store.newest_first(store.unstructured(a, e), 3), "article_id") == [3, 2, 1]
    assert store.newest_first(a, -1).count() == 5 and store.newest_first(a, 0).count() == 0


def test_snapshots_replace_at_once(spark, tmp_path):
    t = tables.SnapshotTable(spark, str(tmp_path / "articles"), ARTICLES)
    assert t.read().count() == 0
    row = article(spark, 1)
    assert t.write(t.read().unionByName(row))["n"] == 1
    held = t.read()
    assert t.write(t.read().unionByName(article(spark, 2)))["n"] == 2
    assert held.count() == 1 and t.read().count() == 2
    t.write(row)
    assert sorted(p.name for p in (tmp_path / "articles").iterdir() if p.is_dir()) == ["v2", "v3"]


def test_nearest_is_exact_and_breaks_ties_by_id(spark):
    rows = [(k, [float(k % 5 + 1), 1.0, 0.5]) for k in range(40)]
    corpus = spark.createDataFrame(rows, "article_id long, embedding array<double>").repartition(3)
    got = retrieval.nearest(corpus, corpus.filter("article_id < 3").withColumnRenamed("article_id", "question_id"), 4)
    for q in range(3):
        assert one(got.filter(F.col("question_id") == q).orderBy("rank"), "article_id") == [q, q + 5, q + 10, q + 15]
    assert retrieval.nearest(corpus, corpus.limit(0).withColumnRenamed("article_id", "question_id"), 4).count() == 0


@pytest.mark.parametrize(
    ("target", "asset", "expected"),
    [("BRK.B", "Berkshire (BRK.B)", None), ("BRK.B", "brk.b ", "target"), ("msft", "Microsoft (MSFT)", "target"), ("apple inc", "Apple  Inc", "target"), ("apple inc", "The apple inc group", None), ("Market", "Broad Market", "target"), ("MSFT", "general-market", "market"), ("market", "MSFT", None), ("", " ", "target")],
)
def test_targets_and_assets(spark, target, asset, expected):
    t = spark.createDataFrame([(target,)], "target string")
    e = spark.createDataFrame([(1, asset, "Positive", "High")], "event_id long, affected_asset string, direction string, importance string")
    assert one(signals.match_events(t, e), "match") == ([expected] if expected else [])


def test_aggregation_scenario(spark):
    rows = [(1, "Company", "Positive", "High", "Long-term", "MSFT"), (2, "Macro", "Negative", "Medium", "Short-term", "General Market")]
    e = spark.createDataFrame(rows, "event_id long, event_type string, direction string, importance string, time_horizon string, affected_asset string").withColumn("structured_at", F.lit("x"))
    r = signals.aggregate(signals.match_events(spark.createDataFrame([("MSFT",)], "target string"), e), with_events=True).first()
    assert (r["company_score"], r["macro_score"], r["net_score"], r["target_specific_event_count"]) == (3, -2, 1, 1)
    assert r["conflicts"] == [signals.CONFLICT_BOTH, signals.CONFLICT_HORIZON]
    assert r["dominant_driver"] == "Company signals are the dominant positive driver" and len(r["target_events"]) == 2


def test_ties_of_drivers_are_named_together(spark):
    df = spark.createDataFrame([(2, -2, 0, 0), (0, 0, 0, 0)], "a long, b long, c long, d long")
    got = one(df, signals.dominant_driver({"Macro": F.col("a"), "Company": F.col("b"), "Sector": F.col("c"), "Market": F.col("d")}))
    assert got == ["Mixed drivers across Company, Macro", "No dominant driver"]


def test_rerank_errors(spark):
    rows = [(["1", "2"], ["2", "1"]), (["1", "2"], ["1"]), (["1", "2"], ["1", "1"]), (["1", "2"], ["1", "9"])]
    got = one(spark.createDataFrame(rows, "e array<string>, a array<string>"), retrieval.rerank_error(F.col("e"), F.col("a")))
    assert got == [None, "Reranker must return the same number of candidate IDs it received", "Reranker returned duplicate candidate IDs", "Reranker returned invalid candidate IDs: invented IDs: ['9'], missing IDs: ['2']"]


def test_model_rules(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), (["a", "b", " - "],)], "b array<string>")
    assert one(df, validation.summary_error(F.col("b"))) == [None, "3 to 5 bullets are needed", "empty bullet"]
    e = spark.createDataFrame([("Macro", "Positive", "High", "Both"), ("Weather", "Positive", "High", "Both")], "event_type string, direction string, importance string, time_horizon string")
    assert one(e, validation.event_error()) == [None, "invalid event_type"]
    r = spark.createDataFrame([("HOLD", "x", ["a"] * 3), ("WATCH", "x", []), ("BUY", " ", []), ("BUY", "x", ["a"] * 4)], "decision string, reasoning string, key_risks array<string>")
    assert one(r, validation.recommendation_error()) == [None, "invalid decision", "Reasoning must be non-empty", "at most 3 key risks"]


def test_providers_are_not_made_without_rows(spark):
    def broken():
        raise RuntimeError("no key")

    none = spark.createDataFrame([], "article_id long, title string, description string, content string")
    assert models.summarise(none, broken).count() == 0


def test_flow_of_recommendations(spark, tmp_path):
    targets = spark.createDataFrame([(1, "MSFT"), (2, "AAPL"), (3, "ZZZ")], "question_id long, target string")
    hits = spark.createDataFrame([(1, 10, 0.1, 1, "t", "u", "c" * 60, None), (2, 11, 0.1, 1, "t", "u", "c" * 60, None)], "question_id long, article_id long, distance double, rank long, title string, url string, content string, summary string").withColumn("published_at", F.lit(None).cast("timestamp"))
    rows = [("e1", 10, "Company", "Positive", "High", "Both", "MSFT"), ("e2", 11, "Macro", "Negative", "Low", "Both", "Market")]
    events = spark.createDataFrame(rows, "event_id string, article_id long, event_type string, direction string, importance string, time_horizon string, affected_asset string").withColumn("structured_at", F.lit("x")).withColumn("evidence_excerpt", F.lit("ev"))
    got = recommend.recommend(targets, hits, events)
    assert {r["target"]: (r["route"], r["decision"]) for r in got.collect()} == {"MSFT": ("decide", "BUY"), "AAPL": ("market_only", "HOLD"), "ZZZ": ("no_evidence", "HOLD")}
    written = reports.write_reports(got.filter("target = 'AAPL'"), str(tmp_path), F.lit("2026-05-10 20:30:15").cast("timestamp"))
    path = written.first()["path"]
    assert path.endswith("2026-05-10_203015_AAPL.md")
    text = open(path, encoding="utf-8").read()
    assert "- Insufficient evidence: yes" in text and "## Conflicts" not in text and text.endswith("Snippet: " + "c" * 60 + "\n")


def test_sources(spark):
    payload = json.dumps({"status": "ok", "articles": [{"title": "T" * 40, "description": "D" * 20}, {"title": None, "description": "D" * 60}, {"title": "short", "description": "x"}]})
    got = one(collect.news(spark.createDataFrame([(payload,)], "value string")), "raw_text")
    assert got == ["T" * 40 + ". " + "D" * 20, ". " + "D" * 60]
    series = json.dumps({"Time Series (Daily)": {"2024-01-01": {"4. close": "1", "5. volume": "2"}, "2024-01-03": {"4. close": "3"}}})
    got = one(collect.market(spark.createDataFrame([(series,), ("{}",)], "value string")), "raw_text")
    assert got == ["SPY daily close: $3, volume: N/A. Market data from Alpha Vantage API.", collect.FALLBACK]
    assert collect.manual(spark, "  ").count() == 0 and one(collect.manual(spark, " a "), "raw_text") == ["a"]


def test_stream_into_snapshots(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    lines = [{"source": "news", "raw_text": "x" * 60}, {"source": "news", "raw_text": "x" * 60}, {"source": "rss", "raw_text": "y" * 60}]
    (inbox / "a.json").write_text("\n".join(map(json.dumps, lines)))
    t = tables.PartitionedTable(spark, str(tmp_path / "articles"), ARTICLES)
    for _ in range(2):
        ingest_stream(read_inbox(spark, str(inbox)), t, str(tmp_path / "checkpoint")).awaitTermination()
    assert t.read().count() == 1


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "a")], "ts string, event_type string")
    assert sorted(one(windowed_counts(df), "n")) == [1, 2]
