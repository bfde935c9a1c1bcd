from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sparkwell import __main__ as cli
from sparkwell.operators import calls, models, prompts
from sparkwell.plans import ingest as flows
from sparkwell.plans import recommend
from sparkwell.sources import collect, live

TEXT = "{} reports growth. Its profit rose again this year. The outlook is stable for now."


def at():
    return F.lit("2026-05-10 20:30:15").cast("timestamp")


def scripted():
    """Replies with what the request holds behind ``say:``."""

    class Scripted:  # local, so that it travels to the workers by value
        def complete(self, rules, request, form):
            reply = request.partition("say:")[2].split("\n")[0]
            if reply == "refuse":
                raise RuntimeError("refused")
            return reply

    return Scripted


def failing():
    class Failing(models.OfflineProvider):
        def structure(self, title, content):
            if "Beta" in content:
                raise ValueError("no")
            return super().structure(title, content)

    return Failing


@pytest.fixture
def db(spark, tmp_path):
    return flows.Store.open(spark, str(tmp_path / "db"))


@pytest.fixture
def raw(spark):
    rows = [(1, "news", TEXT.format("Alpha")), (2, "news", TEXT.format("Beta")), (3, "rss", TEXT.format("Gamma")), (4, "manual", "short")]
    return spark.createDataFrame(rows, "row_ord long, source string, raw_text string")


def test_ingest_skips_known_urls_and_indexes_the_rest(db, raw):
    assert flows.ingest(db, raw, at()) == {"total": 2, "saved": 2, "summarized": 2, "indexed": 2, "skipped": 0}
    assert flows.ingest(db, raw, at()) == {"total": 2, "saved": 0, "summarized": 0, "indexed": 0, "skipped": 2}
    got = db.articles.read().orderBy("article_id").collect()
    assert [r.article_id for r in got] == [1, 2] and got[0].summary.startswith("- Alpha reports growth.\n- Its profit")
    assert db.index.read().filter("has_summary").count() == 2


def test_a_failed_summary_leaves_the_articles_and_those_before_it(db, spark):
    rows = [(1, "news", TEXT.format("Alpha")), (2, "news", "one sentence without an end but of more than fifty characters"), (3, "news", TEXT.format("Gamma"))]
    with pytest.raises(flows.SummaryError, match="Article 2"):
        flows.ingest(db, spark.createDataFrame(rows, "row_ord long, source string, raw_text string"), at())
    assert [r.summary is None for r in db.articles.read().orderBy("article_id").collect()] == [False, True, True]
    with pytest.raises(flows.SummaryError):
        flows.summarise_stored(db)
    assert flows.summarise_stored(db, limit=0) == {"processed": 0, "indexed": 0, "skipped": 0, "total_candidates": 0}


def test_structuring_counts_failures_and_skips_what_has_events(db, raw):
    flows.ingest(db, raw, at(), summarise=False)
    assert flows.structure_stored(db, at(), make=failing()) == {"processed": 1, "created": 2, "skipped": 0, "failures": 1}
    assert flows.structure_stored(db, at()) == {"processed": 1, "created": 2, "skipped": 1, "failures": 0}
    assert flows.structure_stored(db, at())["skipped"] == 2


def test_shell_steps(spark, tmp_path):
    def step(*argv):
        return "\n".join(cli.run(spark, cli._parser().parse_args([*argv, "--store", str(tmp_path / "s"), "--reports", str(tmp_path / "r")])))

    assert step("ask", "profit?") == "No articles in database"
    assert "'saved': 1" in step("ingest", TEXT.format("MSFT"))
    assert "'created': 2" in step("structure")
    assert "Sources:\n[1] MSFT reports growth." in step("ask", "Which profit rose?")
    assert "Decision: HOLD" in step("recommend", "MSFT") and (tmp_path / "r").exists()
    assert json.loads(step("collect", TEXT.format("x")))["raw_text"].startswith("x reports")


def test_model_names():
    env = {"OPENAI_MODEL": "common", "OWN": "own"}
    assert [calls.resolve_model("x", "OWN", "d", env), calls.resolve_model(None, "OWN", "d", env), calls.resolve_model(None, None, "d", env), calls.resolve_model(None, "OWN", "d", {})] == ["x", "own", "common", "d"]
    with pytest.raises(calls.MissingKeyError):
        calls.HttpClient("m", key="")


def test_model_rerank_and_answer_are_validated(spark):
    def asked(reply):
        return reply if isinstance(reply, str) else json.dumps(reply)

    order = lambda *ids: {"ranked_candidates": [{"candidate_id": i, "reason": "r"} for i in ids]}
    replies = [order("2", "1"), order("1"), order("1", "1"), order("1", "9"), "refuse", "no json"]
    questions = spark.createDataFrame([(k, "say:" + asked(r)) for k, r in enumerate(replies)], "question_id long, question string")
    candidates = questions.crossJoin(spark.createDataFrame([(1, "1", "t1", None, "s1"), (2, "2", "t2", "sum", "s2")], "original_rank long, candidate_id string, title string, summary string, snippet string")).drop("question")
    got = {r.question_id: r for r in calls.rerank(candidates, questions, scripted()).collect()}
    assert got[0].error is None and got[0].ranked == ["2", "1"]
    assert [got[k].error.split(":")[0] for k in range(1, 6)] == ["Reranker must return the same number of candidate IDs it received", "Reranker returned duplicate candidate IDs", "Reranker returned invalid candidate IDs", "RuntimeError", "Model returned no parsed reply"]
    source = [{"id": 1, "title": "t", "url": "u", "snippet": "s"}]
    base = {"answer": "yes", "sources": source, "confidence": "high", "insufficient_evidence": False, "counter_points": []}
    replies = [base | {"supporting_points": [{"text": "p", "citations": [1]}]}, base | {"supporting_points": [{"text": "p", "citations": [2]}]}, base | {"confidence": "sure", "supporting_points": []}, base | {"supporting_points": [{"text": " ", "citations": [1]}]}]
    questions = spark.createDataFrame([(k, "say:" + asked(r)) for k, r in enumerate(replies)], "question_id long, question string")
    evidence = questions.select("question_id", F.lit(1).cast("long").alias("id"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("").alias("summary"), F.lit("e").alias("excerpt"))
    got = {r.question_id: r.error for r in calls.answer(evidence, questions, scripted()).collect()}
    assert got == {0: None, 1: "Point citations reference unknown source ids: [2]", 2: "invalid confidence", 3: "Point text must be non-empty"}
    text = prompts.answer_requests(evidence, questions).first()["request"]
    assert text.endswith("\n\nRetrieved Sources:\nSource [1]\nTitle: t\nURL: u\nSummary:\nNone\nExcerpt:\ne")


def test_decisions_of_a_model(spark):
    reply = json.dumps({"decision": "BUY", "confidence": "low", "time_horizon": "Both", "reasoning": "r", "key_risks": [" a  b ", " "], "insufficient_evidence": False, "sources": []})
    hits = spark.createDataFrame([(k, 10, 0.1, 1, f"say:{reply}", "u", "c" * 60, None) for k in (1, 2)], "question_id long, article_id long, distance double, rank long, title string, url string, content string, summary string").withColumn("published_at", F.lit(None).cast("timestamp"))
    events = spark.createDataFrame([("e1", 10, "Company", "Positive", "High", "Both", "MSFT", "why", "ev")], "event_id string, article_id long, event_type string, direction string, importance string, time_horizon string, affected_asset string, reasoning string, evidence_excerpt string").withColumn("structured_at", F.lit("x"))
    targets = spark.createDataFrame([(1, "MSFT"), (2, "msft")], "question_id long, target string")
    got = recommend.recommend(targets, hits, events, decide=lambda rows, evidence: calls.decide(rows, evidence, scripted())).collect()
    assert [(r.decision, r.key_risks, r.error, r.event_count) for r in got] == [("BUY", ["a b"], None, 1)] * 2


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        body = json.dumps({"status": "ok", "articles": [{"title": "T" * 40, "description": self.path}]}).encode()
        self.send_response(200 if "apiKey=k" in self.path else 500)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_live_sources(spark, monkeypatch):
    monkeypatch.delenv("NEWSAPI_API_KEY", raising=False)
    monkeypatch.delenv("ALPHA_VANTAGE_API_KEY", raising=False)
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    try:
        got = [r.raw_text for r in live.live_news(spark, pages=2, url=url, key="k").collect()]
        assert len(got) == 2 and all("country=us" in x and "pageSize=100" in x for x in got) and "page=2" in "".join(got)
        with pytest.raises(Exception, match="Request failed"):
            live.live_news(spark, url=url, key="wrong").collect()
        assert live.live_market(spark, url=url, key="wrong").first()["raw_text"] == collect.FALLBACK
    finally:
        server.shutdown()
    with pytest.raises(live.MissingKeyError):
        live.live_news(spark)
    assert live.live_market(spark).first()["raw_text"] == collect.FALLBACK


class Service(BaseHTTPRequestHandler):
    """Chat completions and embeddings; the log has path and key of each request."""

    log: list[tuple[str, str]] = []

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.log.append((self.path, self.headers["Authorization"], body["model"]))
        if self.path.endswith("/embeddings"):
            reply = {"data": [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in reversed(list(enumerate(body["input"])))]}
        else:
            rules, request = (m["content"] for m in body["messages"])
            event = {"event_type": "Company", "direction": "Positive", "importance": "High", "time_horizon": "Both", "affected_asset": " ", "reasoning": "r", "evidence_excerpt": "e"}
            content = json.dumps({"bullets": ["a", "- b", "c"]}) if rules.startswith("Give 3") else json.dumps({"events": [event, event]})
            message = {"refusal": "won't"} if "Beta" in request and "signals" in rules else {"content": content}
            reply = {"choices": [{"message": message}]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(reply).encode())

    def log_message(self, *args):
        pass


def test_steps_of_a_service(db, raw):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    steps = flows.Steps.of_service(lambda: calls.HttpClient("m", "k", url), lambda: calls.HttpEmbedder("v", "k", url))
    try:
        assert flows.ingest(db, raw, at(), make=steps)["summarized"] == 2
        assert {r.summary for r in db.articles.read().collect()} == {"- a\n- b\n- c"}
        assert {len(r.embedding) for r in db.index.read().collect()} == {2}
        assert flows.structure_stored(db, at(), make=steps) == {"processed": 1, "created": 2, "skipped": 0, "failures": 1}
        got = db.events.read().collect()
        assert len({r.event_id for r in got}) == 2 and {r.affected_asset for r in got} == {"General Market"}
        assert flows.structure_stored(db, at(), force=True, make=steps)["processed"] == 1
    finally:
        server.shutdown()
    assert {(path, model) for path, _, model in Service.log} == {("/chat/completions", "m"), ("/embeddings", "v")} and {key for _, key, _ in Service.log} == {"Bearer k"}


def test_what_is_invalid_is_not_sent(spark):
    questions = spark.createDataFrame([(1, " "), (2, "say:{}")], "question_id long, question string")
    candidates = spark.createDataFrame([(1, 1, "1", "t", None, "s"), (2, 1, "1", "t", None, " ")], "question_id long, original_rank long, candidate_id string, title string, summary string, snippet string")

    def broken():
        raise RuntimeError("asked")

    got = {r.question_id: r.error for r in calls.rerank(candidates, questions, broken).collect()}
    assert got == {1: "Question must be non-empty", 2: "empty snippet"}


def test_shell_shows_debug_parts_and_documents(spark, tmp_path):
    def step(*argv):
        return "\n".join(cli.run(spark, cli._parser().parse_args([*argv, "--store", str(tmp_path / "s"), "--reports", str(tmp_path / "r")])))

    step("ingest", TEXT.format("MSFT"))
    step("structure")
    assert "'processed': 0" in step("structure") and "'processed': 1" in step("structure", "--force")
    assert step("ask", "Which profit rose?", "--debug-rerank").endswith("Rerank Debug:\n1. Candidate 1: 2 word(s) in common")
    shown = step("recommend", "general market", "--debug-aggregation", "--debug-rerank")
    assert "Aggregation Debug:\n[1] MSFT reports growth." in shown and "Rerank Debug:\n1. Candidate 1" in shown
    report = next((tmp_path / "r").iterdir()).read_text(encoding="utf-8")
    assert "## Aggregated Events\n- [1] MSFT" in report and report.rstrip().endswith("in common")
    batch = json.loads(step("collect", TEXT.format("x"), "--document"))
    assert set(batch) == {"batch_id", "created_at", "events"} and [set(e) for e in batch["events"]] == [{"id", "source", "raw_text", "timestamp"}]
    assert json.loads(step("collect", "", "--document"))["events"] == []


class Everything(Service):
    """The whole shell on one service."""

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.log.append((self.path, self.headers["Authorization"], body["model"]))
        rules = "" if self.path.endswith("/embeddings") else body["messages"][0]["content"]
        event = {"event_type": "Company", "direction": "Positive", "importance": "High", "time_horizon": "Both", "affected_asset": "MSFT", "reasoning": "r", "evidence_excerpt": "e"}
        source = {"id": 1, "title": "t", "url": "u", "snippet": "s"}
        replies = {
            "Give 3": {"bullets": ["a", "b", "c"]}, "Order": {"ranked_candidates": [{"candidate_id": "1", "reason": "fits"}]}, "Answer": {"answer": "It rose.", "sources": [source], "confidence": "high", "insufficient_evidence": False, "supporting_points": [{"text": "p", "citations": [1]}], "counter_points": []},
            "Decide": {"decision": "BUY", "confidence": "low", "time_horizon": "Both", "reasoning": "so", "key_risks": [], "insufficient_evidence": False, "sources": [source]},
        }
        found = next((r for head, r in replies.items() if rules.startswith(head)), {"events": [event]})
        reply = {"choices": [{"message": {"content": json.dumps(found)}}]} if rules else {"data": [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in enumerate(body["input"])]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(reply).encode())


def test_shell_on_a_service(spark, tmp_path, monkeypatch):
    server = HTTPServer(("127.0.0.1", 0), Everything)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("OPENAI_MODEL", "common")
    monkeypatch.setenv("OPENAI_ANSWER_MODEL", "answering")
    monkeypatch.delenv("OPENAI_RERANK_MODEL", raising=False)
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    Everything.log = []

    def step(*argv):
        return "\n".join(cli.run(spark, cli._parser().parse_args([*argv, "--store", str(tmp_path / "s"), "--reports", str(tmp_path / "r"), "--service", f"http://127.0.0.1:{server.server_port}"])))

    try:
        with pytest.raises(calls.MissingKeyError):
            step("ingest", TEXT.format("MSFT"))
        monkeypatch.setenv("OPENAI_API_KEY", "k")
        assert "'summarized': 1" in step("ingest", TEXT.format("MSFT"))
        assert "'created': 1" in step("structure")
        assert "Answer:\nIt rose." in step("ask", "Which profit rose?") and "1. Candidate 1: fits" in step("ask", "Which profit rose?", "--debug-rerank")
        assert "Decision: BUY" in step("recommend", "MSFT")
    finally:
        server.shutdown()
    assert {(m, p) for p, _, m in Everything.log} == {("common", "/chat/completions"), ("answering", "/chat/completions"), ("text-embedding-3-small", "/embeddings")}
    # the second question was known; each of the others was asked once
    assert sum(p == "/chat/completions" for p, *_ in Everything.log) == 6


def test_shell_lists_shows_and_deletes(spark, tmp_path):
    def step(*argv):
        return "\n".join(cli.run(spark, cli._parser().parse_args([*argv, "--store", str(tmp_path / "s")])))

    assert step("list") == "No articles in database" and step("show", "1") == "No such article"
    for name in ("Alpha", "Beta " * 30):
        step("ingest", TEXT.format(name))
    step("structure")
    lines = step("list").split("\n")
    assert len(lines) == 2 and lines[0].startswith("2  manual  ") and lines[0].endswith("Beta Beta...") and step("list", "--limit", "1").startswith("2  ")
    shown = step("show", "1").split("\n")
    assert shown[0].startswith("Alpha reports growth.") and shown[-1] == "Company / Positive / Medium / Both / General Market"
    assert "'cells': 1" in step("index") and "Sources:\n[1]" in step("ask", "What does Alpha report?")
    assert step("delete", "1") == "{'events': 2, 'vectors': 1, 'articles': 1}" and step("show", "1") == "No such article"
