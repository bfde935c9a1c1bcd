"""Replies that are asked for once, files that are all there or not at all, and a stream that goes on where it ended."""

from __future__ import annotations

import json
import threading
import urllib.parse
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sparkwell.operators import calls
from sparkwell.operators.ledger import Ledger
from sparkwell.operators.tables import PartitionedTable
from sparkwell.plans import ingest as flows
from sparkwell.plans import reports
from sparkwell.schema import ARTICLES
from sparkwell.sources import documents, live
from sparkwell.streaming.inbox import ingest_stream

TEXT = "{} reports growth. Its profit rose again this year. The outlook is stable for now."


class Service(BaseHTTPRequestHandler):
    """Answers and counts; the request that holds ``crash`` is answered, and then ends the task that asked, the first time."""

    asked: list[str] = []
    busy = most = 0
    lock = threading.Lock()

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with self.lock:
            Service.busy += 1
            Service.most = max(Service.most, Service.busy)
        threading.Event().wait(0.02)
        with self.lock:
            Service.busy -= 1
            request = body["messages"][1]["content"]
            crash = "crash" in request and not any("crash" in x for x in self.asked)
            self.asked.append(request)
        event = {"event_type": "Company", "direction": "Positive", "importance": "High", "time_horizon": "Both", "affected_asset": "A", "reasoning": "r", "evidence_excerpt": "e"}
        content = json.dumps({"events": [event]} if "signals" in body["messages"][0]["content"] else {"bullets": ["a", "b", "c"]})
        message = {"refusal": "no"} if "refuse" in request else {"content": content}
        self.send_response(200)
        self.send_header("Crash", str(int(crash)))
        self.end_headers()
        self.wfile.write(json.dumps({"choices": [{"message": message}]}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def url():
    Service.asked, Service.busy, Service.most = [], 0, 0
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def client_of(url):
    def make():
        class Fragile(calls.HttpClient):
            def complete(self, rules, request, form):
                import urllib.request

                asked = urllib.request.Request(f"{self.url}/chat/completions", json.dumps({"model": self.model, "messages": [{"content": rules}, {"content": request}]}).encode())
                with urllib.request.urlopen(asked, timeout=20) as reply:
                    if reply.headers["Crash"] == "1":
                        raise SystemExit("the task is lost")
                    message = json.load(reply)["choices"][0]["message"]
                if "refusal" in message:
                    raise RuntimeError("refused")
                return message["content"]

        return Fragile("m", "k", url)

    return make


def test_a_lost_task_asks_for_the_rest_only(spark, tmp_path, url):
    requests = spark.createDataFrame([(k, f"text {k}" if k != 30 else "crash") for k in range(60)] + [(100, "text 5")], "id long, request string").coalesce(2)
    ledger = Ledger(spark, str(tmp_path / "ledger"), "m", batch=4, in_flight=2)
    with pytest.raises(Exception, match="the task is lost|SystemExit|crashed"):
        calls.call(requests, calls.SUMMARY_RULES, calls.SUMMARY_REPLY, client_of(url), ledger=ledger)
    first = len(Service.asked)
    assert 0 < first < 60
    got = calls.call(requests, calls.SUMMARY_RULES, calls.SUMMARY_REPLY, client_of(url), ledger=ledger)
    rows = got.collect()
    assert len(rows) == 61 and all(r.error is None and r.reply.bullets == ["a", "b", "c"] for r in rows)
    # the one reply that was lost with its task is the only one that was asked for twice; equal requests count once
    assert len(Service.asked) == 60 + 1 and Service.most <= 2
    assert calls.call(requests, calls.SUMMARY_RULES, calls.SUMMARY_REPLY, client_of(url), ledger=ledger).count() == 61
    assert len(Service.asked) == 61 and not list((tmp_path / "ledger" / "open").iterdir())
    other = Ledger(spark, str(tmp_path / "ledger"), "another model")
    calls.call(requests.limit(3), calls.SUMMARY_RULES, calls.SUMMARY_REPLY, client_of(url), ledger=other)
    assert len(Service.asked) == 64


def test_failures_are_rows_and_are_asked_again(spark, tmp_path, url):
    requests = spark.createDataFrame([(1, "fine"), (2, "refuse this"), (3, "unsent")], "id long, request string")
    ledger = Ledger(spark, str(tmp_path / "ledger"), "m")
    for n in (2, 3):
        got = calls.call(requests, calls.SUMMARY_RULES, calls.SUMMARY_REPLY, client_of(url), F.when(F.col("id") == 3, "not asked"), ledger)
        assert {r.id: r.error for r in got.collect()} == {1: None, 2: "RuntimeError: refused", 3: "not asked"}
        assert len(Service.asked) == n
    assert calls.call(requests.limit(0), calls.SUMMARY_RULES, calls.SUMMARY_REPLY, client_of(url), ledger=ledger).count() == 0


def test_flows_ask_once_and_count_on_the_write(spark, tmp_path, url):
    db = flows.Store.open(spark, str(tmp_path / "db"))
    ledger = Ledger(spark, str(tmp_path / "ledger"), "m")

    class Width:
        def embed_all(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    steps = flows.Steps.of_service(client_of(url), Width, ledger)
    raw = spark.createDataFrame([(k, "news" if k % 2 else "rss", TEXT.format(f"A{k}" if k != 5 else "refuse")) for k in range(12)], "row_ord long, source string, raw_text string")
    at = F.lit(datetime(2024, 1, 1))
    assert flows.ingest(db, raw, at, make=steps, summarise=False) == {"total": 6, "saved": 6, "summarized": 0, "indexed": 6, "skipped": 0}
    assert flows.structure_stored(db, at, make=steps) == {"processed": 5, "created": 5, "skipped": 0, "failures": 1}
    assert len(Service.asked) == 6
    assert flows.structure_stored(db, at, make=steps) == {"processed": 0, "created": 0, "skipped": 5, "failures": 1}
    assert len(Service.asked) == 7
    assert flows.structure_stored(db, at, force=True, make=steps) == {"processed": 5, "created": 5, "skipped": 0, "failures": 1}
    assert len(Service.asked) == 8  # all but the refused one are known
    assert db.events.read().count() == 5


def test_files_of_a_failed_write_do_not_stay(spark, tmp_path):
    folder = tmp_path / "out"
    good = spark.createDataFrame([(f"n{k}.md", f"text {k} é\n") for k in range(20)], "name string, text string").repartition(4)
    bad = good.withColumn("text", F.when(F.col("name") == "n7.md", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        documents.write_documents(bad, str(folder))
    assert not folder.exists() or not list(folder.rglob("*.md")) and not list(folder.glob(".drafts*"))
    for _ in range(2):
        documents.write_documents(good, str(folder))
        assert sorted(p.name for p in folder.iterdir()) == sorted(f"n{k}.md" for k in range(20))
    assert (folder / "n7.md").read_text(encoding="utf-8") == "text 7 é\n"
    documents.write_documents(good.limit(0), str(tmp_path / "none"))


def test_a_document_per_batch(spark, tmp_path):
    rows = [(f"b{k % 3}", "2024-01-01T00:00:00", f"{k:04d}", "news", f'say "{k}"\n') for k in range(300)]
    events = spark.createDataFrame(rows, "batch_id string, created_at string, id string, source string, raw_text string").repartition(5)
    reports.write_batches(events, f"file://{tmp_path}/batches")
    files = sorted((tmp_path / "batches").iterdir())
    assert [p.name for p in files] == ["b0.json", "b1.json", "b2.json"]
    for k, p in enumerate(files):
        doc = json.loads(p.read_text())
        assert doc["batch_id"] == f"b{k}" and doc["created_at"] == "2024-01-01T00:00:00"
        assert [(e["id"], e["raw_text"]) for e in doc["events"]] == [(r[2], r[4]) for r in rows if r[0] == f"b{k}"]
        one = events.filter(F.col("batch_id") == f"b{k}").orderBy("id").drop("batch_id", "created_at")
        assert p.read_text().rstrip("\n") == "\n".join(reports.batch_document(one, f"b{k}", "2024-01-01T00:00:00"))


class Paper(BaseHTTPRequestHandler):
    """Headlines, newest first, by pages."""

    articles: list[dict] = []

    def do_GET(self):  # noqa: N802
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        some = sorted((a for a in self.articles if a["publishedAt"] >= q.get("from", "")), key=lambda a: a["publishedAt"], reverse=True)
        size, page = int(q["pageSize"]), int(q["page"])
        ok = q.get("apiKey") == "k"
        self.send_response(200 if ok else 500)
        self.end_headers()
        self.wfile.write(json.dumps({"status": "ok", "articles": some[(page - 1) * size : page * size]}).encode())

    def log_message(self, *args):
        pass


def test_a_stream_stores_every_headline_once(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Paper)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/news"
    store = PartitionedTable(spark, str(tmp_path / "articles"), ARTICLES, parts=4, blooms=("url",))
    add = lambda ks, day: Paper.articles.extend({"publishedAt": f"2024-01-0{day}T00:00:00Z", "url": f"http://x/{k:03d}", "title": f"Headline number {k}", "description": "which is long enough to be an event"} for k in ks)

    def run():
        ingest_stream(live.stream_news(spark, url, key="k", page_size=7), store, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(r.title.split("number ")[1].split(".")[0] for r in store.read().collect())

    try:
        add(range(20), 1)
        assert run() == sorted(map(str, range(20))) and run() == sorted(map(str, range(20)))
        add(range(20, 33), 1)  # the same time as those that were read, later urls
        add(range(33, 40), 2)
        assert run() == sorted(map(str, range(40)))
        assert sorted(r.article_id for r in store.read().collect()) == list(range(1, 41))
        reader = live.NewsStreamReader({"url": url, "pagesize": "7", "query.apikey": "k"})
        rows, end = reader.read(reader.initialOffset())
        add([50], 3)
        assert list(reader.readBetweenOffsets(reader.initialOffset(), end)) == list(rows) and end == {"at": "2024-01-02T00:00:00Z", "url": "http://x/039"}
    finally:
        server.shutdown()
    with pytest.raises(live.MissingKeyError):
        live.stream_news(spark, url, key="")
