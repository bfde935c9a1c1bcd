"""python -m sparkwell STEP --store FOLDER: the flows from a shell. Models are the offline stand-ins, or those of a service with --service."""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import iso, truncate
from .operators import calls, models, retrieval
from .operators.ledger import Ledger
from .operators.store import newest_first
from .plans import ingest as flows
from .plans import recommend, reports
from .sources import collect, live

# Where the models are by default, and which they are.
SERVICE, MODEL, ANSWER_MODEL = "https://api.openai.com/v1", "gpt-5.4-mini", "gpt-5.4"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkwell", description=__doc__)
    p.add_argument("step", choices=["collect", "ingest", "summarize", "structure", "ask", "recommend", "list", "show", "delete", "index"])
    p.add_argument("text", nargs="?", help="an event's text, a question, a target or an article's id")
    p.add_argument("--store", default="sparkwell-store", help="folder of the tables, on a cluster one that all executors share")
    p.add_argument("--news", action="store_true", help="also take the newest headlines (NEWSAPI_API_KEY)")
    p.add_argument("--market", action="store_true", help="also take the newest market day")
    p.add_argument("--source")
    p.add_argument("--limit", type=int)
    p.add_argument("--force", action="store_true", help="take all articles, not only those without a summary or without events")
    p.add_argument("--top-k", type=int, default=3)
    p.add_argument("--retrieval-top-k", type=int, default=5)
    p.add_argument("--debug-rerank", action="store_true", help="show the reranked order with its reasons")
    p.add_argument("--debug-aggregation", action="store_true", help="show the events of a recommendation")
    p.add_argument("--document", action="store_true", help="collect: one JSON document, not a line per event")
    p.add_argument("--service", nargs="?", const=SERVICE, help="ask the models of this service (OPENAI_API_KEY), without an address those of the usual one")
    p.add_argument("--model", help="the model of all steps; else OPENAI_RERANK_MODEL, OPENAI_ANSWER_MODEL and OPENAI_MODEL name them")
    p.add_argument("--embedding-model", default="text-embedding-3-small")
    p.add_argument("--reports", default="reports", help="folder of the Markdown reports")
    return p


def _raw(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    parts = [collect.manual(spark, args.text)]
    parts += [live.live_news(spark)] if args.news else []
    parts += [live.live_market(spark)] if args.market else []
    # a collected source is small, and its rows have no number of their own
    return collect.union_in_order([x.withColumn("n", F.monotonically_increasing_id()) for x in parts], "n").withColumn("row_ord", F.col("source_ord") * 2**40 + F.col("row_ord")).drop("n", "source_ord")


@dataclass(frozen=True)
class Models:
    """What the steps ask: the service's models, or nothing for the stand-ins."""

    steps: flows.Make = models.OfflineProvider
    rerank: recommend.Rerank = recommend.lexical_order
    answer: Callable[[DataFrame, DataFrame], DataFrame] = recommend.answer
    decide: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def _sound(rows: DataFrame) -> DataFrame:
    """Raises the first error of a model's rows."""
    if (bad := rows.filter("error is not null").first()) is not None:
        raise ValueError(bad["error"])
    return rows.drop("error")


def _models(spark: SparkSession, args: argparse.Namespace) -> Models:
    if not args.service:
        return Models()
    # the key travels with the tasks, as executors have an environment of their own
    url, key, model = args.service, os.environ.get("OPENAI_API_KEY"), partial(calls.resolve_model, args.model)
    client = lambda name: partial(calls.HttpClient, name, key, url)
    kept = lambda name: Ledger(spark, f"{args.store.rstrip('/')}/asked", name)
    plain, rerank, answer = model(None, MODEL), model("OPENAI_RERANK_MODEL", MODEL), model("OPENAI_ANSWER_MODEL", ANSWER_MODEL)
    client(plain)()  # a missing key is told before anything is read
    return Models(
        flows.Steps.of_service(client(plain), partial(calls.HttpEmbedder, args.embedding_model, key, url), kept(plain)),
        lambda candidates, questions: _sound(calls.rerank(candidates, questions, client(rerank), kept(rerank))),
        lambda questions, evidence: recommend.answer(questions, evidence) if evidence.isEmpty() else _sound(calls.answer(evidence, questions, client(answer), kept(answer))),
        lambda rows, evidence: _sound(calls.decide(rows, evidence, client(answer), kept(answer))),
    )


def _listed(args: argparse.Namespace, db: flows.Store) -> list[str]:
    if args.step == "list":
        shown = newest_first(db.articles.read(), args.limit, args.source).select(F.concat_ws("  ", "article_id", "source", iso(F.col("published_at")), truncate(F.col("content"), 100)).alias("t"))
        return [r["t"] for r in shown.toLocalIterator()] or ["No articles in database"]
    own = db.articles.of_key(int(args.text))
    if args.step == "delete":
        return [str(flows.remove(db, own.select("article_id")))]
    found = [f"{r['title']}\n{r['url']}\n{r['summary'] or ''}".rstrip() for r in own.collect()]
    events = db.events.of_key(int(args.text)).orderBy("structured_at", "event_id")
    return [*found, *(" / ".join(r[c] for c in ("event_type", "direction", "importance", "time_horizon", "affected_asset")) for r in events.collect())] or ["No such article"]


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The lines that a step prints."""
    now, db = F.current_timestamp(), flows.Store.open(spark, args.store)
    if args.step == "collect":
        batch, created = str(uuid.uuid4()), datetime.now(UTC).replace(tzinfo=None)
        events = flows.validate(_raw(spark, args))[0].select(F.expr("uuid()").alias("id"), "source", "raw_text", iso(F.lit(created)).alias("timestamp"))
        if args.document:
            return list(reports.batch_document(events, batch, created.isoformat()))
        return [r["value"] for r in reports.batch_json(events, batch, created.isoformat()).toLocalIterator()]
    if args.step in ("list", "show", "delete"):
        return _listed(args, db)
    use = _models(spark, args)
    if args.step == "ingest":
        return [str(flows.ingest(db, _raw(spark, args), now, make=use.steps))]
    if args.step == "summarize":
        return [str(flows.summarise_stored(db, args.source, args.limit, args.force, use.steps))]
    if args.step == "structure":
        return [str(flows.structure_stored(db, now, args.source, args.limit, args.force, use.steps))]
    if db.articles.read().isEmpty():
        return ["No articles in database"]
    if args.step == "index":
        return [str(flows.build_cells(db))]
    asked = spark.createDataFrame([(1, args.text or "")], "question_id long, question string")
    hits = flows.search(db, asked, max(args.top_k, args.retrieval_top_k), use.steps)
    ranked, shown = "ranked_candidates" if args.debug_rerank else None, "target_events" if args.debug_aggregation else None
    if args.step == "ask":
        order = recommend.new_order(hits, asked, use.rerank, args.retrieval_top_k)
        found = use.answer(asked, retrieval.evidence(retrieval.reorder(hits, order), args.top_k))
        if ranked:
            found = found.join(order.select("question_id", ranked), "question_id", "left")
        return [found.select(reports.answer_text(ranked).alias("t")).first()["t"]]
    found = recommend.recommend(asked.withColumnRenamed("question", "target"), hits, db.events.read(), args.top_k, args.retrieval_top_k, use.rerank, use.decide).persist()
    paths = reports.write_reports(found, args.reports, now, shown, ranked)
    lines = [found.select(reports.recommendation_text(shown, ranked).alias("t")).first()["t"], "", f"Report: {paths.first()['path']}"]
    found.unpersist()
    return lines


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("sparkwell").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print("\n".join(run(spark, args)))
    except Exception as e:  # noqa: BLE001  a shell gets a line and a status
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
