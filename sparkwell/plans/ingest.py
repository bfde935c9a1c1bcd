"""Flows over stored tables: ingestion, later summaries and structured events, and search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import render_bullets
from ..operators import calls, models, retrieval, store, validation
from ..operators.cells import CellIndex
from ..operators.events import reject_reason, to_articles, unknown_rows, validate
from ..operators.ledger import Ledger
from ..operators.tables import PartitionedTable, SnapshotTable
from ..schema import ARTICLES, RETRIEVAL_TOP_K, STRUCTURED_EVENTS

INDEX = T.StructType([T.StructField("article_id", T.LongType(), False), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("has_summary", T.BooleanType())])
REPLIES = T.StructType([*(T.StructField(f.name, f.dataType) for f in STRUCTURED_EVENTS if f.name != "structured_at"), T.StructField("error", T.StringType())])
BACKLOG = T.StructType([T.StructField("article_id", T.LongType(), False), T.StructField("done", T.BooleanType())])
SUMMARIES = T.StructType([T.StructField("article_id", T.LongType(), False), T.StructField("summary", T.StringType()), T.StructField("error", T.StringType())])


class SummaryError(RuntimeError):
    """A model gave no valid summary; articles before this one have theirs."""


@dataclass(frozen=True)
class Steps:
    """The model steps of the flows, which take a maker of providers as well."""

    summarise: Callable[[DataFrame], DataFrame]
    structured: Callable[[DataFrame], DataFrame]
    embed: Callable[[Column], Column]

    @staticmethod
    def of(make: models.Make | Steps) -> Steps:
        if isinstance(make, Steps):
            return make
        return Steps(partial(models.summarise, make=make), partial(models.structured, make=make), partial(models.embed, make=make))

    @staticmethod
    def of_service(client: calls.Make, embedder: models.Make, ledger: Ledger | None = None) -> Steps:
        """Summaries and events from a service that answers in a form; ``embedder`` makes what has ``embed_all``, ``ledger`` keeps the replies."""
        return Steps(partial(calls.summarise, make=client, ledger=ledger), partial(calls.structured, make=client, ledger=ledger), partial(models.embed, make=embedder))


Make = models.Make | Steps


@dataclass(frozen=True)
class Store:
    """``summaries``, ``replies``, ``vectors`` and ``backlog`` have what the last step made, written once before it is used."""

    articles: PartitionedTable
    events: PartitionedTable
    index: PartitionedTable
    cells: CellIndex
    summaries: SnapshotTable
    replies: SnapshotTable
    vectors: SnapshotTable
    backlog: SnapshotTable

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Store:
        at = lambda name: f"{folder.rstrip('/')}/{name}"
        articles = PartitionedTable(spark, at("articles"), ARTICLES, blooms=("url",))
        kept = {"summaries": SUMMARIES, "replies": REPLIES, "vectors": INDEX, "backlog": BACKLOG}
        return Store(
            articles, PartitionedTable(spark, at("events"), STRUCTURED_EVENTS, blooms=("event_id",), parents={"articles": articles}), PartitionedTable(spark, at("index"), INDEX), CellIndex(spark, at("cells")),
            **{name: SnapshotTable(spark, at(name), schema) for name, schema in kept.items()},
        )


def reindex(db: Store, articles: DataFrame, make: Make = models.OfflineProvider) -> int:
    """Vectors of ``articles`` take the place of those they had; how many."""
    made = articles.select("article_id", Steps.of(make).embed(retrieval.embedding_text()).alias("embedding"), F.col("summary").isNotNull().alias("has_summary"))
    n = db.vectors.write(made)["n"]
    new = db.vectors.read()
    if n:
        db.index.change(new, lambda old: retrieval.upsert_index(old, new))
        if db.cells.built():
            db.cells.upsert(new)
    return n


def _summarise(db: Store, articles: DataFrame, make: Make) -> int:
    """Stores and indexes summaries of ``articles`` up to the first failure in the order of publishing, which is raised."""
    bullets = F.col("bullets")
    found = Steps.of(make).summarise(articles).select("article_id", F.coalesce("error", validation.summary_error(bullets)).alias("error"), render_bullets(bullets).alias("summary"))
    seen = db.summaries.write(found, {"failed": F.count_if(F.col("error").isNotNull())})
    found, first = db.summaries.read(), None
    good = found.filter("error is null").select("article_id", "summary")
    if seen["failed"]:
        order = F.struct("published_at", "article_id")
        when = db.articles.of_keys(found).select("article_id", "published_at")
        first = found.filter("error is not null").join(when, "article_id").agg(F.min_by(F.struct("article_id", "error", "published_at"), order).alias("f")).first()["f"]
        before = when.filter(order < F.struct(F.lit(first["published_at"]).alias("published_at"), F.lit(first["article_id"]).alias("article_id"))).select("article_id")
        good = good.join(before, "article_id", "left_semi")
        # the dates come from the table that is about to change
        kept = SnapshotTable(db.articles.spark, f"{db.summaries.path}_before_failure", T.StructType([*SUMMARIES.fields[:2]]))
        kept.write(good)
        good = kept.read()
    seen = db.articles.change(good, lambda old: store.update_summaries(old, good).withColumnRenamed("updated", "_seen"), {"updated": F.count_if(F.col("_seen"))}, ["summary"])
    n = seen["updated"] or 0
    if n:
        reindex(db, db.articles.of_keys(good), make)
    if first is not None:
        raise SummaryError(f"Article {first['article_id']}: {first['error']}")
    return n


def ingest(db: Store, raw: DataFrame, at: Column, order: str = "row_ord", event_id: Column | None = None, make: Make = models.OfflineProvider, summarise: bool = True) -> dict[str, int]:
    """Valid events of ``raw`` (source, raw_text and an integer ``order``) become articles; total, saved, summarized, indexed, skipped.

    Known and repeated urls are skipped before any model is asked. The url is made of ``event_id``, without which it is a hash of
    source, text and order. If a summary fails, the articles are stored and SummaryError is raised. All figures are observed on the
    writes themselves.
    """
    # sources may be live: they are read once, and all that follows reads what was written
    inbox = SnapshotTable(db.articles.spark, f"{db.articles.path}_raw", T.StructType([T.StructField(f.name, f.dataType) for f in raw.schema]))
    total = inbox.write(raw, {"total": F.count_if(reject_reason(F.col("source"), F.col("raw_text")).isNull())})["total"] or 0
    valid, _ = validate(inbox.read())
    own_id = F.sha2(F.concat_ws("|", "source", "raw_text", F.col(order).cast("string")), 256) if event_id is None else event_id
    rows = to_articles(valid, own_id, at).withColumn("fetched_at", at)
    new, seen = db.articles.insert(unknown_rows(db.articles.read(), rows, order), order)
    saved = seen["n"]
    summarized = _summarise(db, new, make) if summarise and saved else 0
    if saved and not summarise:
        reindex(db, new, make)
    return {"total": total, "saved": saved, "summarized": summarized, "indexed": saved, "skipped": total - saved}


def _upto(n: int, limit: int | None) -> int:
    return n if limit is None or limit < 0 else min(n, limit)


def summarise_stored(db: Store, source: str | None = None, limit: int | None = None, force: bool = False, make: Make = models.OfflineProvider) -> dict[str, int]:
    """Summaries for stored articles that have none (the filter comes before the limit), or for all with ``force``."""
    articles = db.articles.read()
    own = articles.filter(F.col("source") == source) if source else articles
    counted = own.agg(F.count(F.lit(1)).alias("all"), F.count_if(store.no_summary()).alias("missing")).first()
    candidates, n = _upto(counted["all"], limit), _upto(counted["all" if force else "missing"], limit)
    chosen = store.newest_first(articles if force else store.missing_summary(articles), limit, source)
    done = _summarise(db, chosen, make) if n else 0
    return {"processed": done, "indexed": done, "skipped": candidates - n, "total_candidates": candidates}


def structure_stored(db: Store, at: Column, source: str | None = None, limit: int | None = None, force: bool = False, make: Make = models.OfflineProvider) -> dict[str, int]:
    """Structured events for those of the newest articles that have none, or for all of these with ``force``; a failure is counted and the rest goes on.

    What the model returns is written before it is used, so it is asked once whatever follows.
    """
    every, events = store.newest_first(db.articles.read(), limit, source).select("article_id"), db.events.read()
    marked = every.join(events.select("article_id").distinct().withColumn("done", F.lit(True)), "article_id", "left").withColumn("done", F.coalesce("done", F.lit(False)) & F.lit(not force))
    seen = db.backlog.write(marked, {"todo": F.count_if(~F.col("done"))})
    n = seen["todo"] or 0
    if not n:
        return {"processed": 0, "created": 0, "skipped": seen["n"], "failures": 0}
    found = Steps.of(make).structured(db.articles.of_keys(db.backlog.read().filter("not done"))).withColumn("structured_at", at)
    replied = db.replies.write(found.withColumn("error", F.coalesce("error", validation.event_error())), {"errors": F.count_if(F.col("error").isNotNull())})
    good, created, failures = db.replies.read(), replied["n"], 0
    if replied["errors"]:
        failed = good.filter("error is not null").select("article_id").distinct()
        good = good.join(failed, "article_id", "left_anti")
        created, failures = good.count(), failed.count()
    if created:
        new = good.withColumn("structured_at", at).select(*db.events.schema.names)
        if force:
            db.events.change(new, lambda old: store.replace_events(old, new))
        else:
            db.events.append(new)
    return {"processed": n - failures, "created": created, "skipped": seen["n"] - n, "failures": failures}


def remove(db: Store, ids: DataFrame) -> dict[str, int]:
    """Articles go with their events and vectors; how many of each. Their ids don't come back."""
    gone = {"events": db.events.delete(ids), "vectors": db.index.delete(ids)}
    if db.cells.built():
        db.cells.delete(ids)
    return gone | {"articles": db.articles.delete(ids)}


def build_cells(db: Store, **options: object) -> dict[str, object]:
    """Sorts the vectors into cells, which :func:`search` then uses; what was measured on the way."""
    return db.cells.build(db.index.read(), **options)


def search(db: Store, questions: DataFrame, k: int = RETRIEVAL_TOP_K, make: Make = models.OfflineProvider, exact: bool = False) -> DataFrame:
    """Hydrated hits of ``questions`` (question_id, question) with their rank; from the cells, if they are built, else by comparing all."""
    queries = questions.select("question_id", Steps.of(make).embed(F.col("question")).alias("embedding"))
    hits = db.cells.search(queries, k) if db.cells.built() and not exact else retrieval.nearest(db.index.read(), queries, k)
    return retrieval.hydrate(hits, db.articles.read())
