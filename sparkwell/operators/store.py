"""Article and event tables: reads, backlogs and changes. Changes give a new state of a table; ``tables`` keeps states on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_first(articles: DataFrame, limit: int | None = None, source: str | None = None) -> DataFrame:
    """By published_at, then id; an empty source is no filter, a negative limit is none."""
    own = articles.filter(F.col("source") == source) if source else articles
    own = own.orderBy(F.desc("published_at"), F.asc("article_id"))
    return own if limit is None or limit < 0 else own.limit(limit)


def no_summary() -> Column:
    """No summary, or one of spaces alone."""
    return F.col("summary").isNull() | (F.trim("summary") == "")


def missing_summary(articles: DataFrame) -> DataFrame:
    return articles.filter(no_summary())


def unstructured(articles: DataFrame, events: DataFrame) -> DataFrame:
    """Articles without a structured event."""
    return articles.join(events.select("article_id"), "article_id", "left_anti")


def structuring_backlog(articles: DataFrame, events: DataFrame, limit: int | None = None, source: str | None = None) -> DataFrame:
    """Those of the newest ``limit`` articles that have no event; the limit comes first."""
    return unstructured(newest_first(articles, limit, source), events)


def update_summaries(articles: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates``: article_id and summary, one row per article. The column ``updated`` tells which rows were met."""
    new = updates.select("article_id", F.struct("summary").alias("_new"))
    return articles.join(new, "article_id", "left").withColumn("updated", F.col("_new").isNotNull()).withColumn("summary", F.when(F.col("updated"), F.col("_new.summary")).otherwise(F.col("summary"))).drop("_new")


def delete_articles(articles: DataFrame, events: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given articles and their events."""
    return articles.join(ids.select("article_id"), "article_id", "left_anti"), events.join(ids.select("article_id"), "article_id", "left_anti")


def replace_events(events: DataFrame, new: DataFrame) -> DataFrame:
    """The events of all articles in ``new`` are replaced by those in ``new``."""
    return events.join(new.select("article_id").distinct(), "article_id", "left_anti").unionByName(new)
