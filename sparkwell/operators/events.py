"""Validation of raw events and their way into the article table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_line
from ..schema import DESCRIPTION_CHARS, MIN_TEXT, REQUIRED, SOURCES, TITLE_CHARS

#: Rows of an order's range that are numbered together.
NUMBER_RANGE = 100_000


def reject_reason(source: Column, text: Column) -> Column:
    """Why an event is invalid, or null; the source is looked at first."""
    return F.when(~F.coalesce(source.isin(SOURCES), F.lit(False)), "invalid_source").when(F.coalesce(F.length(text), F.lit(0)) < MIN_TEXT, "invalid_text")


def validate(raw: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid events, and rejected ones with a ``reason``; ``strict`` reads all and raises, if any is invalid, the least reason there is (an invalid source before a text)."""
    marked = raw.withColumn("reason", reject_reason(F.col("source"), F.col("raw_text")))
    if strict and (reason := marked.agg(F.min("reason")).first()[0]):
        raise ValueError(f"Invalid event: {reason}")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def to_articles(events: DataFrame, event_id: Column | None, at: Column, url: Column | None = None) -> DataFrame:
    """Events as articles; the url is made of source and id, without an id of source and time. A ``url`` that isn't empty stays."""
    raw = F.col("raw_text")
    own = F.concat(F.lit("internal://"), F.col("source"), F.lit("/"), F.format_string("%.6f", F.unix_micros(at) / 1e6) if event_id is None else event_id)
    return events.select(
        "*", F.substring(raw, 1, TITLE_CHARS).alias("title"), F.substring(raw, 1, DESCRIPTION_CHARS).alias("description"), raw.alias("content"),
        (own if url is None else F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(own)).alias("url"), at.alias("published_at"), F.lit(None).cast("string").alias("summary"), first_line(raw).alias("first_line"),
    )


def numbered(rows: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """``name``: 1, 2, ... after ``start`` in the order of an integer column without ties.

    Ranges of the column are numbered apart, and a small table of counts by range gives each its start, so no task sees all rows.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order) / NUMBER_RANGE))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.join(starts, "_range").withColumn(name, (nth + F.col("_before") + start).cast("long")).drop("_range", "_before")


def unknown_rows(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The rows of ``new`` that are to be stored: no null where a value is needed, an unknown url, the first of equal urls in ``order``."""
    whole = [c for c in REQUIRED if c in new.columns]
    first = new.filter(" and ".join(f"{c} is not null" for c in whole)).withColumn("_nth", F.row_number().over(Window.partitionBy("url").orderBy(order))).filter("_nth = 1").drop("_nth")
    return first.join(existing.select("url"), "url", "left_anti")


def insert_or_skip(existing: DataFrame, new: DataFrame, order: str, greatest: int | None = None) -> DataFrame:
    """:func:`unknown_rows` with an article_id each; skipped rows take none.

    Ids go on from ``greatest``, the last that was ever given, without it from the greatest there is.
    """
    if greatest is None:
        greatest = existing.agg(F.max("article_id")).first()[0] or 0
    return numbered(unknown_rows(existing, new, order), order, "article_id", greatest)


def ingest_stats(events: DataFrame, saved: DataFrame, summarise: bool = True) -> DataFrame:
    """total, saved, summarized, indexed and skipped as one row."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both = one(events, "total").unionByName(one(saved, "saved"), allowMissingColumns=True).agg(F.sum("total").alias("total"), F.sum("saved").alias("saved"))
    done = F.col("saved") if summarise else F.lit(0).cast("long")
    return both.select("total", "saved", done.alias("summarized"), F.col("saved").alias("indexed"), (F.col("total") - F.col("saved")).alias("skipped"))
