"""Rules for what models return, as columns that hold the first reason for a refusal, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import citations, clean, clean_bullet, strip
from ..schema import CONFIDENCE, DECISIONS, DIRECTIONS, EVENT_TYPES, HORIZONS, IMPORTANCE, MAX_RISKS


def _blank(x: Column) -> Column:
    return strip(F.coalesce(x, F.lit(""))) == ""


def summary_error(bullets: Column) -> Column:
    n = F.coalesce(F.size(bullets), F.lit(0))
    return F.when((n < 3) | (n > 5), "3 to 5 bullets are needed").when(F.exists(bullets, lambda b: clean_bullet(b) == ""), "empty bullet")


def event_error() -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for column, values in (("event_type", EVENT_TYPES), ("direction", list(DIRECTIONS)), ("importance", list(IMPORTANCE)), ("time_horizon", HORIZONS)):
        out = out.when(~F.coalesce(F.col(column).isin(values), F.lit(False)), f"invalid {column}")
    return out


def point_error(point: Column) -> Column:
    return F.when(_blank(point["text"]), "Point text must be non-empty").when(F.coalesce(F.size(citations(point["citations"])), F.lit(0)) == 0, "Point citations must contain at least one positive source id")


def question_error(question: Column) -> Column:
    return F.when(clean(question) == "", "Question must be non-empty")


def aggregation_error() -> Column:
    """Of event_count, target_specific_event_count and target_events (their source_id and article_id)."""
    return F.when((F.col("event_count") < 0) | (F.col("target_specific_event_count") < 0), "negative count").when(
        F.exists("target_events", lambda e: (F.coalesce(e["source_id"], F.lit(0)) < 1) | (F.coalesce(e["article_id"], F.lit(0)) < 1)), "event with a source or article id below 1"
    )


def answer_error(points: Column) -> Column:
    """Of answer, confidence, sources and all ``points``."""
    return (
        F.when(_blank(F.col("answer")), "Answer must be non-empty")
        .when(~F.coalesce(F.col("confidence").isin(CONFIDENCE), F.lit(False)), "invalid confidence")
        .when(F.exists("sources", lambda s: F.coalesce(s["id"], F.lit(0)) < 1), "source id below 1")
        .otherwise(F.get(F.array_compact(F.transform(points, point_error)), F.lit(0)))
    )


def unknown_citations(points: Column, sources: Column) -> Column:
    """Ids that points cite and sources lack, rising."""
    cited = F.array_distinct(F.flatten(F.transform(points, lambda p: citations(p["citations"]))))
    return F.array_sort(F.array_except(cited, F.transform(sources, lambda s: s["id"])))


def citation_error(points: Column, sources: Column) -> Column:
    missing = unknown_citations(points, sources)
    return F.when(F.size(missing) > 0, F.concat(F.lit("Point citations reference unknown source ids: ["), F.array_join(F.transform(missing, lambda c: c.cast("string")), ", "), F.lit("]")))


def recommendation_error() -> Column:
    return (
        F.when(~F.coalesce(F.col("decision").isin(DECISIONS), F.lit(False)), "invalid decision")
        .when(_blank(F.col("reasoning")), "Reasoning must be non-empty")
        .when(F.size("key_risks") > MAX_RISKS, f"at most {MAX_RISKS} key risks")
    )


def clean_risks(risks: Column) -> Column:
    return F.filter(F.transform(risks, clean), lambda r: r != "")
