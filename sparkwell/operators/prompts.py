"""What models are asked, as texts in column expressions. The labels of the parts are fixed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, display_target, iso


def _field(label: str, value: Column, absent: str = "None") -> Column:
    return F.concat(F.lit(label), F.coalesce(value.cast("string"), F.lit(absent)))


def _joined(rows: Column, block: Callable[[Column], Column], between: str = "\n\n") -> Column:
    return F.array_join(F.transform(rows, block), between)


def _gathered(rows: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    """The rows of a question as an array in the order of the first column; a question has a bounded number of hits."""
    return rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def article_request() -> Column:
    """Of article_id, url, title, description and content, for summaries and for structured events."""
    return F.concat_ws("\n", *(_field(label, F.col(c)) for label, c in (("Article ID: ", "article_id"), ("URL: ", "url"), ("Title: ", "title"), ("Description: ", "description"), ("Content:\n", "content"))))


def rerank_requests(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, question, candidates (array by original rank) and request."""
    own = _gathered(candidates, "candidates", "original_rank", "candidate_id", "title", "summary", "snippet")

    def block(c: Column) -> Column:
        return F.concat_ws("\n", _field("Candidate ID: ", c["candidate_id"]), _field("Original Rank: ", c["original_rank"]), _field("Title: ", c["title"]), _field("Summary:\n", blank_to_null(c["summary"])), _field("Snippet:\n", c["snippet"]))

    request = F.concat(F.lit("User Question:\n"), F.col("question"), F.lit("\n\nCandidates:\n"), _joined(F.col("candidates"), block))
    return own.join(questions.select("question_id", "question"), "question_id").withColumn("request", request)


def _source_lines(s: Column, *more: Column) -> Column:
    return F.concat_ws("\n", *more, _field("Summary:\n", blank_to_null(s["summary"])), _field("Excerpt:\n", s["excerpt"]))


def answer_requests(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, question, evidence (array by id) and request."""
    own = _gathered(evidence, "evidence", "id", "title", "url", "summary", "excerpt")

    def block(s: Column) -> Column:
        return _source_lines(s, F.concat(F.lit("Source ["), s["id"].cast("string"), F.lit("]")), _field("Title: ", s["title"]), _field("URL: ", s["url"]))

    request = F.concat(F.lit("User Question:\n"), F.col("question"), F.lit("\n\nRetrieved Sources:\n"), _joined(F.col("evidence"), block))
    return own.join(questions.select("question_id", "question"), "question_id").withColumn("request", request)


def recommendation_requests(aggregated: DataFrame, evidence: DataFrame) -> DataFrame:
    """``aggregated`` (by question_id, with target_events) with evidence (array by id) and request."""
    published = iso(F.col("published_at").cast("timestamp")).alias("published")
    own = _gathered(evidence, "evidence", "id", "article_id", "title", "url", published, "summary", "excerpt")

    def source(s: Column) -> Column:
        return _source_lines(s, F.concat(F.lit("Source ["), s["id"].cast("string"), F.lit("]")), _field("Article ID: ", s["article_id"]), _field("Title: ", s["title"]), _field("URL: ", s["url"]), _field("Published At: ", s["published"], "Unknown"))

    def event(e: Column) -> Column:
        head = F.concat_ws(" / ", e["event_type"], e["direction"], e["importance"], e["time_horizon"], _field("Asset: ", e["affected_asset"]), _field("Score: ", e["score"]))
        return F.concat(F.lit("- Source ["), e["source_id"].cast("string"), F.lit("] "), head, _field("\n  Reasoning: ", e["reasoning"]), _field("\n  Evidence: ", e["evidence_excerpt"]))

    listed = F.concat(F.lit("['"), F.array_join("conflicts", "', '"), F.lit("']"))
    signal = F.concat_ws(
        "\n", _field("- Summary: ", F.col("summary")), _field("- Dominant driver: ", F.col("dominant_driver")), *(_field(f"- {k} score: ", F.col(f"{k.lower()}_score")) for k in ("Net", "Macro", "Company", "Sector", "Market")),
        _field("- Target-specific events: ", F.col("target_specific_event_count")), _field("- Conflicts: ", F.when(F.size("conflicts") > 0, listed), "['None']"),
    )
    request = F.concat(
        F.lit("Target:\n"), display_target(F.col("target")), F.lit("\n\nAggregated Signal:\n"), signal, F.lit("\n\nTarget Events:\n"), F.coalesce(blank_to_null(_joined(F.col("target_events"), event, "\n")), F.lit("None")),
        F.lit("\n\nRetrieved Sources:\n"), _joined(F.col("evidence"), source),
    )
    return aggregated.join(own, "question_id").withColumn("request", request)
