"""Texts of answers, recommendations and reports as column expressions, and their sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import display_target, iso, render_citations, report_filename, rstrip, yes_no
from ..sources.documents import write_documents

# What stands where a list is empty. The heads and labels below are fixed, too.
NO_RISKS = "- No specific additional risks were surfaced beyond the evidence limits."
NO_SOURCES = "- No sources were cited."


def _lines(*parts: Column | str) -> Column:
    """Lines joined; null ones are left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _field(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value.cast("string"))


def _each(items: Column, line) -> Column:  # noqa: ANN001
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, line), "\n"))


def _headed(head: str, items: Column, line) -> Column:  # noqa: ANN001
    """An empty line, a head and a line per item; null without items."""
    return F.when(F.size(items) > 0, _lines("", head, _each(items, line)))


def _source_block(s: Column) -> Column:
    return F.concat(F.lit("["), s["id"].cast("string"), F.lit("] "), s["title"], F.lit("\nURL: "), s["url"], F.lit("\nSnippet: "), s["snippet"])


def _sources(head: str) -> Column:
    return F.when(F.size("sources") > 0, _lines("", head, F.array_join(F.transform(F.col("sources"), _source_block), "\n\n")))


def _rerank(head: str, ranked: str | None) -> Column:
    if ranked is None:
        return F.lit(None).cast("string")
    return _headed(head, F.col(ranked), lambda r, i: F.concat((i + 1).cast("string"), F.lit(". Candidate "), r["candidate_id"], F.lit(": "), r["reason"]))


def answer_text(ranked: str | None = None) -> Column:
    """Of answer, confidence, insufficient_evidence, supporting_points, counter_points and sources; ``ranked`` adds the rerank's debug part."""
    point = lambda p: rstrip(F.concat(F.lit("- "), p["text"], F.lit(" "), render_citations(p["citations"])))
    return _lines(
        "Answer:", F.col("answer"), "", _field("Confidence: ", F.col("confidence")), _field("Insufficient evidence: ", yes_no(F.col("insufficient_evidence"))),
        _headed("Supporting Points:", F.col("supporting_points"), point), _headed("Counter Points:", F.col("counter_points"), point), _sources("Sources:"), _rerank("Rerank Debug:", ranked),
    )


def _event_line(e: Column) -> Column:
    return F.concat(F.lit("["), e["source_id"].cast("string"), F.lit("] "), e["article_title"], F.lit(": "), F.concat_ws(" / ", e["event_type"], e["direction"], e["importance"], e["time_horizon"]), F.lit(" (score "), e["score"].cast("string"), F.lit(")"))


def recommendation_text(events: str | None = None, ranked: str | None = None) -> Column:
    """The console form. The aggregation's columns are null where there is none."""
    known = F.col("summary").isNotNull()
    return _lines(
        "Recommendation:", _field("Decision: ", F.col("decision")), _field("Confidence: ", F.col("confidence")), _field("Time horizon: ", F.col("time_horizon")), _field("Insufficient evidence: ", yes_no(F.col("insufficient_evidence"))),
        "", "Reasoning:", F.col("reasoning"), _headed("Key Risks:", F.col("key_risks"), lambda r: F.concat(F.lit("- "), r)),
        F.when(known, _lines("", "Aggregation:", _field("- Summary: ", F.col("summary")), _field("- Dominant driver: ", F.col("dominant_driver")), _field("- Net score: ", F.col("net_score")), F.when(F.size("conflicts") > 0, _lines("- Conflicts:", _each(F.col("conflicts"), lambda c: F.concat(F.lit("  - "), c)))))),
        _sources("Sources:"), _headed("Aggregation Debug:", F.col(events), _event_line) if events else F.lit(None).cast("string"), _rerank("Rerank Debug:", ranked),
    )


def report_markdown(generated_at: Column, events: str | None = None, ranked: str | None = None) -> Column:
    """The Markdown report of a recommendation."""
    known = F.col("summary").isNotNull()
    scores = [_field(f"- {k} score: ", F.col(f"{k.lower()}_score")) for k in ("Net", "Macro", "Company", "Sector", "Market")]
    source = lambda s: F.concat(F.lit("- ["), s["id"].cast("string"), F.lit("] "), s["title"], F.lit(" ("), s["url"], F.lit(")\n  - Snippet: "), s["snippet"])
    event = lambda e: F.concat(F.lit("- "), _event_line(e), F.lit("\n  - Asset: "), e["affected_asset"], F.lit("\n  - Evidence: "), e["evidence_excerpt"])
    body = _lines(
        F.concat(F.lit("# Recommendation Report: "), display_target(F.col("target"))), "", F.concat(F.lit("- Generated at: "), iso(generated_at)), F.concat(F.lit("- Target: "), display_target(F.col("target"))),
        _field("- Decision: ", F.col("decision")), _field("- Confidence: ", F.col("confidence")), _field("- Time horizon: ", F.col("time_horizon")), _field("- Insufficient evidence: ", yes_no(F.col("insufficient_evidence"))),
        "", "## Reasoning", F.col("reasoning"),
        F.when(known, _lines("", "## Aggregation Summary", F.col("summary"), "", _field("- Dominant driver: ", F.col("dominant_driver")), *scores)),
        _headed("## Conflicts", F.col("conflicts"), lambda c: F.concat(F.lit("- "), c)),
        "", "## Key Risks", F.coalesce(_each(F.col("key_risks"), lambda r: F.concat(F.lit("- "), r)), F.lit(NO_RISKS)),
        "", "## Sources", F.coalesce(_each(F.col("sources"), source), F.lit(NO_SOURCES)),
        _headed("## Aggregated Events", F.col(events), event) if events else F.lit(None).cast("string"), _rerank("## Rerank Debug", ranked),
    )
    return F.concat(F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit("\n"))


def write_reports(recommendations: DataFrame, folder: str, generated_at: Column, events: str | None = None, ranked: str | None = None) -> DataFrame:
    """A Markdown file per recommendation, written by the tasks and put in place when all are done; target and path of each.

    Targets are normalised into names, so those with one name and time have one file, that of the last text in their order.
    """
    name = report_filename(F.col("target"), generated_at)
    texts = recommendations.select(name.alias("name"), report_markdown(generated_at, events, ranked).alias("text"))
    write_documents(texts.groupBy("name").agg(F.max("text").alias("text")), folder)
    return recommendations.select("target", F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("path"))


def batch_json(events: DataFrame, batch_id: str, created_at: str) -> DataFrame:
    """Events as JSON lines that carry their batch; written with ``df.write.text``, which keeps the work on the executors."""
    return events.select(F.to_json(F.struct(F.lit(batch_id).alias("batch_id"), F.lit(created_at).alias("created_at"), *[F.col(c) for c in events.columns])).alias("value"))


def batch_rows(events: DataFrame) -> DataFrame:
    """The rows of a JSON document per batch_id (name, place and text): batch_id, created_at and the array ``events`` in the order of their ids.

    ``events`` have batch_id, created_at (one per batch) and id; the other columns go into the array as well.
    """
    columns = [c for c in events.columns if c not in ("batch_id", "created_at")]
    nth = F.row_number().over(Window.partitionBy("batch_id").orderBy("id"))
    name = F.concat(F.col("batch_id"), F.lit(".json"))
    rows = events.select(name.alias("name"), nth.cast("long").alias("place"), F.concat(F.when(nth > 1, ",").otherwise(""), F.lit("\n    "), F.to_json(F.struct(*columns))).alias("text"))
    batches = events.groupBy("batch_id").agg(F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("_n"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    head = batches.select(name.alias("name"), F.lit(0).cast("long").alias("place"), F.concat(F.lit('{\n  "batch_id": '), quoted("batch_id"), F.lit(',\n  "created_at": '), quoted("created_at"), F.lit(',\n  "events": [')).alias("text"))
    tail = batches.select(name.alias("name"), (F.col("_n") + 1).alias("place"), F.lit("\n  ]\n}\n").alias("text"))
    return rows.unionByName(head).unionByName(tail)


def write_batches(events: DataFrame, folder: str) -> None:
    """A JSON document per batch, see :func:`batch_rows`."""
    write_documents(batch_rows(events), folder)


def batch_document(events: DataFrame, batch_id: str, created_at: str) -> Iterator[str]:
    """The lines of one JSON document with batch_id, created_at and the array ``events``; rows come to the driver one partition at a time."""
    yield f'{{\n  "batch_id": {json.dumps(batch_id)},\n  "created_at": {json.dumps(created_at)},\n  "events": ['
    before = None
    for row in events.select(F.to_json(F.struct(*events.columns)).alias("value")).toLocalIterator():
        if before is not None:
            yield f"    {before},"
        before = row["value"]
    if before is not None:
        yield f"    {before}"
    yield "  ]\n}"
