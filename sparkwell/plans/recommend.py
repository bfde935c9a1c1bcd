"""From search hits to answers and recommendations: the order of steps, and what happens where evidence is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_target
from ..operators import retrieval, signals
from ..schema import GENERAL_SLUG

# What is said where evidence is missing.
NO_EVIDENCE = "I do not have enough retrieved evidence to make a news-grounded Buffett-style recommendation for this target yet."
NO_SIGNALS = "I found news articles, but they do not provide enough target-specific structured evidence to support a disciplined recommendation."
MARKET_ONLY = "The retrieved evidence is mostly general-market context rather than target-specific signals, so the disciplined default is HOLD."
NO_ANSWER = "I do not have enough retrieved evidence to answer that question yet."
RISKS = ["Retrieved evidence is not specific enough to separate temporary noise from durable impairment.", "Long-term valuation and business-quality evidence are missing from this news-only pass."]


def route(has_hits: Column, aggregated: Column, specific: Column, target: Column) -> Column:
    """no_evidence, no_signals, market_only or decide."""
    return (
        F.when(~has_hits, "no_evidence")
        .when(~aggregated, "no_signals")
        .when((specific == 0) & (normalize_target(target) != GENERAL_SLUG), "market_only")
        .otherwise("decide")
    )


def insufficient(routed: DataFrame) -> DataFrame:
    """HOLD with low confidence for all routes but ``decide``; a reason for each, and sources only where there are signals."""
    reason = F.create_map(*[F.lit(x) for x in ("no_evidence", NO_EVIDENCE, "no_signals", NO_SIGNALS, "market_only", MARKET_ONLY)])
    own = routed.filter("route <> 'decide'")
    return own.withColumns(
        {
            "decision": F.lit("HOLD"), "confidence": F.lit("low"), "time_horizon": F.lit("Long-term"), "reasoning": F.element_at(reason, F.col("route")), "key_risks": F.array(*map(F.lit, RISKS)), "insufficient_evidence": F.lit(True),
            "sources": F.when(F.col("route") == "market_only", F.col("sources")).otherwise(F.array().cast(own.schema["sources"].dataType)),
        }
    )


def rule_decision(routed: DataFrame) -> DataFrame:
    """A deterministic stand-in for the deciding model: the sign of the net score."""
    own = routed.filter("route = 'decide'")
    decision = F.when(F.col("net_score") > 2, "BUY").when(F.col("net_score") < -2, "SELL").otherwise("HOLD")
    return own.withColumns({"decision": decision, "confidence": F.when(F.size("conflicts") > 0, "low").otherwise("medium"), "time_horizon": F.lit("Long-term"), "reasoning": F.col("summary"), "key_risks": F.col("conflicts"), "insufficient_evidence": F.lit(False)})


def evidence_events(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Structured events of the evidence's articles, with their source's id and title, by question."""
    own = evidence.select("question_id", "article_id", F.col("id").alias("source_id"), F.col("title").alias("article_title"))
    return events.join(own, "article_id")


def lexical_order(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, ranked and ranked_candidates (with reasons): a deterministic stand-in for the reranking model."""
    ranked = retrieval.lexical_rerank(candidates, questions).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("new_rank", "candidate_id", "overlap"))).alias("r"))
    reason = lambda x: F.concat(x["overlap"].cast("string"), F.lit(" word(s) in common"))
    item = lambda x: F.struct(x["candidate_id"].alias("candidate_id"), reason(x).alias("reason"))
    return ranked.select("question_id", F.transform("r", lambda x: x["candidate_id"]).alias("ranked"), F.transform("r", item).alias("ranked_candidates"))


Rerank = Callable[[DataFrame, DataFrame], DataFrame]


def reranked_evidence(hits: DataFrame, questions: DataFrame, rerank: Rerank = lexical_order, top_k: int = 3, retrieval_top_k: int = 5) -> DataFrame:
    """Evidence of each question: more hits than needed are reranked, the first of the new order stay. ``questions``: question_id, question."""
    return retrieval.evidence(retrieval.reorder(hits, new_order(hits, questions, rerank, retrieval_top_k)), top_k)


def new_order(hits: DataFrame, questions: DataFrame, rerank: Rerank = lexical_order, retrieval_top_k: int = 5) -> DataFrame:
    """question_id, ranked and, for debug parts of texts, ranked_candidates (null if ``rerank`` gives no reasons)."""
    order = rerank(retrieval.rerank_candidates(hits, retrieval_top_k), questions)
    return order if "ranked_candidates" in order.columns else order.withColumn("ranked_candidates", F.lit(None).cast("array<struct<candidate_id: string, reason: string>>"))


def recommend(targets: DataFrame, hits: DataFrame, events: DataFrame, top_k: int = 3, retrieval_top_k: int = 5, rerank: Rerank = lexical_order, decide: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """A recommendation per target. ``targets``: question_id, target; ``hits``: hydrated hits with rank.

    Candidates are reranked (by words in common, or by ``rerank``), evidence is what stands first then, its events are aggregated by
    question. The rows hold target_events and ranked_candidates for debug parts of texts. ``decide`` gets the rows of the route ``decide`` and the evidence; without it :func:`rule_decision` decides.
    """
    order = new_order(hits, targets.select("question_id", F.col("target").alias("question")), rerank, retrieval_top_k)
    evidence = retrieval.evidence(retrieval.reorder(hits, order), top_k)
    matched = signals.match_events(targets.select("question_id", "target"), evidence_events(evidence, events), ["question_id"])
    total = signals.aggregate(matched, True, ("question_id", "target"))
    sources = evidence.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("id", "title", "url", "snippet"))).alias("sources"))
    own = targets.select("question_id", "target").join(sources, "question_id", "left").join(total, ["question_id", "target"], "left").join(order.select("question_id", "ranked_candidates"), "question_id", "left")
    routed = own.withColumn("route", route(F.col("sources").isNotNull(), F.col("net_score").isNotNull(), F.col("target_specific_event_count"), F.col("target")))
    decided = decide(routed.filter("route = 'decide'"), evidence) if decide else rule_decision(routed)
    return insufficient(routed).unionByName(decided, allowMissingColumns=True)


def answer(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """A grounded answer per question: the first evidence's snippet, cited, or the sentence for none. Stands in for the answering model."""
    sources = evidence.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("id", "title", "url", "snippet"))).alias("sources"))
    own = questions.join(sources, "question_id", "left")
    has = F.col("sources").isNotNull()
    point = "array<struct<text: string, citations: array<bigint>>>"
    return own.select(
        "question_id", F.when(has, F.col("sources")[0]["snippet"]).otherwise(NO_ANSWER).alias("answer"), F.coalesce("sources", F.array().cast("array<struct<id: bigint, title: string, url: string, snippet: string>>")).alias("sources"),
        F.when(has, "medium").otherwise("low").alias("confidence"), (~has).alias("insufficient_evidence"),
        F.when(has, F.transform("sources", lambda s: F.struct(s["title"].alias("text"), F.array(s["id"]).alias("citations")))).otherwise(F.array().cast(point)).alias("supporting_points"), F.array().cast(point).alias("counter_points"),
    )
