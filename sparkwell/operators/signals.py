"""Scores of structured events and their aggregation by target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import display_target, normalize_target, target_token, tokens
from ..schema import DIRECTIONS, EVENT_TYPES, GENERAL_SLUG, IMPORTANCE

# What conflicts are called.
CONFLICT_BOTH = "Positive and negative signals are both present in the retrieved evidence."
CONFLICT_HORIZON = "Short-term headwinds conflict with more durable long-term positives."


def _case(x: Column, values: dict[str, int]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, n in values.items():
        out = out.when(x == name, F.lit(n))
    return out


def score() -> Column:
    """Direction times importance."""
    return (_case(F.col("direction"), DIRECTIONS) * _case(F.col("importance"), IMPORTANCE)).cast("long")


def _targets(targets: DataFrame, also_on: list[str]) -> DataFrame:
    return targets.select("target", *also_on).distinct().withColumn("_t", normalize_target(F.col("target")))


def _own_events(t: DataFrame, e: DataFrame, also_on: list[str]) -> DataFrame:
    """Events that name a target, once per target: assets and targets meet by tagged keys, their whole name or a token, in an equi-join."""
    token = target_token(F.col("target"))
    wanted = t.filter(F.col("_t") != GENERAL_SLUG).withColumn("_key", F.explode(F.array_compact(F.array(F.concat(F.lit("full:"), "_t"), F.when(token != "", F.concat(F.lit("tok:"), token))))))
    keys = F.concat(F.array(F.concat(F.lit("full:"), "_a")), F.transform(F.array_distinct(tokens(F.col("_a"))), lambda x: F.concat(F.lit("tok:"), x)))
    offered = e.filter(F.col("_a") != GENERAL_SLUG).withColumn("_key", F.explode(keys))
    # what meets by its whole name may meet by its token as well
    once = F.startswith("_key", F.lit("full:")) | (F.col("_a") != F.col("_t"))
    return offered.join(wanted, ["_key", *also_on]).filter(once).drop("_key").withColumn("match", F.lit("target"))


def match_events(targets: DataFrame, events: DataFrame, also_on: list[str] | None = None) -> DataFrame:
    """Events relevant to each target, with ``match``: ``target`` or ``market`` (a general-market event for another target).

    General-market events go to every target, so this is for what needs the events themselves; sums are to be had from
    :func:`aggregate_targets`, which doesn't multiply them. ``also_on`` are columns that must agree, too. Without them, a task holds
    all targets beside its share of the events.
    """
    also_on = also_on or []
    t, e = _targets(targets, also_on), events.withColumn("_a", normalize_target(F.col("affected_asset")))
    label = F.when(F.col("_t") == GENERAL_SLUG, "target").otherwise("market")
    general = e.filter(F.col("_a") == GENERAL_SLUG)
    if also_on:
        wide = general.join(t, also_on)
    else:
        # events stay in one place each: they are dealt by a salt, and every salt gets all targets, which are the short side
        salts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        wide = general.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int")).join(every.hint("shuffle_hash"), "_salt").drop("_salt")
    wide = wide.withColumn("match", label)
    return _own_events(t, e, also_on).unionByName(wide).drop("_a", "_t").withColumn("score", score())


def conflicts(positive: Column, negative: Column, short_negative: Column, long_positive: Column) -> Column:
    return F.array_compact(F.array(F.when(positive & negative, F.lit(CONFLICT_BOTH)), F.when(short_negative & long_positive, F.lit(CONFLICT_HORIZON))))


def dominant_driver(scores: dict[str, Column]) -> Column:
    """The bucket of greatest absolute score; ties are named together."""
    buckets = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("s")) for k, v in scores.items()])
    most = F.greatest(*[F.abs(v) for v in scores.values()])
    top = F.filter(buckets, lambda b: F.abs(b["s"]) == most)
    names = F.array_join(F.array_sort(F.transform(top, lambda b: b["k"])), ", ")
    tone = F.when(top[0]["s"] > 0, "positive").otherwise("negative")
    return F.when(most == 0, F.lit("No dominant driver")).when(F.size(top) > 1, F.concat(F.lit("Mixed drivers across "), names)).otherwise(F.concat(top[0]["k"], F.lit(" signals are the dominant "), tone, F.lit(" driver")))


def summary_sentence() -> Column:
    leaning = F.when(F.col("net_score") > 0, "overall positive").when(F.col("net_score") < 0, "overall negative").otherwise("balanced or mixed")
    tail = F.when(F.size("conflicts") > 0, F.concat(F.lit(" Key conflict: "), F.col("conflicts")[0])).otherwise(F.concat(F.lit(" The aggregation is based on "), F.col("event_count").cast("string"), F.lit(" structured event(s).")))
    return F.concat(F.lit("Retrieved signals for "), display_target(F.col("target")), F.lit(" are "), leaning, F.lit(". "), F.col("dominant_driver"), F.lit("."), tail)


def _sums() -> list[Column]:
    """Aggregates of matched or general events (score, event_type, time_horizon, match); sums and maxima of them are those of all events together."""
    s, h = F.col("score"), F.col("time_horizon")
    bucket = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("score")).otherwise(0)).alias(f"{k.lower()}_score")
    flag = lambda c, name: F.max(F.coalesce(c, F.lit(False))).alias(name)
    return [
        F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("match") == "target").alias("target_specific_event_count"), *[bucket(k) for k in EVENT_TYPES], F.sum("score").alias("net_score"),
        flag(s > 0, "_pos"), flag(s < 0, "_neg"), flag((s < 0) & h.isin("Short-term", "Both"), "_short"), flag((s > 0) & h.isin("Long-term", "Both"), "_long"),
    ]


_NUMBERS = ["event_count", "target_specific_event_count", *(f"{k.lower()}_score" for k in EVENT_TYPES), "net_score"]
_FLAGS = ["_pos", "_neg", "_short", "_long"]


def _described(sums: DataFrame) -> DataFrame:
    out = sums.withColumn("conflicts", conflicts(*(F.col(c) for c in _FLAGS))).drop(*_FLAGS)
    out = out.withColumn("dominant_driver", dominant_driver({k: F.col(f"{k.lower()}_score") for k in EVENT_TYPES}))
    return out.withColumn("summary", summary_sentence())


def aggregate(matched: DataFrame, with_events: bool = False, keys: tuple[str, ...] = ("target",)) -> DataFrame:
    """One row per ``keys`` (a target, or a question and its target): counts, four bucket scores, their sum, conflicts, dominant driver and summary; no row where nothing matches.

    ``with_events`` adds target_events in the order of structured_at and event_id, which gathers a target's events in one row; it is
    for targets whose events come from a bounded number of articles.
    """
    fields = [c for c in ("source_id", "structured_at", "event_id", "article_id", "article_title", "event_type", "direction", "importance", "time_horizon", "affected_asset", "score", "reasoning", "evidence_excerpt") if c in matched.columns]
    return _described(matched.groupBy(*keys).agg(*_sums(), *([F.array_sort(F.collect_list(F.struct(*fields))).alias("target_events")] if with_events else [])))


def aggregate_targets(targets: DataFrame, events: DataFrame) -> DataFrame:
    """The rows of ``aggregate(match_events(targets, events))`` without the multiplication of general-market events.

    These are added up once; their one row of sums is then added to those of every target.
    """
    t, e = _targets(targets, []), events.select("event_type", "time_horizon", score().alias("score"), normalize_target(F.col("affected_asset")).alias("_a"))
    own = _own_events(t, e, []).groupBy("target").agg(*_sums())
    general = e.filter(F.col("_a") == GENERAL_SLUG).withColumn("match", F.lit("market")).groupBy(F.lit(0).alias("_one")).agg(*_sums())
    market = t.withColumn("_one", F.lit(0)).join(general, "_one").withColumn("target_specific_event_count", F.when(F.col("_t") == GENERAL_SLUG, F.col("event_count")).otherwise(F.lit(0).cast("long")))
    both = own.unionByName(market.select(own.columns)).groupBy("target").agg(*[F.sum(c).alias(c) for c in _NUMBERS], *[F.max(c).alias(c) for c in _FLAGS])
    return _described(both)


def ordered_events(matched: DataFrame) -> DataFrame:
    """Matched events in the order of target, structured_at and event_id, sorted by ranges, with their ``place`` (from 1) among the target's.

    Hours of a target are numbered apart, and a table of counts by hour gives each its start, so no task sees a target's events.
    """
    hourly = matched.withColumn("_hour", F.date_trunc("hour", "structured_at"))
    before = Window.partitionBy("target").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    starts = hourly.groupBy("target", "_hour").agg(F.count(F.lit(1)).alias("_n")).select("target", "_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("target", "_hour").orderBy("structured_at", "event_id"))
    same = starts.withColumnsRenamed({"target": "_target", "_hour": "_of"})
    placed = hourly.withColumn("_nth", nth).join(same, (F.col("target") == F.col("_target")) & F.col("_hour").eqNullSafe(F.col("_of")))
    return placed.withColumn("place", (F.col("_nth") + F.col("_before")).cast("long")).drop("_nth", "_before", "_hour", "_target", "_of").orderBy("target", "structured_at", "event_id")
