"""Tables, enum domains and work parameters."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCES = ["manual", "news", "api"]
EVENT_TYPES = ["Macro", "Company", "Sector", "Market"]
DIRECTIONS = {"Positive": 1, "Negative": -1, "Neutral": 0}
IMPORTANCE = {"High": 3, "Medium": 2, "Low": 1}
HORIZONS = ["Short-term", "Long-term", "Both"]
CONFIDENCE = ["high", "medium", "low"]
DECISIONS = ["BUY", "HOLD", "SELL"]
GENERAL_SLUG, GENERAL_LABEL = "general-market", "General Market"
GENERAL_NAMES = ["general market", "market", "broad market"]
MIN_TEXT, TITLE_CHARS, DESCRIPTION_CHARS = 50, 100, 200
TOP_K, RETRIEVAL_TOP_K, EXCERPT_CHARS, SNIPPET_CHARS, MAX_RISKS = 3, 5, 700, 220, 3

REQUIRED = ["source", "title", "content", "url", "published_at"]

_s, _l, _at = T.StringType(), T.LongType(), T.TimestampType()


def _field(name: str, kind: T.DataType = _s, needed: bool = True, **rules: object) -> T.StructField:
    """``rules``: see operators/constraints.py."""
    return T.StructField(name, kind, not needed, rules or None)


RAW_EVENT = T.StructType([T.StructField("source", _s), T.StructField("raw_text", _s)])
ARTICLES = T.StructType(
    [_field("article_id", _l, unique=True), _field("source"), _field("title"), _field("description", needed=False), _field("content"), _field("url", unique=True), _field("published_at", _at), _field("summary", needed=False), _field("fetched_at", _at, needed=False)]
)
STRUCTURED_EVENTS = T.StructType(
    [
        _field("event_id", unique=True), _field("article_id", _l, references="articles"), _field("event_type", values=EVENT_TYPES), _field("direction", values=list(DIRECTIONS)), _field("importance", values=list(IMPORTANCE)), _field("time_horizon", values=HORIZONS),
        *map(_field, ("affected_asset", "reasoning", "evidence_excerpt")), _field("structured_at", _at),
    ]
)
