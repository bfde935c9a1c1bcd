"""Model steps as maps over rows: a provider per worker, results or errors as columns. The provider here is deterministic and offline."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

EVENT_FIELDS = "event_type: string, direction: string, importance: string, time_horizon: string, affected_asset: string, reasoning: string, evidence_excerpt: string, error: string"
EVENT_KEYS = ("event_type", "direction", "importance", "time_horizon", "affected_asset", "reasoning", "evidence_excerpt")


class Provider(Protocol):
    """What a model offers; any object with these methods will do. Each may raise."""

    def summarise(self, title: str, description: str, content: str) -> list[str]: ...

    def structure(self, title: str, content: str) -> list[dict]: ...

    def embed_all(self, texts: list[str]) -> list[list[float]]: ...


class OfflineProvider:
    """Stands in for models: first sentences, a lexicon of words, hashed tokens."""

    def __init__(self, lexicon: dict[str, str] | None = None, width: int = 64) -> None:
        self.lexicon = lexicon or {"growth": "Positive", "profit": "Positive", "upgrade": "Positive", "loss": "Negative", "lawsuit": "Negative", "downgrade": "Negative"}
        self.width = width

    def summarise(self, title: str, description: str, content: str) -> list[str]:
        found = [s.strip() for s in re.split(r"(?<=[.!?])\s+", content or "") if s.strip()]
        if len(found) < 3:
            raise ValueError("Summary needs 3 to 5 bullets")
        return found[:3]

    def structure(self, title: str, content: str) -> list[dict]:
        words = set(re.findall(r"[a-z]+", (content or "").lower()))
        return [
            {"event_type": "Company", "direction": d, "importance": "Medium", "time_horizon": "Both", "affected_asset": "", "reasoning": f"mentions {w}", "evidence_excerpt": (title or "")[:100]}
            for w, d in sorted(self.lexicon.items())
            if w in words
        ]

    def embed(self, text: str) -> list[float]:
        v = np.zeros(self.width)
        for w in re.findall(r"\w+", (text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % self.width] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    def embed_all(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]


Make = Callable[[], Provider]


def summarise(articles: DataFrame, make: Make = OfflineProvider) -> DataFrame:
    """Adds bullets (array) and error. The provider is made once per task, and not at all where there are no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider: Provider | None = None
        for b in batches:
            bullets: list[list[str] | None] = []
            errors: list[str | None] = []
            for t, d, c in zip(b["title"], b["description"], b["content"], strict=True):
                provider = provider or make()
                try:
                    bullets.append(provider.summarise(t, d, c))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any failure of a model is a row's error
                    bullets.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"article_id": b["article_id"], "bullets": bullets, "error": errors})

    return articles.select("article_id", "title", "description", "content").mapInPandas(run, "article_id long, bullets array<string>, error string")


def identified(rows: DataFrame) -> DataFrame:
    """Events with their article_id, ``place`` in the reply, fields and error: a blank asset is named and event_id takes the place's stead."""
    asset = F.when(F.col("error").isNull(), F.coalesce(F.nullif(strip(F.col("affected_asset")), F.lit("")), F.lit("General Market")))
    fields = F.to_json(F.struct("article_id", "place", *EVENT_KEYS))
    return rows.withColumn("affected_asset", asset).withColumn("event_id", F.sha2(fields, 256)).drop("place")


def structured(articles: DataFrame, make: Make = OfflineProvider) -> DataFrame:
    """Events of all articles; a blank asset becomes General Market, ids depend on the article, the event's place and all its fields.

    An article whose model failed has one row, with ``error`` and no event. The provider is made once per task that has rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider: Provider | None = None
        for b in batches:
            rows: list[tuple] = []
            for i, t, c in zip(b["article_id"], b["title"], b["content"], strict=True):
                provider = provider or make()
                try:
                    rows += [(i, place, *(e.get(k) for k in EVENT_KEYS), None) for place, e in enumerate(provider.structure(t, c))]
                except Exception as e:  # noqa: BLE001  any failure of a model is a row's error
                    rows.append((i, 0, *(None for _ in EVENT_KEYS), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["article_id", "place", *EVENT_KEYS, "error"])

    rows = articles.select("article_id", "title", "content").mapInPandas(run, f"article_id long, place long, {EVENT_FIELDS}")
    return identified(rows)


def embed(text: Column, make: Make = OfflineProvider) -> Column:
    """Vectors of texts, a batch at a time; the provider is made once per worker and batch stream, and not at all without rows."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider: Provider | None = None
        for s in batches:
            if len(s):
                provider = provider or make()
            yield pd.Series(provider.embed_all(s.tolist()) if len(s) else [], index=s.index, dtype=object)

    return run.asNondeterministic()(text)
