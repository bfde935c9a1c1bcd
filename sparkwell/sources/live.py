"""Payloads of HTTP services as a data source of Spark, for news and market series. Needs a network; tests use a local server."""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.text import strip
from ..schema import MIN_TEXT
from .collect import market, news

NEWS_URL, MARKET_URL = "https://newsapi.org/v2/top-headlines", "https://www.alphavantage.co/query"


class MissingKeyError(RuntimeError):
    """No key for a service that needs one."""


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.timeout = options["url"], float(options.get("timeout", "10"))
        self.fail = options.get("onerror", "fail") == "fail"
        self.pages = int(options.get("pages", "1"))
        self.query = {k.removeprefix("query."): v for k, v in options.items() if k.startswith("query.")}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(page) for page in range(1, self.pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str | None]]:
        query = self.query | ({"page": str(partition.value)} if self.pages > 1 else {})
        try:
            with urllib.request.urlopen(f"{self.url}?{urllib.parse.urlencode(query)}", timeout=self.timeout) as reply:
                yield (reply.read().decode(),)
        except OSError as e:
            if self.fail:
                raise RuntimeError(f"Request failed: {e}") from e
            yield (None,)


class HttpPayloads(DataSource):
    """Format ``http_payloads``: a row ``value`` (the reply's text) per page, a task per page.

    Options: url, timeout (seconds), pages, ``query.<name>`` for the query's parameters, onError (fail, or null for a null row).
    """

    @classmethod
    def name(cls) -> str:
        return "http_payloads"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> HttpReader:  # noqa: ANN001
        names = {k.lower(): k for k in ("query.pageSize", "query.apiKey")}  # the reader's options come in lower case
        return HttpReader({names.get(k.lower(), k.lower()): v for k, v in self.options.items()})


def payloads(spark: SparkSession, url: str, query: dict[str, str], **options: str) -> DataFrame:
    spark.dataSource.register(HttpPayloads)
    return spark.read.format("http_payloads").option("url", url).options(**options, **{f"query.{k}": v for k, v in query.items()}).load()


def live_news(spark: SparkSession, country: str = "us", category: str = "business", page_size: int = 100, pages: int = 1, url: str = NEWS_URL, key: str | None = None, null_text: str = "") -> DataFrame:
    """Events from the newest headlines; the key is that of NEWSAPI_API_KEY if none is given."""
    key = key or os.environ.get("NEWSAPI_API_KEY", "")
    if not key:
        raise MissingKeyError("NEWSAPI_API_KEY is required to fetch news from NewsAPI")
    return news(payloads(spark, url, {"country": country, "category": category, "pageSize": str(page_size), "apiKey": key}, pages=str(pages)), null_text)


def live_market(spark: SparkSession, symbol: str = "SPY", url: str = MARKET_URL, key: str | None = None) -> DataFrame:
    """One event from the newest day of a daily series; without a key, and after any failure, the fallback event."""
    key = key or os.environ.get("ALPHA_VANTAGE_API_KEY", "")
    if not key:
        return market(spark.createDataFrame([(None,)], "value string"))
    return market(payloads(spark, url, {"function": "TIME_SERIES_DAILY", "symbol": symbol, "apikey": key}, onError="null"))


class NewsStreamReader(SimpleDataSourceStreamReader):
    """Articles in the order of publishedAt and url; the offset is the last one that was read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.timeout = options["url"], float(options.get("timeout", "10"))
        self.size = int(options.get("pagesize", "100"))
        self.query = {{"apikey": "apiKey"}.get(k, k): v for k, v in ((k.removeprefix("query."), v) for k, v in options.items() if k.startswith("query."))}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": "", "url": ""}

    def _after(self, start: dict) -> list[tuple[str, str, str | None, str | None]]:
        """All articles behind ``start``; pages are read until one isn't full."""
        found: set[tuple[str, str, str | None, str | None]] = set()
        page = 1
        while True:
            query = self.query | {"pageSize": str(self.size), "page": str(page)} | ({"from": start["at"]} if start["at"] else {})
            with urllib.request.urlopen(f"{self.url}?{urllib.parse.urlencode(query)}", timeout=self.timeout) as reply:
                articles = json.load(reply).get("articles") or []
            found.update((a.get("publishedAt") or "", a.get("url") or "", a.get("title"), a.get("description")) for a in articles)
            if len(articles) < self.size:
                return sorted((x for x in found if x[:2] > (start["at"], start["url"])), key=lambda x: (x[0], x[1], x[2] or "", x[3] or ""))
            page += 1

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._after(start)
        return iter(rows), {"at": rows[-1][0], "url": rows[-1][1]} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The same rows again, if a batch has to be repeated."""
        return iter([x for x in self._after(start) if x[:2] <= (end["at"], end["url"])])


class NewsStream(DataSource):
    """Format ``http_news``: articles of a paged service as a stream (published_at, url, title, description).

    Options: url, timeout, pageSize, ``query.<name>`` for the query's parameters. The reply has what news payloads have, and publishedAt and url
    for each article. Spark's checkpoint holds the offset, so a query goes on behind the last article that it has finished; one that the
    service shows late, with an earlier time, isn't read. Articles come through the driver, as headlines are few.
    """

    @classmethod
    def name(cls) -> str:
        return "http_news"

    def schema(self) -> str:
        return "published_at string, url string, title string, description string"

    def simpleStreamReader(self, schema) -> NewsStreamReader:  # noqa: ANN001, N802
        return NewsStreamReader({k.lower(): v for k, v in self.options.items()})


def stream_news(spark: SparkSession, url: str = NEWS_URL, key: str | None = None, page_size: int = 100, null_text: str = "", **query: str) -> DataFrame:
    """Events (source, raw_text) from the headlines as they are published; for :func:`sparkwell.streaming.inbox.ingest_stream`."""
    key = key or os.environ.get("NEWSAPI_API_KEY", "")
    if not key:
        raise MissingKeyError("NEWSAPI_API_KEY is required to fetch news from NewsAPI")
    spark.dataSource.register(NewsStream)
    rows = spark.readStream.format("http_news").option("url", url).option("pageSize", str(page_size)).options(**{f"query.{k}": v for k, v in (query | {"apiKey": key}).items()}).load()
    text = strip(F.concat(F.coalesce("title", F.lit(null_text)), F.lit(". "), F.coalesce("description", F.lit(null_text))))
    return rows.select(F.lit("news").alias("source"), text.alias("raw_text")).filter(F.length("raw_text") >= MIN_TEXT)
