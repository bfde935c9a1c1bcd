"""Raw events from a line of input, from news payloads and from market series, and their ordered union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import MIN_TEXT

NEWS_PAYLOAD = "status string, articles array<struct<title: string, description: string>>"
# Fixed value: stands in where no market series can be read.
FALLBACK = "Fallback API Data: Treasury yields spike 15bps across curve following FOMC minutes release, 10-year at 4.25%. VIX up 5 points to 18.5."


def manual(spark: SparkSession, line: str | None) -> DataFrame:
    """One event from a line; none if it is blank."""
    text = (line or "").strip()
    return spark.createDataFrame([("manual", text)] if text else [], "source string, raw_text string")


def news(payloads: DataFrame, null_text: str = "") -> DataFrame:
    """Events from payloads (a string column ``value``, or the columns of NEWS_PAYLOAD): title and description, if together they are long enough.

    ``null_text`` stands for a title or description that is null.
    """
    own = payloads.select(F.from_json("value", NEWS_PAYLOAD).alias("p")).select("p.*") if "value" in payloads.columns else payloads
    return news_rows(own, null_text).select(F.lit("news").alias("source"), "raw_text")


def news_rows(parsed: DataFrame, null_text: str = "") -> DataFrame:
    """raw_text of each article of parsed payloads, with the payloads' other columns."""
    part = lambda name: F.coalesce(F.col(f"_a.{name}"), F.lit(null_text))
    text = strip(F.concat(part("title"), F.lit(". "), part("description")))
    rows = parsed.withColumn("_a", F.explode("articles")).drop("articles")
    return rows.withColumn("raw_text", text).drop("_a").filter(F.length("raw_text") >= MIN_TEXT)


def newest_point(series: Column) -> Column:
    """The value at the greatest key of a map; null for an empty map."""
    newest = F.array_max(F.map_keys(series))
    return F.element_at(series, newest)


def market(payloads: DataFrame) -> DataFrame:
    """One event per payload (string column ``value``) from the newest day of its series, or the fallback."""
    day = newest_point(F.from_json(F.get_json_object("value", "$['Time Series (Daily)']"), "map<string, map<string, string>>"))
    field = lambda name: F.coalesce(F.element_at(day, name), F.lit("N/A"))
    text = F.concat(F.lit("SPY daily close: $"), field("4. close"), F.lit(", volume: "), field("5. volume"), F.lit(". Market data from Alpha Vantage API."))
    return payloads.select(*[c for c in payloads.columns if c != "value"], F.lit("api").alias("source"), F.when(day.isNull(), F.lit(FALLBACK)).otherwise(text).alias("raw_text"))


def union_in_order(parts: list[DataFrame], order: str) -> DataFrame:
    """The union of all parts with source_ord (the part) and row_ord (``order`` within it), which keep the order of collection."""
    tagged = [p.withColumn("source_ord", F.lit(k)).withColumn("row_ord", F.col(order).cast("long")) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged)
