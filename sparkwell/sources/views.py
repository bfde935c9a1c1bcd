"""Articles and signals as views of the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ARTICLES = """
select doc_id + 1 as article_id,
    case doc_id % 4 when 0 then 'manual' when 1 then 'news' when 2 then 'api' else 'rss' end as source,
    substring(text, 1, 100) as title, substring(text, 1, 200) as description, text as content,
    timestamp '2024-01-01 00:00:00' + (doc_id % 500) * interval '1' minute as published_at,
    case when quality = 1 then substring(text, 1, 150) when quality = 0 then '   ' end as summary,
    concat('internal://article/', doc_id) as url
from {documents} left join {labels} using (doc_id)
"""
SIGNALS = """
select event_id, event_id % (select cast(floor(count(*) * 0.8) as bigint) from {documents}) + 1 as article_id, ts as structured_at,
    case event_type when 'error' then 'Macro' when 'purchase' then 'Company' when 'signup' then 'Sector' else 'Market' end as event_type,
    case when value < 20 then 'Negative' when value < 50 then 'Neutral' else 'Positive' end as direction,
    case when event_id % 9 < 3 then 'High' when event_id % 9 < 6 then 'Medium' else 'Low' end as importance,
    case event_id % 3 when 0 then 'Short-term' when 1 then 'Long-term' else 'Both' end as time_horizon,
    case user_id % 6 when 0 then 'MSFT' when 1 then 'Microsoft (MSFT)' when 2 then 'General  Market' when 3 then 'BRK.B' when 4 then 'AAPL' else 'Broad Market' end as affected_asset
from {events}
"""
ARTICLES_SQL = ARTICLES.format(documents="documents", labels="labels")
SIGNALS_SQL = SIGNALS.format(events="events", documents="documents")
#: To be put before a query: both views as named subqueries.
WITH = f"with recursive articles_v as ({ARTICLES_SQL}), signals_v as ({SIGNALS_SQL})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ARTICLES, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are dealt over four fifths of all articles."""
    return spark.sql(SIGNALS, events=table(spark, sf_dir, "events"), documents=table(spark, sf_dir, "documents"))
