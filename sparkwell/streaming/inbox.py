"""Raw events from a folder of JSON files as a stream into snapshot tables. An addition to the batch flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.events import to_articles, unknown_rows, validate
from ..operators.tables import PartitionedTable, SnapshotTable
from ..schema import RAW_EVENT


def read_inbox(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RAW_EVENT).json(folder)


def ingest_stream(inbox: DataFrame, articles: PartitionedTable, checkpoint: str):  # noqa: ANN201
    """Every micro-batch is written once, numbered there, and goes through the batch flow, which appends what is new. Urls are made of the text, so a batch that is repeated stores nothing new."""

    def store(batch: DataFrame, _: int) -> None:
        staged = SnapshotTable(articles.spark, f"{articles.path}_batch", T.StructType([*RAW_EVENT.fields, T.StructField("ord", T.LongType())]))
        staged.write(batch.withColumn("ord", F.monotonically_increasing_id()))
        valid, _rejects = validate(staged.read())
        rows = to_articles(valid, F.sha2("raw_text", 256), F.current_timestamp()).withColumn("fetched_at", F.current_timestamp())
        articles.insert(unknown_rows(articles.read(), rows, "ord"), "ord")

    return inbox.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by window and type; late ones count until the watermark has passed."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
