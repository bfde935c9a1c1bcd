"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo; a null id has none."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def sample_ids(labels: DataFrame, label: str, trained: Column, most: int) -> DataFrame:
    """doc_id and ``_label`` (0 or 1) of at most ``most`` labelled documents for which ``trained`` holds, in the order of a hash.

    Rows without id or label go; of several labels of a document the highest counts.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("_label").isNotNull() & trained)
    return own.groupBy("doc_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sample_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, _label and text (null: empty) of the sample's documents. ``ids`` has a bounded number of rows, so it is broadcast."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.join(F.broadcast(ids), "doc_id")
