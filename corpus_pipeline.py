"""A corpus from raw documents to packed sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import shared_dir, table
from sparkwell.llm.near_dup import keep_one
from sparkwell.llm.packing import pack_documents
from sparkwell.llm.pii import pseudonymise, run_secret
from sparkwell.llm.quality_classifier import keep_good
from sparkwell.llm.toxicity import keep_civil

#: Bytes of an Arrow batch, about. By rows alone (10,000) a batch grows with the texts, in the JVM and in its Python worker.
BATCH = "4m"
#: The whole can't be said in SQL: two stages are fitted models, one packs greedily.
ORACLE_SQL: str | None = None


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH``: Spark reads this when the stage's result is written."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from the labels of these documents."""
    bound_batches(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted to be toxic."""
    bound_batches(spark)
    return keep_civil(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    bound_batches(spark)
    return keep_one(docs, percent=75)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets; n_chars follows the new text."""
    out = pseudonymise(docs, run_secret(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of at most 4096."""
    bound_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("pii_surrogates", pii),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of ``sf_dir``; each result is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/sparkwell-work/{uuid.uuid4().hex}-stage-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
