"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import centroids, embedding_dup, lexical_search, near_dup, quality_rules
from .bpe_codec import round_trip
from .common import table
from .differencing import pack_evenly
from .lm_scoring import score_documents
from .packing import pack_documents
from .pii import pseudonymise, run_secret
from .quality_classifier import score_quality
from .token_counts import token_counts
from .toxicity import score_toxicity


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_first(table(spark, sf_dir, "documents")).select(quality_rules.COLUMNS)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), secret=run_secret(spark), count="n_entities")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_evenly(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


def op12_max_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_token_counts": op6_token_counts,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_embedding_duplicates": op8_embedding_duplicates,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_differencing_packing": op11_differencing_packing,
    "op12_max_tree_search": op12_max_tree_search,
    "op13_hamerly_clusters": op13_hamerly_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op5_near_duplicates": near_dup.SQL,
    "op8_embedding_duplicates": embedding_dup.SQL,
    "op12_max_tree_search": lexical_search.SQL,
    "op13_hamerly_clusters": centroids.SQL,
}
