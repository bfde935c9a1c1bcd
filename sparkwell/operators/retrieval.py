"""Exact nearest neighbours, hydration of hits, rerank candidates, reranking and its validation, evidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clean, strip, tokens, truncate
from ..schema import EXCERPT_CHARS, RETRIEVAL_TOP_K, SNIPPET_CHARS, TOP_K

#: Rows of a block of queries and of the corpus, about. A task holds one of each.
QUERY_BLOCK, CORPUS_BLOCK = 8192, 32_768
#: Queries and corpus rows that are multiplied at once: their product is an array of 4 MB, whatever the size of a block.
QUERY_SLICE, SLICE = 256, 2048


def usable(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """Rows with an embedding that can be compared: there, not empty, of ``size`` components if that is given, none null or not finite."""
    e = F.col("embedding")
    right = F.size(e) > 0 if size is None else F.size(e) == size
    return vectors.filter(e.isNotNull() & right & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))


def rows_of(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows, in their own precision."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows, in double precision."""
    return rows_of(lists).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _nearer(best: np.ndarray, best_ids: np.ndarray, ids: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k least distances (rounded to 12 places; ties go to the least id) among ``best`` (infinite where there is none) and 1 - ``cosine``, with their ids."""
    n, k = best.shape
    # whatever may be as near as the k-th, so that ties are decided by id below
    least = 1 - best[:, -1:] - 2e-12
    near = cosine >= least
    if cosine.shape[1] > k and np.count_nonzero(near) > 8 * best.size:
        kth = np.partition(cosine, -k, axis=1)[:, -k, None]
        near = cosine >= np.maximum(least, np.minimum(1.0, kth) - 2e-12)
    row, at = np.nonzero(near)
    far = np.r_[best.ravel(), np.maximum(0.0, 1 - cosine[row, at])]
    all_ids = np.r_[best_ids.ravel(), ids[at]]
    row = np.r_[np.repeat(np.arange(n), k), row]
    order = np.lexsort((all_ids, np.round(far, 12), row))
    many = np.bincount(row, minlength=n)
    first = order[(np.cumsum(many) - many)[:, None] + np.arange(k)]
    return far[first], all_ids[first]


def nearest(corpus: DataFrame, queries: DataFrame, k: int = RETRIEVAL_TOP_K) -> DataFrame:
    """question_id, article_id, distance (1 - cosine, in double precision) and rank of the k nearest of ``corpus`` to each query.

    ``corpus``: article_id, embedding; ``queries``: question_id, embedding. All rows are compared: both are dealt into blocks, every
    two blocks meet in one task and give k rows per query, of which the last choice is made by a window per query. Only the
    numbers of rows come to the driver. Rows whose embedding is null or empty or has a null or non-finite component aren't found
    and find nothing, and a query meets only rows of its own length.
    """
    blocks = lambda df, most: max(1, -(-df.count() // most))
    own = usable(queries.select(F.col("question_id").cast("long").alias("id"), "embedding"))
    rows = usable(corpus.select(F.col("article_id").cast("long").alias("id"), "embedding"))
    n_queries, n_rows = blocks(own, QUERY_BLOCK), blocks(rows, CORPUS_BLOCK)
    left = own.select("id", "embedding", _block(n_queries).alias("q"), _all_of(n_rows).alias("c"), F.size("embedding").alias("d"))
    right = rows.select("id", "embedding", _all_of(n_queries).alias("q"), _block(n_rows).alias("c"), F.size("embedding").alias("d"))
    return best_of(left, right, ["q", "c", "d"], k)


def _block(n: int | Column) -> Column:
    """One of ``n`` blocks."""
    return F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n) if isinstance(n, int) else n).cast("int")


def _all_of(n: int | Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n).cast("int") - 1))


def best_of(queries: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest rows of each query among those that meet it: id, embedding and ``keys``, by which they are grouped. A task holds a group."""

    def search(pair: pa.Table) -> pa.Table:
        query = pair.column("query").to_numpy()
        ids, vectors = pair.column("id").to_numpy(), rows_of(pair.column("embedding"))
        asked, there = np.flatnonzero(query), np.flatnonzero(~query)
        unit = _unit(vectors[asked].astype(np.float64))
        best, best_ids = np.full((len(asked), k), np.inf), np.zeros((len(asked), k), np.int64)
        for at in range(0, len(there), SLICE):
            some = there[at : at + SLICE]
            rows = _unit(vectors[some].astype(np.float64)).T
            for q in range(0, len(asked), QUERY_SLICE):
                own = slice(q, q + QUERY_SLICE)
                best[own], best_ids[own] = _nearer(best[own], best_ids[own], ids[some], unit[own] @ rows)
        real = best < np.inf
        return pa.table({"question_id": np.repeat(ids[asked], real.sum(axis=1)), "article_id": best_ids[real], "distance": best[real]})

    both = queries.withColumn("query", F.lit(True)).unionByName(rows.withColumn("query", F.lit(False)))
    found = both.groupBy(*keys).applyInArrow(search, "question_id long, article_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.round("distance", 12), "article_id"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def hydrate(hits: DataFrame, articles: DataFrame, content: bool = True) -> DataFrame:
    """Hits with the columns of their articles; those of unknown articles are null. Without ``content`` the text columns are null."""
    columns = ["article_id", "source", "title", "url", "published_at", "content", "summary"]
    own = articles.select(columns)
    if not content:
        own = own.withColumn("content", F.lit(None).cast("string")).withColumn("summary", F.lit(None).cast("string"))
    return hits.join(own, "article_id", "left")


def embedding_text() -> Column:
    """What is embedded of an article: led by the summary if there is one, else by title and description."""
    title, description, content = (F.col(c) for c in ("title", "description", "content"))
    led = F.concat(F.col("summary"), F.lit("\n"), title, F.lit("\n"), F.coalesce(description, F.lit("None")))
    return F.when(F.col("summary") != "", led).otherwise(F.concat(title, F.lit(". "), F.coalesce(description, F.lit("None")), F.lit(". "), content))


def upsert_index(index: DataFrame, new: DataFrame) -> DataFrame:
    return index.join(new.select("article_id"), "article_id", "left_anti").unionByName(new)


def _default(name: str, absent: str) -> Column:
    return clean(F.coalesce(F.col(name), F.lit(absent)))


def snippet(body: Column, limit: int = SNIPPET_CHARS) -> Column:
    """From the first that isn't empty: summary, ``body``, title."""
    return truncate(F.coalesce(blank_to_null(clean(F.col("summary"))), blank_to_null(body), _default("title", "Untitled")), limit)


def rerank_candidates(hits: DataFrame, limit: int = RETRIEVAL_TOP_K) -> DataFrame:
    """candidate_id (the rank as text), title, summary, snippet and original_rank of the first hits of each question."""
    summary = F.when(F.col("summary") != "", clean(F.col("summary")))
    return hits.filter(F.col("rank") <= limit).withColumn("snippet", snippet(clean(F.col("content")))).withColumn("title", _default("title", "Untitled")).withColumn("summary", summary).withColumn("candidate_id", F.col("rank").cast("string")).withColumnRenamed("rank", "original_rank")


def candidate_error(c: Column) -> Column:
    """Why a candidate (a struct) can't be reranked, or null."""
    empty = lambda name: strip(F.coalesce(c[name], F.lit(""))) == ""
    return F.when(empty("candidate_id"), "empty candidate_id").when(empty("title"), "empty title").when(empty("snippet"), "empty snippet").when(F.coalesce(c["original_rank"], F.lit(0)) < 1, "rank below 1")


def lexical_rerank(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """A deterministic order: most tokens in common with the question first, then the original rank. Adds overlap and new_rank."""
    own = candidates.join(questions.select("question_id", "question"), "question_id")
    common = F.size(F.array_intersect(tokens(F.lower("question")), tokens(F.lower(F.concat_ws(" ", "title", "snippet")))))
    place = Window.partitionBy("question_id").orderBy(F.desc("overlap"), "original_rank")
    return own.withColumn("overlap", common.cast("long")).withColumn("new_rank", F.row_number().over(place).cast("long"))


def _listed(ids: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(F.array_sort(ids), "', '"), F.lit("']"))


def rerank_error(expected: Column, actual: Column) -> Column:
    """Why a returned order is no permutation of the candidates (the first reason), or null."""
    invented, missing = F.array_except(actual, expected), F.array_except(expected, actual)
    details = F.concat_ws(", ", F.when(F.size(invented) > 0, F.concat(F.lit("invented IDs: "), _listed(invented))), F.when(F.size(missing) > 0, F.concat(F.lit("missing IDs: "), _listed(missing))))
    return (
        F.when(F.size(actual) != F.size(expected), F.lit("Reranker must return the same number of candidate IDs it received"))
        .when(F.size(F.array_distinct(actual)) != F.size(actual), F.lit("Reranker returned duplicate candidate IDs"))
        .when(details != "", F.concat(F.lit("Reranker returned invalid candidate IDs: "), details))
    )


def reorder(hits: DataFrame, ranked: DataFrame) -> DataFrame:
    """Hits in the order of a validated permutation. ``ranked``: question_id, ranked (array of candidate ids)."""
    places = ranked.select("question_id", F.posexplode("ranked").alias("_p", "candidate_id"))
    return hits.withColumn("candidate_id", F.col("rank").cast("string")).join(places, ["question_id", "candidate_id"]).withColumn("rank", (F.col("_p") + 1).cast("long")).drop("_p", "candidate_id")


def evidence(hits: DataFrame, limit: int = TOP_K) -> DataFrame:
    """The first hits of each question as evidence: id (from 1), title, url, summary, excerpt and snippet."""
    excerpt = truncate(clean(F.col("content")), EXCERPT_CHARS)
    return hits.filter(F.col("rank") <= limit).select(
        "question_id", "article_id", F.col("rank").alias("id"), _default("title", "Untitled").alias("title"), _default("url", "N/A").alias("url"),
        F.when(F.col("summary") != "", clean(F.col("summary"))).alias("summary"), excerpt.alias("excerpt"), snippet(excerpt).alias("snippet"), "published_at",
    )
