"""Centroid clustering in whole numbers, with one upper and one lower bound per vector that spare most distances.

A round is one pass over a written table of vectors with their cluster and bounds, and writes the next one; nothing is shuffled but
sums by cluster. Distances that decide or are returned are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save_table

#: Rows that are compared with all centroids at once.
SLICE = 4096
#: Components are held within this range, so that squared distances of up to 128 of them fit in 64 bits.
MOST = 2**27
#: Bounds are widened by this share, far more than roots and sums of them can be off.
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id and x, the floors of ``scale`` times each component as double, of rows with exactly ``size`` components, all finite.

    Beyond plus or minus 2^27 a component counts as that.
    """
    e = F.col("embedding")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    kept = vectors.filter((F.size(e) == size) & ~F.exists(e, odd))
    # held before the floor, which gives 64-bit integers
    whole = lambda v: F.floor(F.greatest(F.least(F.lit(float(scale)) * v.cast("double"), F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, whole).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the least sha256 of ``seed:vec_id``, at most k; equal ids by their components, null ids behind the others."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["x"] for r in vectors.orderBy(key.asc_nulls_last(), "x").limit(k).select("x").collect()], np.int64)


def exact(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> int:
    """Brings ``cluster`` and the bounds up to date, in place; how many rows had to be compared with all centroids.

    ``upper`` is at least the distance to the own centroid, ``lower`` at most that to the second nearest. While the first is under the
    second, or under half the way to the nearest other centroid, the own centroid is the only nearest one.
    """
    k = len(centroids)
    between = np.sqrt(exact(centroids, centroids).astype(float))
    np.fill_diagonal(between, np.inf)
    safe = np.maximum(lower, between.min(axis=1)[cluster] / 2 * (1 - SLACK))
    doubtful = np.flatnonzero(upper >= safe)
    for at in range(0, len(doubtful), SLICE):
        rows = doubtful[at : at + SLICE]
        d = x[rows] - centroids[cluster[rows]]
        upper[rows] = np.sqrt(np.einsum("ij,ij->i", d, d).astype(float)) * (1 + SLACK)
    doubtful = doubtful[upper[doubtful] >= safe[doubtful]]
    for at in range(0, len(doubtful), SLICE):
        rows = doubtful[at : at + SLICE]
        d = exact(x[rows], centroids)
        cluster[rows] = d.argmin(axis=1)  # the first of equal ones
        two = np.sort(d, axis=1)[:, :2].astype(float) ** 0.5
        upper[rows] = two[:, 0] * (1 + SLACK)
        lower[rows] = two[:, 1] * (1 - SLACK) if k > 1 else np.inf
    return len(doubtful)


def loosen(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
    """Bounds that hold after centroids have moved, in place."""
    d = new - old
    drift = np.sqrt(np.einsum("ij,ij->i", d, d).astype(float)) * (1 + SLACK)
    upper += drift[cluster]
    upper *= 1 + SLACK
    most = np.array([max((drift[j] for j in range(len(drift)) if j != i), default=0.0) for i in range(len(drift))])
    lower -= most[cluster]
    lower -= SLACK * np.abs(lower)


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), size).astype(np.int64)


STATE = "vec_id long, x array<int>, cluster int, upper double, lower double, distance long"


def round_of(state: DataFrame, old: np.ndarray | None, new: np.ndarray, last: bool = False) -> DataFrame:
    """``state`` assigned to the centroids ``new``; its bounds, if it has any, were right for ``old``. ``last``: with the exact distance."""
    size = new.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"), size)
            if old is None:
                cluster, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
            else:
                cluster, upper, lower = b.column("cluster").to_numpy().astype(np.int64), b.column("upper").to_numpy().copy(), b.column("lower").to_numpy().copy()
                loosen(cluster, upper, lower, old, new)
            assign(x, cluster, upper, lower, new)
            d = x - new[cluster]
            distance = pa.array(np.einsum("ij,ij->i", d, d)) if last else pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), distance], ["vec_id", "x", "cluster", "upper", "lower", "distance"])

    return state.mapInArrow(run, STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the exact means of all clusters; empty ones stay as they are."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches:
            cluster = b.column("cluster").to_numpy()
            x = _matrix(b.column("x"), size)
            for j in np.unique(cluster):
                own = cluster == j
                n[j] += own.sum()
                sums[j] += x[own].sum(axis=0)
        met = np.flatnonzero(n)
        at = np.tile(np.arange(size), len(met))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(met, size)), pa.array(at), pa.array(sums[met].ravel()), pa.array(np.repeat(n[met], size))], ["cluster", "at", "x", "n"])

    # a task sends a row per cluster and component; sums of them could pass 64 bits, so they are decimals
    parts = state.select("x", "cluster").mapInArrow(run, "cluster long, at long, x long, n long")
    sums = parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return out


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """Clusters of the vectors that :func:`whole_vectors` keeps: vec_id, cluster, distance (squared), cluster_inertia, inertia (sums of
    distances) and centroid_sha256 (of the final centroid's components in decimal, joined by commas).

    Vectors are assigned and centroids replaced ``rounds`` times, then vectors are assigned once more. Ties go to the smaller number. Fewer
    vectors than ``k`` give fewer centroids. Repeated rows count each for itself, a null vec_id is kept, other columns aren't read;
    an empty table, or one without a whole vector, gives no rows.
    """
    state = save_table(whole_vectors(vectors, size, scale), "vectors")
    new, old = first_centroids(state, k, seed), None
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(new):
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        state = save_table(round_of(state, old, new), "assigned")
        old, new = new, means(state, new)
    state = save_table(round_of(state, old, new, last=True), "assigned")
    inertia = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row per cluster
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in new]
    found = vectors.sparkSession.createDataFrame([(j, d, sum(inertia.values()), digest[j]) for j, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(found), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> str:
    """What :func:`cluster_vectors` gives for embeddings, in DuckDB."""
    parts = [f"""
with recursive kept as (
    select vec_id, list_transform(embedding, lambda v: floor({scale} * v::double)::bigint) as x from embeddings
    where len(embedding) = {size} and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = {size}),
cells as materialized (select vec_id, unnest(x) as v, unnest(range({size})) as i from kept),
c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as cluster, x from kept qualify cluster < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""
d{i} as materialized (
    select vec_id, cluster, sum((v - c) * (v - c))::bigint as distance from cells join (select cluster, unnest(x) as c, unnest(range({size})) as i from c{i}) using (i) group by vec_id, cluster
    qualify row_number() over (partition by vec_id order by distance, cluster) = 1)""")
        if i < rounds:
            parts.append(f"""
c{i + 1} as materialized (
    select cluster, coalesce(m.x, c.x) as x from c{i} c left join (
        select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as x from (select cluster, i, sum(v) as s, count(*) as n from cells join d{i} using (vec_id) group by all) group by cluster) m using (cluster))""")
    return ",".join(parts) + f"""
select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, sha256(array_to_string(x, ',')) as centroid_sha256
from d{rounds} join c{rounds} using (cluster)"""


SQL = sql()
