"""Near-duplicate vectors by an inverted multi-index: codebooks on both halves form a grid of cells, searches visit the nearest."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_salted, save_table
from .components import UnionFind, components

#: Vectors from which the codebooks are fitted, and a sample of queries that sets how far searches go, at most.
MAX_SAMPLE, MAX_PROBES = 20_000, 2_000
#: Vectors that a cell of the grid should have.
CELL = 64
#: Vectors on either side of a unit of verification at most.
UNIT_DATA, UNIT_QUERIES = 2_000, 8_000
#: Rows that are compared with all codes at once.
SLICE = 500
#: Parts into which the rows of a cell are dealt where they meet its size.
SALTS = 64


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows (which are in the order of a hash)."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        near = np.concatenate([np.argmin((c**2).sum(1) - 2 * x[i : i + SLICE] @ c.T, axis=1) for i in range(0, len(x), SLICE)])
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.r_[0, np.cumsum(n[n > 0])[:-1]], axis=0)
        c[n > 0] = sums / n[n > 0][:, None]
    return c


def multi_sequence(far_a: np.ndarray, far_b: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Cells (first code, second code) by rising sum of their halves' distances, as far as ``most``.

    Both codebooks are sorted by distance; a heap holds the next cells. A cell is pushed when its neighbours before it in
    both orders have been visited, so the heap stays small and no cell beyond the last one is looked at.
    """
    near_a, near_b = np.flatnonzero(far_a <= most), np.flatnonzero(far_b <= most)
    order_a, order_b = near_a[np.argsort(far_a[near_a], kind="stable")].tolist(), near_b[np.argsort(far_b[near_b], kind="stable")].tolist()
    a, b = far_a[order_a].tolist(), far_b[order_b].tolist()
    heap, seen, out = [(a[0] + b[0], 0, 0)] if a and b else [], [0] * len(a), []  # seen: how many of each row's cells are visited
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > most:
            break
        out.append((order_a[i], order_b[j]))
        seen[i] = j + 1
        if i + 1 < len(a) and seen[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or seen[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return out


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of both halves by vectors' length, and the sum of squared distances at which searches stop."""

    codebooks: dict[int, tuple[np.ndarray, np.ndarray]]
    reach: dict[int, float]

    def halves(self, x: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For each half the nearest code, and for every code the square of how far a vector must move at least for it to be the nearest."""
        d = x.shape[1]
        books = self.codebooks.get(d) or (np.zeros((1, d // 2)), np.zeros((1, d - d // 2)))
        out = []
        for part, c in zip((x[:, : d // 2], x[:, d // 2 :]), books, strict=True):
            far = (part**2).sum(1)[:, None] - 2 * part @ c.T + (c**2).sum(1)
            own = np.argmin(far, axis=1)
            apart = np.sqrt(np.maximum((c**2).sum(1)[:, None] - 2 * c @ c.T + (c**2).sum(1), 1e-18))
            out.append((own, (np.maximum(far - far[np.arange(len(x)), own][:, None], 0) / (2 * apart[own])) ** 2))
        return out[0], out[1]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both codes of each vector's own cell, and the visits of all searches: row, first code, second code."""
        (a, far_a), (b, far_b) = self.halves(x)
        most = self.reach.get(x.shape[1], 0.0) + 1e-12
        found = [multi_sequence(fa, fb, most) for fa, fb in zip(far_a, far_b, strict=True)]
        row = np.repeat(np.arange(len(x)), [len(f) for f in found])
        codes = np.array([c for f in found for c in f], np.int64).reshape(-1, 2)
        return a, b, row, codes[:, 0], codes[:, 1]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that squares neither vanish nor overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows' places and unit vectors, for each length of vectors."""
    sizes = pc.list_value_length(column).to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        own = column if len(at) == len(column) else column.take(pa.array(at))
        yield at, unit(own.flatten().to_numpy().reshape(len(at), d))


def _pair_reach(index: MultiIndex, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of rows the reach from which one of the two searches visits the other's cell."""
    out = [np.empty(0)]
    for start in range(0, len(x), SLICE):
        (ax, fax), (bx, fbx) = index.halves(x[start : start + SLICE])
        (ay, fay), (by, fby) = index.halves(y[start : start + SLICE])
        k = np.arange(len(ax))
        out.append(np.minimum(fax[k, ay] + fbx[k, by], fay[k, ax] + fby[k, bx]))
    return np.concatenate(out)


def _visits(index: MultiIndex, x: np.ndarray, i: np.ndarray, j: np.ndarray, reach: float) -> np.ndarray:
    """Whether the search of row ``j`` visits the cell of row ``i``, pair by pair; a slice of rows at a time."""
    wanted, at = np.unique(i, return_inverse=True)
    codes = np.empty((len(wanted), 2), np.int64)
    for k in range(0, len(wanted), SLICE):
        (a, _), (b, _) = index.halves(x[wanted[k : k + SLICE]])
        codes[k : k + SLICE] = np.stack([a, b], axis=1)
    out = np.empty(len(i), bool)
    order = np.argsort(j, kind="stable")
    rows, first = np.unique(j[order], return_index=True)
    ends = np.append(first, len(j))
    for k in range(0, len(rows), SLICE):
        (_, far_a), (_, far_b) = index.halves(x[rows[k : k + SLICE]])
        own = order[ends[k] : ends[min(k + SLICE, len(rows))]]
        row = np.searchsorted(rows, j[own]) - k
        out[own] = far_a[row, codes[at[own], 0]] + far_b[row, codes[at[own], 1]] <= reach
    return out


def fit_index(vectors: DataFrame, threshold: float, recall: float, max_sample: int = MAX_SAMPLE) -> MultiIndex:
    """Codebooks from a sample of at most ``max_sample`` vectors in the order of a hash, and how far searches go.

    The number of codes is the root of the number of vectors of the largest label by CELL; it is bounded by the sample alone, from which centroids are made.
    Searches go as far as ``recall`` needs among pairs of two kinds: those linked in the sample, and sampled vectors with copies at the
    threshold itself, the noise spread over all directions, and over a few of the data's own. The greater of the two counts.
    """
    n = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    rows = vectors.orderBy(F.xxhash64("rep"), "rep").limit(max_sample).select("label", "v").toArrow()
    labels = np.array(rows.column("label").to_pylist(), object)
    rng, books, reach = np.random.default_rng(1), {}, {}
    codes = max(2, round(math.sqrt(n / CELL)))
    for at, x in _by_length(rows.column("v").combine_chunks()):
        d = x.shape[1]
        books[d] = _kmeans(x[:, : d // 2], codes), _kmeans(x[:, d // 2 :], codes)
        index = MultiIndex(books, reach)
        probes = x[:MAX_PROBES]
        # copies at the threshold: cosine t means a step of length sqrt(1 / t^2 - 1) across
        t = max(min(threshold, 1.0), 1e-3)
        kinds = [rng.normal(size=probes.shape), (x[rng.integers(0, len(x), len(probes))] - x[rng.integers(0, len(x), len(probes))])]
        needed = []
        for noise in kinds:
            noise = noise - (noise * probes).sum(1)[:, None] * probes
            size = np.linalg.norm(noise, axis=1)
            some = size > 1e-9
            copy = probes[some] + noise[some] / size[some][:, None] * math.sqrt(max(1 / t**2 - 1, 0))
            needed.append(_pair_reach(index, probes[some], copy / np.linalg.norm(copy, axis=1)[:, None]))
        linked = []
        for k in range(0, len(probes), 200):
            i, j = np.nonzero(probes[k : k + 200] @ x.T >= threshold)
            same = (labels[at[i + k]] == labels[at[j]]) & (i + k != j)
            linked.append(np.stack([i[same] + k, j[same]]))
        i, j = np.concatenate(linked, axis=1)
        even = np.unique(np.linspace(0, len(i) - 1, min(len(i), max_sample)).astype(int)) if len(i) else []
        needed.append(_pair_reach(index, x[i[even]], x[j[even]]) if len(even) else np.empty(0))
        reach[d] = max((float(np.quantile(r, recall, method="higher")) for r in needed if len(r)), default=0.0)
    return MultiIndex(books, reach)


#: 128 bits of a label and vector, by which rows find their entry; inside, entries are told apart by their number in a written table.
KEY = ["key_a", "key_b"]


def _keys() -> list[Column]:
    return [F.xxhash64("label", "v"), F.xxhash64(F.lit(0x9E3779B9), "v", "label")]


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors with the same label (not null) and a cosine of at least ``threshold``, in double precision, are linked; n_links counts the
    other rows linked directly, component_id is the smallest vec_id that links reach, kept says whether that is the vector
    itself. Pairs found are verified on the vectors; ``recall`` is the share of pairs, at the threshold itself, that searches are to find.

    Rows with equal label and vector are one entry of the index with their number. Every entry is indexed, in the cell of its two codes, and
    searches the cells that a multi-sequence traversal visits until the sum of distances from which :func:`fit_index` measured
    ``recall``. A unit is a label's cell with the searches that visit it; large ones are dealt into parts on both sides. A unit
    returns numbers of links and a forest, never pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label or vec_id, are linked with
    nothing: n_links 0, component_id their own vec_id. Vectors of different lengths are not linked. Rows that repeat a vec_id count
    as vectors of their own, each linked by its own vector. An empty table gives no rows.
    """
    v = F.col("embedding").cast("array<double>")
    # neither a null nor a non-finite component; not all of them zero
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(F.coalesce(sound, F.lit(False)), v).alias("v"))
    entries = rows.filter("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many")).withColumns(dict(zip(KEY, _keys(), strict=True)))
    entries = save_table(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")
    index = fit_index(entries, threshold, recall)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the cell that holds an entry, and one for each cell that its search visits."""
        for b in batches:
            for at, x in _by_length(b.column("v")):
                for start in range(0, len(at), 500):
                    a, b_, row, first, second = index.cells(x[start : start + 500])
                    rows = b.take(pa.array(at[start : start + 500]))
                    part = rows.take(pa.concat_arrays([pa.array(np.arange(len(a))), pa.array(row)]))
                    is_query = np.r_[np.zeros(len(a), bool), np.ones(len(row), bool)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.r_[a, first], pa.int32()), pa.array(np.r_[b_, second], pa.int32()), pa.array(is_query)], [*part.schema.names, "first", "second", "is_query"])

    dealt = save_table(entries.select("label", "rep", "many", "entry", "v").mapInArrow(deal, "label string, rep long, many long, entry long, v array<double>, first int, second int, is_query boolean"), "dealt")
    cell = ["label", "first", "second"]
    size = dealt.groupBy(*cell).agg(F.ceil(F.count_if(~F.col("is_query")) / UNIT_DATA).cast("int").alias("s"), F.ceil(F.count_if("is_query") / UNIT_QUERIES).cast("int").alias("t"))
    own = F.when(F.col("is_query"), F.pmod(F.xxhash64("entry", F.lit(1)), "t")).otherwise(F.pmod(F.xxhash64("entry", F.lit(1)), "s")).cast("int")
    whole = join_salted(dealt, save_table(size.filter("s > 0 and t > 0"), "sizes"), cell, "entry", SALTS).withColumn("own", own)
    whole = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("is_query"), F.col("s")).otherwise(F.col("t")) - 1)))
    whole = whole.select(*cell, F.when(F.col("is_query"), F.col("other")).otherwise(F.col("own")).alias("s"), F.when(F.col("is_query"), F.col("own")).otherwise(F.col("other")).alias("t"), "rep", "many", "entry", "v", "is_query")

    def verify(unit_: pa.Table) -> pa.Table:
        ids, many, entry, query = (unit_.column(c).to_numpy() for c in ("rep", "many", "entry", "is_query"))
        nodes = list(zip(ids.tolist(), entry.tolist(), strict=True))
        total, found = np.zeros(len(ids), np.int64), UnionFind()
        for at, x in _by_length(unit_.column("v").combine_chunks()):
            reach = index.reach.get(x.shape[1], 0.0) + 1e-12
            d, q = np.flatnonzero(~query[at]), np.flatnonzero(query[at])
            for k in range(0, len(q), 1_000):
                block = q[k : k + 1_000]
                i, j = np.nonzero(x[block] @ x[d].T >= threshold)
                i, j = block[i], d[j]
                other = entry[at[i]] != entry[at[j]]
                i, j = i[other], j[other]
                # a pair that both searches find counts here only where the lesser entry searches
                once = entry[at[i]] < entry[at[j]]
                later = np.flatnonzero(~once)
                once[later] = ~_visits(index, x, i[later], j[later], reach)
                i, j = i[once], j[once]
                np.add.at(total, at[i], many[at[j]])
                np.add.at(total, at[j], many[at[i]])
                for n, m in zip(at[i].tolist(), at[j].tolist(), strict=True):
                    found.union(nodes[n], nodes[m])
        links = found.links()
        some = np.flatnonzero(total)
        pair = lambda k: pa.array([None] * len(some) + [{"rep": x[k][0], "entry": x[k][1]} for x in links], pa.struct([("rep", pa.int64()), ("entry", pa.int64())]))
        return pa.table({"entry": pa.array([*entry[some].tolist(), *[None] * len(links)], pa.int64()), "n": pa.array([*total[some].tolist(), *[0] * len(links)], pa.int64()), "a": pair(0), "b": pair(1)})

    node = "struct<rep: long, entry: long>"
    result = save_table(whole.groupBy(*cell, "s", "t").applyInArrow(verify, f"entry long, n long, a {node}, b {node}"), "verified")
    counts = result.filter("entry is not null").groupBy("entry").agg(F.sum("n").alias("n"))
    root = components(result.filter("a is not null").select("a", "b"))
    known = entries.select("entry", "rep", "many").join(counts, "entry", "left").join(root.select(F.col("node.entry").alias("entry"), F.col("root.rep").alias("root")), "entry", "left")
    known = known.join(entries.select("entry", *KEY), "entry").select(*KEY, (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "rep").alias("least"))
    # a vector may have any share of the rows
    named = [F.when(F.col("v").isNotNull(), k).alias(name) for name, k in zip(KEY, _keys(), strict=True)]
    out = join_salted(rows.select("vec_id", *named), known, KEY, "vec_id", 1_024, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id and list_cosine_similarity(x.e, y.e) >= 0.93),
reach(vec_id, other) as (select vec_id, vec_id from embeddings union select reach.vec_id, links.b from reach join links on reach.other = links.a),
least as (select vec_id, min(other) as component_id from reach group by vec_id),
n as (select a as vec_id, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from least left join n using (vec_id)
"""
