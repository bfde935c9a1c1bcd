"""Ranked lexical search: trees of maxima over ranges of documents, searched best first by branch and bound.

The texts are read once for the terms that items ask for; what is kept is a written table with a row per document. Statistics of the
corpus are sums of it. A task then reads its rows in ranges of bounded size and builds a tree over each: the leaves are
documents, a node has for each term the greatest weight it has below. An item opens the nodes with the highest summed bounds
until none that is left can reach its best documents, which go on to the task's next range. Only a task's best leave it.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_bytes, save_table, slices

#: Documents of a range and the greatest number of its entries; children of a node as a power of two; nodes opened at a time.
RANGE, ENTRIES, FAN_BITS, AT_A_TIME = 16_384, 4_000_000, 3, 64
#: Bytes of items that are searched in one pass over the documents.
ITEM_BYTES = 16_000_000
#: Weights are in thousandths, the saturation is 2 to the length's share 75 of 100.
SCALE, LENGTH_SHARE, SATURATION = 1000, 75, 8

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of one text, with repeats."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


def _words(data: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts (binary) in a row, and which text each belongs to."""
    sizes = pc.binary_length(data).to_numpy()
    at = data.buffers()[1]
    first, last = (int(np.frombuffer(at, np.int32)[i]) for i in (data.offset, data.offset + len(data)))
    folded = data.buffers()[2][first:last].to_pybytes().translate(_FOLD) if last > first else b""
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    texts = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(folded)]).cast(pa.string())
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    row = np.repeat(np.arange(len(data)), pc.list_value_length(split).to_numpy())
    there = pc.not_equal(words, "")  # white space at either end gives empty ones
    return words.filter(there).dictionary_encode(), row[there.to_numpy(zero_copy_only=False)]


def index_documents(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """One row per document: doc_id, n (terms with repeats, of all kinds), terms (numbers in ``terms``, rising) and tfs (how often they occur)."""
    wanted = pa.array(terms, pa.binary()).cast(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8_000_000):
            words, row = _words(b.column("data"))
            number = pc.index_in(words.dictionary, wanted)
            number = pc.fill_null(number, -1).to_numpy()[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
            n = np.bincount(row, minlength=b.num_rows)
            known = number >= 0
            keys, tf = np.unique(row[known] * len(terms) + number[known], return_counts=True)
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(keys // max(1, len(terms)), minlength=b.num_rows))].astype(np.int32))
            numbers = pa.array((keys % max(1, len(terms))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(ends, numbers), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))], ["doc_id", "n", "terms", "tfs"])

    return doc_bytes(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


@dataclass(frozen=True)
class Corpus:
    """How many documents have a term, how many terms all have, and how many documents have each asked term."""

    documents: int
    terms: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(SCALE * math.log((2 * self.documents + 2) / (2 * int(x) + 1))) for x in self.df], np.int64)

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * self.documents // max(1, self.terms)
        return 10**9 * tf // (1000 * tf + SATURATION * m)


def corpus_of(index: DataFrame, n_terms: int) -> Corpus:
    """Sums over all rows; each task sends a row per term that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, totals = np.zeros(n_terms, np.int64), [0, 0]
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=n_terms)
            n = b.column("n").to_numpy()
            totals = [totals[0] + int((n > 0).sum()), totals[1] + int(n.sum())]
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, met]), pa.array(np.r_[totals, df[met]].astype(np.int64))], ["term", "n"])

    sums = index.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in sums.collect()}  # a row per asked term
    df = np.zeros(n_terms, np.int64)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    return Corpus(found.get(-1, 0), found.get(-2, 0), df)


class MaxTree:
    """Over documents 0, 1, ...: level 0 has their weights by term, each level above the maxima of ``1 << FAN_BITS`` nodes.

    A level is sparse: keys (term and node, rising) and values.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, n_docs: int) -> None:
        order = np.lexsort((doc, term))
        term, doc, value = term[order].astype(np.int64), doc[order].astype(np.int64), value[order]
        self.size = [max(1, n_docs)]
        self.keys, self.values = [term * self.size[0] + doc], [value]
        while self.size[-1] > 1:
            doc = doc >> FAN_BITS
            self.size.append(-(-self.size[-1] >> FAN_BITS))
            first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.empty(0, np.int64)
            value = np.maximum.reduceat(value, first) if len(first) else value
            term, doc = term[first], doc[first]
            self.keys.append(term * self.size[-1] + doc)
            self.values.append(value)

    def bounds(self, terms: np.ndarray, weights: np.ndarray, level: int, nodes: np.ndarray, fan: int = 1 << FAN_BITS) -> np.ndarray:
        """Sums of ``weights`` times the maxima of ``terms`` for each of the ``fan`` nodes of ``level`` from each of ``nodes`` on."""
        keys, size = self.keys[level], self.size[level]
        first = np.searchsorted(keys, (terms[:, None] * size + nodes).ravel())
        last = np.searchsorted(keys, (terms[:, None] * size + np.minimum(nodes + fan, size)).ravel())
        many = last - first
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pair = np.repeat(np.arange(len(many)), many)
        which, node = pair // len(nodes), pair % len(nodes)
        out = np.zeros(len(nodes) * fan, np.int64)
        np.add.at(out, node * fan + keys[at] - terms[which] * size - nodes[node], weights[which] * self.values[level][at])
        return out.reshape(len(nodes), fan)


@dataclass
class Best:
    """The k highest scores so far and their documents: falling scores, then rising ids, null ids last."""

    k: int
    score: np.ndarray
    doc: np.ndarray
    null: np.ndarray

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.r_[self.score, score], np.r_[self.doc, doc], np.r_[self.null, null]
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]

    def least(self) -> tuple[int, tuple[bool, int]]:
        """A score below this, or equal to it with an id that isn't less, is of no use."""
        return (int(self.score[-1]), (bool(self.null[-1]), int(self.doc[-1]))) if len(self.score) == self.k else (0, (False, -(2**63)))


def search_tree(tree: MaxTree, doc: np.ndarray, null: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Adds the documents of ``tree`` (ids rising, null ids last) to ``best``; how many nodes were opened.

    The nodes with the highest bounds are opened first, ``AT_A_TIME`` together. One with a bound equal to the least score of
    the best is opened if its first document stands before the last of them.
    """
    top = len(tree.size) - 1
    bound = int(tree.bounds(terms, weights, top, np.zeros(1, np.int64), 1)[0, 0])
    front = [(-bound, top, 0)] if bound else []
    opened = 0
    while front:
        score, last = best.least()
        some: dict[int, list[int]] = {}
        n = 0
        while front and n < AT_A_TIME and -front[0][0] >= score:
            bound, level, node = heapq.heappop(front)
            at = node << FAN_BITS * level
            if -bound > score or (bool(null[at]), int(doc[at])) < last:
                some.setdefault(level, []).append(node)
                n += 1
        if not n:
            if not front or -front[0][0] < score:
                break
            continue
        opened += n
        for level, nodes in some.items():
            if not level:  # a document is its own leaf (a tree of one)
                at = np.array(nodes)
                best.add(np.array([bound_of(tree, terms, weights, x) for x in nodes]), doc[at], null[at])
                continue
            first = np.array(sorted(nodes), np.int64) << FAN_BITS
            bounds = tree.bounds(terms, weights, level - 1, first)
            node, child = np.nonzero(bounds >= max(1, score))
            sums, at = bounds[node, child], first[node] + child
            if level == 1:
                best.add(sums, doc[at], null[at])
            else:
                for b, x in zip(sums.tolist(), at.tolist(), strict=True):
                    heapq.heappush(front, (-b, level - 1, x))
    return opened


def bound_of(tree: MaxTree, terms: np.ndarray, weights: np.ndarray, doc: int) -> int:
    return int(tree.bounds(terms, weights, 0, np.array([doc], np.int64), 1)[0, 0])


def ranked(index: DataFrame, corpus: Corpus, asked: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """item (a number in ``asked``), doc_id and score of each task's k best for each item; those of all are among them.

    ``asked``: numbers of terms, and how often the item has each.
    """
    weights = corpus.weights()
    items = [(t.astype(np.int64), q * weights[t]) for t, q in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best = [Best(k, none, none, none.astype(bool)) for _ in items]

        def search(rows: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(rows).combine_chunks()
            ids = t.column("doc_id").combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            doc = pc.fill_null(ids, 0).to_numpy()
            place = np.empty(len(doc), np.int64)
            order = np.lexsort((doc, null))
            place[order] = np.arange(len(doc))
            lists, n = t.column("terms").combine_chunks(), t.column("n").to_numpy()
            row = np.repeat(np.arange(len(doc)), pc.list_value_length(lists).to_numpy())
            tf = t.column("tfs").combine_chunks().flatten().to_numpy()
            tree = MaxTree(lists.flatten().to_numpy(), place[row], corpus.impacts(tf, n[row]), len(doc))
            for (terms, w), b in zip(items, best, strict=True):
                if len(terms):
                    search_tree(tree, doc[order], null[order], terms, w, b)

        held: list[pa.RecordBatch] = []
        docs = entries = 0
        for b in batches:
            for at in range(0, b.num_rows, RANGE):
                part = b.slice(at, RANGE)
                more = int(pc.sum(pc.list_value_length(part.column("terms"))).as_py() or 0)
                if held and (docs + part.num_rows > RANGE or entries + more > ENTRIES):
                    search(held)
                    held, docs, entries = [], 0, 0
                held, docs, entries = [*held, part], docs + part.num_rows, entries + more
        if held:
            search(held)
        for i, b in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), i)), pa.array(b.doc, mask=b.null), pa.array(b.score)], ["item", "doc_id", "score"])

    found = index.mapInArrow(run, "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents of each item, scores above 0 alone.

    ``docs``: doc_id and text, ``items``: item_id and text; other columns aren't read. Equal scores are ranked by rising doc_id, a
    null id is behind the others; each of repeated documents has a rank of its own. A repeated item (same id and text) is
    one item, items of one id with different texts are ranked apart, a null id is an id. Null texts and those without terms
    find nothing and are not found; an empty table gives no rows. Items come to the driver in blocks of about ``item_bytes``; each
    block is one pass over the documents, so what a task is sent is bounded however many items there are.
    """
    spark = docs.sparkSession
    own = items.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // item_bytes))
    out = None
    for block in range(blocks):
        some = sorted(own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        lists = [terms_of(r["text"]) for r in some]
        terms = sorted({t for x in lists for t in x})
        number = {t: i for i, t in enumerate(terms)}
        asked = [tuple(np.unique(np.array([number[t] for t in x], np.int64), return_counts=True)) for x in lists]
        index = save_table(index_documents(docs, terms), "index")
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(some)], own.select(F.lit(0).cast("long").alias("item"), "item_id").schema)
        found = ranked(index, corpus_of(index, len(terms)), asked, k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = re.compile(_TERM)
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: What :func:`search_documents` gives for benchmark and documents, in DuckDB.
SQL = f"""
with words as (select doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as term from documents),
tfs as (select doc_id, term, count(*)::bigint as tf from words group by all),
sizes as (select doc_id, sum(tf)::bigint as n from tfs group by doc_id),
corpus as (select count(*)::bigint as d, coalesce(sum(n), 0)::bigint as l from sizes),
weights as (select term, floor({SCALE} * ln((2 * d + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tfs, corpus group by term, d),
asked as (select item_id, term, count(*)::bigint as q from (select item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as term from benchmark) group by all),
scores as (
    select item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + {SATURATION} * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * d) // l))))::bigint as score
    from asked join weights using (term) join tfs using (term) join sizes using (doc_id), corpus group by item_id, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scores where score > 0 qualify rank <= 10"""
