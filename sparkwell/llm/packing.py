"""Packing of token pieces into sequences: exact complements from an index of length sums, then best fit for the rest.

The plan works on the histogram of lengths, which has at most ``capacity`` rows whatever the input, so the driver's part
doesn't grow. Pieces get their places by their rank among pieces of the same length: ranks come from counts by task, and a
plan's entry covers a range of ranks. No length, however frequent, is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_bytes, kept, save_table, slices
from .word_encoder import WordEncoder

Pattern = tuple[tuple[int, int], ...]  # (length, times), in the order in which they stand in the sequence


class SumIndex:
    """Which lengths are left, and how many pairs of them make each sum."""

    def __init__(self, left: np.ndarray) -> None:
        self.left = left
        self.size = len(left)
        self.there = left > 0
        at = np.flatnonzero(self.there)
        self.pairs = np.zeros(2 * self.size, np.int64)
        for k, a in enumerate(at):
            self.pairs[a + at[k:]] += 1

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if n and not self.left[length]:
            self.pairs[length + np.flatnonzero(self.there)] -= 1
            self.there[length] = False

    def pair(self, total: int, spare: Counter) -> tuple[int, int] | None:
        """Two lengths with this sum, as even as can be, so that short ones stay for later; ``spare`` is spoken for."""
        if total < 2 or not self.pairs[total]:
            return None
        low = np.arange(total // 2, max(0, total - self.size), -1)
        for a in low[self.there[low] & self.there[total - low]]:
            need = spare + Counter((int(a), int(total - a)))
            if all(self.left[x] >= n for x, n in need.items()):
                return int(a), int(total - a)
        return None

    def exact(self, gap: int, first: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap beside a piece of length ``first``."""
        spare = Counter((first,))
        if self.left[gap] >= 1 + (gap == first):
            return (gap,)
        if found := self.pair(gap, spare):
            return found
        third = np.arange(1, gap // 3 + 1)
        third = third[self.there[third] & (self.pairs[gap - third] > 0)][::-1]
        for c in third:
            c = int(c)
            if self.left[c] >= 1 + (c == first) and (found := self.pair(gap - c, spare + Counter((c,)))):
                return (c, *found)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of sequences and how often each is used; together they use every piece of ``counts`` once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left[length] = n
    out: list[tuple[Pattern, int]] = []
    if left[capacity]:
        out.append((((capacity, 1),), int(left[capacity])))
    left = left[:capacity].copy()
    index = SumIndex(left)
    for length in range(capacity - 1, 0, -1):
        while left[length] and (rest := index.exact(capacity - length, length)):
            use = Counter((length, *rest))
            times = int(min(left[x] // n for x, n in use.items()))
            for x, n in use.items():
                index.take(x, n * times)
            out.append((tuple(sorted(use.items(), reverse=True)), times))
    # best fit, longest first; equal bins are handled together
    bins: dict[int, list[tuple[Pattern, int]]] = {}
    open_ = np.zeros(capacity + 1, bool)

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            bins.setdefault(room, []).append((pattern, n))
            open_[room] = True

    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(open_[length:])
            if len(fits):
                room = length + int(fits[0])
                pattern, many = bins[room].pop()
                open_[room] = bool(bins[room])
            else:
                room, pattern, many = capacity, (), n  # as many new ones as there can be need of
            each = min(room // length, n)
            full = min(many, n // each)
            put(room - each * length, (*pattern, (length, each)), full)
            n -= full * each
            if pattern:
                put(room, pattern, many - full)
    out += [x for r in sorted(bins) for x in bins[r]]
    return out


def _ranges(patterns: list[tuple[Pattern, int]], capacity: int) -> dict[int, np.ndarray]:
    """By length, rows (first rank, sequences, first sequence, offset): the ranks from there on go to this pattern."""
    ranked: Counter = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for pattern, n in patterns:
        offset = 0
        for length, times in pattern:
            rows.setdefault(length, []).append((ranked[length], n, base, offset))
            ranked[length] += n * times
            offset += length * times
        base += n
    return {length: np.array(x, np.int64) for length, x in rows.items()}


class Numbering:
    """Ranks of a task's rows among its rows of the same length."""

    def __init__(self) -> None:
        self.seen: dict[int, int] = {}
        self.part = TaskContext.get().partitionId()

    def columns(self, lengths: list[int]) -> list[pa.Array]:
        ranks = []
        for x in lengths:
            ranks.append(n := self.seen.get(x, 0))
            self.seen[x] = n + 1
        return [pa.array([self.part] * len(lengths), pa.int64()), pa.array(ranks, pa.int64())]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Tokens of every text and ``end_id`` behind them, cut into pieces of ``capacity`` where they are longer.

    One row per piece: doc_id, piece (from 0), start, length, ids_crc32 (of little-endian unsigned 32-bit ids), with
    ``with_ids`` also ids (binary), and task_part and task_rank, which :func:`pack` needs. A null or empty text is a piece
    with ``end_id`` alone. Repeated rows are packed each for itself, null ids are kept, other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path))
        numbering = Numbering()
        for b in slices(batches, 2_000_000):
            ids, edges = encoder.flat(b.column("data"))
            ids = np.insert(ids, edges[1:], end_id).astype("<u4")
            starts, sizes = edges[:-1] + np.arange(b.num_rows), np.diff(edges) + 1
            many = -(-sizes // capacity)
            piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            own = np.repeat(np.arange(b.num_rows), many)
            lengths = np.minimum(capacity, sizes[own] - piece * capacity)
            at = 4 * (starts[own] + piece * capacity)
            raw = memoryview(ids).cast("B")
            cut = [raw[i:j] for i, j in zip(at.tolist(), (at + 4 * lengths).tolist(), strict=True)]
            found = [b.column("doc_id").take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(lengths), pa.array(map(zlib.crc32, cut), pa.int64())]
            yield pa.RecordBatch.from_arrays([*found, *([pa.array(map(bytes, cut), pa.binary())] if with_ids else []), *numbering.columns(lengths.tolist())], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "task_part", "task_rank"]
    kinds = ["long", "int", "long", "long", "long", *(["binary"] if with_ids else []), "long", "long"]
    return doc_bytes(docs).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces that have length, task_part and task_rank (both are dropped).

    ``pieces`` is read several times, so it should be a written table. Every piece gets one place, places in a sequence follow each
    other without gaps from 0, and no sequence is longer than ``capacity``. An empty table gives no rows; equal lengths,
    repeated rows and nulls in other columns make no difference.
    """
    by_task = pieces.groupBy("length", "task_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["_n"] for r in by_task.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}  # a row per length
    ranges = _ranges(plan(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("task_part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("length", "task_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = pieces.join(first, ["length", "task_part"]).withColumn("_rank", F.col("task_rank") + F.col("_first"))
    keep = [c for c in pieces.columns if c not in ("task_part", "task_rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                x = int(length[own[0]])
                r = ranges[x]
                row = r[np.searchsorted(r[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + nth % row[:, 1]
                offset[own] = row[:, 3] + nth // row[:, 1] * x
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*keep).schema) + ", sequence_id long, offset long"
    return ranked.select(*keep, "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """:func:`token_pieces` of all texts, written once, with their places."""
    return pack(save_table(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of whole sequences, for pieces packed ``with_ids``; a group has ``capacity`` tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.aggregate("_parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
