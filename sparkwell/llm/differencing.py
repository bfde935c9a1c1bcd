"""Packing by multiway differencing: token pieces are spread over near-equal windows, block by block as a task reads them.

A block has the rests of documents that its windows are made of, about ``windows`` times the capacity in tokens. Blocks are
made of the rows of one task in their order and need no shuffle, so no length or copy of a document, however frequent, is
gathered anywhere, and what a task holds is bounded by a block and one batch of texts.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import doc_bytes, kept, slices
from .word_encoder import WordEncoder

#: Windows of a block, the share of its tokens that is cut into fine pieces at first, their greatest and least length.
WINDOWS, FINE_SHARE, FINE, LEAST = 256, 0.2, 256, 16
#: One token in so many is left free at first where a block has 100 windows or more, as fewer hardly ever do.
SPARE = 500
#: Neighbours with this many tokens together at most are moved as one.
BUNDLE = 32
#: By so many the windows of a block may become more before more of its documents are cut.
RISE = 1


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each size, by Karmarkar and Karp's method for k parts.

    Every size starts as a partition of its own into k parts, all but one empty. The two partitions with the greatest difference
    between their parts are merged, the greatest part of one with the least of the other, until one is left.
    """
    n = len(sizes)
    if k == 1 or not n:
        return np.zeros(n, np.int64)
    heap = [(-int(x), i) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    bits = k.bit_length()
    numbers = np.arange(k)
    parts: dict[int, np.ndarray] = {}  # falling sums less the least of them, of merged partitions
    made: list[tuple[int, int, np.ndarray]] = []

    def take() -> tuple[int, np.ndarray]:
        i = heapq.heappop(heap)[1]
        if i >= n:
            return i, parts.pop(i)
        one = np.zeros(k, np.int64)
        one[0] = sizes[i]
        return i, one

    while len(heap) > 1:
        a, x = take()
        b, y = take()
        # falling sums; the part's number in the low bits makes all keys different, so that any sort gives one order
        keyed = np.sort((x + y[::-1] << bits) + numbers)[::-1]
        order = keyed & (1 << bits) - 1
        both = keyed >> bits
        both -= both[-1]
        parts[n + len(made)] = both
        heapq.heappush(heap, (-int(both[0]), n + len(made)))
        made.append((a, b, order.astype(np.int32)))
    # from the last merge back to the sizes: which window each part has become
    out = np.zeros(n, np.int64)
    windows = {heap[0][1]: np.arange(k)}
    for i in range(n + len(made) - 1, n - 1, -1):
        a, b, order = made[i - n]
        own = np.empty(k, np.int64)
        own[order] = windows.pop(i)
        for j, x in ((a, own), (b, own[::-1])):
            if j < n:
                out[j] = x[0]
            else:
                windows[j] = x
    return out


def fine_lengths(length: int) -> list[int]:
    """Parts of ``FINE`` tokens, then ever half of what is left, down to ``LEAST``."""
    out = []
    while length > 2 * LEAST:
        out.append(min(FINE, (length + 1) // 2))
        length -= out[-1]
    return [*out, length]


def _bundles(lengths: np.ndarray) -> np.ndarray:
    """For each piece the number of its bundle, rising; neighbours are together while they have ``BUNDLE`` tokens at most."""
    ends = np.cumsum(lengths)
    cell = (ends - 1) // BUNDLE
    first = np.r_[True, (cell[1:] != cell[:-1]) | (lengths[1:] > BUNDLE) | (lengths[:-1] > BUNDLE)]
    return np.cumsum(first) - 1


def windows_of(lengths: np.ndarray, doc_tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a block's rests and their windows: (which rest, length, window), pieces of a rest in their order.

    The longest documents are cut into fine pieces, which even out what the whole ones leave: those with ``FINE_SHARE`` of all
    tokens, at first. The count of windows starts with the least and rises while one of them is above the capacity. Where it
    would have to rise by more than ``RISE``, twice as many documents are cut and it starts anew; when all are cut, it rises as far as needed.
    """
    total = int(lengths.sum())
    least = -(-total // capacity)
    share = FINE_SHARE if least > 1 else 0.0
    order = np.argsort(-doc_tokens, kind="stable")
    upto = np.cumsum(lengths[order])
    while True:
        cut = np.zeros(len(lengths), bool)
        cut[order[: int(np.searchsorted(upto, share * total, side="left")) + 1 if share else 0]] = True
        pieces = [fine_lengths(int(x)) if c else [int(x)] for x, c in zip(lengths, cut, strict=True)]
        own = np.repeat(np.arange(len(lengths)), [len(p) for p in pieces])
        size = np.array([x for p in pieces for x in p], np.int64)
        bundle = _bundles(size)
        sums = np.bincount(bundle, weights=size).astype(np.int64)
        k = least if least < 100 else -(-(total + total // SPARE) // capacity)
        while share >= 1 or not share or k <= least + RISE:
            window = differencing(sums, k)
            over = int(np.bincount(window, weights=sums, minlength=k).max()) - capacity
            if over <= 0:
                return own, size, window[bundle]
            # parts are near equal, so each further window takes capacity / k from all
            k += max(1, over * k // (2 * capacity))
        share = min(1.0, 2 * share)


def pack_evenly(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False, windows: int = WINDOWS) -> DataFrame:
    """The ids of every text and ``end_id`` behind them in sequences of at most ``capacity``, with little left to pad.

    One row per piece: doc_id, start (ids of the document before it), length, ids_crc32 (of little-endian unsigned 32-bit ids),
    doc_tokens (with ``end_id``), sequence_id, offset (without gaps from 0), with ``with_ids`` also ids (binary). Documents above the
    capacity fill sequences of their own as long as they can; rests and shorter documents go to :func:`windows_of`. A null or
    empty text has ``end_id`` alone. Repeated rows are packed each for itself, null ids are kept, other columns aren't
    read, an empty table gives no rows. The last block of a task may be small, so each task may leave up to a window unfilled.
    """
    if capacity < 1 or windows < 1:
        raise ValueError("capacity and windows must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path))
        made = TaskContext.get().partitionId() << 40

        def rows(doc: pa.Array, tokens: np.ndarray, start: np.ndarray, ids: np.ndarray, at: np.ndarray, length: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
            """``at``: where pieces begin in ``ids``."""
            raw = memoryview(ids).cast("B")
            cut = [raw[4 * i : 4 * (i + n)] for i, n in zip(at.tolist(), length.tolist(), strict=True)]
            found = [doc, pa.array(start), pa.array(length), pa.array(map(zlib.crc32, cut), pa.int64()), pa.array(tokens), pa.array(sequence), pa.array(offset)]
            return pa.RecordBatch.from_arrays([*found, *([pa.array(map(bytes, cut), pa.binary())] if with_ids else [])], names)

        def block(rest: list) -> pa.RecordBatch:
            nonlocal made
            doc = pa.concat_arrays([r[0] for r in rest])
            tokens, start, length, ids = (np.concatenate([r[i] for r in rest]) for i in (1, 2, 3, 4))
            own, size, window = windows_of(length, tokens, capacity)
            ends = np.cumsum(size)
            inside = ends - size - (np.cumsum(length) - length)[own]
            order = np.argsort(window, kind="stable")
            there = np.bincount(window, weights=size).astype(np.int64)
            offset = np.empty(len(size), np.int64)
            offset[order] = np.cumsum(size[order]) - size[order] - (np.cumsum(there) - there)[window[order]]
            out = rows(doc.take(pa.array(own)), tokens[own], start[own] + inside, ids, ends - size, size, made + window, offset)
            made += len(there)
            return out

        rest: list = []
        room = windows * capacity
        for b in slices(batches, 8_000_000):
            ids, edges = encoder.flat(b.column("data"))
            ids = np.insert(ids, edges[1:], end_id).astype("<u4")
            begin, tokens, doc = edges[:-1] + np.arange(b.num_rows), np.diff(edges) + 1, b.column("doc_id")
            whole = tokens // capacity
            if whole.sum():
                own = np.repeat(np.arange(b.num_rows), whole)
                start = capacity * (np.arange(len(own)) - np.repeat(np.cumsum(whole) - whole, whole))
                yield rows(doc.take(pa.array(own)), tokens[own], start, ids, begin[own] + start, np.full(len(own), capacity), made + np.arange(len(own)), np.zeros(len(own), np.int64))
                made += len(own)
            length = tokens - capacity * whole
            some = np.flatnonzero(length)
            while len(some):
                n = max(1, int(np.searchsorted(np.cumsum(length[some]), room, side="right")))
                now, some = some[:n], some[n:]
                at = begin[now] + capacity * whole[now]
                size = length[now]
                flat = ids[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                rest.append((doc.take(pa.array(now)), tokens[now], capacity * whole[now], size, flat))
                room -= int(size.sum())
                if len(some) or room <= 0:
                    yield block(rest)
                    rest, room = [], windows * capacity
        if rest:
            yield block(rest)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return doc_bytes(docs).mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))
