from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkwell.llm.differencing import differencing, pack_evenly, windows_of

WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_differencing(sizes: list[int], k: int) -> list[int]:
    """Sums of the parts, by the same rule on lists."""
    parts = [[x] + [0] * (k - 1) for x in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(0), parts.pop(0)
        both = sorted((x + y for x, y in zip(a, b[::-1], strict=True)), reverse=True)
        parts.append([x - both[-1] for x in both])
    return [x - parts[0][-1] for x in parts[0]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=30, unique=True), st.integers(1, 6))
def test_differences_are_those_of_the_plain_rule(sizes, k):
    window = differencing(np.array(sizes), k)
    sums = sorted(np.bincount(window, weights=sizes, minlength=k).astype(int).tolist(), reverse=True)
    plain = plain_differencing(sizes, k)
    assert sums[0] - sums[-1] == plain[0] - plain[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200), st.integers(0, 2000))
def test_windows_hold_every_piece_once(lengths, more):
    lengths = np.array(lengths)
    own, size, window = windows_of(lengths, lengths + more * (lengths % 3), 64)
    assert (np.bincount(own, weights=size) == lengths).all() and (np.diff(own) >= 0).all()
    assert np.bincount(window, weights=size).max() <= 64


def test_little_is_left_to_pad():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2049, 500), np.minimum(2048, rng.lognormal(6.5, 1, 700).astype(int) + 1), np.full(476, 1100), np.full(250, 2047), np.ones(60_000, int)):
        _, size, window = windows_of(lengths, lengths, 2048)
        assert 2048 * (window.max() + 1) - size.sum() < 2048 + 0.012 * size.sum()


def check(rows, docs, capacity):
    """Every id is in one piece, and sequences have no gaps; by the library."""
    library = Tokenizer.from_file(WORDS)
    left = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    want = []
    for r in docs:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append(((r["doc_id"] is None, r["doc_id"] or 0), ids))
    for key, ids in sorted(want, key=lambda x: (x[0], len(x[1]))):
        at = 0
        while at < len(ids):
            piece = next(p for p in left if p[0] == key and p[1] == at and p[4] == len(ids) and p[3] == zlib.crc32(ids[at : at + p[2]].tobytes()))
            left.remove(piece)
            at += piece[2]
        assert at == len(ids)
    assert not left
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= capacity


def test_pieces_are_the_documents(spark, odd_docs, no_docs):
    docs = odd_docs.collect()
    for capacity, windows in ((2048, 256), (100, 3), (1, 2)):
        some = odd_docs if capacity > 1 else odd_docs.filter("doc_id between 1 and 5")
        rows = pack_evenly(some, WORDS, capacity, windows=windows).collect()
        check(rows, docs if capacity > 1 else [r for r in docs if r["doc_id"] is not None and r["doc_id"] <= 5], capacity)
    assert pack_evenly(no_docs, WORDS).collect() == []
    with_ids = pack_evenly(odd_docs, WORDS, 100, with_ids=True).collect()
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in with_ids)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = pack_evenly(docs, WORDS).collect()
    check(rows, docs.collect(), 2048)
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    # beside the last window of the task
    assert sum(2048 - n for n in used.values()) <= 0.01 * sum(used.values()) + 2048
