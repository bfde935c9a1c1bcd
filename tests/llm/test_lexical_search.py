from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import sparkwell.llm.lexical_search as L


def brute(docs, items, k):
    terms = [(i, Counter(w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in L.TERM.findall(t or ""))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    d, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(w for _, c in terms for w in c)
    out = []
    for item, text in sorted(set(items), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        found = []
        for i, c in terms:
            m = 25 + 75 * sum(c.values()) * d // total
            score = 0
            for w in L.TERM.findall(text or ""):
                w = "".join(x.lower() if "A" <= x <= "Z" else x for x in w)
                if w in c:
                    score += math.floor(1000 * math.log((2 * d + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_terms():
    assert L.terms_of("Ab-c 1x\tÉß日本’s\0_Z\x7f~") == [x.encode() for x in ("ab", "c", "1x", "Éß日本’s", "z")]
    assert L.terms_of(None) == L.terms_of(" .") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.dictionaries(st.integers(0, 5), st.integers(1, 9), max_size=5)), max_size=120), st.lists(st.integers(0, 5), min_size=1, unique=True), st.integers(1, 5), st.integers(1, 4))
def test_tree_finds_what_a_scan_finds(rows, asked, k, at_a_time):
    rows.sort(key=lambda r: r[0])  # ids rise, some are equal
    ids, null = np.array([r[0] for r in rows], np.int64), np.zeros(len(rows), bool)
    entries = [(t, d, v) for d, r in enumerate(rows) for t, v in r[1].items()]
    term, doc, value = (np.array(x, np.int64) for x in (zip(*entries, strict=True) if entries else ([], [], [])))
    tree = L.MaxTree(term, doc, value, len(rows))
    none = np.empty(0, np.int64)
    best, weights = L.Best(k, none, none, none.astype(bool)), np.array(asked, np.int64) + 1
    L.AT_A_TIME, before = at_a_time, L.AT_A_TIME
    try:
        if rows:
            L.search_tree(tree, ids, null, np.array(asked, np.int64), weights, best)
    finally:
        L.AT_A_TIME = before
    scores = [(-sum((t + 1) * r[1].get(t, 0) for t in asked), r[0]) for r in rows]
    assert list(zip((-best.score).tolist(), best.doc.tolist(), strict=True)) == sorted(x for x in scores if x[0] < 0)[:k]


def test_few_nodes_are_opened():
    rng = np.random.default_rng(0)
    term, doc = rng.integers(0, 50, 200_000), rng.integers(0, 50_000, 200_000)
    pairs = np.unique(np.c_[term, doc], axis=0)
    value = rng.integers(1, 1000, len(pairs))
    planted = np.flatnonzero((pairs[:, 0] < 5) & (pairs[:, 1] % 5000 < 3))
    value[planted] += 20_000
    tree = L.MaxTree(pairs[:, 0], pairs[:, 1], value, 50_000)
    none = np.empty(0, np.int64)
    best = L.Best(3, none, none, none.astype(bool))
    assert L.search_tree(tree, np.arange(50_000), np.zeros(50_000, bool), np.arange(5), np.ones(5, np.int64), best) < 1500  # of 6250 nodes over documents alone


@pytest.mark.parametrize(("size", "item_bytes"), [(16_384, 10**7), (3, 40)])
def test_odd_rows(spark, odd_docs, no_docs, monkeypatch, size, item_bytes):
    monkeypatch.setattr(L, "RANGE", size)
    items = [(1, "Lorem IPSUM lorem"), (1, "Lorem IPSUM lorem"), (1, "three"), (None, "ten words of text"), (2, None), (3, ""), (4, "nothinglikeit"), (5, "日本語 x it's LINE one"), (6, "one two three " * 50)]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 as item", "2 as doc_id", "3 as `rank`", "4 as score")
    docs = odd_docs.withColumnRenamed("n_words", "item_id")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for k in (1, 3, 10):
        assert got(L.search_documents(docs, asked, k, item_bytes)) == brute(rows, [(i, t or "") for i, t in items], k)
    assert L.search_documents(no_docs, asked).collect() == [] and L.search_documents(docs, asked.limit(0)).collect() == []


def test_copies_and_ties(spark):
    docs = [(i, "alpha beta gamma") for i in range(400, 0, -1)] + [(i, "alpha") for i in range(401, 420)] + [(7, "alpha beta gamma"), (None, "alpha beta gamma")] + [(1000 + i, f"w{i} other words") for i in range(600)]
    items = [(1, "alpha beta"), (2, "gamma"), (3, "words w5 w9")]
    found = L.search_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert got(found) == brute(docs, items, 10)
