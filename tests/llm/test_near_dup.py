from __future__ import annotations

import random

import pytest

from sparkwell.llm import near_dup
from sparkwell.llm.near_dup import keep_one, near_duplicates
from sparkwell.llm.superminhash import Shingler, signatures


def brute(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    moved = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                moved = True
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for size in (1, 1, 1, 40, 6, 3, 90):
        base = [rnd.choice(words) for _ in range(rnd.choice([30, 120, 4]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(k, "The same Text of five words"), (k + 1, "the SAME text  of\tfive words"), (k + 2, None), (k + 3, ""), (k + 4, " "), (k + 5, "a b"), (k + 6, "A b")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("documents", [1000, 12])
def test_links_are_those_of_brute_force(spark, corpus, documents, monkeypatch):
    monkeypatch.setattr(near_dup, "UNIT_DOCUMENTS", documents)  # the smaller bound deals large stars into parts
    got = near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(corpus)


def test_estimates_are_close():
    rnd = random.Random(2)
    a, b = [" ".join(f"w{rnd.randrange(3)}{i}" if i % 10 == 0 else f"w{i}" for i in range(600)).encode() for _ in range(2)]
    x, y = Shingler().sets([a, b])
    true = len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
    s = signatures([x, y, x[:0]], 256)
    assert abs((s[0] == s[1]).mean() - true) < 0.12 and s[2].min() == float("inf")


def test_odd_documents(spark, odd_docs, no_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].component_id is None and by_id[None].kept
    assert by_id[5].component_id == 4 and by_id[7].component_id == 6 and by_id[1].n_shingles == by_id[3].n_shingles == 0
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 9, 10]
    assert near_duplicates(no_docs).count() == 0 and keep_one(no_docs).count() == 0
