from __future__ import annotations

import random

import numpy as np
import pytest

from sparkwell.llm import near_dup
from sparkwell.llm.near_dup import keep_one, near_duplicates
from sparkwell.llm.superminhash import signatures

A = "the quick brown fox jumps over the lazy dog while seven wizards mix five dozen jugs of liquor for the queen and her court"
B = "quite another text about the weather of last week which was cold and wet but turned out to be fine in the end after all"


def by_text(df):
    return sorted(((r.doc_id, r.component_id, r.kept) for r in df.collect()), key=str)


def test_a_repeated_id_keeps_its_other_text(spark):
    rows = [(1, A), (5, A + " again"), (5, B)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_text(near_duplicates(docs)) == sorted([(1, 1, True), (5, 1, False), (5, 5, True)], key=str)
    assert sorted((r.doc_id, r.text) for r in keep_one(docs).collect()) == [(1, A), (5, B)]


def test_repeated_rows_and_texts_of_an_id(spark):
    rows = [(3, A, 1), (3, A, 1), (3, A.upper(), 2), (4, A, 3), (7, B, 4), (7, B, 5), (None, A, 6), (8, None, 7), (8, None, 7), (9, "", 8)]
    kept = [(r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string, x int")).collect()]
    assert len(kept) == 6
    assert [d for d, _ in kept].count(3) == 1 and [d for d, _ in kept].count(7) == 1 and kept.count((8, None)) == 2 and (9, "") in kept and (None, A) in kept


def test_links_beyond_the_hub_are_found(spark, monkeypatch):
    """Chains: the ends of each are no near duplicates of the hub, and parts are small."""
    monkeypatch.setattr(near_dup, "UNIT_DOCUMENTS", 4)
    rnd, rows, sets = random.Random(3), [], {}
    for chain in range(3):
        words = [f"c{chain}w{i}" for i in range(80)]
        for k in range(25):
            rows.append((len(rows), " ".join(words)))
            words[rnd.randrange(80)] = f"x{len(rows)}"
    rnd.shuffle(rows)
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}
    for _ in range(80):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == root


def test_texts_are_dealt_once(spark, monkeypatch):
    """Links beyond the hub are looked for among the sets of large stars, not by dealing all texts again."""
    monkeypatch.setattr(near_dup, "UNIT_DOCUMENTS", 4)
    read, own = [], near_dup.doc_bytes
    monkeypatch.setattr(near_dup, "doc_bytes", lambda *a: read.append(1) or own(*a))
    words, rows = [f"w{i}" for i in range(80)], []
    for k in range(25):
        rows.append((k, " ".join(words)))
        words[k * 3] = f"x{k}"
    docs = spark.createDataFrame([*rows, (100, A), (101, A + " again"), (102, B)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == {k: 0 for k in range(25)} | {100: 100, 101: 100, 102: 102}
    assert len(read) == 2  # sketches, shingles


@pytest.mark.parametrize("similarity", [0.5, 0.75])
def test_estimates_vary_less_than_with_independent_ranks(similarity):
    """SuperMinHash: no bias, and a lower variance than the binomial one of plain MinHash (sets not much larger than the signature)."""
    rng = np.random.default_rng(4)
    n, size, found = 200, 256, []
    both = round(2 * n * similarity / (1 + similarity))
    for _ in range(150):
        x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        s = signatures([np.sort(x[:n]), np.sort(x[n - both :])], size)
        found.append((s[0] == s[1]).mean())
    true = both / (2 * n - both)
    plain = (true * (1 - true) / size) ** 0.5
    assert abs(np.mean(found) - true) < 4 * plain / 150**0.5 and np.std(found) < 0.92 * plain
