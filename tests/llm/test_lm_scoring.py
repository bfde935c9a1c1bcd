from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkwell.llm import lm_scoring
from sparkwell.llm.lm_scoring import CLASSES, LogBilinear, score_documents


def base_scores(rows):
    own = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    learnt = Counter(w for i, words in own if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in words)
    n, v = learnt.total(), len(learnt)
    return sorted((len(w), sum(learnt[x] > 0 for x in w), n, round(sum(math.log10((learnt[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for _, w in own)


@pytest.mark.parametrize("kept", [150_000, 30])
def test_base_is_that_of_brute_force_and_the_model_is_better(spark, kept, monkeypatch):
    monkeypatch.setattr(lm_scoring, "KEPT_WORDS", kept)  # the smaller bound sends most words through the join
    rnd = random.Random(1)
    languages = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    rows = [(k, " ".join(rnd.choice(languages[k % 3]) for _ in range(rnd.randint(0, 120)))) for k in range(4000)]
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base_scores(rows)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in got)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    m = LogBilinear.of(rng.normal(size=len(LogBilinear.start(np.ones(CLASSES)).flat())))
    a, b, z = m.tables()
    p = np.exp(a[[5, CLASSES]].astype(float) + b[[7, 3]] - z[[5, CLASSES], [7, 3]][:, None])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-3)


def test_odd_documents(odd_docs, no_docs):
    got = score_documents(odd_docs).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base_scores([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert score_documents(no_docs).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
