from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwell.llm import common, quality_classifier, toxicity
from sparkwell.llm.quality_classifier import STATISTICS, fit, keep_good, score_quality, statistics
from sparkwell.llm.toxicity import FEATURES, INSULTS, SECOND_PERSON, Lexicon, bare, keep_civil, score_toxicity
from sparkwell.llm.trees import fit_boosted, isotonic, sigmoid

SF = "/root/testdata/sf0.01"


def held(scored, labels, name):
    rows = scored.join(labels, "doc_id").filter("held_out").select("predicted", name, "score").collect()
    return np.array([[r[0], r[1], r[2]] for r in rows])


@pytest.mark.parametrize(("score", "name", "least"), [(score_quality, "quality", 0.95), (score_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, score, name, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = score(docs, labels)
    x = held(scored, labels, name)
    assert (x[:, 0] == x[:, 1]).mean() >= least
    assert scored.count() == docs.count() and scored.filter("score < 0 or score > 1 or score is null").count() == 0


@pytest.mark.parametrize(("score", "keep", "name"), [(score_quality, keep_good, "quality"), (score_toxicity, keep_civil, "toxic")])
def test_odd_documents_and_labels(spark, odd_docs, no_docs, score, keep, name):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score(odd_docs, none).collect()} == {0.5}
    kept = keep(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    some = spark.createDataFrame([(2, 0, 1), (4, 1, 0), (4, None, None), (None, 1, 1), (6, 1, 0), (8, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert score(odd_docs, some).count() == odd_docs.count() and score(no_docs, some).count() == 0
    # a document from which both learn: 8 is held out from neither
    assert zlib.crc32(b"8") % 5 != 0 and zlib.crc32(b"8") % 3 != 1
    one = score(odd_docs, some.filter("doc_id = 8")).collect()
    assert all(abs(r.score - (0 if name == "quality" else 1)) < 1e-6 for r in one)


def test_trees_rules_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    assert ((fit_boosted(x, y).margin(x) > 0) == y).mean() > 0.98
    rules = fit(x, y)
    held = np.array([[all((row[j] <= c) if low else (row[j] > c) for j, low, c in rule) for rule, _ in rules.rules] for row in x])
    assert ((sigmoid(rules.bias + held @ np.array([w for _, w in rules.rules])) > 0.5) == y).mean() > 0.97
    knots, values = isotonic(np.array([1.0, 2.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(values) >= 0).all() and np.interp(2.0, knots, values) == 0.5


def some_texts(spark):
    return ["", " \n", "a", "You idiot, YOU m0ron!!", *(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect())]


def test_statistics_are_those_of_brute_force(spark):
    for text in some_texts(spark):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        n, chars = max(len(words), 1), max(len(text), 1)
        want = {
            "words": math.log1p(len(words)), "word_length": sum(len(w.encode()) for w in words) / n, "bars": text.count("|") / n, "stops": text.count(".") / n, "digits": len(re.findall("[0-9]", text)) / chars,
            "distinct": len(set(words)) / n, "adjacent": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "lines": math.log1p(len(lines)), "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1),
        }
        got = dict(zip(STATISTICS, statistics(text.encode()), strict=True))
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), (text, want, got)


def test_features_are_those_of_brute_force(spark):
    lexicon = Lexicon({b"the": 1.5, b"moron": 2.5})
    texts = some_texts(spark)
    for text, row in zip(texts, lexicon.features([t.encode() for t in texts]), strict=True):
        words = [bare(w) for w in text.encode().split()]
        bad = [k for k, w in enumerate(words) if w in INSULTS or lexicon.weights.get(w, 0)]
        you = [k for k, w in enumerate(words) if w in SECOND_PERSON]
        f, n = dict(zip(FEATURES, row, strict=True)), max(len(words), 1)
        weights = [lexicon.weights.get(w, 0.0) for w in words]
        assert f["insults"] == sum(w in INSULTS for w in words) and f["terms"] == sum(w > 0 for w in weights)
        assert abs(f["weight_share"] - sum(weights) / n) < 1e-9 and abs(f["second_share"] - len(you) / n) < 1e-9
        assert f["near_second"] == sum(any(abs(k - j) <= 3 for j in you) for k in bad)
        assert abs(f["marks"] - (text.count("!") + text.count("?")) / n) < 1e-9


def test_features_of_the_sample_are_computed_once(spark, tmp_path, monkeypatch):
    seen = str(tmp_path / "seen")

    class Counting(Lexicon):
        def features(self, texts):
            with open(seen, "a") as f:
                f.write(f"{len(texts)}\n")
            return super().features(texts)

    monkeypatch.setattr(toxicity, "Lexicon", Counting)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").repartition(3), spark.read.parquet(f"{SF}/labels.parquet")
    toxicity.learn(docs, labels, toxicity.fold(3) != 1)
    sample = labels.filter((toxicity.fold(3) != 1) & F.col("toxic").isNotNull()).select("doc_id").distinct().join(docs.select("doc_id").distinct(), "doc_id").count()
    with open(seen) as f:
        assert sum(map(int, f)) == (toxicity.PARTS + 1) * sample


def test_a_worker_drops_what_it_kept_for_other_operators():
    for use in (lambda: quality_classifier._statistics_of(pa.array([b"some text"])), lambda: toxicity.features_of([toxicity.Lexicon({})], [b"some text"])):
        common.kept("words of another operator", dict)
        use()
        assert "words of another operator" not in common._kept


def test_features_hold_the_words_of_some_texts_at_a_time(monkeypatch):
    held = []
    whole = toxicity.Lexicon.features
    monkeypatch.setattr(toxicity.Lexicon, "features", lambda self, texts: held.append(sum(map(len, texts))) or whole(self, texts))
    texts = [b"", b"you idiot " * 50_000, *[b"a fine day, %d " % k * 5_000 for k in range(60)], b"", b"stupid"]
    lexicons = [toxicity.Lexicon({b"day": 2.0}), toxicity.Lexicon({b"stup*": 3.0})]
    got = toxicity.features_of(lexicons, texts)
    assert max(held) <= 2_000_000 and sum(held) == 2 * sum(map(len, texts))
    assert np.array_equal(got, np.stack([whole(x, texts) for x in lexicons], axis=1))
    assert toxicity.features_of(lexicons, []).shape == (0, 2, len(toxicity.FEATURES))
