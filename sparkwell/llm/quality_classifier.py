"""Quality by a sparse rule ensemble: tree paths become conjunctive rules, a lasso weighs them, Spark columns apply them."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_nothing
from .labels import fold, sample_documents, sample_ids
from .trees import Tree, fit_boosted, sigmoid

#: At most so many labelled documents are used for fitting.
MAX_LABELLED = 20_000
STATISTICS = ["words", "word_length", "long_words", "symbols", "bars", "shouts", "capitals", "digits", "stops", "commas", "distinct", "adjacent", "lines", "line_length", "repeated_lines", "wide"]
_CLASSES = [b"#*$%&<>{}^~=_\\", b"|", b"!?", bytes(range(65, 91)), b"0123456789", b".", b",;:"]
_class_rows = np.zeros((len(_CLASSES) + 2, 256))
for _k, _chars in enumerate(_CLASSES):
    _class_rows[_k, list(_chars)] = 1
_class_rows[len(_CLASSES), 192:] = 1  # first bytes of characters beyond ASCII
_class_rows[len(_CLASSES) + 1] = 1 - (np.arange(256) // 64 == 2)  # characters
_capital = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")


def statistics(data: bytes) -> list[float]:
    """Of a text's UTF-8 bytes: densities by character or word, so that they don't depend on its length (but for ``words``)."""
    words = data.split()
    n = len(words)
    symbols, bars, shouts, capitals, digits, stops, commas, wide, size = (_class_rows @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)).tolist()
    capitals += len(_capital.findall(data)) if wide else 0
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    size, some, rows = max(size, 1), max(n, 1), max(len(lines), 1)
    lengths = list(map(len, words))
    return [
        math.log1p(n), sum(lengths) / some, sum(x > 20 for x in lengths) / some, symbols / size, bars / some, shouts / some, capitals / size, digits / size, stops / some, commas / some,
        len(set(words)) / some, sum(map(eq, words, words[1:])) / some, math.log1p(len(lines)), math.log1p(size / rows), 1 - len(set(lines)) / rows, wide / size,
    ]


def _statistics_of(data: pa.Array) -> pa.Array:
    keep_nothing("quality")
    found = np.array([statistics(x.as_py()) for x in data]).reshape(-1, len(STATISTICS))
    return pa.StructArray.from_arrays([pa.array(c) for c in found.T], STATISTICS)


def _statistics_once(data: Column) -> Column:
    """A struct of the statistics; a filter on it must not run the function again, so it isn't called deterministic."""
    return F.arrow_udf(_statistics_of, f"struct<{', '.join(f'{x}: double' for x in STATISTICS)}>").asNondeterministic()(data)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most, cut): all must hold


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, statistic: Column) -> Column:
        """The score of a struct of statistics, as one column expression."""

        def holds(rule: Rule) -> Column:
            return reduce(and_, [(statistic[STATISTICS[j]] <= F.lit(cut)) if low else (statistic[STATISTICS[j]] > F.lit(cut)) for j, low, cut in rule])

        z = sum((F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in self.rules), F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def paths(trees: tuple[Tree, ...]) -> list[Rule]:
    """The way to every node but the root, once each; several bounds on a statistic become one on each side."""
    found: dict[Rule, None] = {}

    def walk(t: Tree, node: int, bounds: dict[tuple[int, bool], float]) -> None:
        if bounds:
            found[tuple((j, low, c) for (j, low), c in sorted(bounds.items()))] = None
        if (j := int(t.feature[node])) >= 0:
            cut = float(t.cut[node])
            walk(t, int(t.left[node]), bounds | {(j, True): min(cut, bounds.get((j, True), math.inf))})
            walk(t, int(t.right[node]), bounds | {(j, False): max(cut, bounds.get((j, False), -math.inf))})

    for t in trees:
        walk(t, 0, {})
    return list(found)


def fit_lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an absolute penalty, by accelerated proximal gradient steps; the bias is free."""
    n = len(y)
    a = np.c_[np.ones(n), r]
    step = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = np.zeros(a.shape[1])
    w[0] = np.log(mean / (1 - mean))
    v, t = w.copy(), 1.0
    for _ in range(steps):
        new = v - step * (a.T @ (sigmoid(a @ v) - y) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (before - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 3, penalty: float = 2e-4) -> RuleEnsemble:
    """With one class or no rows there is nothing to learn: the score is that class, or 0.5."""
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble(0.0 if len(y) == 0 else math.copysign(20.0, float(y[0]) - 0.5), ())
    rules = paths(fit_boosted(x, y, trees, depth, rate=0.4).trees)
    held = np.stack([np.all([(x[:, j] <= c) if low else (x[:, j] > c) for j, low, c in rule], axis=0) for rule in rules], 1) if rules else np.zeros((len(y), 0))
    bias, weights = fit_lasso(held.astype(float), y, penalty)
    return RuleEnsemble(bias, tuple((rule, float(w)) for rule, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def learn(docs: DataFrame, labels: DataFrame, trained: Column, most: int = MAX_LABELLED) -> RuleEnsemble:
    """Fits on at most ``most`` labelled documents; only their statistics come to the driver."""
    rows = sample_documents(docs, sample_ids(labels, "quality", trained, most))
    rows = rows.select("doc_id", "_label", _statistics_once(F.col("text").cast("binary")).alias("_s"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("_label", "_s")).alias("_r")).select("doc_id", "_r._label", "_r._s.*").orderBy("doc_id").toPandas()
    return fit(rows[STATISTICS].to_numpy(float).reshape(-1, len(STATISTICS)), rows["_label"].to_numpy(float))


def add_score(docs: DataFrame, model: RuleEnsemble, name: str) -> DataFrame:
    """``docs`` with its columns and the score 0 to 1 of their texts (null: empty)."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*keep, _statistics_once(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("__statistics")).select(*keep, model.column(F.col("__statistics")).alias(name))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Labels of documents with crc32(doc_id) mod 5 = 0 are held out. Scores come from the text alone; null and empty texts
    are scored as texts without words. A null id is not held out. Repeated rows get equal scores; no rows give no rows. Without labels
    every score is 0.5, with labels of one class it is about 0 or 1.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = add_score(own, learn(docs, labels, fold(5) != 0), "score")
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return add_score(docs, learn(docs, labels, fold(5) != 0), "__score").filter(F.col("__score") >= threshold).drop("__score")
