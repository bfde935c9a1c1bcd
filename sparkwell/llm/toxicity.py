"""Toxicity by gradient-boosted trees over dense features of words, calibrated by isotonic regression."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, keep_nothing, pieces, slices
from .labels import fold, sample_documents, sample_ids
from .trees import Boosted, fit_boosted, isotonic, sigmoid

#: At most so many labelled documents are used for fitting, and so many learned terms are kept.
MAX_LABELLED, MAX_TERMS = 20_000, 5_000
#: A learned term stands in at least so many toxic documents, and is so much likelier there (natural logarithm).
LEAST_DOCUMENTS, LEAST_WEIGHT = 4, 2.0
#: Insults known beforehand.
INSULTS = frozenset(b"idiot idiots moron morons stupid dumb loser losers scum trash clown pathetic worthless disgusting imbecile jerk bastard idioten dummkopf arschloch trottel abschaum connard imbecile salaud ordure cretin estupido estupida imbecil basura tonto".split())
#: Second persons in four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestra vuestro".encode().split())
NEAR = 3
#: Parts of the sample that calibration leaves out in turn.
PARTS = 3
_EDGE = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Characters that stand for letters.
_PLAIN = bytes.maketrans(b"013457@$!", b"oieastasi")
_SEPARATORS = b".-_*"
PREFIXES = (4, 5, 6)
FEATURES = ["words", "insults", "insult_share", "terms", "term_share", "weight", "weight_share", "top", "near_second", "second_share", "near_share", "capital_share", "shouted_words", "marks", "stops", "obfuscated", "hidden_insults"]


def bare(word: bytes) -> bytes:
    """Lower case (ASCII) without punctuation around it."""
    return word.lower().strip(_EDGE)


def terms_of(word: bytes) -> list[bytes]:
    """A word itself, and its beginnings by characters, marked with a star."""
    if not word:
        return []
    text = word.decode()
    return [word, *(text[:n].encode() + b"*" for n in PREFIXES if len(text) > n)]


@dataclass
class Lexicon:
    """Learned terms with weights. A worker remembers words' rows of features; equal rows are stored once."""

    weights: dict[bytes, float]

    def __post_init__(self) -> None:
        self.memo, self.rows, self.row_id = Memo(300_000), [], {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.weights = state["weights"]
        self.__post_init__()

    def _row(self, raw: bytes) -> int:
        word = bare(raw)
        weight = max((self.weights.get(t, 0.0) for t in terms_of(word)), default=0.0)
        edged = raw.lower().strip(b",.;:!?\"'()")
        plain = edged.translate(_PLAIN, _SEPARATORS).strip(_EDGE)
        odd = plain != edged and any(65 <= b <= 90 or 97 <= b <= 122 for b in raw) and any(b in b"013457@$!*._-" for b in edged[1:-1])
        hidden = odd and (plain in INSULTS or self.weights.get(plain, 0.0) > 0) and word not in INSULTS
        letters = sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw)
        row = (float(word in INSULTS), weight, float(word in SECOND_PERSON), float(letters > 1 and raw.isupper()), float(odd), float(hidden))
        if row not in self.row_id:
            self.row_id[row] = len(self.rows)
            self.rows.append(row)
        return self.row_id[row]

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Rows of FEATURES."""
        split = [x.split() for x in texts]
        self.memo.learn(set().union(*split), lambda missing: map(self._row, missing))
        row = self.memo.__getitem__
        out = np.zeros((len(texts), len(FEATURES)))
        for k, (data, words) in enumerate(zip(texts, split, strict=True)):
            n = len(words)
            some, size = max(n, 1), max(len(data), 1)
            bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            f = out[k]
            f[0], f[11], f[13], f[14] = math.log1p(n), bytes_[65:91].sum() / size, (bytes_[33] + bytes_[63]) / some, bytes_[46] / some
            if n:
                own = np.fromiter(map(row, words), np.int64, n)
                used, many = np.unique(own, return_counts=True)
                r = np.array([self.rows[i] for i in used])
                insults, terms, second = (float(many[r[:, j] > 0].sum()) for j in (0, 1, 2))
                weight = float((r[:, 1] * many).sum())
                near = 0.0
                if terms + insults and second:
                    at = np.flatnonzero(np.isin(own, used[(r[:, 0] > 0) | (r[:, 1] > 0)]))
                    you = np.flatnonzero(np.isin(own, used[r[:, 2] > 0]))
                    after = np.searchsorted(you, at - NEAR)
                    near = float((you[np.minimum(after, len(you) - 1)] - at <= NEAR)[after < len(you)].sum())
                f[1:11] = insults, insults / some, terms, terms / some, weight, weight / some, r[:, 1].max(), near, second / some, near / max(1.0, terms)
                f[12], f[15], f[16] = (float((r[:, j] * many).sum()) for j in (3, 4, 5))
                f[12:16:3] /= some
        return out


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.knots[0]):
            return np.full(len(texts), self.trees.start)
        z = self.trees.margin(self.lexicon.features(texts))
        # a little of the uncalibrated score keeps the order inside a step
        return np.clip(0.98 * np.interp(z, *self.knots) + 0.02 * sigmoid(z), 0, 1)


def learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """Terms of toxic documents, by counts of documents with each term; tasks count first, a bounded number of terms is kept.

    One lexicon for each of the PARTS, learned from all others, and one learned from all. Terms are counted by part once for all of them.
    """
    names = [f"{name}{k}" for k in range(PARTS) for name in ("toxic", "clean")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing("toxicity")
        for b in slices(batches):
            seen = [Counter() for _ in names]
            for label, part, data in zip(*(b.column(c).to_pylist() for c in ("_label", "_part", "data")), strict=True):
                seen[2 * part + (label <= 0)].update({t for w in {bare(x) for x in data.split()} for t in terms_of(w)})
            terms = [*set().union(*seen)]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *(pa.array([x[t] for t in terms], pa.int64()) for x in seen)], ["term", *names])

    own = sample.select("_label", "_part", F.col("text").cast("binary").alias("data"))
    sizes = {r["_part"]: r for r in sample.groupBy("_part").agg(F.count_if(F.col("_label") > 0).alias("toxic"), F.count_if(F.col("_label") == 0).alias("clean")).collect()}
    found = own.mapInArrow(count, "term binary, " + ", ".join(f"{c} long" for c in names)).groupBy("term").agg(*[F.sum(c).alias(c) for c in names])
    found = found.filter(reduce(add, [F.col(f"toxic{k}") for k in range(PARTS)]) >= LEAST_DOCUMENTS).persist()
    try:
        return [_lexicon(found, sizes, [k for k in range(PARTS) if k != left_out]) for left_out in range(PARTS + 1)]
    finally:
        found.unpersist()


def _lexicon(found: DataFrame, sizes: dict, parts: list[int]) -> Lexicon:
    """The lexicon of the documents in ``parts``."""
    toxic, clean = (reduce(add, [F.col(f"{name}{k}") for k in parts]) for name in ("toxic", "clean"))
    n_toxic, n_clean = (sum(sizes[k][name] for k in parts if k in sizes) for name in ("toxic", "clean"))
    weight = F.log((toxic + 0.5) / F.lit(n_toxic + 1.0)) - F.log((clean + 0.5) / F.lit(n_clean + 1.0))
    rows = found.filter(toxic >= LEAST_DOCUMENTS).select("term", toxic.alias("toxic"), weight.alias("w")).filter(F.col("w") >= LEAST_WEIGHT).orderBy((F.col("w") * F.col("toxic")).desc(), "term").limit(MAX_TERMS).collect()
    return Lexicon({bytes(r["term"]): r["w"] for r in rows})


def features_of(lexicons: list[Lexicon], texts: list[bytes]) -> np.ndarray:
    """By text and lexicon, rows of FEATURES. The words of some megabytes are held at a time, not those of a whole batch."""
    keep_nothing("toxicity")
    found = [np.stack([x.features(some) for x in lexicons], axis=1) for some in pieces(texts)]
    return np.concatenate([np.empty((0, len(lexicons), len(FEATURES))), *found])


def learn(docs: DataFrame, labels: DataFrame, trained: Column, most: int = MAX_LABELLED) -> ToxicityModel:
    """Fits on at most ``most`` labelled documents; only their features and the lexicon come to the driver.

    Calibration uses scores of trees and lexicons that haven't seen the document: three parts by crc32 of the id in turn.
    """
    part = (F.crc32(F.col("doc_id").cast("string")) % 7 % 3).alias("_part")
    sample = sample_documents(docs, sample_ids(labels, "toxic", trained, most)).groupBy("doc_id").agg(F.min(F.struct("_label", "text")).alias("_r")).select("doc_id", "_r.*", part).persist()
    try:
        lexicons = learn_lexicons(sample)

        @F.arrow_udf("array<array<double>>")
        def features(data: pa.Array) -> pa.Array:
            return pa.array(features_of(lexicons, data.to_pylist()).tolist(), pa.list_(pa.list_(pa.float64())))

        # sorted here: a sort in Spark would compute all features a second time, to find its ranges
        rows = sample.select("_label", "_part", "doc_id", features(F.col("text").cast("binary")).alias("_f")).toArrow().sort_by("doc_id")
    finally:
        sample.unpersist()
    y, part_of = rows.column("_label").to_numpy().astype(float), rows.column("_part").to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel(lexicons[-1], Boosted(0.5 if len(y) == 0 else float(y[0]), ()), (np.empty(0), np.empty(0)))
    x = np.array(rows.column("_f").to_pylist(), float)
    z = np.zeros(len(y))
    for k in np.unique(part_of):
        own = part_of == k
        if 0 < y[~own].sum() < (~own).sum():
            z[own] = fit_boosted(x[~own, k], y[~own]).margin(x[own, k])
    return ToxicityModel(lexicons[-1], fit_boosted(x[:, -1], y), isotonic(z, y))


def score_column(model: ToxicityModel) -> Column:
    """The score of the column ``text`` (null: empty)."""

    @F.arrow_udf("double")
    def score(data: pa.Array) -> pa.Array:
        keep_nothing("toxicity")
        return pa.array(np.concatenate([np.empty(0), *map(model.scores, pieces(data.to_pylist()))]))

    return score.asNondeterministic()(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Labels of documents with crc32(doc_id) mod 3 = 1 are held out. Scores come from the text alone; null and empty texts are
    scored as texts without words. A null id is not held out. Repeated rows get equal scores; no rows give no rows. Without labels
    every score is 0.5, with labels of one class it is 0 or 1.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = own.select("doc_id", score_column(learn(docs, labels, fold(3) != 1)).alias("score"))
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*keep, score_column(learn(docs, labels, fold(3) != 1)).alias("__score")).filter(F.col("__score") < threshold).drop("__score")
