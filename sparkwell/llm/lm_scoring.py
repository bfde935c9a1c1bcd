"""Language-model scores: a log-bilinear model trained in numpy by noise-contrastive estimation, and a unigram base.

Words of a corpus are an open set. The most frequent have a class of their own, the others share classes by their ending; the neural
model predicts classes, and inside a shared class a word's probability comes from its count. Both are normalised, so a
text's score is a log-probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_bytes, save_table, slices
from .labels import fold

#: Classes of single words (the end of a text is one), shared classes, and the vectors' size.
OWN_CLASSES, SHARED_CLASSES, WIDTH = 768, 256, 24
#: Words whose counts every worker has; counts of all others are joined.
KEPT_WORDS = 150_000
#: Rounds over the corpus, tokens of a step, noise words of a step, step size.
ROUNDS, STEP, NOISE, RATE = 2, 2048, 48, 0.25
#: Models of which a task takes the mean.
TREE = 16
#: The end of a text, a word that no text can hold.
END = b""
CLASSES = OWN_CLASSES + SHARED_CLASSES
LN10 = math.log(10)


def shared_class(word: bytes) -> int:
    """By the last three bytes of its letters, which say much about the language and the form."""
    return OWN_CLASSES + xxhash.xxh32_intdigest(word.strip(b".,;:!?\"'()")[-3:]) % SHARED_CLASSES


@dataclass
class Counts:
    """The corpus as every worker knows it: the frequent words' counts, and totals."""

    words: dict[bytes, int]  # the most frequent first
    total: int
    distinct: int
    shared_total: np.ndarray
    shared_distinct: np.ndarray
    class_total: np.ndarray

    def __post_init__(self) -> None:
        own = [w for w in self.words if w != END][: OWN_CLASSES - 1]
        self.own = {END: 0} | {w: k + 1 for k, w in enumerate(own)}

    def __getstate__(self) -> tuple:
        return self.words, self.total, self.distinct, self.shared_total, self.shared_distinct, self.class_total

    def __setstate__(self, state: tuple) -> None:
        self.words, self.total, self.distinct, self.shared_total, self.shared_distinct, self.class_total = state
        self.__post_init__()

    def class_of(self, word: bytes) -> int:
        found = self.own.get(word)
        return shared_class(word) if found is None else found

    def base(self, c: int) -> float:
        return math.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def inside(self, c: int, k: int) -> float:
        """log10 of a word's probability inside its class."""
        k -= OWN_CLASSES
        return 0.0 if k < 0 else math.log10((c + 0.5) / (self.shared_total[k] + 0.5 * (self.shared_distinct[k] + 1)))


@dataclass(frozen=True)
class LogBilinear:
    """The prediction from the two words before is a sum of their vectors, by place; a class's score is its product with that, and a bias."""

    near: np.ndarray  # CLASSES + 1 rows: the last stands before the text
    far: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(class_total: np.ndarray, seed: int = 1) -> LogBilinear:
        rng = np.random.default_rng(seed)
        table = lambda n: (rng.normal(size=(n, WIDTH)) * 0.1).astype(np.float32)
        p = (class_total + 1) / (class_total.sum() + len(class_total))
        return LogBilinear(table(CLASSES + 1), table(CLASSES + 1), table(CLASSES), np.log(p).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in (self.near, self.far, self.out, self.bias)]).astype(np.float32)

    @staticmethod
    def of(flat: np.ndarray) -> LogBilinear:
        a, b, c, d = np.split(flat.astype(np.float32), np.cumsum([(CLASSES + 1) * WIDTH, (CLASSES + 1) * WIDTH, CLASSES * WIDTH]))
        return LogBilinear(a.reshape(-1, WIDTH), b.reshape(-1, WIDTH), c.reshape(-1, WIDTH), d)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by near and far context (the bias is in the first), and the logarithm of the normaliser by both contexts.

        The sum over classes of products of two exponentials is a matrix product.
        """
        a, b = self.near @ self.out.T + self.bias, self.far @ self.out.T
        ma, mb = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        z = np.log(np.exp(a - ma).astype(np.float64) @ np.exp(b - mb).astype(np.float64).T + 1e-300) + ma + mb.T
        return a, b, z.astype(np.float32)


class Trainer:
    """Steps of noise-contrastive estimation with a rate per parameter (Adagrad). Noise words are shared in a step."""

    def __init__(self, model: LogBilinear, noise: np.ndarray, seed: int) -> None:
        self.near, self.far, self.out, self.bias = (x.copy() for x in (model.near, model.far, model.out, model.bias))
        self.squares = [np.full_like(x, 1e-2) for x in (self.near, self.far, self.out, self.bias)]
        self.rng, self.cumulative, self.log_noise = np.random.default_rng(seed), np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)
        self.seen = 0

    def _add(self, k: int, table: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        width = grad.shape[1]
        g = np.bincount((rows[:, None] * width + np.arange(width)).reshape(-1), grad.reshape(-1), table.size).astype(np.float32).reshape(table.shape)
        self.squares[k] += g * g
        table -= RATE * g / np.sqrt(self.squares[k])

    def step(self, word: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        n = np.float32(len(word))
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1], side="right"), CLASSES - 1)
        h = self.near[near] + self.far[far]
        q, qn = self.out[word], self.out[noise]
        offset = self.bias - self.log_noise
        s = np.einsum("ij,ij->i", h, q) + offset[word]
        sn = h @ qn.T
        sn += offset[noise]
        g = -1 / (1 + np.exp(np.clip(s, -30, 30))) / n
        np.clip(sn, -30, 30, out=sn)
        np.exp(np.negative(sn, out=sn), out=sn)
        sn += 1
        gn = np.divide(1 / n, sn, out=sn)
        gh = g[:, None] * q
        gh += gn @ qn
        rows, grads = np.concatenate([word, noise]), np.concatenate([g[:, None] * h, gn.T @ h])
        self._add(0, self.near, near, gh)
        self._add(1, self.far, far, gh)
        self._add(2, self.out, rows, grads)
        b = np.bincount(rows, np.concatenate([g, gn.sum(0)]), CLASSES).astype(np.float32)
        self.squares[3] += b * b
        self.bias -= RATE * b / np.sqrt(self.squares[3])
        self.seen += len(word)


def _coded(data: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of texts (binary): the distinct words (ASCII letters in lower case), which of them each word is, and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(data.cast(pa.string())))
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)  # there is an empty one where a text begins or ends with white space
    owner = np.repeat(np.arange(len(data)), pc.list_value_length(lists).to_numpy())
    coded = words.filter(some).cast(pa.binary()).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.bincount(owner[some.to_numpy(zero_copy_only=False)], minlength=len(data))


def _flat(words: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens (``end`` behind each text), and where texts start."""
    starts = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(len(words) + len(sizes), end, np.int64)
    own = np.ones(len(out), bool)
    own[starts + sizes] = False
    out[own] = words
    return out, starts


def _before(word: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two before; before a text stands CLASSES."""
    near = np.concatenate([[CLASSES], word[:-1]])
    near[starts] = CLASSES
    far = np.concatenate([[CLASSES], near[:-1]])
    far[starts] = CLASSES
    return near, far


class Solved:
    """A worker's rows of numbers by word; it forgets all when there are too many."""

    def __init__(self, limit: int) -> None:
        self.limit, self.ids, self.rows = limit, {}, np.empty((0, 3))

    def learn(self, seen: set[bytes], solve: Callable[[list[bytes]], Iterator[tuple]]) -> None:
        missing = list(seen.difference(self.ids))
        if len(self.ids) + len(missing) > self.limit:
            self.ids, self.rows, missing = {}, self.rows[:0], list(seen)
        if missing:
            self.ids.update(zip(missing, range(len(self.ids), len(self.ids) + len(missing)), strict=True))
            self.rows = np.concatenate([self.rows, np.array([*solve(missing)], np.float64)])


def held_out() -> Column:
    """crc32(doc_id) mod 5 is 1; a null id is not held out."""
    return F.coalesce(fold(5) == 1, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary; the end of texts is empty) and c over all texts of ``docs``, counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for b in slices(batches):
            words, which, _ = _coded(b.column("data"))
            seen.update(dict(zip(words, np.bincount(which, minlength=len(words)).tolist(), strict=True)))
            seen[END] += b.num_rows
            if len(seen) > 300_000:
                yield flush()
        if seen:
            yield flush()

    return doc_bytes(docs).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def gather(vocab: DataFrame) -> Counts:
    """The frequent words, and by class what the rest of the vocabulary sums to; both are bounded, the vocabulary stays a table."""
    top = vocab.orderBy(F.desc("c"), "word").limit(KEPT_WORDS).toArrow()
    words = dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True))
    own = {END, *[w for w in words if w != END][: OWN_CLASSES - 1]}

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct = np.zeros(SHARED_CLASSES + 1, np.int64), np.zeros(SHARED_CLASSES + 1, np.int64)
        for b in batches:
            word = b.column("word").to_pylist()
            k = np.array([SHARED_CLASSES if w in own else shared_class(w) - OWN_CLASSES for w in word], np.int64)
            np.add.at(total, k, b.column("c").to_numpy())
            np.add.at(distinct, k, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SHARED_CLASSES + 1)), pa.array(total), pa.array(distinct)], ["k", "c", "n"])

    rows = vocab.mapInArrow(classes, "k long, c long, n long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()  # a row per class
    total, distinct = np.zeros(SHARED_CLASSES + 1, np.int64), np.zeros(SHARED_CLASSES + 1, np.int64)
    for r in rows:
        total[r["k"]], distinct[r["k"]] = r["c"], r["n"]
    in_order = [words.get(END, 0), *[words[w] for w in words if w in own and w != END]]
    class_total = np.r_[in_order, np.zeros(OWN_CLASSES - len(in_order), np.int64), total[:-1]]
    return Counts(words, int(total.sum()), int(distinct.sum()), total[:-1], distinct[:-1], class_total)


def encode(docs: DataFrame, counts: Counts) -> DataFrame:
    """Every text once: row, doc_id, held_out, n_tokens, data (classes of all tokens, 16 bits each), and what doesn't depend on the model.

    n_known, base_score and inside (log10 of words' probabilities inside their classes) cover the words with known counts;
    ``rare`` has the others, to be joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, solved = shared.value, Solved(300_000)
        row = TaskContext.get().partitionId() << 40

        def solve(missing: list[bytes]) -> Iterator[tuple[int, float, float]]:
            for w in missing:
                c, k = own.words.get(w), own.class_of(w)
                yield (k, math.nan, math.nan) if c is None else (k, own.base(c), own.inside(c, k))

        end = (0, own.base(own.words.get(END, 0)), 0.0)
        for batch in slices(batches):
            distinct, which, sizes = _coded(batch.column("data"))
            solved.learn(set(distinct), solve)
            known_as = np.fromiter(map(solved.ids.__getitem__, distinct), np.int64, len(distinct))
            at, starts = _flat(known_as[which], sizes, -1)
            names, _ = _flat(which, sizes, -1)
            k, m, inside = np.concatenate([solved.rows, [end]])[at].T
            absent = np.isnan(m)
            total = lambda x, at=starts: np.add.reduceat(x, at)  # noqa: E731  every text has a token
            n = total(np.ones(len(k), np.int64))
            known = n - total(absent.astype(np.int64)) - (END not in own.words)
            rare: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            where = np.flatnonzero(absent)
            text_of = np.repeat(np.arange(batch.num_rows), n)[where]
            real = names[where] >= 0
            pairs, x = np.unique((text_of[real] << 32) | names[where][real], return_counts=True)
            for t, w, c in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), x.tolist(), strict=True):
                rare[t].append({"word": distinct[w], "k": int(solved.rows[known_as[w], 0]) - OWN_CLASSES, "n": c})
            classes = k.astype("<i2").tobytes()
            edges = (2 * np.append(starts, len(k))).tolist()
            kinds = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int32()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + batch.num_rows), pa.int64()), batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array([classes[i:j] for i, j in zip(edges, edges[1:], strict=False)], pa.binary()),
                    pa.array(known), pa.array(total(np.nan_to_num(m))), pa.array(total(np.nan_to_num(inside))), pa.array(rare, kinds),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "data", "n_known", "base_score", "inside", "rare"],
            )
            row += batch.num_rows

    return doc_bytes(docs, held_out().alias("held_out")).mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, data binary, n_known long, base_score double, inside double, rare array<struct<word: binary, k: int, n: long>>")


def _decoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens of a batch, and where its texts start."""
    data = batch.column("data").to_pylist()
    sizes = np.fromiter(map(len, data), np.int64, len(data)) // 2
    return np.frombuffer(b"".join(data), "<i2").astype(np.int64), np.cumsum(sizes) - sizes


def train(encoded: DataFrame, counts: Counts) -> LogBilinear:
    """Every task trains on all its texts from the same start; the mean of the tasks' parameters, weighted by tokens, starts the next round.

    Means are taken level by level in groups of TREE models, so no task holds more of them, however many tasks there are.
    """
    spark = encoded.sparkSession
    noise = (counts.class_total + 1.0) ** 0.75
    noise /= noise.sum()
    model = LogBilinear.start(counts.class_total)

    def mean(group: pa.Table) -> pa.Table:
        weight = group.column("weight").to_numpy()
        total = sum(w * np.frombuffer(x, np.float64) for w, x in zip(weight, group.column("flat").to_pylist(), strict=True)) / weight.sum()
        return pa.table({"some": group.column("some").slice(0, 1), "weight": [float(weight.sum())], "flat": pa.array([total.tobytes()], pa.binary())})

    for round_ in range(ROUNDS):
        flat = spark.sparkContext.broadcast(model.flat())

        def run(batches: Iterator[pa.RecordBatch], flat=flat, round_=round_) -> Iterator[pa.RecordBatch]:
            part, trainer = TaskContext.get().partitionId(), None
            for b in slices(batches, 1_500_000):
                # the seed follows the rows' origin, so that it doesn't depend on how files are dealt
                trainer = trainer or Trainer(LogBilinear.of(flat.value), noise, 1_000_003 * round_ + (b.column("row")[0].as_py() >> 40))
                word, starts = _decoded(b)
                near, far = _before(word, starts)
                order = trainer.rng.permutation(len(word))
                for k in range(0, len(word), STEP):
                    at = order[k : k + STEP]
                    trainer.step(word[at], near[at], far[at])
            if trainer:
                done = LogBilinear(trainer.near, trainer.far, trainer.out, trainer.bias)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([float(trainer.seen)]), pa.array([done.flat().astype(np.float64).tobytes()], pa.binary())], ["some", "weight", "flat"])

        kind = "some int, weight double, flat binary"
        rows = encoded.select("row", "data")
        tree, left = rows.mapInArrow(run, kind), rows.rdd.getNumPartitions()
        while left > 1:
            tree, left = tree.withColumn("some", F.floor(F.col("some") / TREE).cast("int")).groupBy("some").applyInArrow(mean, kind), -(-left // TREE)
        found = tree.collect()  # one row
        if found:
            model = LogBilinear.of(np.frombuffer(bytes(found[0]["flat"]), np.float64))
    return model


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text, learning from those not held out.

    Tokens are words (ASCII letters in lower case) and an end. base_score is the log10 probability by smoothed counts, score
    that of the neural model. Null and empty texts are an end alone. Repeated rows are learnt from and scored each for itself; a null id is
    never held out. With nothing to learn from, all words are unknown. An empty table gives no rows.
    """
    vocab = save_table(word_counts(docs.filter(~held_out())), "words")
    counts = gather(vocab)
    encoded = save_table(encode(docs, counts), "encoded")
    flat = docs.sparkSession.sparkContext.broadcast(train(encoded.filter(~F.col("held_out")), counts).flat())
    keep = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, z = LogBilinear.of(flat.value).tables()
        for batch in slices(batches, 1_500_000):
            k, starts = _decoded(batch)
            near, far = _before(k, starts)
            token = a[near, k].astype(np.float64) + b[far, k] - z[near, far]
            score = np.add.reduceat(token, starts) / LN10 + batch.column("inside").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], [*keep, "score"])

    first = encoded.select(*keep, "inside", "data").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    totals = F.array(*[F.lit(float(t + 0.5 * (d + 1))) for t, d in zip(counts.shared_total, counts.shared_distinct, strict=True)])
    rare = encoded.select("row", F.inline("rare")).join(vocab, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.select("row", "n", "c", (F.log10((F.col("c") + 0.5) / F.lit(counts.total + 0.5 * (counts.distinct + 1))) * F.col("n")).alias("_base"), (F.log10((F.col("c") + 0.5) / F.get(totals, F.col("k"))) * F.col("n")).alias("_score"))
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"), F.sum("_base").alias("_base"), F.sum("_score").alias("_score"))
    out = first.join(rare, "row", "left")
    more = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
    return out.select("doc_id", "held_out", "n_tokens", more("n_known", "_known"), F.lit(counts.total).cast("long").alias("train_tokens"), more("base_score", "_base"), more("score", "_score"))
