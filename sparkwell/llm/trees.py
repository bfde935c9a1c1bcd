"""Small boosted trees for dense features, fitted in numpy on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MAX_BINS = 64


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays; ``feature`` is -1 at leaves, rows with values at most ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            k = np.flatnonzero(inner)
            node = at[k]
            at[k] = np.where(x[k, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return self.value[at]


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: tuple[Tree, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _cuts(column: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring values, or between quantiles where there are many."""
    values = np.unique(column)
    if len(values) > MAX_BINS:
        values = np.unique(np.quantile(column, np.linspace(0, 1, MAX_BINS), method="lower"))
    return (values[1:] + values[:-1]) / 2


def _grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, l2: float, least: int) -> tuple[Tree, np.ndarray]:
    feature, cut, left, right, value = [], [], [], [], []
    fitted = np.empty(len(g))

    def node(rows: np.ndarray, deep: int) -> int:
        me = len(feature)
        for x, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, -rate * g[rows].sum() / (h[rows].sum() + l2))):
            x.append(v)
        best = (1e-9, -1, -1)
        if deep < depth and len(rows) >= 2 * least:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(cuts):
                if len(c):
                    own = bins[rows, j]
                    n = np.cumsum(np.bincount(own, minlength=len(c) + 1))[:-1]
                    gl, hl = (np.cumsum(np.bincount(own, weights=w[rows], minlength=len(c) + 1))[:-1] for w in (g, h))
                    gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
                    gain[(n < least) | (n > len(rows) - least)] = -1
                    if gain[k := int(np.argmax(gain))] > best[0]:
                        best = (gain[k], j, k)
        if best[1] < 0:
            fitted[rows] = value[me]
            return me
        _, j, k = best
        feature[me], cut[me] = j, float(cuts[j][k])
        low = bins[rows, j] <= k
        left[me] = node(rows[low], deep + 1)
        right[me] = node(rows[~low], deep + 1)
        return me

    node(np.arange(len(g)), 0)
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)), fitted


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, l2: float = 1.0, least: int = 5) -> Boosted:
    """Logistic boosting with second-order steps."""
    cuts = [_cuts(x[:, j]) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    z, out = np.full(len(y), start), []
    for _ in range(trees):
        p = sigmoid(z)
        tree, step = _grow(bins, cuts, p - y, p * (1 - p) + 1e-6, depth, rate, l2, least)
        out.append(tree)
        z += step
    return Boosted(start, tuple(out))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a rising step function of the score, to be read by interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, lowest and highest score
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, n, _, high = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m * n) / (b[1] + n), b[1] + n, high
    knots = [(s, m) for m, _, low, high in blocks for s in ((low, high) if high > low else (low,))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])
