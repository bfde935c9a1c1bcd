from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from sparkwell.llm import centroids as C


def brute(rows, k, rounds, size, scale, seed):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == size and all(v is not None and math.isfinite(v) for v in e):
            kept.append((i, [max(-(2**27), min(2**27, math.floor(scale * v))) for v in e]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    c = [x for _, x in sorted(kept, key=key)[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda x: min(range(len(c)), key=lambda j: (far(x, c[j]), j))
    for _ in range(rounds):
        own = [nearest(x) for _, x in kept]
        c = [[sum(v) // len(v) for v in zip(*g, strict=True)] if (g := [x for (_, x), o in zip(kept, own, strict=True) if o == j]) else c[j] for j in range(len(c))]
    own = [(i, nearest(x), x) for i, x in kept]
    d = [(i, j, far(x, c[j])) for i, j, x in own]
    return sorted(((i, j, y, sum(z for _, o, z in d if o == j), sum(z for *_, z in d), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, y in d), key=repr)


def got(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (1, 2), (3, 0), (5, 6)])
def test_is_brute_force(spark, k, rounds):
    rng = np.random.default_rng(k)
    rows = [(i, [float(v) for v in np.float32(rng.normal(size=4) * (0.2 + i % 3))]) for i in range(150)]
    rows += [(i, [0.25, 0.5, -0.25, 0.0]) for i in range(200, 260)]  # copies
    rows += [(3, [0.1, 0.2, 0.3, 0.4]), (3, [0.1, 0.2, 0.3, 0.4]), (3, [1.0, 0.2, 0.3, 0.4]), (None, [0.5, 0.5, 0.5, 0.5]), (None, [0.0, 0.0, 0.0, 1.0])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, 2.0, 3.0, 4.0, 5.0]), (904, [1.0, None, 3.0, 4.0]), (905, [1.0, float("nan"), 3.0, 4.0]), (906, [1.0, float("inf"), 3.0, 4.0]), (907, [3e38, -3e38, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cluster", "2 as x", "3 as `upper`", "4 as distance")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], k, rounds, 4, 64, 1)
    assert got(C.cluster_vectors(df.repartition(3), k, rounds, size=4)) == want


def test_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert C.cluster_vectors(empty).collect() == []
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [4.0, 2.0])], "vec_id long, embedding array<double>")
    assert got(C.cluster_vectors(two, 16, 3, size=2)) == brute([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [4.0, 2.0])], 16, 3, 2, 64, 1)


def test_bounds_spare_scans_and_hold():
    rng = np.random.default_rng(1)
    middle = rng.integers(-1000, 1000, (8, 16))
    x = middle[rng.integers(0, 8, 4000)] + rng.integers(-60, 60, (4000, 16))
    c = x[:8].copy()
    cluster, upper, lower = np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros(4000)
    scans = []
    for _ in range(6):
        scans.append(C.assign(x, cluster, upper, lower, c))
        d = C.exact(x, c)
        assert (cluster == d.argmin(axis=1)).all()
        two = np.sqrt(np.sort(d, axis=1)[:, :2])
        assert (upper >= two[:, 0]).all() and (lower <= two[:, 1]).all()
        new = np.array([x[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(8)])
        C.loosen(cluster, upper, lower, c, new)
        c = new
    assert scans[0] > 3900 and scans[-1] < 1000
