from __future__ import annotations

import duckdb
import numpy as np
import pytest

from sparkwell.llm import embedding_dup
from sparkwell.llm.embedding_dup import SQL, embedding_duplicates


@pytest.mark.parametrize("bounds", [(2000, 8000), (40, 60)])
def test_links_are_those_of_brute_force(spark, bounds, monkeypatch):
    monkeypatch.setattr(embedding_dup, "UNIT_DATA", bounds[0])
    monkeypatch.setattr(embedding_dup, "UNIT_QUERIES", bounds[1])
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [(k, (base[k % 60] + rng.normal(size=32) * rng.uniform(0, 0.07)).astype(np.float32).tolist(), k % 60 % 3) for k in range(420)]
    rows += [(k, rows[0][1], 0) for k in range(420, 500)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    root = np.arange(len(rows))
    for _ in range(20):
        root = np.minimum(root, np.where(link, root, len(rows)).min(axis=1))
    got = {r.vec_id: r for r in embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    found = np.array([got[k].n_links for k in range(len(rows))])
    assert found.sum() >= 0.99 * link.sum() and (found <= link.sum(axis=1)).all()
    assert (np.array([got[k].component_id for k in range(len(rows))]) == root).mean() > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0, 3.0], 1), (None, [1.0, 2.0], 1), (11, [1e-40, 2e-40], 1), (12, [-1.0, -2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as v", "2 as entry", "3 as n_links")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id) for r in embedding_duplicates(df).collect())
    alone = [(k, 0, k) for k in (1, 2, 3, 4, 5, 6, 7, 10, 12)]
    assert got == sorted([(0, 0, None), *alone, (8, 3, 8), (9, 3, 8), (9, 3, 8), (11, 3, 8)])
    assert embedding_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["even", "few directions", "one direction"])
def test_recall_on_a_grid_of_many_cells(spark, kind, monkeypatch):
    """Pairs at the threshold itself, 40 codes on each half; noise spread over all directions, along four, and along one."""
    monkeypatch.setattr(embedding_dup, "CELL", 2)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(1600, 48))
    base /= np.linalg.norm(base, axis=1)[:, None]
    few = np.linalg.qr(rng.normal(size=(48, 4 if kind == "few directions" else 1)))[0]
    noise = rng.normal(size=base.shape) if kind == "even" else rng.normal(size=(1600, few.shape[1])) @ few.T
    noise -= (noise * base).sum(1)[:, None] * base
    noise *= rng.uniform(0.3, 0.394, size=(1600, 1)) / np.linalg.norm(noise, axis=1)[:, None]
    rows = [(k, x.tolist(), k % 2) for k, x in enumerate(base)] + [(1600 + k, x.tolist(), k % 2) for k, x in enumerate(base + noise)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.93) & (np.arange(3200)[:, None] % 2 == np.arange(3200) % 2)
    np.fill_diagonal(link, False)
    got = {r.vec_id: r.n_links for r in embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = np.array([got[k] for k in range(3200)])
    assert link.sum() > 2500 and (found <= link.sum(axis=1)).all() and found.sum() >= 0.99 * link.sum()


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = np.round(rng.random(9), 1), np.round(rng.random(7), 1)
        a[3] = b[2] = 0
        visited = embedding_dup.multi_sequence(a, b, 0.8)
        sums = [a[i] + b[j] for i, j in visited]
        assert sums == sorted(sums) and set(visited) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.8} and len(set(visited)) == len(visited)


def test_a_repeated_id_is_linked_by_its_own_vector(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (5, [1.0, 0.1, 0.0], 0), (5, [0.0, 0.0, 1.0], 0), (6, [0.0, 0.1, 1.0], 0)]
    got = embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (5, 1, 1), (5, 1, 5), (6, 1, 5)]


def test_sql_on_a_table_with_links(spark, tmp_path):
    """The given tables have no pair above the threshold, so the SQL is tried on one that has many."""
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(40, 16))
    rows = []
    for k in range(400):
        x = middle[k % 40] + rng.normal(size=16) * (0.02 if k % 3 else 0.35)
        rows.append((k, [float(v) for v in np.float32(x)], None if k % 57 == 0 else int(k % 40 % 5)))
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(0, 400, 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    table.write.parquet(str(tmp_path / "embeddings"))
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings/*.parquet'")
    want = sorted(duck.execute(SQL).fetchall())
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_duplicates(spark.read.parquet(str(tmp_path / "embeddings"))).collect())
    assert sum(r[1] for r in want) > 1000 and got == want
