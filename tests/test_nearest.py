"""Memory and ties of the search in two blocks."""

from __future__ import annotations

import tracemalloc
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa

from sparkwell.operators import retrieval


def search_of(k):
    """What a task runs for a group of ``best_of``."""
    queries = MagicMock()
    retrieval.best_of(queries, MagicMock(), ["q", "c", "d"], k)
    return queries.withColumn().unionByName().groupBy().applyInArrow.call_args[0][0]


def pair(queries, rows):
    both = np.r_[queries, rows].astype(np.float32)
    lists = pa.ListArray.from_arrays(np.arange(0, both.size + 1, both.shape[1], dtype=np.int32), pa.array(both.ravel()))
    return pa.table({"id": np.r_[np.arange(len(queries)), np.arange(len(rows))], "embedding": lists, "query": np.arange(len(both)) < len(queries)})


def test_memory_does_not_follow_the_number_of_queries(spark):
    rng = np.random.default_rng(3)
    search, most = search_of(5), {}
    for n in (1024, 4096):
        own = pair(rng.normal(size=(n, 16)), rng.normal(size=(4096, 16)))
        tracemalloc.start()
        assert search(own).num_rows == 5 * n
        most[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    # the queries themselves and what they have found grow, in all a MB or two
    assert most[4096] < 50e6 and most[4096] - most[1024] < 4e6


def test_ties_and_copies_over_several_slices(spark):
    rng = np.random.default_rng(4)
    few = rng.normal(size=(30, 8)).astype(np.float32)
    # most rows are copies of one vector, also by other lengths; the order is that of ids
    rows = np.where(rng.random((5000, 1)) < 0.8, few[:1], few[rng.integers(0, 30, 5000)]) * 2.0 ** rng.integers(-2, 3, (5000, 1))
    asked = np.r_[few, rng.normal(size=(400, 8)), np.zeros((1, 8))].astype(np.float32)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    far = np.round(np.maximum(0, 1 - unit(asked.astype(float)) @ unit(rows.astype(np.float32).astype(float)).T), 12)
    want = np.lexsort((np.broadcast_to(np.arange(5000), far.shape), far), axis=1)[:, :7]
    found = search_of(7)(pair(asked, rows))
    got = np.array(sorted(zip(found["question_id"].to_pylist(), np.round(found["distance"].to_numpy(), 12), found["article_id"].to_pylist(), strict=True)))
    assert (got[:, 2].reshape(len(asked), 7) == want).all() and np.allclose(got[:, 1].reshape(want.shape), np.take_along_axis(far, want, 1), atol=2e-12)
    assert search_of(7)(pair(asked, rows[:3])).num_rows == 3 * len(asked)
    assert search_of(7)(pair(asked, rows[:0])).num_rows == search_of(7)(pair(asked[:0], rows)).num_rows == 0
