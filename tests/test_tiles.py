"""Vectors are scored a tile at a time: what a task holds does not grow with the queries."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lodestone.operators import retrieval


def lists(x):
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def test_tiles_are_bounded_and_the_best_are_those_of_all():
    random = np.random.default_rng(5)
    docs, queries = random.integers(-2, 3, (6_000, 8)).astype(np.float64), random.integers(-2, 3, (2_000, 8)).astype(np.float64)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + 3_000)), lists(docs[at : at + 3_000])], ["id", "v"]) for at in (0, 3_000)]
    tracemalloc.start()
    found = list(retrieval._kept_best(((ids, queries @ x.T) for ids, x in retrieval._vectors(batches, len(queries))), np.arange(2_000) * 50, 3))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20  # the scores of a batch are 48 MB, and were there several times
    (out,) = found
    got = sorted(zip(*(c.to_pylist() for c in out.columns), strict=True))
    scores = queries @ docs.T
    want = sorted((q * 50, d, scores[q, d]) for q in range(2_000) for d in np.lexsort((np.arange(6_000), -scores[q]))[:3].tolist())
    assert got == want


def test_tiles_cover_all():
    for rows, queries, width in ((1, 1, 1), (10, 1 << 21, 4), (5_000, 700, 64)):
        parts = list(retrieval._tiles(rows, queries, width))
        assert [i for p in parts for i in range(p.start, p.stop)] == list(range(rows))
        assert all((p.stop - p.start) * queries <= max(retrieval.TILE, queries) for p in parts)
