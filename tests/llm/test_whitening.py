"""Whitening against numpy's own eigenvectors, exact sums, hard rows, and the solver on wide operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n int, _v int, ids int"


def made(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1, 2, 3) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def expected(vectors):
    """Ids, x, and the eigenpairs of x's covariance, by numpy."""
    ids = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vectors[i]] for i in ids], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = ((x * n - s).astype(object) / n).astype(float)
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    deviation = [int(sum(int(t) ** 2 for t in row)) for row in x * n - s]
    return ids, deviation, centred, values[::-1], turn[:, ::-1]


def check(rows, vectors, components=32):
    ids, deviation, centred, values, turn = expected(vectors)
    k = min(components, sum(values > 1e-12 * values[0]))
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == len(ids) * k and {i for i, _ in got} == set(ids)
    for c in range(k):
        want = centred @ turn[:, c] / math.sqrt(values[c])
        have = np.array([got[i, c + 1].whitened for i in ids])
        assert np.abs(have - math.copysign(1, want @ have) * want).max() < 1e-7
    for i, d in zip(ids, deviation):
        r = got[i, 1]
        assert r.deviation == d and r.n == len(ids) and r.identity_error < 1e-9 and r.residual <= 1e-11
        assert abs(r.explained - values[0] / values.sum()) < 1e-9


@pytest.fixture(scope="module")
def vectors():
    random = np.random.default_rng(3)
    x = random.standard_normal((400, 12)) * np.linspace(3, 0.2, 12) + random.standard_normal(12)
    out = [list(v) for v in x] + [list(x[5])] * 150  # a third are copies
    out[7], out[8], out[9], out[10], out[11] = None, [1.0] * 11 + [float("nan")], [1.0] * 11 + [None], [float("-inf")] * 12, []
    return out


def query_like(df, components=32):
    return whitening.whiten(df, "vec_id", "embedding", components, 64, 1_000_000)


def test_against_numpy(spark, vectors):
    check(query_like(made(spark, vectors)).collect(), vectors)
    check(query_like(made(spark, vectors, 1), 4).collect(), vectors, 4)


def test_many_tasks_and_small_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    blocks = whitening.store_blocks(made(spark, vectors, 11), "vec_id", "embedding", 64, 1_000_000)
    assert blocks.agg(F.sum("n")).first()[0] == 545 and blocks.agg(F.max("n")).first()[0] <= 7
    blocks = blocks.repartition(29)
    model = whitening.fit(blocks, 5)
    check(whitening.whitened(blocks, model, "vec_id").selectExpr("*", f"{model.n}L AS n", f"{whitening.identity_error(blocks, model)}D AS identity_error").collect(), vectors, 5)


def test_hard_tables(spark):
    few = [[1.0, 2.0, 3.0]] * 3
    for vectors in ([], [None, []], few, [[1.0, 2.0]]):
        assert query_like(made(spark, vectors)).collect() == []
    thin = [[1.0, 2.0, 3.0], [1.5, 2.0, 3.0], [2.0, 2.0, 4.0], [2.0, 2.0, 4.0]]
    check(query_like(made(spark, thin)).collect(), thin)
    # the most frequent length counts; of two as frequent the longer
    mixed = [*thin, [5.0, 6.0], [1.0]]
    assert {r.vec_id for r in query_like(made(spark, mixed)).collect()} == {0, 1, 2, 3}
    even = [[1.0], [2.0], [1.0, 2.0], [3.0, 5.0]]
    assert {r.vec_id for r in query_like(made(spark, even)).collect()} == {2, 3}
    no_id = made(spark, thin).withColumn("vec_id", F.lit(None).cast("string"))
    assert [r.vec_id for r in query_like(no_id, 1).collect()] == [None] * 4


def test_giant_entries_stay_exact(spark):
    vectors = [[1e30, 1.0], [2e9, 5.0], [-1e30, 2.0], [0.0, 0.0]]
    rows = {r.vec_id: r for r in query_like(made(spark, vectors), 1).collect()}
    assert len(rows) == 4 and rows[0].deviation is None
    assert whitening.deviations(np.array([[10**9, 5]]), 3, [1, -1]) == [(3 * 10**9 - 1) ** 2 + 16**2]
    assert whitening.deviations(np.array([[10**9, 5]]), 4, [0, 0]) == [None]


def test_real_vectors(spark, vectors):
    """Without a scale entries are doubles; the means are as large as they like."""
    good = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    far = [[float(np.float32(c)) + 1e6 for c in v] for v in good]
    df = spark.createDataFrame(list(enumerate(far)), "vec_id long, embedding array<double>").repartition(3)
    rows = whitening.whiten(df, components=3).collect()
    x = np.array(far)
    x = x - x.mean(axis=0)
    values = np.linalg.eigvalsh(x.T @ x / len(x))[::-1]
    assert rows[0].deviation is None and rows[0].identity_error < 1e-6
    assert np.allclose(sorted({r.eigenvalue for r in rows}, reverse=True), values[:3], rtol=1e-8)


@pytest.mark.parametrize("decay", [0.5, 0.02])
def test_wide_operators_converge(decay):
    """Widths far beyond the block: many steps, each with one product."""
    random = np.random.default_rng(1)
    turn = np.linalg.qr(random.standard_normal((300, 300)))[0]
    values = 1 / (1 + np.arange(300) * decay)
    a = turn * values @ turn.T
    products = []
    got, vectors, residuals, steps = whitening.lobpcg(lambda w: products.append(w.shape[1]) or a @ w, 300, 10)
    assert np.allclose(got, values[:10], rtol=1e-12) and residuals.max() <= 1e-11
    assert np.abs(np.abs(vectors.T @ turn[:, :10]) - np.eye(10)).max() < 1e-7
    assert len(products) <= steps + 4 and max(products) <= 18


def test_equal_eigenvalues():
    a = np.diag([5.0] * 6 + [2.0] * 30 + [0.0] * 14)
    got, vectors, residuals, _ = whitening.lobpcg(lambda w: a @ w, 50, 12)
    assert np.allclose(got, [5] * 6 + [2] * 6) and np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-12)


def test_query(spark):
    rows = queries.queries()["op11_whitening"](spark, "/root/testdata/sf0.001")
    assert rows.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in table] == list(range(len(table)))
    check(rows.collect(), [r.embedding for r in table])
