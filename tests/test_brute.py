"""Registered queries that SQL can't express, against plain Python over the same graph."""

import math
import re

import numpy as np
import pytest
from test_graphs import plain_cycles, plain_traverse

from lodestone.operators import analytics, context, reports, retrieval
from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def g(spark):
    graph = catalog.graph(spark, SF)
    nodes = {r.id: r for r in graph.nodes.collect()}
    return nodes, sorted(tuple(r) for r in graph.edges.select("id", "source_id", "target_id", "kind").collect())


def result(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_cycles(spark, g):
    nodes, edges = g
    calls = [e for e in edges if e[3] == "calls"]
    want = plain_cycles(calls, {i: n.qualified_name for i, n in nodes.items()}, 50)
    assert [c.path for c in sorted(result(spark, "cycles_dfs"), key=lambda c: c.cycle)] == want and want


def test_impact(spark, g):
    nodes, edges = g
    found = {}
    for seed in sorted(i for i, n in nodes.items() if n.name == "red_widget"):
        if len(found) < 20:
            for node, depth in plain_traverse(edges, seed, 2, 20 - len(found), "backward", ["calls", "imports"])[0]:
                found.setdefault(node, depth)
    assert [(r.node, r.depth) for r in sorted(result(spark, "impact"), key=lambda r: r.ord)] == list(found.items())


def test_plan_risk(spark, g):
    nodes, edges = g
    targets = sorted(i for i, n in nodes.items() if n.name == "red_widget" or n.path == "src/mod1/brand_1.py")
    first, cut = {}, set()
    for t in targets:
        walk, truncated = plain_traverse(edges, t, 3, 50, "backward", ["calls", "imports"])
        cut |= {t} if truncated else set()
        for node, depth in walk:
            first.setdefault(node, depth)
    rows = result(spark, "plan_risk")
    of = lambda item: {(r.key, r.n) for r in rows if r.item == item}
    assert of("impacted") == {(str(i), d) for i, d in first.items()} and of("risk") == {(analytics.risk_of(len(first)), len(first))}
    paths = {nodes[i].path for i in first}
    assert of("file") == {(p, 1) for p in paths} and of("test") == {(p, 1) for p in paths if "__tests__" in p}
    callers = {t: sum(e[2] == t and e[3] == "calls" for e in edges) for t in targets}
    assert sum(r.item == "warning" for r in rows) == len(cut) + sum(n >= 5 for n in callers.values())


def words(text, punctuation=r"[_\-./:\\(){}\[\]<>,;'\"=+]"):
    return [w for w in re.sub(punctuation, " ", re.sub("([a-z])([A-Z])", r"\1 \2", text)).lower().split() if len(w) >= 2]


def test_intent_search(spark, g):
    nodes, edges = g
    calls = [e for e in edges if e[3] == "calls"]
    callers, callees = {}, {}
    for _, s, t, _ in calls:
        callers.setdefault(t, []).append(s)
        callees.setdefault(s, []).append(t)
    terms = ["red", "widget", "promo"]
    own = lambda n: f"{n.name} {n.qualified_name} {n.signature}"
    hits = {i for i, n in nodes.items() if any(w in terms or any(len(t) <= 4 and w.startswith(t) for t in terms) for w in words(own(n)))}
    wide = hits | {x for i in hits for x in callers.get(i, [])[:3] + callees.get(i, [])[:3]}
    docs = {i: words(" ".join([own(nodes[i]), *(nodes[x].name for x in callers.get(i, [])[:5] + callees.get(i, [])[:5])])) for i in wide}
    mean = sum(map(len, docs.values())) / len(docs)
    score = dict.fromkeys(docs, 0.0)
    for t in terms:
        df = sum(t in d for d in docs.values())
        for i, d in docs.items():
            tf = d.count(t)
            score[i] += math.log((len(nodes) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    want = {i: math.floor(x * 1000 + 0.5) / 1000 for i, x in score.items() if x > 0}
    got = {r.id: r.score for r in result(spark, "intent_search")}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 0.0011 for i in want) and want


def test_symbol_search(spark, g):
    nodes, _ = g
    terms = ["red", "widget"]

    def rank(n):
        out = 10 * n.exported
        for t in terms:
            name, rest = n.name.lower(), f"{n.qualified_name.lower()} {n.signature.lower()}"
            out += 100 if name == t else 50 if name.startswith(t) else 20 if t in name else 5 if t in rest else 0
        return out

    toks = lambda n: words(f"{n.name} {n.qualified_name} {n.signature}", r"[_\-./:\\(){}\[\]<>,;'\"=+*#@!?|&^~`$%]")
    found = sorted((-rank(n), i) for i, n in nodes.items() if any(w in terms or w.startswith("red") for w in toks(n)) and rank(n) > 0)[:40]
    want = [(i, r) for r, i in found if nodes[i].kind == "function"][:20]
    assert len(want) >= 3
    assert [(r.id, r.rank) for r in result(spark, "symbol_search")] == want


def test_rotations(spark):
    rows = result(spark, "rht_norm")
    v = {r.vec_id: np.linalg.norm(np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert len(rows) == len(v) and all(abs(r.norm - v[r.vec_id]) < 1e-4 and abs(r.norm - r.rotated_norm) < 1e-4 for r in rows)
    table = {r.method: r for r in result(spark, "rotation_table")}
    assert set(table) == {"none", "hadamard", "randomised"} and all(r.recall > 0.85 and 0 < r.mse < 1e-3 for r in table.values())


def test_clusters_do_not_depend_on_partitions(spark):
    a = {r.vec_id: (r.label, r.embedding) for r in retrieval.gaussian_clusters(spark, 1500, 16).collect()}
    b = {r.vec_id: (r.label, r.embedding) for r in retrieval.gaussian_clusters(spark, 3000, 16).repartition(7).filter("vec_id < 1500").collect()}
    assert a == b and len(a) == 1500 and all(abs(sum(x * x for x in e) - 1) < 1e-5 for _, e in a.values())
    p = spark.createDataFrame([(0.0, 1.0), (1.0, 0.5), (3.0, 0.5)], "gap double, noise double")
    got = [r.p for r in p.select(retrieval.flip_probability(p.gap, p.noise).alias("p")).collect()]
    assert np.allclose(got, [0.5, 0.158655, 0.00134990], atol=1e-6)


def test_vector_search_by_blocks(spark, monkeypatch):
    vectors = retrieval.gaussian_clusters(spark, 900, 8).select("vec_id", "embedding").repartition(5)
    queries = vectors.filter("vec_id % 50 = 0")
    whole = {tuple(r) for r in retrieval.search_exact(vectors, queries, 7).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    assert {tuple(r) for r in retrieval.search_exact(vectors, queries, 7).collect()} == whole and len(whole) == 18 * 7
    ties = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(40)] + [(99, None)], "vec_id long, embedding array<double>")
    found = retrieval.search_exact(ties, ties.filter("vec_id IN (5, 99)"), 3).collect()
    assert [(r.query_id, r["rank"], r.doc_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(5, 1, 0, 1.0), (5, 2, 1, 1.0), (5, 3, 2, 1.0)]
    assert retrieval.search_exact(ties.limit(0), ties.limit(0), 3).count() == 0


def test_stored_vector_index(spark, tmp_path):
    """Blocks hold what the columns' expressions give; another corpus, or an index that isn't whole, is an error."""
    vectors = retrieval.gaussian_clusters(spark, 700, 16).select("vec_id", "embedding").repartition(3)
    odd = spark.createDataFrame([(5000, None), (5001, [float("nan")] * 16)], "vec_id long, embedding array<float>")
    path = f"file://{tmp_path}/index"
    index = retrieval.VectorIndex.build(vectors.unionByName(odd), path)
    assert (index.rows, index.width) == (700, 16)
    want = {r.vec_id: (r.q, r.scale, r.q_sum) for r in retrieval.build_index(vectors).collect()}
    got = {}
    for b in index.blocks.collect():
        q = np.frombuffer(b.q, np.int8).reshape(len(b.ids), -1)
        got |= {i: (list(q[k]), float(np.frombuffer(b.scale)[k]), int(np.frombuffer(b.sums, np.int64)[k])) for k, i in enumerate(b.ids)}
    assert got == want
    again = retrieval.VectorIndex.open(odd.unionByName(vectors.repartition(5)), path)
    queries = vectors.filter("vec_id % 50 = 0")
    found = {(r.query_id, r["rank"], r.doc_id) for r in again.search(queries, 3).collect()}
    q, scale, _ = (np.array([want[i][c] for i in range(700)]) for c in range(3))
    scores = np.round(q[::50] @ q.T * scale[::50, None] * scale, 6)
    assert found == {(50 * r, k + 1, int(d)) for r, row in enumerate(scores) for k, d in enumerate(np.lexsort((np.arange(700), -row))[:3])}
    with pytest.raises(ValueError, match="another corpus"):
        retrieval.VectorIndex.open(vectors, path)
    with pytest.raises(FileNotFoundError):
        retrieval.VectorIndex.open(vectors, path + "-none")
    with pytest.raises(ValueError, match="queries of 8"):
        again.search(retrieval.gaussian_clusters(spark, 10, 8).select("vec_id", "embedding"), 3)
    shared = retrieval.VectorIndex.of(vectors)
    assert retrieval.VectorIndex.of(vectors.repartition(2)).blocks.inputFiles() == shared.blocks.inputFiles()
    none = retrieval.VectorIndex.of(vectors.limit(0))
    assert none.rows == 0 and none.search(queries, 3).count() == 0 and shared.search(vectors.limit(0), 3).count() == 0


def test_exact_search_reads_vectors_as_they_are(spark):
    """Rows without a vector go by a filter on the stored column, before anything is computed."""
    plan = retrieval.build_index(spark.read.parquet(f"{SF}/embeddings.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and all("lambda" not in f and "isnotnull(embedding" in f for f in filters)


def test_money(spark):
    rows = spark.createDataFrame([(1.005, "USD"), (2.5, "JPY"), (-2.5, "JPY")], "x double, currency string")
    got = [r.r for r in rows.select(reports.rounded(rows.x, rows.currency).alias("r")).collect()]
    assert got == [1.0, 3.0, -2.0] or got == [1.01, 3.0, -2.0]
    assert reports.one_currency(rows.filter("currency = 'JPY'"), "x").first().amount == 0.0
    with pytest.raises(Exception, match="currencies differ"):
        reports.one_currency(rows, "x").collect()


def test_limits_clamp():
    assert context.limits("impact", 100, 1, depth=40) == (10, 100)
    assert analytics.risk_of(5) == "low" and analytics.risk_of(6) == "medium" and analytics.risk_of(21) == "high"
