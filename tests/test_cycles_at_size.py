"""The search for cycles holds numbers alone, and plans make what is asked for."""

import random
import tracemalloc

import numpy as np
import pytest
from test_graphs import make, plain_cycles

from lodestone.operators import components, context
from lodestone.sources import storage


def test_a_plan_looks_for_cycles_only_if_they_are_asked_for(spark, monkeypatch):
    def none(*_):
        raise AssertionError("cycles")

    monkeypatch.setattr(context, "search_cycles", none)
    g = make(spark, [(k + 1, f"src/{n}.ts", n, 1, 2, 1) for k, n in enumerate("ABC")], [(1, 2), (2, 3), (3, 1)])
    plan = context.plan_risk(g, ["C"])
    assert plan.score == plan.impacted.count() == 3 and plan.warnings.count() == 0
    with pytest.raises(AssertionError):
        _ = plan.cycle_risks


def test_components_of_a_large_region_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", 3)
    monkeypatch.setattr(components, "WALK_EDGES", 3)
    r = random.Random(8)
    pairs = [(1, 5), (5, 2), (2, 3), (3, 5), (2, 5), (3, 2), *sorted({(r.randrange(1, 12), r.randrange(1, 12)) for _ in range(14)})]
    edges = [(k + 1, s, t, "calls") for k, (s, t) in enumerate(dict.fromkeys(pairs))]
    names = {i: f"n{(i * 7) % 23:02}" for e in edges for i in e[1:3]}
    nodes = spark.createDataFrame([(i, q, f"{q}.py") for i, q in names.items()], "id long, qualified_name string, path string")
    got = components.search_cycles(spark.createDataFrame(edges, storage.EDGES), nodes, 6).orderBy("cycle").collect()
    assert [c.path for c in got] == plain_cycles(edges, names, 6)


def test_a_walk_holds_few_bytes_an_edge():
    n, m = 100_000, 400_000
    random_ = np.random.default_rng(2)
    source = np.sort(random_.integers(0, n, m))
    target = np.maximum(source, random_.integers(0, n, m)) + 1  # no cycle, so all of it is walked
    tracemalloc.start()
    held = components._Held(0, int(source[0]))
    for at in range(0, m, 10_000):
        part = slice(at, at + 10_000)
        held.add(source[part], target[part], source[part], None, None, None)
    assert held.walk(10) == []
    assert tracemalloc.get_traced_memory()[1] < 50 * m  # as rows and lists of tuples they were some 400 bytes an edge
    tracemalloc.stop()
