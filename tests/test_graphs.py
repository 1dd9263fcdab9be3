"""Hand-made graphs with known answers, and random ones against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lodestone.operators import analytics, classify, components, context, export, ranges, resolve, search, traversal
from lodestone.sources import adjacency, storage
from lodestone.sources.storage import Graph


def make(spark, nodes, edges):
    """nodes: (id, path, name, start, end, exported); edges: (source, target) or with a kind."""
    paths = list(dict.fromkeys(n[1] for n in nodes))
    rows = [(i, paths.index(p) + 1, n, f"{p}::{n}", "class" if n == "deadClass" else "function", a, b, "", None, x, p) for i, p, n, a, b, x in nodes]
    schema = "id long, file_id long, name string, qualified_name string, kind string, start_line int, end_line int, signature string, doc string, exported int, path string"
    e = [(k + 1, x[0], x[1], x[2] if len(x) > 2 else "calls") for k, x in enumerate(edges)]
    return Graph(spark.createDataFrame([(k + 1, p, "typescript") for k, p in enumerate(paths)], "file_id long, path string, language string"), spark.createDataFrame(rows, schema), spark.createDataFrame(e, storage.EDGES))


@pytest.fixture(scope="module")
def chain(spark):
    return make(spark, [(k + 1, "src/test.ts", n, k + 1, k + 1, 1) for k, n in enumerate("ABCD")], [(1, 2), (2, 3), (1, 4)])


@pytest.fixture(scope="module")
def service(spark):
    a, u, t, s = "src/app.ts", "src/utils.ts", "src/__tests__/app.test.ts", "src/services/auth.ts"
    nodes = [(1, a, "main", 1, 30, 1), (2, a, "handleRequest", 32, 50, 1), (3, u, "validateEmail", 1, 10, 1), (4, u, "formatDate", 12, 20, 1), (5, u, "orphan", 22, 25, 0), (6, t, "testMain", 1, 10, 0), (7, s, "authenticate", 1, 20, 1), (8, s, "hashPassword", 22, 30, 1)]
    return make(spark, nodes, [(1, 2), (2, 3), (2, 7), (7, 8), (7, 3), (1, 4), (6, 1)])


def nodes_of(walk):
    return [(r.node, r.depth) for r in walk.nodes.orderBy("ord").collect()]


def test_chain(chain):
    walk = traversal.traverse(chain.edges, 1, 3)
    assert nodes_of(walk) == [(1, 0), (2, 1), (4, 1), (3, 2)] and not walk.truncated
    assert {r.id for r in walk.edges.collect()} == {1, 2, 3}
    short = traversal.traverse(chain.edges, 1, 1)
    assert nodes_of(short) == [(1, 0), (2, 1), (4, 1)] and {r.id for r in short.edges.collect()} == {1, 2, 3}
    cut = traversal.traverse(chain.edges, 1, 3, 2)
    assert nodes_of(cut) == [(1, 0), (2, 1)] and cut.truncated
    assert {tuple(r) for r in traversal.callers(chain.nodes, chain.edges, "B").collect()} == {(2, 0), (1, 1)}
    assert [tuple(r)[:2] for r in traversal.impact(chain.nodes, chain.edges, "C").collect()] == [(3, 0), (2, 1), (1, 2)]
    assert traversal.trace(chain.nodes, chain.edges, "A", "C") == [1, 2, 3] and len(traversal.trace(chain.nodes, chain.edges, "A", "B")) == 2
    assert traversal.trace(chain.nodes, chain.edges, "C", "A") == [] and traversal.callees(chain.nodes, chain.edges, "none").count() == 0


def test_cycle(spark):
    g = make(spark, [(1, "src/app.ts", "main", 1, 9, 1), (2, "src/app.ts", "unused", 10, 12, 0), (3, "src/utils.ts", "helper", 1, 2, 1), (4, "src/utils.ts", "deadClass", 3, 4, 0), (5, "src/utils.ts", "validate", 5, 6, 0)], [(1, 3), (3, 5), (5, 1)])
    (cycle,) = components.search_cycles(g.edges, g.nodes).collect()
    assert cycle.path == ["src/app.ts::main", "src/utils.ts::helper", "src/utils.ts::validate", "src/app.ts::main"] and cycle.length == 3
    assert [tuple(r) for r in classify.three_cycles(g.edges).collect()] == [(1, 3, 5)] and classify.two_cycles(g.edges).count() == 0
    role = classify.roles(g.nodes, g.edges)
    assert {r.name for r in classify.dead_code(role).collect()} == {"unused", "deadClass"}
    assert [r.name for r in classify.dead_code(role, path="app.ts").collect()] == ["unused"]
    assert tuple(classify.average_fan(classify.degrees(g.nodes, g.edges)).first()) == (0.6, 0.6)
    assert {tuple(r) for r in classify.fan_out_histogram(classify.degrees(g.nodes, g.edges)).collect()} == {("0", 2), ("1-3", 3), ("4-7", 0), ("8-15", 0), ("16+", 0)}
    assert components.search_cycles(g.edges.filter("id < 3"), g.nodes).count() == 0


def test_service(service):
    g = service
    degree = classify.degrees(g.nodes, g.edges)
    assert tuple(classify.average_fan(degree).first()) == (0.88, 0.88)
    assert {tuple(r) for r in classify.most_fan(degree).collect()} == {("fan_in", 3, 2), ("fan_out", 1, 2)}
    plan = context.plan_risk(g, ["validateEmail"])
    assert (plan.risk, plan.score, [r.path for r in plan.affected_tests.collect()]) == ("low", 5, ["src/__tests__/app.test.ts"])
    assert sorted((r.id, r.depth) for r in plan.impacted.collect()) == [(1, 2), (2, 1), (3, 0), (6, 3), (7, 1)]
    assert [r.path for r in traversal.affected_tests(g.nodes, g.edges, ["src/utils.ts"]).collect()] == ["src/__tests__/app.test.ts"]
    assert traversal.trace(g.nodes, g.edges, "testMain", "hashPassword") == [6, 1, 2, 7, 8]
    own = {r.id: (r.callers, r.callees) for r in analytics.file_context(g.nodes, g.edges, "src/app.ts").collect()}
    assert own == {1: ("testMain", "handleRequest,formatDate"), 2: ("main", "validateEmail,authenticate")}
    assert [r.path for r in analytics.tests_of(g.nodes, "src/app.ts").collect()] == ["src/__tests__/app.test.ts"]
    deny = analytics.lint(g, [analytics.Rule("deny-dependency", "src/app.ts", "src/services/**")]).collect()
    assert [(r.subject, r.detail) for r in deny] == [("src/app.ts::handleRequest", "src/services/auth.ts::authenticate")]
    fan = analytics.lint(g, [analytics.Rule("max-fan-out", most=1)]).collect()
    assert {r.subject.split("::")[1] for r in fan} == {"main", "handleRequest", "authenticate"}
    many = analytics.lint(g, [analytics.Rule("max-file-symbols", most=1)]).collect()
    assert {(r.subject, r.detail) for r in many} == {("src/app.ts", "2"), ("src/utils.ts", "3"), ("src/services/auth.ts", "2")}
    role = {r.name: r.role for r in classify.roles(g.nodes, g.edges).collect()}
    assert role["testMain"] == "test" and role["orphan"] == "dead" and {role[n] for n in ("main", "handleRequest", "validateEmail", "authenticate", "hashPassword", "formatDate")} == {"utility"}
    health = analytics.health(g).first()
    assert (health.modularity, health.dead, health.coverage, health.complexity, health.overall) == (100, 75, 33, 100, 77)
    assert analytics.style(g.files).first().style == "monolith"
    detail = context.node_detail(g, "main")
    assert detail["callers"] == ["testMain"] and detail["callees"] == ["handleRequest", "formatDate"] and context.node_detail(g, "nothing") is None


def test_bm25(spark, service):
    notes = {"main": ("function main()", "Entry point"), "handleRequest": ("function handleRequest(req: Request)", "Handles HTTP requests"), "validateEmail": ("function validateEmail(email: string): boolean", "Validates email format"), "formatDate": ("function formatDate(d: Date): string", ""), "orphan": ("function orphan()", ""), "testMain": ("", ""), "authenticate": ("function authenticate(token: string)", "Authenticates user token"), "hashPassword": ("function hashPassword(pw: string)", "")}
    extra = spark.createDataFrame([(n, s, d) for n, (s, d) in notes.items()], "name string, signature string, doc string")
    nodes = service.nodes.drop("signature", "doc").join(extra, "name")
    got = {r.id: r.score for r in search.intent_search(nodes, service.edges, "validate email format").collect()}
    assert got == {3: 3.996, 2: 1.802, 7: 1.802, 4: 1.563, 1: 0.992}
    got = {r.id: r.score for r in search.intent_search(nodes, service.edges, "authenticate user token").collect()}
    assert got == {7: 5.230, 8: 0.759, 2: 0.674, 3: 0.674}


def test_suggestions(spark):
    nodes = [(1, "src/app.ts", "bigFunction", 1, 120, 1), (2, "src/utils.ts", "tinyWrapper", 1, 5, 1), (3, "src/utils.ts", "orphan", 10, 20, 0)]
    nodes += [(k + 3, "src/utils.ts", f"dep{k}", 20 + 10 * k, 25 + 10 * k, 1) for k in range(1, 7)]
    g = make(spark, nodes, [(1, k) for k in range(4, 10)] + [(1, 2)])
    found = analytics.suggestions(g.nodes, g.edges).collect()
    assert [(r.type, r.id, r.priority) for r in found[:2]] == [("extract", 1, "high"), ("dead", 3, "medium")]
    assert {(r.type, r.priority) for r in found[2:]} == {("inline", "low")} and len(found) == 9


def test_roles_and_bridges(spark):
    path = "src/a.ts"
    hub = make(spark, [(k, path, f"n{k}", k, k, 1) for k in range(1, 8)], [(1, 4), (2, 4), (3, 4), (4, 5), (4, 6), (4, 7)])
    assert {r.id: r.role for r in classify.roles(hub.nodes, hub.edges).collect()}[4] == "hub"
    bridge = make(spark, [(k, path, f"n{k}", k, k, 1) for k in range(1, 6)], [(1, 3), (2, 3), (3, 4), (3, 5)])
    assert [r.id for r in classify.bridges(bridge.nodes, bridge.edges).collect()] == [3]
    assert {r.id: r.role for r in classify.roles(bridge.nodes, bridge.edges).collect()}[3] == "bridge"
    shortcut = make(spark, [(k, path, f"n{k}", k, k, 1) for k in range(1, 6)], [(1, 3), (2, 3), (3, 4), (3, 5), (1, 4)])
    assert {r.id: r.role for r in classify.roles(shortcut.nodes, shortcut.edges).collect()}[3] == "utility"


def test_clearing_edges(spark):
    g = make(spark, [(1, "a.ts", "A", 1, 1, 1), (2, "b.ts", "B", 1, 1, 1), (3, "c.ts", "C", 1, 1, 1)], [(1, 2), (2, 3), (1, 3)])
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(g.clear_edges(g.files.filter("path = 'a.ts'")).edges) == [2]
    assert len(ids(g.clear_edges(g.files.limit(0)).edges)) == 3 and ids(g.clear_edges().edges) == []
    left, gone = g.keep_only(g.files.filter("path != 'b.ts'"))
    assert [r.path for r in gone.collect()] == ["b.ts"] and ids(left.edges) == [3] and left.nodes.count() == 2


def plain_traverse(edges, start, depth, most, direction, kinds):
    order, at, queue = [start], {start: 0}, deque([start])
    while queue:
        u = queue.popleft()
        if at[u] == depth:
            continue
        steps = []
        if direction in ("forward", "both"):
            steps += [(0, kinds.index(k), e, t) for e, s, t, k in edges if s == u and k in kinds]
        if direction in ("backward", "both"):
            steps += [(1, kinds.index(k), e, s) for e, s, t, k in edges if t == u and k in kinds]
        for *_, v in sorted(steps):
            if v not in at:
                at[v] = at[u] + 1
                order.append(v)
                queue.append(v)
    return [(v, at[v]) for v in order[:most]], len(order) > most


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
def test_random_graphs(spark, direction):
    r = random.Random(5)
    for n in (5, 12, 30):
        pairs = sorted({(r.randrange(n), r.randrange(n), r.choice(["calls", "imports"])) for _ in range(n * 2)})
        edges = [(k + 1, s, t, kind) for k, (s, t, kind) in enumerate(pairs) if s != t]
        df = spark.createDataFrame(edges, storage.EDGES)
        for most in (4, 50):
            walk = traversal.traverse(df, 0, 3, most, direction, ("calls", "imports"))
            assert (nodes_of(walk), walk.truncated) == plain_traverse(edges, 0, 3, most, direction, ["calls", "imports"])
            seeds = [0, 1, n - 1, 2]
            walks, cut = traversal.traverse_each(df, spark.createDataFrame([(s,) for s in seeds], "seed long"), 3, most, direction, ("calls", "imports"))
            got, truncated = walks.orderBy("ord").collect(), {r.seed for r in cut.collect()}
            for s in seeds:
                assert ([(r.node, r.depth) for r in got if r.seed == s], s in truncated) == plain_traverse(edges, s, 3, most, direction, ["calls", "imports"])


@pytest.mark.parametrize("few", [1_000, 2])
def test_stored_adjacency(spark, tmp_path, monkeypatch, few):
    """Traversals over edges stored by node, with many folders; a frontier of more nodes than are named, and levels that don't stay on the driver."""
    monkeypatch.setattr(adjacency, "BUCKET_EDGES", 9)
    monkeypatch.setattr(adjacency, "FEW", few)
    monkeypatch.setattr(traversal, "LOCAL_NODES", 10_000 if few > 2 else 0)
    r = random.Random(9)
    pairs = sorted({(r.randrange(20), r.randrange(20), r.choice(["calls", "imports"])) for _ in range(50)})
    edges = [(k + 1, s, t, kind) for k, (s, t, kind) in enumerate(pairs)]
    df = spark.createDataFrame(edges, storage.EDGES)
    ways = adjacency.Adjacency.write(df, f"file://{tmp_path}/ways")
    assert ways.buckets > 4 and adjacency.Adjacency.open(spark, ways.path) == ways and adjacency.Adjacency.open(spark, f"file://{tmp_path}/none") is None
    for direction in ("forward", "backward", "both"):
        for most in (4, 50):
            walk, plain = (traversal.traverse(e, 3, 3, most, direction, ("calls", "imports")) for e in (ways, df))
            assert (nodes_of(walk), walk.truncated) == plain_traverse(edges, 3, 3, most, direction, ["calls", "imports"])
            assert sorted(map(tuple, walk.edges.collect())) == sorted(map(tuple, plain.edges.collect()))
    seeds = spark.createDataFrame([(0,), (3,), (19,)], "seed long")
    a, b = (sorted(map(tuple, traversal.traverse_each(e, seeds, 2, 6)[0].collect())) for e in (ways, df))
    assert a == b
    starts = seeds.withColumnRenamed("seed", "node")
    assert sorted(map(tuple, traversal.reach(ways, starts, 2).collect())) == sorted(map(tuple, traversal.reach(df, starts, 2).collect()))
    if few > 2:
        plan = ways.of(spark.createDataFrame([(3,)], "node long"), "forward", ("calls",))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def plain_cycles(edges, names, most):
    """The search as it is usually written: recursive, over the whole graph."""
    after = {}
    for kind in ("calls", "imports"):
        for _, s, t, k in sorted(edges):
            if k == kind:
                after.setdefault(s, []).append(t)
    state, found = {}, []

    def visit(u, stack):
        if len(found) >= most:
            return
        state[u] = "open"
        stack.append(u)
        for v in after.get(u, []):
            if len(found) >= most:
                return
            if state.get(v) == "open":
                way = [names[x] for x in stack[stack.index(v) :]]
                k = way.index(min(way))
                cycle = way[k:] + way[:k] + [way[k]]
                if cycle not in found:
                    found.append(cycle)
            elif v not in state:
                visit(v, stack)
        stack.pop()
        state[u] = "done"

    for u in sorted(names):
        if u not in state:
            visit(u, [])
    return found


def test_components_against_reachability(spark, monkeypatch):
    r = random.Random(3)
    for n, m, local in ((1, 1, 0), (6, 8, 2), (30, 40, 6), (40, 160, 20)):
        monkeypatch.setattr(components, "LOCAL_EDGES", local)
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        reach = {v: {v} for e in pairs for v in e}
        for _ in reach:
            for s, t in pairs:
                for v in reach:
                    if s in reach[v]:
                        reach[v].add(t)
        want = {v: (min(w for w in reach if v in reach[w] and w in reach[v]), min(w for w in reach if v in reach[w])) for v in reach}
        got = components.strong_components(spark.createDataFrame(pairs, "source_id long, target_id long")).collect()
        assert {x.id: (x.component, x.root) for x in got} == want and len(got) == len(want)
    assert components.strong_components(spark.createDataFrame([], "source_id long, target_id long")).count() == 0


@pytest.mark.parametrize("local", [200_000, 3])
def test_cycles_in_the_order_of_the_whole_graph(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    r = random.Random(3)
    cases = [[(1, 5), (5, 2), (2, 3), (3, 5), (2, 5), (3, 2)], [(1, 1), (1, 2)]]
    for n in (6, 10, 20) if local > 3 else (12,):
        cases.append(sorted({(r.randrange(1, n), r.randrange(1, n), r.choice(["calls", "imports"])) for _ in range(2 * n)}, key=str))
    for pairs in cases:
        edges = [(k + 1, p[0], p[1], p[2] if len(p) > 2 else "calls") for k, p in enumerate(pairs)]
        names = {i: f"n{(i * 7) % 23:02}" for e in edges for i in e[1:3]}
        nodes = spark.createDataFrame([(i, q, f"{q}.py") for i, q in names.items()], "id long, qualified_name string, path string")
        for most in (2, 50) if local > 3 else (4,):
            got = components.search_cycles(spark.createDataFrame(edges, storage.EDGES), nodes, most).orderBy("cycle").collect()
            assert [c.path for c in got] == plain_cycles(edges, names, most)
            assert all(set(c.files) == {f"{q}.py" for q in c.path} and c.length == len(c.path) - 1 for c in got)
    edges = [(k + 1, s, t, "calls") for k, (s, t) in enumerate(cases[0])]
    assert len(plain_cycles(edges, {i: str(i) for i in range(1, 6)}, 50)) == 3


def test_style(spark):
    def of(*paths):
        return analytics.style(spark.createDataFrame([(p,) for p in paths], "path string")).first().style

    assert of("app/Handlers/a.py", "app/services/b.py") == "layered (MVC / service-oriented)"
    assert of("web/screens/a.ts", "web/pages/b.ts") == "component-based"
    assert of("services/x/a.py", "models/y/b.py", "c/d.py") == "modular"  # the folder that holds the file counts
    assert of("a/x.py", "b/y.py") == "monolith" and of("a/x.py", "b/y.py", "root.py") == "modular" and of("x.py") == "monolith"


def test_affected_tests_keep_changed_tests(spark):
    g = make(spark, [(1, "src/a.py", "a", 1, 2, 1), (2, "src/b.test.py", "b", 1, 2, 0), (3, "src/c.spec.ts", "c", 1, 2, 0)], [(3, 1)])
    found = lambda *p, **k: {r.path for r in traversal.affected_tests(g.nodes, g.edges, list(p), **k).collect()}
    assert found("src/a.py", "src/b.test.py") == {"src/b.test.py", "src/c.spec.ts"} and found("src/a.py", depth=0) == set()
    assert found("src/a.py", pattern="*.PY") == {"src/a.py"}


def test_plan_risk_follows_all_targets(spark):
    nodes = [(k, "src/big.py", f"f{k}", k, k, 1) for k in range(1, 71)] + [(100 + k, f"src/u{k}.test.py", f"g{k}", 1, 1, 0) for k in range(1, 71)]
    g = make(spark, nodes, [(100 + k, k) for k in range(1, 71)] + [(k, 70) for k in range(1, 60)] + [(1, 2), (2, 1)])
    plan = context.plan_risk(g, files=["src/big.py"])
    assert plan.score == 140 and plan.risk == "high" and plan.affected_tests.count() == 70 and plan.files.count() == 71
    warnings = {r.warning for r in plan.warnings.collect()}
    assert "f70 has 60 callers: high-impact change" in warnings and "the impact of f70 was cut: large blast radius" in warnings
    assert [r.risk for r in plan.cycle_risks.collect()] == ["f1 is in a cycle: src/big.py::f1 -> src/big.py::f2 -> src/big.py::f1"]
    assert context.plan_risk(g, ["none"]).score == 0


def test_suggestions_by_scope_without_repetition(spark):
    nodes = [(1, "src/a.ts", "twin", 1, 2, 0), (2, "src/a.ts", "twin", 5, 6, 0), (3, "src/b.ts", "used", 1, 30, 1)] + [(10 + k, f"src/c{k % 2}.ts", f"c{k}", 1, 60, 1) for k in range(5)]
    g = make(spark, nodes, [(10 + k, 3) for k in range(5)])
    found = analytics.suggestions(g.nodes, g.edges).collect()
    assert [(r.type, r.id, r.line) for r in found if r.name == "twin"] == [("dead", 1, 1)]
    (move,) = [r for r in found if r.type == "move"]
    assert (move.priority, move.reason) == ("high", "5/5 callers are in other files; most from src/c0.ts (3 calls)")
    assert {r.name for r in analytics.suggestions(g.nodes, g.edges, symbol="used").collect()} == {"used"} and analytics.suggestions(g.nodes, g.edges, path="none").count() == 0
    assert [r.name for r in analytics.suggestions(g.nodes, g.edges, path="src/a.ts").collect()] == ["twin"]


def test_resolution(spark):
    g = make(spark, [(1, "src/a.ts", "run", 1, 5, 1), (2, "src/b.ts", "help", 1, 5, 0), (3, "src/c.ts", "help", 1, 5, 1), (4, "src/a.ts", "local", 6, 7, 0), (5, "src/b.ts", "local", 6, 7, 1)], [(1, 2)])
    refs = spark.createDataFrame([(1, 1, "call", "src/a.ts::run", "help"), (2, 1, "call", "src/a.ts::run", "local"), (3, 1, "call", "src/a.ts::run", "run"), (4, 1, "call", "src/a.ts::gone", "help"), (5, 1, "extends", "src/a.ts::run", "nothing")], "id long, file_id long, kind string, source_qname string, target_name string")
    assert {tuple(r) for r in resolve.resolve_edges(refs, g.nodes).collect()} == {(1, 3, "calls"), (1, 4, "calls")}
    imports = spark.createDataFrame([(1, "help", "src/b")], "file_id long, name string, target_path string")
    assert {tuple(r) for r in resolve.resolve_edges(refs, g.nodes, imports).collect()} == {(1, 2, "calls"), (1, 4, "calls")}
    paths = spark.createDataFrame([("src/x/a.ts", "./b"), ("src/x/a.ts", "../lib/c"), ("src/x/a.ts", "react")], "f string, m string")
    assert [r[0] for r in paths.select(resolve.module_path(F.col("f"), F.col("m"))).collect()] == ["src/x/b", "src/lib/c", None]


def test_ranges(spark):
    rows = spark.createDataFrame([("f", 1, 10), ("f", 12, 20), ("f", 35, 40)], "path string, start_line int, end_line int")
    assert sorted(tuple(r)[1:3] for r in ranges.islands(rows, "path", "start_line", "end_line").collect()) == [(1, 20), (35, 40)]
    more = rows.union(spark.createDataFrame([("f", 30, 31)], rows.schema))
    assert [tuple(r)[1:3] for r in ranges.islands(more, "path", "start_line", "end_line").collect()] == [(1, 40)]
    sections = spark.createDataFrame([("f", 1, 3000), ("f", 2, 2500), ("f", 3, 600), ("f", 4, 100)], "path string, k int, n int")
    assert [r.k for r in ranges.within_budget(sections, "path", ["k"], "n", 6_000).orderBy("k").collect()] == [1, 2]


def test_export_and_context(spark, service, tmp_path):
    part = export.gathered(service)
    text = export.dot_text(part)
    assert text.count("subgraph cluster_") == 4 and text.count("->") == 7
    assert '"handleRequest"' in export.html(part) and export.gathered(service, "orphan").nodes.count() == 1
    contents = spark.createDataFrame([(p, "\n".join(f"line {k}" for k in range(1, 60))) for p in ("src/app.ts", "src/utils.ts", "src/services/auth.ts")], "path string, content string")
    found = context.build_context(service, "validateEmail", contents)
    assert {r.id for r in found.symbols.collect()} >= {2, 3, 7} and found.tokens > 0
    sections = context.explore(service, "validateEmail", contents).collect()
    assert {r.path for r in sections} >= {"src/utils.ts"} and all(len(r.section) <= 6_000 for r in sections)
    assert context.limits("callers", 100) == (4, 60) and context.limits("callers", 5_000, 30) == (1, 90) and context.limits("impact", 500, 3, depth=2) == (2, 80)
    assert context.limits("trace", 1_000) == (8, 2_000) and context.limits("affected", 100, 2) == (8, 520) and context.limits("node", 5_000, 30) == (1, 65) and context.limits("context", 10, None, 12, 300) == (12, 300)
    assert context.limits("explore", 1_000, 10, depth=50) == (10, 60) and context.limits("callees", 1_000, 10, most=1) == (3, 5)
    service.save(f"{tmp_path}/g")
    stored = spark.read.parquet(f"{tmp_path}/g/edges")
    assert stored.count() == 7


def test_transactions(spark, tmp_path):
    import datetime

    rows = spark.createDataFrame([("1", datetime.date(2024, 1, 2), "expense", 5.5, "food", 'a "quoted", text', ["x", "y"])], "id string, date date, type string, amount double, category string, description string, tags array<string>")
    export.write_transactions(rows, f"{tmp_path}/t")
    good, bad = export.read_transactions(spark, f"{tmp_path}/t")
    assert good.collect() == rows.collect() and bad.count() == 0
    (tmp_path / "u.csv").write_text('id,date,type,amount,category,description,tags\n1,2024-01-02,gift,5,c,d,\n2,2024-01-02,income,-1,c,d,\n3,2024-01-02,income,4,c,d,a;b\n')
    good, bad = export.read_transactions(spark, f"file://{tmp_path}/u.csv")
    assert [r.id for r in good.collect()] == ["3"] and sorted(r.reason for r in bad.collect()) == ["amount", "type"]


def test_suggestions_stop_at_three_times_the_limit(spark):
    nodes = [(k, "src/a.ts", f"dead{k:02}", k, k + 1, 0) for k in range(1, 20)] + [(k, "src/b.ts", f"big{k}", 1, 120, 1) for k in (20, 21)] + [(100 + j, "src/c.ts", f"t{j}", 1, 60, 1) for j in range(6)]
    g = make(spark, nodes, [(k, 100 + j) for k in (20, 21) for j in range(6)])
    assert [r.type for r in analytics.suggestions(g.nodes, g.edges, 30).collect()][:2] == ["extract", "extract"]
    cut = analytics.suggestions(g.nodes, g.edges, 4).collect()
    assert [(r.type, r.id) for r in cut] == [("dead", k) for k in range(1, 5)]  # the large ones come after twelve others


def test_many_rules_at_once(spark, service):
    """What the automaton says of each rule is what its regular expression says, and all rules at once are all rules one by one."""
    import re

    from lodestone.functions.globs import GlobSet
    from lodestone.functions.text import segment_glob

    r = random.Random(4)
    parts = ["**", "*", "a", "b", "a.b", "x+y", ""]
    globs = ["/".join(r.choice(parts) for _ in range(r.choice([1, 2, 3, 4]))) for _ in range(300)]
    paths = ["/".join(r.choice(["a", "b", "c", "a.b", "x+y", "", "aXb"]) for _ in range(r.choice([1, 2, 3, 5]))) for _ in range(200)]
    every = GlobSet(globs)
    for p in paths:
        assert every.matching(p) == [k for k, g in enumerate(globs) if re.fullmatch(segment_glob(g).removeprefix("^").removesuffix("$"), p)]
    scopes = ["**", "src/**", "src/*", "src/utils.ts", "**/services/**", "nothing/**"]
    rules = [analytics.Rule("deny-dependency", r.choice(scopes), r.choice(scopes), severity=r.choice(["error", "warn"])) for _ in range(40)]
    rules += [analytics.Rule("max-fan-out", most=r.choice([0, 1, None]), scope=r.choice(scopes)) for _ in range(10)] + [analytics.Rule("max-file-symbols", most=r.choice([1, 2, None]), scope=r.choice(scopes)) for _ in range(10)]
    r.shuffle(rules)
    got = sorted(map(tuple, analytics.lint(service, rules).collect()))
    nodes = {x.id: x for x in service.nodes.collect()}
    edges = [(nodes[e.source_id], nodes[e.target_id]) for e in service.edges.collect()]
    fits = lambda glob, path: re.search(segment_glob(glob), path) is not None
    want = []
    for k, rule in enumerate(rules):
        if rule.type == "deny-dependency":
            want += [(k, rule.severity, s.qualified_name, t.qualified_name) for s, t in edges if fits(rule.source, s.path) and fits(rule.target, t.path)]
        elif rule.type == "max-fan-out":
            fan = {n.qualified_name: (n.path, sum(s.id == n.id for s, _ in edges)) for n in nodes.values()}
            want += [(k, "error", q, str(n)) for q, (p, n) in fan.items() if fits(rule.scope, p) and n > (10 if rule.most is None else rule.most)]
        else:
            files = {p: sum(n.path == p for n in nodes.values()) for p in {n.path for n in nodes.values()}}
            want += [(k, "error", p, str(n)) for p, n in files.items() if fits(rule.scope, p) and n > (30 if rule.most is None else rule.most)]
    assert got == sorted(want) and len({w[0] for w in want}) > 15
    plan = analytics.lint(service, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") < 12 and analytics.lint(service, []).count() == 0
    with pytest.raises(ValueError, match="rule type"):
        analytics.lint(service, [analytics.Rule("odd")])


def test_ranges_by_bins_and_budgets_in_parts(spark, monkeypatch):
    r = random.Random(6)
    rows = [(k, r.choice(["a", "b", None]), s, s + r.choice([0, 3, 200, 5000])) for k, s in enumerate(r.randrange(900) for _ in range(60))]
    hunks = [(r.choice(["a", "b", "c"]), s, s + r.choice([-1, 0, 7, 90])) for s in (r.randrange(1500) for _ in range(15))]
    df, h = spark.createDataFrame(rows, "id long, path string, start_line int, end_line int"), spark.createDataFrame(hunks, "path string, start int, end int")
    want = {i for i, p, a, b in rows if any(p == q and a <= e and b >= s and s <= e for q, s, e in hunks)}
    for width in (64, 1):
        monkeypatch.setattr(ranges, "BIN", width)
        got = ranges.overlapping(df, h).collect()
        assert {x.id for x in got} == want and len(got) == len(want) and got[0].asDict().keys() == {"id", "path", "start_line", "end_line"}
    sizes = [(k, r.choice(["hot", "hot", "cold", None]), r.choice([0, 1, 7])) for k in range(400)]
    df = spark.createDataFrame(sizes, "id long, source string, n long").repartition(6)
    for most in (-1, 0, 50, 10_000):
        total, want = {}, set()
        for k, source, n in sizes:
            total[source] = total.get(source, 0) + n
            if total[source] <= most:
                want.add((k, total[source]))
        assert {(x.id, x.running) for x in ranges.within_budget(df, "source", ["id"], "n", most).collect()} == want
