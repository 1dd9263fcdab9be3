"""A small project from its files to the answers."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.analytics import Rule
from lodestone.plans import engine

FILES = {
    "src/main.ts": "import { greet } from './lib/greet';\nimport { check } from './health';\n\nexport function main() {\n  greet('x');\n  check();\n}\n",
    "src/lib/greet.ts": "import { formatMessage } from './format';\n\nexport function greet(name: string) {\n  return formatMessage(name);\n}\n",
    "src/lib/format.ts": "export function formatMessage(m: string) {\n  return m.trim();\n}\n\nfunction unused() {\n  return 1;\n}\n",
    "src/health.ts": "export function check() {\n  return ping();\n}\n\nfunction ping() {\n  return check();\n}\n",
    "src/__tests__/greet.test.ts": "import { greet } from '../lib/greet';\n\nfunction testGreet() {\n  greet('a');\n}\n",
    "api/app.py": "from flask import Flask\n\n@app.route('/users', methods=['POST'])\ndef users():\n    return load()\n\ndef load():\n    return []\n",
}


@pytest.fixture(scope="module")
def code(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return engine.index(spark, f"file://{root}")


def names(code, df, column="node"):
    return {r.name for r in df.join(code.nodes.select(F.col("id").alias(column), "name"), column).collect()}


def test_graph(code):
    edges = code.edges.join(code.nodes.select(F.col("id").alias("source_id"), F.col("name").alias("s")), "source_id").join(code.nodes.select(F.col("id").alias("target_id"), F.col("name").alias("t")), "target_id")
    assert {(r.s, r.t) for r in edges.filter("kind = 'calls'").collect()} == {("main", "greet"), ("main", "check"), ("greet", "formatMessage"), ("check", "ping"), ("ping", "check"), ("testGreet", "greet"), ("users", "load"), ("POST /users", "users")}
    assert {(r.s, r.t) for r in edges.filter("kind = 'imports'").collect()} == {("main", "greet"), ("main", "check"), ("greet", "formatMessage"), ("testGreet", "greet")}
    role = {r.name: r.role for r in code.nodes.collect()}
    assert role["unused"] == "dead" and role["testGreet"] == "test" and role["main"] == "entry" and role["POST /users"] == "entry"


def test_answers(code, spark):
    assert names(code, code.callers("formatMessage")) == {"formatMessage", "greet", "main", "testGreet"}
    assert names(code, code.callees("main")) == {"main", "greet", "check", "formatMessage", "ping"}
    path = code.trace("main", "formatMessage")
    by_id = {r.id: r.name for r in code.nodes.collect()}
    assert [by_id[n] for n in path] == ["main", "greet", "formatMessage"] and code.trace("check", "formatMessage") == []
    assert [r.path for r in code.affected(["src/lib/format.ts"]).collect()] == ["src/__tests__/greet.test.ts"]
    assert {r.name for r in code.dead_code().collect()} == {"unused"}
    assert code.search("formatMessage").first().name == "formatMessage"
    assert by_id[code.intent_search("greet format message").first().id] in ("greet", "formatMessage", "testGreet")
    assert code.cycles().count() == 1 and code.node("greet")["callees"] == ["formatMessage"] and "formatMessage" in code.node("greet")["snippet"]
    violations, totals = code.lint([Rule("deny-dependency", "src/main.ts", "src/health.ts"), Rule("no-cycles", severity="warn")])
    assert totals.first().asDict() == {"errors": 2, "warnings": 1, "passed": False} and violations.count() == 3
    plan = code.plan(["formatMessage"])
    assert [r.path for r in plan.affected_tests.collect()] == ["src/__tests__/greet.test.ts"] and plan.risk == "low"
    assert [r.risk for r in code.plan(["ping"]).cycle_risks.collect()] == ["ping is in a cycle: src/health.ts::check -> src/health.ts::ping -> src/health.ts::check"]
    assert code.affected(["src/lib/format.ts", "src/__tests__/greet.test.ts"]).count() == 1 and code.affected(["src/lib/format.ts"], pattern="lib/*.ts").count() == 2
    assert code.summary().startswith("typescript-dominant code base with 6 files, 10 symbols and 12 edges. Style: monolith.")
    assert {r.path for r in code.explore("formatMessage").collect()} >= {"src/lib/format.ts"} and code.context("formatMessage").tokens > 0
    assert {r.framework for r in code.dna()["frameworks"].collect()} == {"flask"}
    assert code.dna()["health"].first().modularity == 90
    assert "subgraph" in code.export() and "digraph" in code.export("dot", "main") and "<svg" in code.export("html")
    changed = code.changed(spark.createDataFrame([("src/lib/format.ts", "modified")], "path string, status string"), spark.createDataFrame([("src/lib/format.ts", 5, 6)], "path string, start int, end int"))
    assert code.limits("impact", "greet") == (5, 100) == code.limits("impact", "nothing") and code.limits("impact", "ping") == (6, 100)
    assert [r.qualified_name for r in changed.collect()] == ["src/lib/format.ts::unused"]
    assert {r.path for r in code.files("src/lib", "*.ts").collect()} == {"src/lib/greet.ts", "src/lib/format.ts"}
    assert code.status().filter("item = 'files'").first().n == 6 and set(code.stats()) and code.suggest().count() > 0
    assert {r.path for r in code.auto_context("src/lib/greet.ts")["tests"].collect()} == {"src/__tests__/greet.test.ts"}


def test_config():
    c = engine.Config.parse('{"ignore": ["dist"], "max_depth": 5, "max_nodes": "many", "rules": [{"type": "max-fan-out", "max": 3}, {"type": "odd"}], "other": 1}')
    assert (c.ignore, c.max_depth, c.max_nodes, [(r.type, r.most) for r in c.rules]) == (["dist"], 5, 50, [("max-fan-out", 3)])
    assert engine.Config.parse("not json") == engine.Config() == engine.Config.parse("[]")


def test_listed_paths(spark):
    lines = spark.createDataFrame([(" a.py ",), ("",), ("b.txt",)], "value string")
    assert [tuple(r) for r in engine.languages_of(lines).collect()] == [("a.py", "python"), ("b.txt", None)]


def state(code):
    edges = code.edges.join(code.nodes.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("s")), "source_id").join(code.nodes.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("t")), "target_id")
    return {(r.qualified_name, r.kind, r.start_line, r.role) for r in code.nodes.collect()}, {(r.s, r.t, r.kind) for r in edges.collect()}, {tuple(r) for r in code.route_table.collect()}


def test_refresh_equals_a_new_index(spark, tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    root, config = f"file://{tmp_path}", engine.Config()
    first = engine.index(spark, root)
    same = engine.refresh(first, engine.sources_of(spark, root, config))
    assert (same.scanned, same.changed, same.removed, same.resolved) == (6, 0, 0, 0) and state(same.code) == state(first)
    (tmp_path / "src/lib/format.ts").write_text("export function formatMessage(m: string) {\n  return shout(m);\n}\n\nexport function shout(m: string) {\n  return m;\n}\n")
    (tmp_path / "src/health.ts").unlink()
    (tmp_path / "src/new.ts").write_text("import { shout } from './lib/format';\n\nexport function fresh() {\n  shout('a');\n}\n")
    second = engine.refresh(same.code, engine.sources_of(spark, root, config))
    assert (second.scanned, second.changed, second.removed) == (6, 2, 1)
    assert state(second.code) == state(engine.index(spark, root))
    before = {r.qualified_name: r.id for r in first.nodes.collect()}
    after = {r.qualified_name: r.id for r in second.code.nodes.collect()}
    assert after["src/main.ts::main"] == before["src/main.ts::main"] and len(set(after.values())) == len(after)
    assert second.code.graph.files.select("file_id").distinct().count() == 6
    forced = engine.refresh(second.code, engine.sources_of(spark, root, config), force=True)
    assert forced.changed == 6 and state(forced.code) == state(second.code)


def test_refresh_of_random_changes(spark, tmp_path):
    """Files come, change and go, names move between them, imports of beginnings of paths meet other files: always what a whole index gives, with few references resolved."""
    r = random.Random(2)
    names = [f"fn{k}" for k in range(9)]

    def body():
        imports = "".join(f"import {{ {r.choice(names)} }} from './{r.choice(['m', 'mo', 'm1', 'm2', 'other'])}';\n" for _ in range(r.choice([0, 1, 2])))
        own = r.sample(names, r.choice([1, 2, 3]))
        return imports + "".join(f"{r.choice(['export ', ''])}function {n}() {{\n  {r.choice(names)}();\n  {r.choice(names)}();\n}}\n" for n in own)

    for k in range(5):
        (tmp_path / f"m{k}.ts").write_text(body())
    (tmp_path / "far.ts").write_text("function alone() {\n  nobody();\n}\n")
    root, config = f"file://{tmp_path}", engine.Config()
    code = engine.index(spark, root)
    for step in range(3):
        changes = r.sample(["m0", "m1", "m2", "m3", "m4", "mo", "other"], 2)
        for name in changes:
            path = tmp_path / f"{name}.ts"
            if path.exists() and step != 1 and r.random() < 0.5:
                path.unlink()
            else:
                path.write_text(body())
        done = engine.refresh(code, engine.sources_of(spark, root, config))
        assert state(done.code) == state(engine.index(spark, root))
        assert done.resolved < done.code.graph.raw_refs.count()  # not the one in far.ts
        kept = {(e.source_id, e.target_id, e.kind): e.id for e in code.edges.collect()}
        now = {(e.source_id, e.target_id, e.kind): e.id for e in done.code.edges.collect()}
        assert len(set(now.values())) == len(now) and all(now[e] == kept[e] for e in now.keys() & kept.keys())
        code = done.code
