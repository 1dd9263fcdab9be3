"""Versioned graph tables, kept answers, guarded work, inputs, streams."""

import datetime
import threading

import pytest
from test_graphs import make

from lodestone.operators import analytics, export
from lodestone.plans import cache, engine
from lodestone.sources.store import GraphStore
from lodestone.streaming import changes


@pytest.fixture
def g(spark):
    return make(spark, [(1, "a.ts", "x", 1, 2, 1), (2, "b.ts", "y", 1, 2, 0)], [(1, 2)])


def test_transactions(spark, tmp_path, g):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    assert store.version == 0 and store.open().nodes.count() == 0 and store.meta() == {}
    with store.transaction() as t:
        t.graph, t.meta["last_index"] = g, "now"
    old = store.open()
    with pytest.raises(ZeroDivisionError), store.transaction() as t:
        t.graph = t.graph.without_files(g.files)
        1 / 0
    assert store.version == 1 and store.open().nodes.count() == 2
    with store.transaction() as t:
        t.graph = t.graph.without_files(g.files.filter("file_id = 1"))
    assert store.version == 2 and [r.id for r in store.open().nodes.collect()] == [2] and store.open().edges.count() == 0
    assert old.nodes.count() == 2 and store.open(1).nodes.count() == 2 and store.meta() == {"last_index": "now"}
    with pytest.raises(RuntimeError, match="another transaction"), store.transaction() as t:
        with store.transaction() as other:
            other.meta["by"] = "other"
        t.meta["by"] = "late"
    assert store.meta()["by"] == "other" and store.version == 3
    assert len([*(tmp_path / "g/tables").iterdir()]) == 3


def test_answers_are_kept_for_a_while():
    now = [0.0]
    c = cache.AnswerCache(2, 30, lambda: now[0])
    calls = []
    ask = lambda n: c.answer("search", lambda: calls.append(n) or n, query="q", limit=n)
    assert [ask(1), ask(2), ask(1), ask(3), ask(1), ask(2)] == [1, 2, 1, 3, 1, 2] and calls == [1, 2, 3, 2]
    text = c.dump()
    now[0] = 31
    assert len(c) == 2 and c.key("search", query="q", limit=2) not in c and len(c) == 1
    fresh = cache.AnswerCache(2, 30, lambda: 1.0)
    fresh.load(text)
    assert len(fresh) == 2 and fresh.get(c.key("search", limit=2, query="q")) == 2
    fresh.load("no json")
    fresh.clear()
    assert len(fresh) == 0


def test_work_runs_one_at_a_time():
    ran, inside, go = [], threading.Event(), threading.Event()

    def work():
        ran.append(1)
        inside.set()
        go.wait(5)

    guard = cache.OneAtATime(work)
    first = threading.Thread(target=guard.ask)
    first.start()
    inside.wait(5)
    assert guard.ask() is False and guard.ask() is False
    go.set()
    first.join()
    assert len(ran) == 2 and guard.ask() is True and len(ran) == 3
    bad = cache.OneAtATime(lambda: 1 / 0)
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            bad.ask()


def test_inputs_and_json(spark, g):
    assert engine.checked("x", "name") == "x"
    for bad in ("", None, 3, "x" * 10_001):
        with pytest.raises(ValueError):
            engine.checked(bad, "name")
    with pytest.raises(ValueError):
        engine.CodeBase(g).callers("")
    assert export.json_text(g.edges) == '[{"id": 1, "source_id": 1, "target_id": 2, "kind": "calls"}]' and "\n  " in export.json_text(g.edges, pretty=True)
    stamped = engine.replace(g, files=g.files.selectExpr("*", "file_id * 1000 AS indexed_at"))
    assert [r.key for r in analytics.status(stamped, g.nodes.selectExpr("*", "'x' AS role")).filter("item = 'last_indexed'").collect()] == ["1970-01-01T00:00:02.000Z"]


def test_alerts_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    at = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k)
    rows = [(k, at(k), k % 3, float(k % 7) + 0.25) for k in range(120)]
    schema = "event_id long, ts timestamp, user_id int, value double"
    limits = (50.0, 100.0, 1e6)
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"file://{tmp_path}/in")
    found = changes.alert_stream(events, "user_id", "value", limits, history=5)
    query = found.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.user_id, r.limit, r.ts, r.running) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    batch = changes.threshold_alerts(spark.createDataFrame(rows, schema), "user_id", "value", limits)
    assert got == {(r.user_id, r.limit, r.ts, r.running) for r in batch.collect()} and len(got) == 6


def test_file_changes_stream(spark, tmp_path):
    (tmp_path / "src/sub").mkdir(parents=True)
    for name in ("src/a.py", "src/sub/b.ts", "src/n.txt"):
        (tmp_path / name).write_text("x")
    query = changes.file_changes(spark, f"file://{tmp_path}/src").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.path.rsplit("/src/", 1)[1], r.size) for r in spark.table("seen").collect()} == {("a.py", 1), ("sub/b.ts", 1)}
