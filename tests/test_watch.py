"""A tree that is watched, and questions to what it has become."""

import time

import pytest

from lodestone.operators.compression import PayloadStore
from lodestone.plans.desk import Desk, plain
from lodestone.sources.store import GraphStore
from lodestone.streaming.watch import Watch, listing_changes


def names(graph):
    return {r.name for r in graph.nodes.collect()}


def test_listing_changes(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "path string, size long, mtime double")
    before = rows(("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0))
    now = rows(("a", 1, 1.0), ("b", 2, 1.0), ("d", 1, 1.0))
    assert {tuple(r) for r in listing_changes(before, now).collect()} == {("b", "changed"), ("c", "deleted"), ("d", "new")}
    assert listing_changes(now, now).count() == 0 and listing_changes(before, now.limit(0)).count() == 3


def test_create_change_delete_reach_a_version_once_each(spark, tmp_path):
    root, store = tmp_path / "tree", GraphStore(spark, f"file://{tmp_path}/store")
    root.mkdir()
    (root / "a.py").write_text("def one():\n    two()\n")
    heard = []
    watch = Watch(spark, f"file://{root}", store, heard=lambda code, changes: heard.append({tuple(r) for r in changes.collect()}))

    def ticks(n=3):
        for _ in range(n):
            assert watch.tick()
        return store.version, names(store.open())

    assert ticks() == (1, {"one"})
    (root / "b.py").write_text("def two():\n    pass\n")
    assert ticks() == (2, {"one", "two"}) and store.open().edges.count() == 1
    time.sleep(0.01)
    (root / "a.py").write_text("def other():\n    two()\n")
    watch.tick()
    assert store.version == 2  # more may come
    (root / "c.py").write_text("def three():\n    pass\n")
    watch.tick()
    assert store.version == 2  # it has
    assert ticks() == (3, {"other", "two", "three"})
    (root / "b.py").unlink()
    assert ticks() == (4, {"other", "three"}) and store.open().edges.count() == 0
    assert heard == [{("a.py", "new")}, {("b.py", "new")}, {("a.py", "changed"), ("c.py", "new")}, {("b.py", "deleted")}]
    assert names(store.open(2)) == {"one", "two"} and store.meta() == {"root": f"file://{root}"}
    desk = Desk(watch.code, PayloadStore(spark, f"file://{tmp_path}/payloads"))
    first = desk.ask("callers", name="three", depth=1)
    assert desk.retrieve(first["meta"]["payload_id"]) == plain(watch.code.callers("three", 1)) and desk.retrieve("payload_none") is None
    assert {r["name"] for r in desk.retrieve(desk.ask("search", query="other")["meta"]["payload_id"])} == {"other"}
    lint = desk.ask("lint", rules=[{"type": "max-file-symbols", "most": 0}])
    assert len(desk.retrieve(lint["meta"]["payload_id"])[0]) == 2
    assert len(desk.answers) == 3
    desk.renew(watch.code)
    assert len(desk.answers) == 0
    with pytest.raises(ValueError, match="question drop"):
        desk.ask("drop")


def test_a_failing_tick_changes_nothing(spark, tmp_path):
    root, store = tmp_path / "tree", GraphStore(spark, f"file://{tmp_path}/store")
    root.mkdir()
    (root / "a.py").write_text("def one():\n    pass\n")
    watch = Watch(spark, f"file://{root}", store)
    with store.transaction():
        pass
    real, watch.store = store, GraphStore(spark, f"file://{tmp_path}/store")
    watch.store.transaction = lambda: (_ for _ in ()).throw(RuntimeError("no"))
    with pytest.raises(RuntimeError):
        watch.tick()
    watch.store = real
    query = watch.start(0.5)
    try:
        for _ in range(240):
            if real.version == 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert real.version == 2 and names(real.open()) == {"one"}
