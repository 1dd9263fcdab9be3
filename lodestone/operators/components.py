"""Strongly connected components by labels, and the cycles that an ordered depth-first search finds, component by component."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.storage import kept

#: Edges that one task may hold: a part of the graph with no more is finished by itself in a task.
LOCAL_EDGES = 200_000
#: Edges of a region that a walk may hold, as numbers (some 30 bytes an edge while they are put together).
WALK_EDGES = 32_000_000


def _settled(edges: DataFrame) -> DataFrame:
    """(id, c, d), kept: of each node the least node that leads to it and the least that it leads to, itself included.

    Labels go along the edges until nothing changes. A node also takes over the
    label of its label: what leads to c leads to the node, so long ways take few
    rounds.
    """
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select(F.col("target_id").alias("id"))).distinct()
    labels = ends.select("id", F.col("id").alias("c"), F.col("id").alias("d"))
    while True:
        now = labels
        for _ in range(2):
            into = edges.join(now.select(F.col("id").alias("source_id"), "c"), "source_id").select(F.col("target_id").alias("id"), "c", F.lit(None).cast("long").alias("d"))
            back = edges.join(now.select(F.col("id").alias("target_id"), "d"), "target_id").select(F.col("source_id").alias("id"), F.lit(None).cast("long").alias("c"), "d")
            now = now.select("id", "c", "d").unionByName(into).unionByName(back).groupBy("id").agg(F.min("c").alias("c"), F.min("d").alias("d"))
        far = now.select(F.col("id").alias("c"), F.col("c").alias("_c")), now.select(F.col("id").alias("d"), F.col("d").alias("_d"))
        jumped = now.join(far[0], "c").join(far[1], "d").select("id", F.col("_c").alias("c"), F.col("_d").alias("d"))
        before = labels.select("id", F.col("c").alias("_c"), F.col("d").alias("_d"))
        changed = kept(jumped.join(before, "id").select("id", "c", "d", F.expr("c = _c AND d = _d").alias("same")))
        labels = changed.select("id", "c", "d")
        if not changed.filter("NOT same").limit(1).count():
            return labels


def _tarjan(after: dict[int, list[int]]) -> Iterator[list[int]]:
    """The strongly connected components, each after those that it leads to."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    path: list[int] = []
    on: set[int] = set()
    for root in after:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        path.append(root)
        on.add(root)
        while work:
            node, following = work[-1]
            to = next(following, None)
            if to is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    own = [path.pop()]
                    while own[-1] != node:
                        own.append(path.pop())
                    on.difference_update(own)
                    yield own
            elif to not in index:
                index[to] = low[to] = len(index)
                path.append(to)
                on.add(to)
                work.append((to, iter(after.get(to, ()))))
            elif to in on:
                low[node] = min(low[node], index[to])


def _labelled(rows: pd.DataFrame) -> pd.DataFrame:
    """(id, component, root) of the edges of a class: each node's component by its least node, and the least node of the class that leads to it."""
    after: dict[int, list[int]] = {}
    for s, t in zip(rows.source_id.tolist(), rows.target_id.tolist(), strict=True):
        after.setdefault(s, []).append(t)
        after.setdefault(t, [])
    component: dict[int, int] = {}
    order = list(_tarjan(after))
    for own in order:
        component.update(dict.fromkeys(own, min(own)))
    root = {c: c for c in set(component.values())}
    for own in reversed(order):  # what leads on comes first
        c = component[own[0]]
        for node in own:
            for to in after[node]:
                root[component[to]] = min(root[component[to]], root[c])
    return pd.DataFrame([(i, c, root[c]) for i, c in component.items()], columns=["id", "component", "root"])


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component, root), kept: for each end of an edge the least node of its component, and the least node that leads to it.

    Edges fall into classes, at first all into one. A class with at most LOCAL_EDGES
    is finished in a task. In a larger one labels settle first: a node that the
    least node of a class leads to, and that leads to it, is in that node's
    component, and nodes with different labels are in different components, so the
    edges that are left fall into smaller classes.
    """
    left = kept(edges.filter("source_id != target_id").select("source_id", "target_id").distinct().withColumn("class", F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("d"))))
    loops = edges.filter("source_id = target_id").select(F.col("source_id").alias("id")).distinct()
    roots, found = None, []
    while True:
        sizes = kept(left.groupBy("class").agg(F.count("*").alias("n")))
        small = left.join(sizes.filter(F.col("n") <= LOCAL_EDGES), "class", "left_semi")
        found.append(kept(small.groupBy("class").applyInPandas(_labelled, "id long, component long, root long")))
        large = sizes.filter(F.col("n") > LOCAL_EDGES)
        if not large.limit(1).count():
            break
        left = kept(left.join(large, "class", "left_semi").select("source_id", "target_id"))
        labels = _settled(left)
        if roots is None:
            roots = labels.select("id", F.col("c").alias("root"))
        found.append(labels.filter("c = d").select("id", F.col("c").alias("component"), F.col("c").alias("root")))
        open_ = labels.filter("c != d")
        s, t = (open_.select(F.col("id").alias(f"{x}_id"), F.struct("c", "d").alias(f"{x}_class")) for x in ("source", "target"))
        left = kept(left.join(s, "source_id").join(t, "target_id").filter("source_class = target_class").select("source_id", "target_id", F.col("source_class").alias("class")))
    all_ = reduce(DataFrame.unionByName, found)
    if roots is not None:
        all_ = roots.join(all_.select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"), "root")
    alone = loops.join(all_, "id", "left_anti").select("id", F.col("id").alias("component"), F.col("id").alias("root"))
    return kept(all_.unionByName(alone))


#: What a walk finds: a cycle (way: its nodes as they were passed; turned: their names' numbers from the least on, which is at place turn), or an edge that leaves the component; event tells the order.
_FOUND = "event long, edge long, target long, to long, way array<long>, turn int, turned array<long>"
_COLUMNS = [c.split()[0] for c in _FOUND.split(", ")]


class _Held:
    """The edges of a component in the order of a search, batch by batch: 8 bytes an edge, some more for a node or an edge that leaves."""

    def __init__(self, component: int, start: int):
        self.component, self.start, self.size = component, start, 0
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.targets: list[np.ndarray] = []
        self.leaving: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, source: np.ndarray, target: np.ndarray, name: np.ndarray, inner: np.ndarray | None, edge: np.ndarray | None, to: np.ndarray | None) -> None:
        first = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
        self.runs.append((source[first], name[first], first + self.size))
        self.targets.append(target.copy())
        if inner is not None and not inner.all():
            out = np.flatnonzero(~inner)
            self.leaving.append((out + self.size, edge[out], to[out]))
        self.size += len(source)

    def walk(self, most: int) -> list[tuple]:
        """A depth-first search from start along the inner edges, in their order; it ends with the most-th cycle that differs from those before."""
        source, name, first = (np.concatenate(x) for x in zip(*self.runs, strict=True))
        new = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
        ids, name, after = source[new], memoryview(name[new]), first[new]
        end = memoryview(np.r_[after[1:], self.size])
        after = memoryview(after)
        targets = []
        for t in self.targets:  # what has no edges here ends a way
            at = np.minimum(np.searchsorted(ids, t), len(ids) - 1)
            targets.append(np.where(ids[at] == t, at, -1).astype(np.int32))
        following = memoryview(np.concatenate(targets))
        out, edge, to = (np.concatenate(x) for x in zip(*self.leaving, strict=True)) if self.leaving else (np.empty(0, np.int64),) * 3
        leaves = np.zeros(self.size, bool)
        leaves[out] = True
        leaves = memoryview(leaves)
        state, place = bytearray(len(ids)), memoryview(np.zeros(len(ids), np.int64))  # of a node: new, on the way, done
        known: set[tuple[int, ...]] = set()
        found: list[tuple] = []
        stack: list[int] = []
        begin = int(np.searchsorted(ids, self.start))
        if begin < len(ids) and ids[begin] == self.start:
            stack.append(begin)
            state[begin] = 1
        while stack and len(known) < most:
            node = stack[-1]
            e = after[node]
            if e == end[node]:
                stack.pop()
                state[node] = 2
                continue
            after[node] = e + 1
            if leaves[e]:
                k = int(np.searchsorted(out, e))
                found.append((len(found), int(edge[k]), self._target(e), int(to[k]), None, None, None))
                continue
            t = following[e]
            if t < 0:
                continue
            if state[t] == 1:
                way = stack[place[t] :]
                cycle = [name[n] for n in way]
                k = cycle.index(min(cycle))
                turned = tuple(cycle[k:] + cycle[:k])
                if turned not in known:
                    known.add(turned)
                    found.append((len(found), None, None, None, ids[way].tolist(), k, [*turned]))
            elif not state[t]:
                state[t], place[t] = 1, len(stack)
                stack.append(t)
        return found

    def _target(self, e: int) -> int:
        for t in self.targets:
            if e < len(t):
                return int(t[e])
            e -= len(t)
        raise IndexError(e)


def _walked(rows: DataFrame, most: int) -> DataFrame:
    """(component, event, ...) of rows (component, start, source_id, target_id, id, late, name, and to and inner unless all edges are inner): a walk for each component.

    A component's edges come sorted, a batch at a time, and are held as numbers.
    """
    outer = ["inner", "id", "to"] if "inner" in rows.columns else []

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Held | None = None
        found: list[tuple] = []

        def handed() -> Iterator[pa.RecordBatch]:
            if found:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64())]
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["component", *_COLUMNS])
                found.clear()

        for batch in batches:
            component, start, source, target, name, *more = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            bounds = [*np.flatnonzero(np.r_[True, component[1:] != component[:-1]]).tolist(), len(component)] if len(component) else []
            for a, b in zip(bounds, bounds[1:]):
                if held is None or held.component != component[a]:
                    if held is not None:
                        found += [(held.component, *f) for f in held.walk(most)]
                        if len(found) >= 1_000:
                            yield from handed()
                    held = _Held(int(component[a]), int(start[a]))
                held.add(source[a:b], target[a:b], name[a:b], *((x[a:b] for x in more) if outer else (None,) * 3))
        if held is not None:
            found += [(held.component, *f) for f in held.walk(most)]
        yield from handed()

    dealt = rows.repartition("component").sortWithinPartitions("component", "source_id", "late", "id")
    return dealt.select("component", "start", "source_id", "target_id", "name", *outer).mapInArrow(walk, f"component long, {_FOUND}")


def _roots(edges: DataFrame) -> DataFrame:
    """(id, root), kept: of each node the least node that leads to it, itself included; labels go along the edges as in _settled. No table goes to the driver, whatever its size."""
    steps = kept(edges.filter("source_id != target_id").select("source_id", "target_id").distinct())
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select(F.col("target_id").alias("id"))).distinct()
    labels = kept(ends.select("id", F.col("id").alias("root")))
    while True:
        now = labels
        for _ in range(2):
            into = steps.join(now.select(F.col("id").alias("source_id"), "root").hint("merge"), "source_id").select(F.col("target_id").alias("id"), "root")
            now = now.unionByName(into).groupBy("id").agg(F.min("root").alias("root"))
        jumped = now.join(now.select(F.col("id").alias("root"), F.col("root").alias("_far")).hint("merge"), "root").select("id", F.col("_far").alias("root"))
        before = labels.select("id", F.col("root").alias("_root")).hint("merge")
        changed = kept(jumped.join(before, "id").select("id", "root", F.expr("root = _root").alias("same")))
        labels = changed.select("id", "root")
        if not changed.filter("NOT same").limit(1).count():
            return labels


def _longer(key: Column, *more: Column) -> Column:
    return F.concat(key, F.array(*more))


def _in_waves(inner: DataFrame, cross: DataFrame, comps: DataFrame, cyclic: DataFrame, most: int) -> DataFrame:
    """(key, way, turn, turned): the walks of the components of large regions, each when all that lead to it have been walked.

    Outside its component, the way of a depth-first search to a node is the least in
    the order of its steps, as nothing leads back: a component begins where the
    least key leads into it, and a key is the way's roots and events.
    """
    pending, left = kept(comps), kept(cross)
    entered = comps.filter("component = root").select("component", F.array("root").alias("key"), F.col("root").alias("start"))
    out = []
    while pending.join(cyclic, "component", "left_semi").limit(1).count():
        ready = kept(pending.select("component").join(left.select(F.col("to").alias("component")), "component", "left_anti"))
        begun = kept(entered.join(ready, "component", "left_semi").groupBy("component").agg(F.min(F.struct("key", "start")).alias("b")).select("component", "b.key", "b.start"))
        own = left.join(begun, "component")
        plain = own.join(cyclic, "component", "left_anti").select(F.col("to").alias("component"), _longer(F.col("key"), F.col("late"), F.col("id")).alias("key"), F.col("target_id").alias("start"))
        walks = begun.join(cyclic, "component", "left_semi").select("component", "start")
        rows = inner.join(walks, "component").unionByName(left.withColumn("inner", F.lit(False)).join(walks, "component"))
        events = kept(_walked(rows, most).join(begun.select("component", "key"), "component"))
        out.append(events.filter("way IS NOT NULL").select(_longer(F.col("key"), F.col("event")).alias("key"), "way", "turn", "turned"))
        crossed = events.filter("way IS NULL").select(F.col("to").alias("component"), _longer(F.col("key"), F.col("event")).alias("key"), F.col("target").alias("start"))
        entered = kept(entered.join(ready, "component", "left_anti").unionByName(plain).unionByName(crossed))
        left = kept(left.join(ready, "component", "left_anti"))
        pending = kept(pending.join(ready, "component", "left_anti"))
    return reduce(DataFrame.unionByName, out) if out else entered.limit(0).selectExpr("key", "key AS way", "0 AS turn", "key AS turned")


def _by_components(rows: DataFrame, most: int) -> DataFrame:
    """(key, way, turn, turned) of the edges of large regions: each strongly connected component is a walk of its own."""
    labels = strong_components(rows)
    loops = rows.filter("source_id = target_id").select(F.col("source_id").alias("id")).join(labels, "id").select("component")
    cyclic = kept(labels.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component").unionByName(loops).distinct())
    s, t = (labels.select(F.col("id").alias(f"{x}_id"), F.col("component").alias(c), F.col("root").alias(r)) for x, c, r in (("source", "component", "root"), ("target", "to", "_root")))
    big = kept(rows.drop("root").join(s, "source_id").join(t, "target_id").filter("root = _root").drop("root", "_root"))
    comps = labels.select("component", "root").distinct()
    inner = big.filter("component = to").withColumn("inner", F.lit(True))
    return _in_waves(inner, big.filter("component != to"), comps, cyclic, most)


def search_cycles(edges: DataFrame, nodes: DataFrame, most: int = 50) -> DataFrame:
    """(cycle, path, length, files): a cycle for each back edge of a depth-first search, at most `most`.

    The search starts at the nodes in order of their ids and follows a node's calls,
    then its imports, each by edge id. What is reached from a root is a region, which
    no other root's walk enters. A region of at most WALK_EDGES is walked in a task,
    which holds numbers alone; in a larger one each strongly connected component
    is a walk of its own, so only a component has to fit in a task. Names are numbered
    in their order, and come back to the cycles that are returned.
    """
    names = kept(nodes.select("qualified_name").distinct().orderBy("qualified_name").withColumn("name", F.monotonically_increasing_id()))
    place = nodes.select(F.col("id").alias("source_id"), "qualified_name").join(names.hint("merge"), "qualified_name").select("source_id", "name")
    numbers = kept(edges.select("id", "source_id", "target_id", (F.col("kind") != "calls").cast("long").alias("late")).join(place.hint("merge"), "source_id"))
    labels = _roots(numbers)
    rows = kept(numbers.join(labels.select(F.col("id").alias("source_id"), "root").hint("merge"), "source_id"))
    large = kept(rows.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > WALK_EDGES).select("root"))
    some = large.limit(1).count() > 0
    small = rows.join(large, "root", "left_anti") if some else rows
    # a region's own nodes are those with edges there: an edge to another one leads to what is done
    whole = small.select(F.col("root").alias("component"), F.col("root").alias("start"), "source_id", "target_id", "id", "late", "name")
    found = _walked(whole, most).select(F.array("component", "event").alias("key"), "way", "turn", "turned")
    if some:
        # a target whose root is a lesser one is done before; the least node that leads to a target of the region is never greater
        here = rows.join(large, "root", "left_semi").join(labels.select(F.col("id").alias("target_id"), F.col("root").alias("_root")).hint("merge"), "target_id").filter("root = _root").drop("_root")
        found = found.unionByName(_by_components(here, most))
    first = found.groupBy("turned").agg(F.min(F.struct("key", "turn", "way")).alias("f")).orderBy("f.key").limit(most)
    chosen = kept(first.agg(F.sort_array(F.collect_list("f")).alias("all")).select(F.posexplode("all").alias("cycle", "c")).select("cycle", "c.turn", "c.way"))  # at most `most`
    steps = chosen.select("cycle", F.posexplode("way").alias("step", "id")).join(nodes.select("id", "qualified_name", "path"), "id")
    named = steps.groupBy("cycle").agg(F.array_sort(F.collect_list(F.struct("step", "qualified_name", "path"))).alias("s"))
    rest = F.col("length") - F.col("turn")
    turned = F.concat(F.slice("names", F.col("turn") + 1, rest), F.slice("names", F.lit(1), F.col("turn")), F.array(F.element_at("names", F.col("turn") + 1)))
    told = named.join(chosen.select("cycle", "turn"), "cycle").select("cycle", "turn", F.col("s.qualified_name").alias("names"), F.size("s").alias("length"), F.array_distinct("s.path").alias("files"))
    return told.select("cycle", turned.alias("path"), "length", "files")
