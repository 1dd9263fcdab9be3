"""Bounded traversals of a property graph, level by level."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import TEST_PATH, loose_glob
from lodestone.sources.adjacency import Adjacency
from lodestone.sources.storage import kept

CALLS, CALLS_AND_IMPORTS = ("calls",), ("calls", "imports")


class Traversal(NamedTuple):
    nodes: DataFrame  # node, depth, ord
    edges: DataFrame  # id, source_id, target_id, kind
    truncated: bool


#: Nodes of a traversal up to which it is kept on the driver between levels.
LOCAL_NODES = 10_000
#: Edges as a table, or stored by node.
Ways = DataFrame | Adjacency


def _near(edges: Ways, frontier: DataFrame, direction: str, kinds: tuple[str, ...] | None) -> DataFrame:
    """frontier (node, ...) with other, dir_rank, kind_rank, kind and edge: each edge of its nodes by which the direction leaves them."""
    if isinstance(edges, Adjacency):
        found = edges.of(frontier, direction, kinds)
    else:
        chosen = edges if kinds is None else edges.filter(F.col("kind").isin(*kinds))
        side = lambda own, other, k: chosen.select(F.col(own).alias("node"), F.col(other).alias("other"), F.lit(k).alias("dir_rank"), "kind", F.col("id").alias("edge"))
        forward, backward = side("source_id", "target_id", 0), side("target_id", "source_id", 1)
        found = frontier.join({"forward": forward, "backward": backward, "both": forward.unionByName(backward)}[direction], "node")
    rank = F.lit(0)
    for k, kind in enumerate(kinds or ()):
        rank = F.when(F.col("kind") == kind, F.lit(k)).otherwise(rank)
    return found.withColumn("kind_rank", rank)


def traverse(edges: Ways, start: int, max_depth: int = 3, max_nodes: int = 50, direction: str = "forward", kinds: tuple[str, ...] | None = CALLS) -> Traversal:
    """Breadth first from one node: at most max_nodes, in the order of their discovery.

    Within a level that order is by the discoverer's, forward before backward, by
    kind and edge. A level's new nodes are cut to what can still be emitted (and
    one more, which tells whether any were cut) before they are numbered, so that
    numbering is over a bounded number of rows, whatever the degree of a hub. Up to
    LOCAL_NODES they stay on the driver between the levels, a job for each level.
    """
    spark = edges.spark if isinstance(edges, Adjacency) else edges.sparkSession
    schema = "node long, depth int, ord long"
    local = [(start, 0, 0)]
    seen = spark.createDataFrame(local, schema)
    frontier, count, truncated = seen, 1, max_nodes < 1
    for depth in range(1, max_depth + 1):
        found = _near(edges, frontier, direction, kinds).join(seen.select(F.col("node").alias("other")), "other", "left_anti")
        first = found.groupBy("other").agg(F.min(F.struct("ord", "dir_rank", "kind_rank", "edge")).alias("by"))
        first = first.orderBy("by").limit(max(0, max_nodes - count) + 1)
        if max_nodes <= LOCAL_NODES:
            new = [(r.other, depth, count + k) for k, r in enumerate(first.collect())]
            frontier, more = spark.createDataFrame(new, schema), len(new)
            local += new
            seen = spark.createDataFrame(local, schema)
        else:
            frontier = kept(first.select(F.col("other").alias("node"), F.lit(depth).alias("depth"), (F.row_number().over(Window.orderBy("by")) - 1 + count).cast("long").alias("ord")))
            more = frontier.count()
            seen = seen.unionByName(frontier)
        count += more
        if not more or count > max_nodes:
            truncated = truncated or count > max_nodes
            break
    emitted = seen.filter(F.col("ord") < max_nodes) if max_nodes <= LOCAL_NODES else kept(seen.filter(F.col("ord") < max_nodes))
    # edges of emitted nodes to later nodes, or to nodes that were not emitted
    ends = emitted.select(F.col("node").alias("other"), F.col("ord").alias("other_ord"))
    leaving = _near(edges, emitted.filter(F.col("depth") <= max_depth), direction, kinds).join(ends, "other", "left").filter("other_ord IS NULL OR other_ord > ord")
    forward = F.col("dir_rank") == 0
    own = leaving.select(F.col("edge").alias("id"), F.when(forward, F.col("node")).otherwise(F.col("other")).alias("source_id"), F.when(forward, F.col("other")).otherwise(F.col("node")).alias("target_id"), "kind")
    return Traversal(emitted, own.dropDuplicates(["id"]), truncated)


def traverse_each(edges: Ways, seeds: DataFrame, max_depth: int = 3, max_nodes: int = 50, direction: str = "backward", kinds: tuple[str, ...] | None = CALLS_AND_IMPORTS) -> tuple[DataFrame, DataFrame]:
    """(seed, node, depth, ord) and (seed): traverse from each seed (column seed) by itself, all of them level by level at once; and the seeds that found more than max_nodes.

    For each seed that is what traverse gives: the first max_nodes in the order of
    their discovery, so a smaller max_nodes gives a prefix. A level's new nodes are
    cut to max_nodes a seed before they are numbered.
    """
    seen = kept(seeds.select(F.col("seed").cast("long").alias("seed")).distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ord")))
    order = Window.partitionBy("seed").orderBy("by")
    for depth in range(1, max_depth + 1):
        counts = seen.groupBy("seed").agg(F.count("*").alias("so_far")).filter(F.col("so_far") <= max_nodes)
        frontier = seen.filter(F.col("depth") == depth - 1).join(counts.select("seed"), "seed", "left_semi")
        found = _near(edges, frontier, direction, kinds).join(seen.select("seed", F.col("node").alias("other")), ["seed", "other"], "left_anti")
        first = found.groupBy("seed", "other").agg(F.min(F.struct("ord", "dir_rank", "kind_rank", "edge")).alias("by"))
        ranked = first.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= max_nodes + 1).join(counts, "seed")
        placed = ranked.select("seed", F.col("other").alias("node"), F.lit(depth).alias("depth"), (F.col("so_far") + F.col("k") - 1).cast("long").alias("ord"))
        fresh = kept(placed.filter(F.col("ord") <= max_nodes))
        if not fresh.limit(1).count():
            break
        seen = seen.unionByName(fresh)
    cut = seen.filter(F.col("ord") >= max_nodes).select("seed").distinct()
    return seen.filter(F.col("ord") < max_nodes), cut


def reach(edges: Ways, starts: DataFrame, max_depth: int, direction: str = "backward", kinds: tuple[str, ...] = CALLS_AND_IMPORTS) -> DataFrame:
    """(node, depth): all nodes within max_depth of any start (column node), without a cap."""
    seen = kept(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        fresh = _near(edges, seen.filter(F.col("depth") == depth - 1), direction, kinds).select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = kept(fresh.withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def best_connected(nodes: DataFrame, edges: Ways, name: str) -> int | None:
    """Of the nodes of that name the one with most calls in and out; the lowest id of those."""
    own = nodes.filter(F.col("name") == name).select("id")
    degree = _near(edges, own.select(F.col("id").alias("node")), "both", CALLS).groupBy(F.col("node").alias("id")).count()
    row = own.join(degree, "id", "left").orderBy(F.desc(F.coalesce("count", F.lit(0))), "id").first()
    return row.id if row else None


def callers(nodes: DataFrame, edges: Ways, name: str, depth: int = 3, most: int = 50) -> DataFrame:
    return _neighbours(nodes, edges, name, depth, most, "backward")


def callees(nodes: DataFrame, edges: Ways, name: str, depth: int = 3, most: int = 50) -> DataFrame:
    return _neighbours(nodes, edges, name, depth, most, "forward")


def _neighbours(nodes: DataFrame, edges: Ways, name: str, depth: int, most: int, direction: str) -> DataFrame:
    """(node, depth), the start included."""
    start = best_connected(nodes, edges, name)
    if start is None:
        return nodes.sparkSession.createDataFrame([], "node long, depth int")
    return traverse(edges, start, depth, most, direction).nodes.select("node", "depth")


def impact(nodes: DataFrame, edges: Ways, target: str, depth: int = 3, most: int = 50) -> DataFrame:
    """(node, depth, ord): what depends on the nodes of that name, else on those of the file with that path.

    The seeds are followed one after the other, each with what is left of `most`;
    a node keeps its first depth.
    """
    seeds = [r.id for r in nodes.filter(F.col("name") == target).orderBy("id").select("id").limit(most).collect()]
    if not seeds:
        seeds = [r.id for r in nodes.filter(F.col("path") == target).orderBy("id").select("id").limit(most).collect()]
    found: dict[int, int] = {}
    if seeds:
        walks, _ = traverse_each(edges, nodes.sparkSession.createDataFrame([(s,) for s in seeds], "seed long"), depth, most)
        by_seed: dict[int, list] = {}
        for r in walks.orderBy("ord").collect():  # at most `most` rows for each of at most `most` seeds
            by_seed.setdefault(r.seed, []).append(r)
        for seed in seeds:
            for r in by_seed[seed][: most - len(found)]:
                found.setdefault(r.node, r.depth)
    rows = [(n, d, k) for k, (n, d) in enumerate(found.items())]
    return nodes.sparkSession.createDataFrame(rows, "node long, depth int, ord int")


def trace(nodes: DataFrame, edges: Ways, source: str, target: str, max_hops: int = 7, sources: int = 3) -> list[int]:
    """The ids on a shortest path of calls from a node of one name to one of the other; empty if there is none.

    The first nodes of the source's name are tried in order of id, and a later one
    counts only if its path is shorter.
    """
    goals = nodes.filter(F.col("name") == target).select(F.col("id").alias("node"))
    best: list[int] = []
    for seed in [r.id for r in nodes.filter(F.col("name") == source).orderBy("id").limit(sources).select("id").collect()]:
        levels = [nodes.sparkSession.createDataFrame([(seed, None)], "node long, parent long")]
        seen = levels[0].select("node")
        for _ in range(min(max_hops, len(best) - 2 if best else max_hops)):
            step = _near(edges, levels[-1].select("node"), "forward", CALLS).groupBy("other").agg(F.min("node").alias("parent"))
            fresh = kept(step.select(F.col("other").alias("node"), "parent").join(seen, "node", "left_anti"))
            if not fresh.limit(1).count():
                break
            levels.append(fresh)
            seen = seen.union(fresh.select("node"))
            if hit := fresh.join(goals, "node", "left_semi").orderBy("node").first():
                path = [hit.node, hit.parent]
                for level in reversed(levels[1:-1]):
                    path.append(level.filter(F.col("node") == path[-1]).first().parent)
                best = path[::-1]
                break
    return best


def affected_tests(nodes: DataFrame, edges: Ways, paths: list[str], depth: int = 5, pattern: str | None = None) -> DataFrame:
    """(path) in order, of the test files that depend on the files, those of them that are tests themselves included; pattern: a loose glob for what a test is."""
    seeds = nodes.filter(F.col("path").isin(*paths)).select(F.col("id").alias("node"))
    found = reach(edges, seeds, depth).select(F.col("node").alias("id"))
    is_test = F.col("path").rlike(TEST_PATH if pattern is None else loose_glob(pattern))
    return nodes.filter(is_test).join(found, "id", "left_semi").select("path").distinct().orderBy("path")
