"""Answers made of several operators: context, exploration, plan risk, node detail, limits."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import TEST_PATH, lines_between, token_estimate
from lodestone.operators import ranges, search, traversal
from lodestone.operators.analytics import risk_of
from lodestone.operators.components import search_cycles
from lodestone.sources.storage import Graph, kept

#: Depth and nodes by kind of answer, before they are adapted.
BASE_LIMITS = {
    "callers": (3, 40), "callees": (3, 40), "impact": (4, 80), "trace": (8, 2_000),
    "context": (2, 30), "explore": (3, 60), "affected": (6, 500), "node": (1, 15),
}
SNIPPET_LINES, SNIPPETS = 30, 20
MOST_SECTION_CHARS = 6_000


def limits(tool: str, nodes: int, degree: float | None = None, depth: int | None = None, most: int | None = None) -> tuple[int, int]:
    """(depth, nodes) for a graph of so many nodes and a name whose symbols have that mean degree; given ones count instead, within the clamps unless both are given."""
    if depth is not None and most is not None:
        return depth, most
    d, n = BASE_LIMITS[tool]
    if nodes < 200:
        d, n = d + 1, n + 20
    elif nodes > 2_000:
        d, n = d - 1, n + 30
    if degree is not None:
        if degree > 20:
            d, n = d - 1, n + 20
        elif degree < 5:
            d += 1
    d, n = depth if depth is not None else d, most if most is not None else n
    return max(1, min(10, d)), max(5, min(2_000, n))


@dataclass
class Context:
    """symbols (id, depth), edges, files (path, n), snippets (id, snippet), and the estimate of their tokens."""

    symbols: DataFrame
    edges: DataFrame
    files: DataFrame
    snippets: DataFrame | None
    tokens: int


def build_context(graph: Graph, task: str, contents: DataFrame | None = None, max_nodes: int = 50, max_depth: int = 3) -> Context:
    """The neighbourhood of what a task's words find: up to ten seeds, each followed two steps at most and to twenty symbols."""
    seeds = [r.id for r in search.symbol_search(graph.nodes, task, 10).select("id").collect()]
    walks = _walks(graph, seeds, min(max_depth, 2), 20)
    found: dict[int, int] = {}
    reached: dict[int, list[int]] = {}
    for seed in seeds:
        if len(found) >= max_nodes:
            break
        rows = walks.get(seed, [])[: max(1, min(max_nodes - len(found), 20))]
        reached[seed] = [r.node for r in rows]
        for r in rows:
            found.setdefault(r.node, r.depth)
    pairs = [(s, n) for s, ns in reached.items() for n in ns]
    own = F.broadcast(graph.edges.sparkSession.createDataFrame(pairs, "seed long, n long"))  # at most ten times twenty
    inside = graph.edges.join(own.select("seed", F.col("n").alias("source_id")), "source_id").join(own.select(F.col("seed").alias("s"), F.col("n").alias("target_id")), "target_id").filter("seed = s")
    edges = inside.select(*graph.edges.columns)
    symbols = graph.edges.sparkSession.createDataFrame([(k, n, d) for k, (n, d) in enumerate(found.items())], "k int, id long, depth int")
    own = kept(graph.nodes.join(F.broadcast(symbols), "id"))
    files = own.groupBy("path").agg(F.count("*").alias("n"))
    snippets, tokens = None, 0
    if contents is not None:
        first = own.orderBy("depth", "k").limit(SNIPPETS)
        snippets = first.join(contents.select("path", "content"), "path").select("id", lines_between(F.col("content"), F.col("start_line"), F.col("end_line"), SNIPPET_LINES).alias("snippet"))
        tokens = int(snippets.agg(F.sum(token_estimate(F.col("snippet")))).first()[0] or 0)
    return Context(own.select("id", "depth"), edges.distinct(), files, snippets, tokens)


def explore(graph: Graph, query: str, contents: DataFrame, max_files: int = 12, max_chars: int = MOST_SECTION_CHARS, max_depth: int = 2, max_nodes: int = 50) -> DataFrame:
    """(path, score, first, last, section): source ranges of the files that a query and its neighbourhood touch, within a budget per file."""
    entries = [r.id for r in search.symbol_search(graph.nodes, query, 30).select("id").collect()]
    found = dict.fromkeys(entries, 10)
    walks = _walks(graph, entries[:8], max_depth, max_nodes)
    for seed in entries[:8]:
        for r in walks.get(seed, []):
            if len(found) < 200:
                found.setdefault(r.node, 1)
    hits = graph.edges.sparkSession.createDataFrame(list(found.items()), "id long, weight int")
    own = kept(graph.nodes.join(F.broadcast(hits), "id").select("path", "start_line", "end_line", "weight"))
    best = own.groupBy("path").agg(F.sum("weight").alias("score")).orderBy(F.desc("score"), "path").limit(max_files)
    islands = ranges.islands(own.join(best, "path", "left_semi"), "path", "start_line", "end_line")
    sections = islands.join(contents.select("path", "content"), "path").withColumn("section", lines_between(F.col("content"), F.col("start_line"), F.col("end_line"), 1 << 20))
    cut = ranges.within_budget(sections.withColumn("chars", F.length("section")), "path", ["start_line"], "chars", max_chars)
    return cut.join(best, "path").select("path", "score", F.col("start_line").alias("first"), F.col("end_line").alias("last"), "section")


def _walks(graph: Graph, seeds: list[int], depth: int, most: int) -> dict[int, list]:
    """For each seed what it reaches in both directions over all kinds of edges, in order; so many seeds times `most` rows come to the driver."""
    out: dict[int, list] = {}
    if seeds:
        walks, _ = traversal.traverse_each(graph.ways, graph.edges.sparkSession.createDataFrame([(s,) for s in seeds], "seed long"), depth, most, "both", None)
        for r in walks.orderBy("ord").collect():
            out.setdefault(r.seed, []).append(r)
    return out


#: Callers from which on a symbol is worth a warning, and cycles that are looked at.
MANY_CALLERS, RISK_CYCLES = 5, 10


@dataclass
class PlanRisk:
    """What a change to targets (kept: id, name, qualified_name) touches, as tables that may be large, and the risk; each is made when it is first asked for."""

    graph: Graph
    chosen: DataFrame
    depth: int
    most: int

    @property
    def targets(self) -> DataFrame:
        """(id, name)."""
        return self.chosen.select("id", "name")

    @cached_property
    def _walks(self) -> tuple[DataFrame, DataFrame]:
        return traversal.traverse_each(self.graph.ways, self.chosen.select(F.col("id").alias("seed")), self.depth, self.most)

    @cached_property
    def impacted(self) -> DataFrame:
        """(id, name, path, depth)."""
        first = self._walks[0].groupBy("node").agg(F.min(F.struct("seed", "depth")).alias("f")).select(F.col("node").alias("id"), F.col("f.depth").alias("depth"))
        return kept(self.graph.nodes.select("id", "name", "path").join(first, "id"))

    @property
    def files(self) -> DataFrame:
        """(path)."""
        return self.impacted.select("path").distinct()

    @property
    def affected_tests(self) -> DataFrame:
        """(path)."""
        return self.files.filter(F.col("path").rlike(TEST_PATH))

    @cached_property
    def warnings(self) -> DataFrame:
        """(id, warning)."""
        callers = self.graph.edges.filter("kind = 'calls'").join(self.chosen.select(F.col("id").alias("target_id")), "target_id", "left_semi").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
        many = callers.filter(F.col("n") >= MANY_CALLERS).join(self.targets, "id").select("id", F.concat("name", F.lit(" has "), "n", F.lit(" callers: high-impact change")).alias("warning"))
        cut = self._walks[1].withColumnRenamed("seed", "id").join(self.targets, "id").select("id", F.concat(F.lit("the impact of "), "name", F.lit(" was cut: large blast radius")).alias("warning"))
        return cut.unionByName(many)

    @cached_property
    def cycle_risks(self) -> DataFrame:
        """(cycle, risk)."""
        cycles = search_cycles(self.graph.edges.filter(F.col("kind").isin(*traversal.CALLS_AND_IMPORTS)), self.graph.nodes, RISK_CYCLES)
        passed = cycles.select("cycle", "path", F.explode(F.array_distinct("path")).alias("qualified_name")).join(self.chosen, "qualified_name")
        risks = passed.groupBy("cycle").agg(F.min(F.struct("id", F.concat("name", F.lit(" is in a cycle: "), F.array_join("path", " -> ")).alias("risk"))).alias("r"))
        return risks.select("cycle", "r.risk")

    @cached_property
    def score(self) -> int:
        return self.impacted.count()

    @property
    def risk(self) -> str:
        return risk_of(self.score)


def plan_risk(graph: Graph, names: list[str] = (), files: list[str] = (), depth: int = 3, most: int = 50) -> PlanRisk:
    """What a change to these symbols and files touches, its tests, and how risky that makes it.

    Every target is followed, all at once, each to at most `most` symbols; an
    impacted symbol keeps the depth of the first target (by id) that reaches it.
    """
    chosen = graph.nodes.filter(F.col("name").isin(*names) | F.col("path").isin(*files)) if names or files else graph.nodes.limit(0)
    return PlanRisk(graph, kept(chosen.select("id", "name", "qualified_name")), depth, most)


def node_trail(nodes: DataFrame, edges: DataFrame, node: int, trail: int = 15) -> DataFrame:
    """(side, rank, id, name, path): the first callers and callees of a node, by edge id, each once."""
    calls = edges.filter("kind = 'calls'")

    def near(side: str, own: str, other: str) -> DataFrame:
        first = calls.filter(F.col(own) == node).groupBy(F.col(other).alias("id")).agg(F.min("id").alias("e")).orderBy("e").limit(trail)
        return first.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy("e")).alias("rank"), "id")  # of `trail` rows

    both = near("callers", "target_id", "source_id").unionByName(near("callees", "source_id", "target_id"))
    return both.join(nodes.select("id", "name", "path"), "id").select("side", "rank", "id", "name", "path")


def node_detail(graph: Graph, name: str, contents: DataFrame | None = None, trail: int = 15, snippet_lines: int = 60) -> dict | None:
    """The first symbol of that name with its first callers and callees."""
    node = graph.nodes.filter(F.col("name") == name).orderBy("id").first()
    if node is None:
        return None
    near: dict[str, list[str]] = {"callers": [], "callees": []}
    for r in node_trail(graph.nodes, graph.edges, node.id, trail).orderBy("rank").collect():
        near[r.side].append(r.name)
    detail = {"id": node.id, "name": node.name, "path": node.path, **near}
    if contents is not None:
        row = contents.filter(F.col("path") == node.path).select(lines_between(F.col("content"), F.lit(node.start_line), F.lit(node.end_line), snippet_lines).alias("s")).first()
        detail["snippet"] = row.s if row else None
    return detail


def tokens_of(text: str) -> int:
    return math.ceil(len(text) / 4)
