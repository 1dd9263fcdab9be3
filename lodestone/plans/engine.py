"""A code base as a graph, and the questions it answers: one method for each kind of question."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import language_of, loose_glob, segment_glob
from lodestone.operators import analytics, classify, components, context, export, resolve, search, traversal
from lodestone.operators.text_index import TextIndex
from lodestone.sources import code_files, extract
from lodestone.sources.adjacency import Adjacency
from lodestone.sources.storage import Graph, change_tiers, distinct_edges, kept, latest_nodes, shared_folder

#: The longest text that is taken as an input, and the kinds of rules.
MOST_INPUT = 10_000
RULES = ("deny-dependency", "max-fan-out", "max-file-symbols", "no-cycles")


@dataclass
class Config:
    """Settings from a JSON file: known keys of the right type are taken, all else is ignored."""

    ignore: list[str] = field(default_factory=lambda: list(code_files.DEFAULTS))
    extensions: list[str] = field(default_factory=list)
    max_depth: int = 3
    max_nodes: int = 50
    rules: list[analytics.Rule] = field(default_factory=list)

    @staticmethod
    def parse(text: str) -> Config:
        try:
            data = json.loads(text)
        except ValueError:
            return Config()
        out = Config()
        if not isinstance(data, dict):
            return out
        for key in ("ignore", "extensions"):
            if isinstance(data.get(key), list) and all(isinstance(x, str) for x in data[key]):
                out = replace(out, **{key: data[key]})
        for key in ("max_depth", "max_nodes"):
            if isinstance(data.get(key), int) and not isinstance(data[key], bool):
                out = replace(out, **{key: data[key]})
        rules = data.get("rules") if isinstance(data.get("rules"), list) else []
        for r in rules:
            if isinstance(r, dict) and r.get("type") in RULES and r.get("severity", "error") in ("error", "warn"):
                most = r.get("max") if isinstance(r.get("max"), int) else None
                out.rules.append(analytics.Rule(r["type"], str(r.get("from", "**")), str(r.get("to", "**")), most, str(r.get("scope", "**")), r.get("severity", "error")))
        return out


def _numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """With ids that grow in the order (not without gaps), from a distributed sort."""
    return kept(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))


def index(spark: SparkSession, root: str, config: Config | None = None) -> CodeBase:
    """Scans, extracts, resolves and classifies the files under root, by the tree's own ignore files and the settings."""
    return index_files(sources_of(spark, root, config or Config()))


def sources_of(spark: SparkSession, root: str, config: Config) -> DataFrame:
    found = code_files.scan(spark, root, ignore_folders=config.ignore)
    return found.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*config.extensions)) if config.extensions else found


COLUMNS = ["path", "name", "qualified_name", "kind", "start_line", "end_line", "signature", "doc", "exported"]


def _after(df: DataFrame | None, name: str) -> int:
    """The first id beyond those of a table."""
    most = None if df is None else df.agg(F.max(name)).first()[0]
    return 0 if most is None else most + 1


@dataclass
class Parsed:
    """What files (file_id, path, language, content) have, before it is linked; ids begin where they are told to."""

    nodes: DataFrame
    refs: DataFrame
    imports: DataFrame  # file_id, name, target_path
    routes: DataFrame

    @staticmethod
    def of(files: DataFrame, first_node: int = 0, first_ref: int = 0) -> Parsed:
        found = kept(extract.extract_files(files))
        ids = files.select("path", "file_id")
        symbols = found.filter("record = 'symbol'").select(*COLUMNS, "extends", "implements")
        routes = kept(extract.routes(files))
        title, route_name = F.concat_ws(" ", "method", "pattern"), F.concat(F.col("path"), F.lit("::route:"), F.col("pattern"))
        fixed = {"name": title, "qualified_name": route_name, "kind": F.lit("route"), "start_line": F.col("line"), "end_line": F.col("line"), "signature": title, "doc": F.lit(None).cast("string"), "exported": F.lit(1)}
        route_rows = routes.select("path", *(fixed[c].alias(c) for c in COLUMNS[1:]))
        everything = _numbered(symbols.select(*COLUMNS).unionByName(route_rows).join(ids, "path"), "id", "path", "start_line", "qualified_name").withColumn("id", F.col("id") + first_node)
        none = F.lit(None).cast("string").alias("receiver")
        calls = found.filter("record = 'call'").select("path", F.lit("call").alias("kind"), F.col("enclosing").alias("source_qname"), F.col("name").alias("target_name"), "receiver", "line")
        handled = routes.select("path", F.lit("call").alias("kind"), route_name.alias("source_qname"), F.col("handler").alias("target_name"), none, "line")
        late = extract.registration_calls(found).select("path", F.lit("call").alias("kind"), "source_qname", "target_name", none, "line")
        refs = calls.unionByName(handled).unionByName(late)
        for c in ("extends", "implements"):
            refs = refs.unionByName(symbols.filter(F.col(c).isNotNull()).select("path", F.lit(c).alias("kind"), F.col("qualified_name").alias("source_qname"), F.explode(F.split(c, r"\s*,\s*")).alias("target_name"), none, F.col("start_line").alias("line")))
        refs = _numbered(refs.filter("source_qname IS NOT NULL").join(ids, "path"), "id", "path", "line", "target_name").withColumn("id", F.col("id") + first_ref)
        named = found.filter("record = 'import' AND source IS NOT NULL").join(ids, "path").select("file_id", F.explode("specifiers").alias("name"), resolve.module_path(F.col("path"), F.col("source")).alias("target_path")).filter("target_path IS NOT NULL").distinct()
        return Parsed(latest_nodes(everything), refs, kept(named), routes)


def _finished(files: DataFrame, nodes: DataFrame, refs: DataFrame, imports: DataFrame, routes: DataFrame, links: DataFrame, import_links: DataFrame, before: DataFrame | None = None) -> CodeBase:
    """A code base of what references and imports mean: edges, each once, and roles from those; edges that were there before keep their ids."""
    means = links.select("source_id", "target_id", "kind").unionByName(import_links.select("source_id", "target_id", F.lit("imports").alias("kind"))).distinct()
    order = ("source_id", "target_id", "kind")
    if before is None:
        edges = _numbered(means, "id", *order)
    else:
        known = before.select("id", *order)
        fresh = _numbered(means.join(known, list(order), "left_anti"), "id", *order).withColumn("id", F.col("id") + _after(known, "id"))
        edges = known.join(means, list(order), "left_semi").select("id", *order).unionByName(fresh.select("id", *order))
    edges = kept(edges.select("id", *order))
    classified = classify.roles(nodes, edges).drop("fan_in", "fan_out")
    stamped = kept(files.drop("content").withColumn("indexed_at", F.unix_millis(F.current_timestamp())))
    ways = Adjacency.write(edges, f"{shared_folder(edges.sparkSession)}/ways-{uuid.uuid4().hex}")
    return CodeBase(Graph(stamped, kept(classified), edges, refs, ways), files.select("path", "content"), routes, imports, links, import_links)


def index_files(sources: DataFrame) -> CodeBase:
    """The same for files (path, language, hash, size, mtime, content)."""
    files = _numbered(sources, "file_id", "path")
    p = Parsed.of(files)
    links, import_links = kept(resolve.resolve_links(p.refs, p.nodes, p.imports)), kept(resolve.import_links(p.imports, p.nodes))
    return _finished(files, p.nodes, p.refs, p.imports, p.routes, links, import_links)


@dataclass(frozen=True)
class Refresh:
    """A code base after a change of its files, and how many files were listed, parsed again and gone, and references resolved anew."""

    code: CodeBase
    scanned: int
    changed: int
    removed: int
    resolved: int = 0


def refresh(code: CodeBase, sources: DataFrame, force: bool = False) -> Refresh:
    """Takes in the files as they are now: what is gone is purged, what changed (by time and size, then by hash; all if forced) is parsed again.

    Files keep their ids; symbols, references and edges of files that did not change
    keep theirs, and new ones come after them. Only references that may mean
    something else are resolved anew: those of parsed files, those that ask for a name
    which files that changed have or had, and those that an import of a changed
    path brings.
    """
    old = code.graph
    now = kept(sources)
    stored = old.files.select("path", "file_id", "hash", "size", "mtime")
    tiers = change_tiers(stored, now.select("path", "hash", "size", "mtime"))
    parsed_paths = kept((tiers.withColumn("tier", F.lit("parsed")) if force else tiers).filter("tier = 'parsed'").select("path"))
    known = now.drop("indexed_at").join(stored.select("path", "file_id"), "path", "left")
    new = _numbered(known.filter("file_id IS NULL").drop("file_id"), "file_id", "path").withColumn("file_id", F.col("file_id") + _after(stored, "file_id"))
    files = kept(known.filter("file_id IS NOT NULL").unionByName(new))
    again = kept(files.join(parsed_paths, "path", "left_semi"))
    stale = stored.join(now.select("path"), "path", "left_anti")
    gone = kept(stale.select("file_id").union(stored.join(parsed_paths, "path", "left_semi").select("file_id")))
    rest = old.without_files(gone)
    p = Parsed.of(again, _after(old.nodes, "id"), _after(old.raw_refs, "id"))
    nodes = kept(rest.nodes.drop("role").unionByName(p.nodes.select(*(c for c in old.nodes.columns if c != "role"))))
    refs = kept(rest.raw_refs.unionByName(p.refs.select(*old.raw_refs.columns)))
    imports = kept(code.imports.join(gone, "file_id", "left_anti").unionByName(p.imports))
    lost = parsed_paths.union(stale.select("path"))
    routes = kept(code.route_table.join(lost, "path", "left_anti").unionByName(p.routes))
    names = kept(old.nodes.join(gone, "file_id", "left_semi").select("name").union(p.nodes.select("name")).distinct())
    changed = kept(lost.union(again.select("path")).distinct())
    touched = kept(resolve.touched_imports(imports, changed))
    open_refs = kept(resolve.open_references(rest.raw_refs, names, touched).unionByName(p.refs.select(*rest.raw_refs.columns)))
    dead = old.raw_refs.join(gone, "file_id", "left_semi").select(F.col("id").alias("ref_id")).union(open_refs.select(F.col("id").alias("ref_id")))
    links = kept(code.links.join(dead, "ref_id", "left_anti").unionByName(resolve.resolve_links(open_refs, nodes, imports)))
    open_imports = kept(touched.select(*imports.columns).unionByName(p.imports.select(*imports.columns)).distinct())
    same = code.import_links.join(gone, "file_id", "left_anti").join(open_imports.select("file_id", "name", "target_path"), ["file_id", "name", "target_path"], "left_anti")
    import_links = kept(same.select(*code.import_links.columns).unionByName(resolve.import_links(open_imports, nodes)))
    return Refresh(_finished(files, nodes, refs, imports, routes, links, import_links, old.edges), now.count(), parsed_paths.count(), stale.count(), open_refs.count())


@dataclass
class CodeBase:
    graph: Graph
    contents: DataFrame | None = None
    route_table: DataFrame | None = None
    imports: DataFrame | None = None
    links: DataFrame | None = None  # ref_id, source_id, target_id, kind: what each reference means
    import_links: DataFrame | None = None  # file_id, name, target_path, source_id, target_id

    @property
    def nodes(self) -> DataFrame:
        return self.graph.nodes

    @property
    def edges(self) -> DataFrame:
        return self.graph.edges

    @cached_property
    def size(self) -> int:
        return self.nodes.count()

    def limits(self, tool: str, name: str | None = None, depth: int | None = None, most: int | None = None) -> tuple[int, int]:
        """Adaptive depth and number of nodes; a name's degree is the mean over its symbols, all kinds of edges counted at both ends."""
        degree = None
        if name is not None and (depth is None or most is None):
            own = self.nodes.filter(F.col("name") == name).select("id")
            ends = self.edges.select(F.col("source_id").alias("id")).unionAll(self.edges.select(F.col("target_id").alias("id"))).join(own, "id", "left_semi")
            if symbols := own.count():
                degree = ends.count() / symbols
        return context.limits(tool, self.size, degree, depth, most)

    @cached_property
    def text_index(self) -> TextIndex:
        """The stored index of the symbols' words; a code base with the same tables finds it again."""
        own = [c for c in ("name", "qualified_name", "signature", "doc") if c in self.nodes.columns]
        return TextIndex.of(self.nodes, search.document_tokens(*own), "id", "symbols")

    def search(self, query: str, limit: int = 10) -> DataFrame:
        checked(query, "query")
        return search.symbol_search(self.nodes, query, max(1, min(100, limit)), index=self.text_index)

    def intent_search(self, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
        found = search.intent_search(self.nodes, self.edges, query, kind, self.text_index)
        return found.orderBy(F.desc("score"), "id").limit(limit)

    def callers(self, name: str, depth: int | None = None, most: int | None = None) -> DataFrame:
        return traversal.callers(self.nodes, self.graph.ways, checked(name, "name"), *self.limits("callers", name, depth, most))

    def callees(self, name: str, depth: int | None = None, most: int | None = None) -> DataFrame:
        return traversal.callees(self.nodes, self.graph.ways, checked(name, "name"), *self.limits("callees", name, depth, most))

    def impact(self, target: str, depth: int | None = None, most: int | None = None) -> DataFrame:
        return traversal.impact(self.nodes, self.graph.ways, checked(target, "target"), *self.limits("impact", target, depth, most))

    def trace(self, source: str, target: str, max_hops: int = 7) -> list[int]:
        return traversal.trace(self.nodes, self.graph.ways, checked(source, "source"), checked(target, "target"), max_hops)

    def node(self, name: str) -> dict | None:
        return context.node_detail(self.graph, checked(name, "name"), self.contents, self.limits("node", name)[1])

    def affected(self, paths: list[str], depth: int | None = None, pattern: str | None = None) -> DataFrame:
        return traversal.affected_tests(self.nodes, self.graph.ways, paths, self.limits("affected", None, depth)[0], pattern)

    def context(self, task: str, max_nodes: int | None = None, max_depth: int = 3) -> context.Context:
        return context.build_context(self.graph, checked(task, "task"), self.contents, self.limits("context", None, None, max_nodes)[1], max_depth)

    def explore(self, query: str, max_files: int | None = None) -> DataFrame:
        if self.contents is None:
            raise ValueError("the graph has no contents")
        depth, most = self.limits("explore")
        return context.explore(self.graph, checked(query, "query"), self.contents, min(most, 20) if max_files is None else max(1, min(20, max_files)), max_depth=depth, max_nodes=most)

    def files(self, prefix: str = "", pattern: str | None = None) -> DataFrame:
        listed = analytics.symbols_per_file(self.graph).filter(F.col("path").startswith(prefix))
        return listed.filter(F.col("path").rlike(loose_glob(pattern))) if pattern else listed

    def status(self) -> DataFrame:
        return analytics.status(self.graph, self.nodes)

    def dead_code(self, kind: str | None = None, path: str | None = None, limit: int = 100) -> DataFrame:
        return classify.dead_code(self.nodes, kind, path).orderBy("id").limit(limit)

    def cycles(self, most: int = 50) -> DataFrame:
        return components.search_cycles(self.edges.filter(F.col("kind").isin("calls", "imports")), self.nodes, most)

    def stats(self, limit: int = 15) -> dict[str, DataFrame]:
        degree = classify.degrees(self.nodes.select("id"), self.edges)
        return {
            "averages": classify.average_fan(degree),
            "largest": classify.most_fan(degree),
            "histogram": classify.fan_out_histogram(degree),
            "hotspots": analytics.hotspots(self.nodes, self.edges, limit),
            "files": analytics.file_coupling(self.graph).orderBy(F.desc("coupling"), "path").limit(limit),
        }

    def suggest(self, limit: int = 30, symbol: str | None = None, path: str | None = None) -> DataFrame:
        return analytics.suggestions(self.nodes, self.edges, limit, symbol, path)

    def auto_context(self, path: str) -> dict[str, DataFrame]:
        return {"symbols": analytics.file_context(self.nodes, self.edges, path), "tests": analytics.tests_of(self.nodes, path), "stats": analytics.file_stats(self.nodes, self.edges, path)}

    def plan(self, names: list[str] = (), files: list[str] = ()) -> context.PlanRisk:
        return context.plan_risk(self.graph, list(names), list(files))

    def lint(self, rules: list[analytics.Rule]) -> tuple[DataFrame, DataFrame]:
        """The violations and their totals; a rule against cycles counts those that pass a file of its scope."""
        found = analytics.lint(self.graph, [r for r in rules if r.type != "no-cycles"])
        for k, rule in enumerate(rules):
            if rule.type == "no-cycles":
                cycles = self.cycles(20).filter(_passes(rule.scope))
                found = found.unionByName(cycles.select(F.lit(k).alias("rule"), F.lit(rule.severity).alias("severity"), F.col("path")[0].alias("subject"), F.array_join("path", " -> ").alias("detail")))
        return found, analytics.lint_totals(found)

    def dna(self) -> dict[str, DataFrame]:
        out = {
            "languages": analytics.language_shares(self.graph.files),
            "roles": self.nodes.groupBy(F.coalesce("role", F.lit("unknown")).alias("role")).agg(F.count("*").alias("n")),
            "hubs": analytics.key_hubs(self.nodes, self.edges),
            "style": analytics.style(self.graph.files),
            "health": analytics.health(self.graph, classify.degrees(self.nodes, self.edges), self.cycles(50).count()),
        }
        if self.route_table is not None:
            out["frameworks"] = self.route_table.groupBy("framework").agg(F.count("*").alias("n"))
        return out

    def summary(self) -> str:
        return analytics.summary(self.graph, classify.degrees(self.nodes, self.edges), self.cycles(50).count())

    def changed(self, name_status: DataFrame, hunks: DataFrame) -> DataFrame:
        return resolve.changed_symbols(self.nodes, name_status, hunks)

    def export(self, form: str = "mermaid", symbol: str | None = None) -> str:
        part = export.gathered(self.graph, symbol)
        if form == "dot":
            return export.dot_text(part)
        if form == "html":
            return export.html(part)
        blocks = [f'subgraph {k}["{r.path}"]\n{r.body}\nend' for k, r in enumerate(analytics.mermaid(part).orderBy("path").collect())]  # of the first nodes
        return "\n".join(["graph LR", *blocks, *(r.line for r in analytics.mermaid_edges(part).collect())])

    def merged_edges(self, more: DataFrame) -> CodeBase:
        return replace(self, graph=replace(self.graph, adjacency=None, edges=distinct_edges(self.edges.unionByName(more))))


def checked(value: object, name: str, most: int = MOST_INPUT) -> str:
    """The value, if it is a text of one character or more and not too long."""
    if not isinstance(value, str) or not value:
        raise ValueError(f"{name} must be a text that is not empty")
    if len(value) > most:
        raise ValueError(f"{name} is longer than {most} characters")
    return value


def _passes(scope: str) -> Column:
    return F.exists("files", lambda p: p.rlike(segment_glob(scope)))


def languages_of(paths: DataFrame) -> DataFrame:
    """(path, language) of a list of paths (column value), blank lines dropped."""
    trimmed = paths.select(F.trim("value").alias("path")).filter("path != ''")
    return trimmed.select("path", language_of(F.col("path")).alias("language"))
