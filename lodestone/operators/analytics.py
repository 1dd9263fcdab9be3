"""Reports over a code graph: statistics, suggestions, rules, health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.globs import path_rules
from lodestone.functions.text import base_name, half_up, is_test_path, iso_timestamp
from lodestone.operators.classify import degrees, roles
from lodestone.sources.storage import Graph, kept

#: Directory names of layered and of component styles, and the labels of styles.
LAYERED = ("services", "controllers", "models", "routes", "middleware", "handlers", "repositories")
COMPONENTS = ("components", "pages", "features", "views", "screens", "widgets")
STYLES = ("layered (MVC / service-oriented)", "component-based", "monolith", "modular")
#: Kinds of suggestions, which is as many as a symbol can have.
MOST_KINDS = 5


def status(graph: Graph, classified: DataFrame) -> DataFrame:
    """(item, key, n): counts of tables, and of files and nodes by language and role; with the files' indexed_at the time of the last one (key)."""
    count = lambda df, item: df.agg(F.count("*").alias("n")).select(F.lit(item).alias("item"), F.lit("").alias("key"), "n")
    by = lambda df, c: df.filter(f"{c} IS NOT NULL").groupBy(c).agg(F.count("*").alias("n")).select(F.lit(c).alias("item"), F.col(c).alias("key"), "n")
    parts = [count(graph.files, "files"), count(graph.nodes, "nodes"), count(graph.edges, "edges"), by(graph.files, "language"), by(classified, "role")]
    if "indexed_at" in graph.files.columns:
        last = graph.files.agg(F.max("indexed_at").alias("at")).filter("at IS NOT NULL")
        parts.append(last.select(F.lit("last_indexed").alias("item"), iso_timestamp(F.col("at")).alias("key"), F.lit(1).cast("long").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def language_shares(files: DataFrame) -> DataFrame:
    """(language, n, percent)."""
    counts = files.groupBy("language").agg(F.count("*").alias("n"))
    total = files.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("language", "n", half_up(F.col("n") * 100 / F.col("total")).cast("int").alias("percent"))


def symbols_per_file(graph: Graph) -> DataFrame:
    counts = graph.nodes.groupBy("file_id").agg(F.count("*").alias("n"))
    return graph.files.join(counts, "file_id", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


def hotspots(nodes: DataFrame, edges: DataFrame, limit: int = 15) -> DataFrame:
    """(id, fan_in, fan_out, coupling), most coupled first."""
    coupled = degrees(nodes.select("id"), edges).withColumn("coupling", F.col("fan_in") + F.col("fan_out"))
    return coupled.filter("coupling > 0").orderBy(F.desc("coupling"), "id").limit(limit)


def file_coupling(graph: Graph) -> DataFrame:
    """(path, imports_from, imported_by, coupling): distinct other files."""
    place = graph.nodes.select("id", "path")
    imports = graph.edges.filter("kind = 'imports'")
    pairs = imports.join(place.toDF("source_id", "a"), "source_id").join(place.toDF("target_id", "b"), "target_id").filter("a != b").select("a", "b").distinct()
    out = pairs.groupBy(F.col("a").alias("path")).agg(F.count("*").alias("imports_from"))
    into = pairs.groupBy(F.col("b").alias("path")).agg(F.count("*").alias("imported_by"))
    both = graph.files.select("path").join(out, "path", "left").join(into, "path", "left").fillna(0)
    return both.withColumn("coupling", F.col("imports_from") + F.col("imported_by"))


def suggestions(nodes: DataFrame, edges: DataFrame, limit: int | None = 30, symbol: str | None = None, path: str | None = None) -> DataFrame:
    """(type, id, name, path, line, reason, priority) of refactorings, high before medium before low, then by id.

    symbol and path: only of the symbols of that name, of that file. Of rows with
    one type, name and file the first by id counts. With a limit, symbols are looked
    at in order of their ids until three times as many rows are found.
    """
    d = degrees(nodes, edges).withColumn("body", F.col("end_line") - F.col("start_line") + 1)
    chosen = d
    if symbol is not None:
        chosen = chosen.filter(F.col("name") == symbol)
    if path is not None:
        chosen = chosen.filter(F.col("path") == path)
    place = nodes.select("id", "path")
    calls = edges.filter("kind = 'calls'").join(place.toDF("source_id", "from"), "source_id").join(place.toDF("target_id", "to"), "target_id")
    by_file = calls.filter("from != to").groupBy(F.col("target_id").alias("id"), "from").agg(F.count("*").alias("n"), F.min(F.col("id")).alias("first"))
    outside = by_file.groupBy("id").agg(F.sum("n").alias("outside"), F.max(F.struct("n", (-F.col("first")).alias("m"), "from")).alias("top"))
    d = chosen.join(outside, "id", "left").fillna(0, ["outside"]).withColumn("inside", F.col("fan_in") - F.col("outside"))
    rule = lambda when, type_, level, reason: F.when(F.expr(when), F.struct(F.lit(type_).alias("type"), level.alias("level"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in reason)).alias("reason")))
    above = lambda c, most: F.when(F.col(c) > most, 0).otherwise(1)
    c = F.col
    rules = F.array(
        rule("body > 50 AND fan_out >= 5", "extract", above("body", 100), (c("body"), " lines, ", c("fan_out"), " outgoing calls: consider smaller functions")),
        rule("fan_in = 1 AND fan_out <= 2 AND body <= 10 AND kind = 'function'", "inline", F.lit(2), ("only 1 caller, ", c("body"), " lines: may be inlined")),
        rule("fan_in >= 2 AND outside > inside AND outside >= 2", "move", above("outside", 3), (c("outside"), "/", c("fan_in"), " callers are in other files; most from ", c("top.from"), " (", c("top.n"), " calls)")),
        rule("fan_in = 0 AND fan_out = 0 AND exported = 0", "dead", F.lit(1), ("no callers, no callees, not exported: safe to remove",)),
        rule("fan_out >= 10", "split", above("fan_out", 14), (c("fan_out"), " outgoing calls: consider splitting what it does")),
    )
    found = d.select("id", "name", "path", F.col("start_line").alias("line"), F.explode(F.array_compact(rules)).alias("r"))
    if limit:
        some = found.orderBy("id").limit(3 * limit + MOST_KINDS)  # a bounded number of rows, numbered in one task
        before = F.count("*").over(Window.orderBy("id").rangeBetween(Window.unboundedPreceding, -1))
        found = some.withColumn("_before", before).filter(F.col("_before") < 3 * limit).drop("_before")
    first = found.groupBy("r.type", "name", "path").agg(F.min(F.struct("id", "line", "r.reason", "r.level")).alias("f")).select("type", "name", "path", "f.*")
    names = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("level") + 1)
    if limit:
        first = first.orderBy("level", "id", "type").limit(limit)
    return first.select("type", "id", "name", "path", "line", "reason", names.alias("priority"))


def file_context(nodes: DataFrame, edges: DataFrame, path: str, most: int = 5) -> DataFrame:
    """(id, start_line, callers, callees): the symbols of a file with their first neighbours' names, by edge id."""
    own = nodes.filter(F.col("path") == path).select("id", "start_line")
    calls = edges.filter("kind = 'calls'").select(F.col("id").alias("e"), "source_id", "target_id")
    names = nodes.select(F.col("id").alias("other"), "name")

    def near(mine: str, other: str, label: str) -> DataFrame:
        found = own.select("id").join(calls.select(F.col(mine).alias("id"), F.col(other).alias("other"), "e"), "id")
        order = Window.partitionBy("id").orderBy("e")
        first = found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).join(names, "other")
        return first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ",").alias(label))

    out = own.join(near("target_id", "source_id", "callers"), "id", "left").join(near("source_id", "target_id", "callees"), "id", "left")
    return out.fillna("", ["callers", "callees"])


def file_stats(classified: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """(item, key, n) of a file: its symbols in all, the exported ones, those of each role, and the files that it imports from or is imported by."""
    own = classified.filter(F.col("path") == path)
    count = lambda item, n: own.agg(n.alias("n")).select(F.lit(item).alias("item"), F.lit("").alias("key"), "n")
    out = count("total", F.count("*")).unionByName(count("exported", F.count_if(F.col("exported") == 1)))
    out = out.unionByName(own.filter("role IS NOT NULL").groupBy("role").agg(F.count("*").alias("n")).select(F.lit("role").alias("item"), F.col("role").alias("key"), "n"))
    imports, place = edges.filter("kind = 'imports'"), classified.select("id", F.col("path").alias("key"))
    for item, mine, other in (("imports_from", "source_id", "target_id"), ("imported_by", "target_id", "source_id")):
        far = imports.join(own.select(F.col("id").alias(mine)), mine).select(F.col(other).alias("id")).join(place, "id").filter(F.col("key") != path)
        out = out.unionByName(far.select(F.lit(item).alias("item"), "key", F.lit(1).cast("long").alias("n")).distinct())
    return out


def tests_of(nodes: DataFrame, path: str) -> DataFrame:
    """(path) of test files whose path has the file's name without its extension."""
    stem = path.rsplit("/", 1)[-1].split(".")[0]
    return nodes.select("path").distinct().filter(is_test_path(F.col("path")) & F.col("path").contains(stem) & (F.col("path") != path))


@dataclass(frozen=True)
class Rule:
    """An architecture rule: deny-dependency (source, target), max-fan-out or max-file-symbols (most, scope)."""

    type: str
    source: str = "**"
    target: str = "**"
    most: int | None = None
    scope: str = "**"
    severity: str = "error"


#: What a rule allows where it doesn't say.
MOST = {"max-fan-out": 10, "max-file-symbols": 30}


def lint(graph: Graph, rules: list[Rule]) -> DataFrame:
    """(rule, severity, subject, detail): one row per violation; rules are numbered from 0.

    Each path is held against the globs of all rules once, and the edges are joined
    once with the rules of their ends, however many rules there are.
    """
    spark = graph.nodes.sparkSession
    for rule in rules:
        if rule.type not in ("deny-dependency", *MOST):
            raise ValueError(f"rule type {rule.type}")
    none = spark.createDataFrame([], "rule int, subject string, detail string")
    place = graph.nodes.select("id", "path", "qualified_name")
    of = lambda kind, attribute: [getattr(r, attribute) if r.type == kind else None for r in rules]
    sides = {"denied_from": of("deny-dependency", "source"), "denied_to": of("deny-dependency", "target"), "fan_out_scope": of("max-fan-out", "scope"), "symbols_scope": of("max-file-symbols", "scope")}
    used = {side: globs for side, globs in sides.items() if any(g is not None for g in globs)}
    if not used:
        return none.select("rule", F.lit("").alias("severity"), "subject", "detail")
    fitting = kept(path_rules(graph.nodes, used))
    by_rule = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("rule") + 1)
    most = by_rule([MOST.get(r.type, 0) if r.most is None else r.most for r in rules])
    out = none
    if "denied_from" in used:
        ruled = lambda side, own, name: place.join(fitting.filter(F.size(side) > 0), "path").select(F.col("id").alias(own), F.col("qualified_name").alias(name), side)
        ends = graph.edges.select("source_id", "target_id").join(ruled("denied_from", "source_id", "subject"), "source_id").join(ruled("denied_to", "target_id", "detail"), "target_id")
        out = out.unionByName(ends.select(F.explode(F.array_intersect("denied_from", "denied_to")).alias("rule"), "subject", "detail"))
    if "fan_out_scope" in used:
        d = degrees(place, graph.edges).join(fitting, "path").select(F.explode("fan_out_scope").alias("rule"), F.col("qualified_name").alias("subject"), "fan_out")
        out = out.unionByName(d.filter(F.col("fan_out") > most).select("rule", "subject", F.col("fan_out").cast("string").alias("detail")))
    if "symbols_scope" in used:
        d = symbols_per_file(graph).join(fitting, "path").select(F.explode("symbols_scope").alias("rule"), F.col("path").alias("subject"), "n")
        out = out.unionByName(d.filter(F.col("n") > most).select("rule", "subject", F.col("n").cast("string").alias("detail")))
    return out.select("rule", by_rule([r.severity for r in rules]).alias("severity"), "subject", "detail")


def lint_totals(violations: DataFrame) -> DataFrame:
    """(errors, warnings, passed)."""
    totals = violations.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    return totals.withColumn("passed", F.col("errors") == 0)


def key_hubs(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    d = degrees(nodes.select("id"), edges).filter("fan_in >= 3 OR fan_out >= 5")
    return d.withColumn("total", F.col("fan_in") + F.col("fan_out")).orderBy(F.desc("total"), "id").limit(limit)


def health(graph: Graph, classified: DataFrame | None = None, cycles: int = 0) -> DataFrame:
    """(modularity, dead, coverage, complexity, overall), each from 0 to 100."""
    c = classified if classified is not None else roles(graph.nodes, graph.edges)
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), x)).cast("int")
    n = c.agg(F.count("*").alias("n"), F.count_if(F.col("role") == "dead").alias("dead"), F.count_if(F.col("fan_out") >= 10).alias("god"))
    f = graph.files.agg(F.count_if(is_test_path(F.col("path"))).alias("tests"), F.count_if(~is_test_path(F.col("path"))).alias("sources"))
    part = lambda x, by: half_up(x / F.greatest(by, F.lit(1)))
    scores = n.crossJoin(f).select(
        clamp(F.lit(100 - 10 * cycles)).alias("modularity"),
        clamp(100 - part(F.col("dead") * 200, F.col("n"))).alias("dead"),
        F.when(F.col("sources") == 0, 0).otherwise(clamp(part(F.col("tests") * 100, F.col("sources")))).cast("int").alias("coverage"),
        clamp(100 - part(F.col("god") * 1000, F.col("n"))).alias("complexity"),
    )
    mean = (F.col("modularity") + F.col("dead") + F.col("coverage") + F.col("complexity")) / 4
    return scores.withColumn("overall", half_up(mean).cast("int"))


def style(files: DataFrame) -> DataFrame:
    """(style) by the names of the folders that hold files (in any case), then by the number of first path parts; a file at the root counts as one of those."""
    holder = F.lower(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1))
    seen = files.agg(F.collect_set(F.when(holder.isin(*LAYERED, *COMPONENTS), holder)).alias("names"), F.count_distinct(F.substring_index("path", "/", 1)).alias("tops"))
    score = lambda names: F.size(F.array_intersect("names", F.array(*map(F.lit, names))))
    layered, components, monolith, modular = map(F.lit, STYLES)
    return seen.select(F.when(score(LAYERED) >= 2, layered).when(score(COMPONENTS) >= 2, components).when(F.col("tops") <= 2, monolith).otherwise(modular).alias("style"))


def risk_of(impacted: int) -> str:
    return "low" if impacted <= 5 else "medium" if impacted <= 20 else "high"


def mermaid(graph: Graph, most: int = 200) -> DataFrame:
    """(path, body): a subgraph of node lines per file, of the first nodes by id."""
    first = graph.nodes.orderBy("id").limit(most)
    shape = F.when(F.col("kind") == "class", F.concat(F.lit("[["), F.col("name"), F.lit("]]"))).when(F.col("kind") == "interface", F.concat(F.lit("{{"), F.col("name"), F.lit("}}"))).otherwise(F.concat(F.lit("("), F.col("name"), F.lit(")")))
    line = F.concat(F.lit("n"), F.col("id"), shape)
    grouped = first.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return grouped.select("path", "body")


def mermaid_edges(graph: Graph, most: int = 200) -> DataFrame:
    """(line) of the edges between the first nodes."""
    ids = graph.nodes.orderBy("id").limit(most).select("id")
    both = graph.edges.join(ids.toDF("source_id"), "source_id", "left_semi").join(ids.toDF("target_id"), "target_id", "left_semi")
    arrow = F.when(F.col("kind") == "imports", " -.->|imports| ").otherwise(" -->|calls| ")
    return both.select(F.concat(F.lit("n"), F.col("source_id"), arrow, F.lit("n"), F.col("target_id")).alias("line"))


def stem(path: F.Column) -> F.Column:
    return F.regexp_replace(base_name(path), r"\..*$", "")


def summary(graph: Graph, classified: DataFrame, cycles: int) -> str:
    """One paragraph about a code base: its size, style, health, cycles, dead symbols and hubs."""
    languages = language_shares(graph.files).orderBy(F.desc("n"), "language").first()
    h, kind = health(graph, classified, cycles).first(), style(graph.files).first().style
    dead, hubs = classified.filter("role = 'dead'").count(), key_hubs(graph.nodes, graph.edges).count()
    return (
        f"{languages.language if languages else 'unknown'}-dominant code base with {graph.files.count()} files, {classified.count()} symbols and {graph.edges.count()} edges. Style: {kind}. "
        f"Health: modularity {h.modularity}, dead code {h.dead}, test coverage {h.coverage}, complexity {h.complexity}, overall {h.overall} of 100. "
        f"{cycles} cycles, {dead} dead symbols, {hubs} hubs."
    )
