"""Queries over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.vector import dot, rotated
from lodestone.operators import analytics, classify, components, context, export, ranges, reports, resolve, retrieval, search, traversal
from lodestone.operators.text_index import TextIndex
from lodestone.plans import engine
from lodestone.sources import code_files, sample_graph, storage
from lodestone.sources.adjacency import Adjacency
from lodestone.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE, DENSE = sample_graph.sql(), sample_graph.sql(dense=True)
DEGREES = """, fans AS (
  SELECT n.*, coalesce(i.c, 0) AS fan_in, coalesce(o.c, 0) AS fan_out FROM nodes n
  LEFT JOIN (SELECT target_id, count(*) AS c FROM calls GROUP BY 1) i ON i.target_id = n.id
  LEFT JOIN (SELECT source_id, count(*) AS c FROM calls GROUP BY 1) o ON o.source_id = n.id)"""
TEST = "regexp_matches(path, '(?i)(\\.(test|spec|e2e)\\.(ts|tsx|js|jsx|py)$|__tests?__/)')"
BRIDGES = """, bridges AS (
  SELECT id FROM fans WHERE fan_in >= 2 AND fan_out >= 2 AND id NOT IN (
    SELECT i.target_id FROM calls i JOIN calls o ON o.source_id = i.target_id JOIN calls s ON s.source_id = i.source_id AND s.target_id = o.target_id))"""
ROLES = (
    DEGREES
    + BRIDGES
    + f""", roles AS (
  SELECT f.*, CASE WHEN {TEST} THEN 'test' WHEN fan_in = 0 AND exported = 0 AND fan_out = 0 THEN 'dead' WHEN fan_in = 0 AND exported = 1 THEN 'entry'
    WHEN fan_in >= 3 AND fan_out >= 3 THEN 'hub' WHEN b.id IS NOT NULL THEN 'bridge' WHEN fan_in >= 3 THEN 'core'
    WHEN fan_out > 0 AND fan_in = 0 THEN 'leaf' ELSE 'utility' END AS role
  FROM fans f LEFT JOIN bridges b ON b.id = f.id)"""
)
MOST_OUT = "(SELECT id FROM fans ORDER BY fan_out DESC, id LIMIT 1)"
MOST_IN = "(SELECT id FROM fans ORDER BY fan_in DESC, id LIMIT 1)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def graph(spark: SparkSession, sf_dir: str, dense: bool = False) -> storage.Graph:
    return sample_graph.load(spark, sf_dir, dense)


def stored(spark: SparkSession, sf_dir: str, dense: bool = False) -> storage.Graph:
    """The graph's tables and its edges by node, written to the shared folder once for each state of the tables that they come from."""
    own = "-".join(storage.source_identity(read(spark, sf_dir, t)) for t in sample_graph.TABLES)
    path = f"{storage.shared_folder(spark)}/graph-{'dense' if dense else 'sparse'}-{own}"
    g = graph(spark, sf_dir, dense)
    ways = Adjacency.open(spark, f"{path}/ways")
    if ways is None:  # its mark comes last, so with one all of it is there
        for name in ("nodes", "edges"):
            getattr(g, name).write.mode("overwrite").parquet(f"{path}/{name}")
    nodes, edges = (spark.read.schema(getattr(g, name).schema).parquet(f"{path}/{name}") for name in ("nodes", "edges"))
    return storage.Graph(g.files, nodes, edges, adjacency=ways or Adjacency.write(edges, f"{path}/ways"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seed(g: storage.Graph, side: str) -> int:
    return classify.degrees(g.nodes.select("id"), g.edges).orderBy(F.desc(side), "id").first().id


# tables


@query(BASE + " SELECT language, count(*) AS n FROM files GROUP BY 1")
def files_by_language(spark, d):
    return graph(spark, d).files.groupBy("language").agg(F.count("*").alias("n"))


EXTENSIONS = [*T.LANGUAGES, "txt", "JS", ""]
EXTENSION_SQL = "CASE p_partkey % " + str(len(EXTENSIONS)) + " " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(EXTENSIONS)) + " END"
LANGUAGE_SQL = "CASE x " + " ".join(f"WHEN '{x}' THEN '{lang}'" for x, lang in T.LANGUAGES.items()) + " WHEN 'JS' THEN 'javascript' END"


@query(f"SELECT path, {LANGUAGE_SQL} AS language FROM (SELECT {EXTENSION_SQL} AS x, 'src/a.b/f' || p_partkey || '.' || {EXTENSION_SQL} AS path FROM part)")
def language_map(spark, d):
    x = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % len(EXTENSIONS) + 1).cast("int"))
    paths = read(spark, d, "part").select(F.concat(F.lit("src/a.b/f"), F.col("p_partkey").cast("string"), F.lit("."), x).alias("path"))
    return paths.select("path", T.language_of(F.col("path")).alias("language"))


@query(BASE + " SELECT id, path, kind, qualified_name FROM nodes")
def scan_nodes(spark, d):
    return graph(spark, d).nodes.select("id", "path", "kind", "qualified_name")


@query(BASE + " SELECT id, source_id, target_id, kind FROM edges")
def scan_edges(spark, d):
    return graph(spark, d).edges


@query(BASE + " SELECT path, md5(path) AS hash FROM files")
def content_hash(spark, d):
    return graph(spark, d).files.select("path", F.md5("path").alias("hash"))


@query(BASE + f" SELECT path, {TEST} AS is_test FROM files")
def test_files(spark, d):
    return graph(spark, d).files.select("path", T.is_test_path(F.col("path")).alias("is_test"))


@query(BASE + " SELECT f.path, count(n.id) AS n FROM files f LEFT JOIN nodes n USING (file_id) WHERE starts_with(f.path, 'src/') AND regexp_matches(f.path, '(?i)mod[^/]*/.*\\.py') GROUP BY 1")
def file_list_glob(spark, d):
    listed = analytics.symbols_per_file(graph(spark, d))
    return listed.filter(F.col("path").startswith("src/") & F.col("path").rlike(T.loose_glob("mod*/**.py")))


@query(BASE + " SELECT id, name, path FROM nodes WHERE kind = 'class' AND contains(path, 'mod1') AND exported = 1")
def field_query(spark, d):
    q = search.parse_query("kind:class path:mod1 exported:true")
    return graph(spark, d).nodes.filter(search.matches(q)).select("id", "name", "path")


@query(BASE + " SELECT path FROM files WHERE file_id % 4 = 0")
def stale_files(spark, d):
    g = graph(spark, d)
    _, stale = g.keep_only(g.files.filter("file_id % 4 != 0"))
    return stale.select("path")


@query(BASE + ", gone AS (SELECT id FROM nodes WHERE file_id % 4 = 0) SELECT id, source_id, target_id, kind FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def purge_file(spark, d):
    g = graph(spark, d)
    return g.without_files(g.files.filter("file_id % 4 = 0")).edges


@query(BASE + " SELECT path, CASE WHEN file_id % 3 = 0 THEN 'inserted' WHEN file_id % 3 = 1 THEN 'updated' ELSE 'unchanged' END AS change FROM files")
def upsert_files(spark, d):
    files = graph(spark, d).files
    stored = files.filter("file_id % 3 != 0").select("path", F.md5("path").alias("hash"))
    incoming = files.select("path", F.md5(F.when(F.col("file_id") % 3 == 1, F.concat("path", F.lit("x"))).otherwise(F.col("path"))).alias("hash"))
    return storage.upsert_files(stored, incoming)


@query(BASE + " SELECT path, CASE WHEN file_id % 4 = 0 THEN 'parsed' WHEN file_id % 4 = 1 THEN 'skipped' WHEN file_id % 4 = 2 THEN 'unchanged' ELSE 'parsed' END AS tier FROM files")
def changed_tiers(spark, d):
    files = graph(spark, d).files
    stored = files.filter("file_id % 4 != 0").select("path", F.md5("path").alias("hash"), F.lit(10).alias("size"), F.lit(1.0).alias("mtime"))
    listing = files.select("path", F.md5(F.when(F.col("file_id") % 4 == 3, F.lit("new")).otherwise(F.col("path"))).alias("hash"), F.lit(10).alias("size"), F.when(F.col("file_id") % 4 == 1, 1.0).otherwise(2.0).alias("mtime"))
    return storage.change_tiers(stored, listing)


@query("SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def last_writer_wins(spark, d):
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("qualified_name"), F.col("l_partkey").alias("id")).distinct()
    return storage.latest_nodes(lines).select(F.col("file_id").alias("l_orderkey"), F.col("qualified_name").alias("l_linenumber"), F.col("id").alias("l_partkey"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY")
def payload_retention(spark, d):
    events = read(spark, d, "events").withColumn("timestamp", F.unix_millis(F.col("ts").cast("timestamp")))
    return storage.recent_payloads(events, 1_706_572_800_000).select("event_id", "event_type")


# degrees and roles


@query(BASE + DEGREES + " SELECT id, fan_in, fan_out FROM fans")
def degree(spark, d):
    g = graph(spark, d)
    return classify.degrees(g.nodes.select("id"), g.edges)


@query(BASE + DEGREES + " SELECT floor(sum(fan_in) / greatest(count(*), 1)::DOUBLE * 100 + 0.5) / 100 AS avg_in, floor(sum(fan_out) / greatest(count(*), 1)::DOUBLE * 100 + 0.5) / 100 AS avg_out FROM fans")
def avg_fan(spark, d):
    return classify.average_fan(degree(spark, d))


@query(BASE + DEGREES + " SELECT * FROM (SELECT 'fan_in' AS side, id, fan_in AS n FROM fans WHERE fan_in > 0 ORDER BY fan_in DESC, id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'fan_out', id, fan_out FROM fans WHERE fan_out > 0 ORDER BY fan_out DESC, id LIMIT 1)")
def argmax_fan(spark, d):
    return classify.most_fan(degree(spark, d))


@query(BASE + DEGREES + ", b AS (SELECT CASE WHEN fan_out = 0 THEN '0' WHEN fan_out <= 3 THEN '1-3' WHEN fan_out <= 7 THEN '4-7' WHEN fan_out <= 15 THEN '8-15' ELSE '16+' END AS bucket FROM fans) SELECT s.bucket, count(b.bucket) AS n FROM (VALUES ('0'), ('1-3'), ('4-7'), ('8-15'), ('16+')) s(bucket) LEFT JOIN b ON b.bucket = s.bucket GROUP BY 1")
def fanout_hist(spark, d):
    return classify.fan_out_histogram(degree(spark, d))


@query(BASE + " SELECT f.path, count(n.id) AS n FROM files f LEFT JOIN nodes n USING (file_id) GROUP BY 1")
def symbols_per_file(spark, d):
    return analytics.symbols_per_file(graph(spark, d))


@query(BASE + " SELECT language, count(*) AS n, CAST(floor(count(*) * 100 / (SELECT count(*) FROM files)::DOUBLE + 0.5) AS INT) AS percent FROM files GROUP BY 1")
def lang_pct(spark, d):
    return analytics.language_shares(graph(spark, d).files)


@query(BASE + DEGREES + BRIDGES + " SELECT id FROM bridges")
def bridges(spark, d):
    g = graph(spark, d)
    return classify.bridges(g.nodes, g.edges)


@query(BASE + ROLES + " SELECT id, role FROM roles")
def roles(spark, d):
    g = graph(spark, d)
    return classify.roles(g.nodes, g.edges).select("id", "role")


@query(BASE + ROLES + " SELECT role, count(*) AS n FROM roles GROUP BY 1")
def role_dist(spark, d):
    return roles(spark, d).groupBy("role").agg(F.count("*").alias("n"))


@query(BASE + ROLES + " SELECT id, kind, path FROM roles WHERE role = 'dead' AND contains(path, 'mod')")
def dead_code(spark, d):
    g = graph(spark, d)
    return classify.dead_code(classify.roles(g.nodes, g.edges), path="mod").select("id", "kind", "path")


@query(
    BASE + ROLES + ", dead AS (SELECT kind, path FROM roles WHERE role = 'dead') SELECT 'total' AS by, '' AS key, count(*) AS n FROM dead UNION ALL SELECT 'kind', kind, count(*) FROM dead GROUP BY 2 UNION ALL SELECT 'file', path, count(*) FROM dead GROUP BY 2"
)
def dead_totals(spark, d):
    g = graph(spark, d)
    return classify.dead_totals(classify.dead_code(classify.roles(g.nodes, g.edges)))


@query(BASE + ROLES + " SELECT 'files' AS item, '' AS key, count(*) AS n FROM files UNION ALL SELECT 'nodes', '', count(*) FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges UNION ALL SELECT 'language', language, count(*) FROM files GROUP BY 2 UNION ALL SELECT 'role', role, count(*) FROM roles GROUP BY 2")
def status(spark, d):
    g = graph(spark, d)
    return analytics.status(g, classify.roles(g.nodes, g.edges))


@query(BASE + DEGREES + " SELECT id, fan_in, fan_out FROM fans WHERE name = 'red_widget'")
def name_lookup(spark, d):
    g = graph(spark, d)
    return classify.degrees(g.nodes.filter("name = 'red_widget'").select("id"), g.edges)


@query(DENSE + " SELECT a.source_id AS a, a.target_id AS b FROM calls a JOIN calls r ON r.source_id = a.target_id AND r.target_id = a.source_id WHERE a.source_id < a.target_id")
def cycles2(spark, d):
    return classify.two_cycles(graph(spark, d, dense=True).edges)


@query(DENSE + " SELECT x.source_id AS a, x.target_id AS b, y.target_id AS c FROM calls x JOIN calls y ON y.source_id = x.target_id JOIN calls z ON z.source_id = y.target_id AND z.target_id = x.source_id WHERE x.source_id < x.target_id AND x.source_id < y.target_id")
def cycles3(spark, d):
    return classify.three_cycles(graph(spark, d, dense=True).edges)


@query()
def cycles_dfs(spark, d):
    g = stored(spark, d)
    return components.search_cycles(g.edges.filter("kind = 'calls'"), g.nodes)


# traversals


def reach_sql(start: str, step: str, depth: int) -> str:
    return f", walk AS (SELECT {start} AS node, 0 AS depth UNION SELECT {step} FROM walk w JOIN %s WHERE w.depth < {depth}) SELECT node, min(depth) AS depth FROM walk GROUP BY 1"


@query(BASE + DEGREES + reach_sql(MOST_OUT, "c.target_id, w.depth + 1", 3) % "calls c ON c.source_id = w.node")
def bfs_forward(spark, d):
    g = stored(spark, d)
    return traversal.traverse(g.ways, seed(g, "fan_out"), 3, 2_000).nodes.select("node", "depth")


@query(BASE + DEGREES + reach_sql(MOST_IN, "c.source_id, w.depth + 1", 3) % "calls c ON c.target_id = w.node")
def bfs_backward(spark, d):
    g = stored(spark, d)
    return traversal.traverse(g.ways, seed(g, "fan_in"), 3, 2_000, "backward").nodes.select("node", "depth")


@query(BASE + DEGREES + reach_sql(MOST_OUT, "c.v, w.depth + 1", 2) % "(SELECT source_id AS u, target_id AS v FROM edges UNION SELECT target_id, source_id FROM edges) c ON c.u = w.node")
def bfs_both(spark, d):
    g = stored(spark, d)
    return traversal.traverse(g.ways, seed(g, "fan_out"), 2, 2_000, "both", None).nodes.select("node", "depth")


BEST = ", best AS (SELECT id FROM fans WHERE name = 'red_widget' ORDER BY fan_in + fan_out DESC, id LIMIT 1)"


@query(BASE + DEGREES + BEST + reach_sql("id", "c.source_id, w.depth + 1", 3).replace("AS node, 0 AS depth UNION", "AS node, 0 AS depth FROM best UNION") % "calls c ON c.target_id = w.node")
def callers(spark, d):
    g = stored(spark, d)
    return traversal.callers(g.nodes, g.ways, "red_widget", 3, 2_000)


@query(BASE + DEGREES + BEST + reach_sql("id", "c.target_id, w.depth + 1", 3).replace("AS node, 0 AS depth UNION", "AS node, 0 AS depth FROM best UNION") % "calls c ON c.source_id = w.node")
def callees(spark, d):
    g = stored(spark, d)
    return traversal.callees(g.nodes, g.ways, "red_widget", 3, 2_000)


@query(BASE + ", walk AS (SELECT id AS node, 0 AS depth FROM nodes WHERE path = 'src/mod1/brand_1.py' UNION SELECT e.source_id, w.depth + 1 FROM walk w JOIN edges e ON e.target_id = w.node WHERE w.depth < 2) SELECT node, min(depth) AS depth FROM walk GROUP BY 1")
def impact_set(spark, d):
    g = stored(spark, d)
    seeds = g.nodes.filter("path = 'src/mod1/brand_1.py'").select(F.col("id").alias("node"))
    return traversal.reach(g.ways, seeds, 2)


@query()
def impact(spark, d):
    g = stored(spark, d)
    return traversal.impact(g.nodes, g.ways, "red_widget", 2, 20)


@query(
    BASE
    + ", seeds AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM nodes WHERE name = 'red_widget' QUALIFY k <= 3), walk AS (SELECT id AS node, 0 AS depth FROM seeds UNION SELECT c.target_id, w.depth + 1 FROM walk w JOIN calls c ON c.source_id = w.node WHERE w.depth < 7)"
    " SELECT coalesce(min(depth) + 1, 0)::BIGINT AS total_hops FROM walk JOIN nodes n ON n.id = node WHERE depth >= 1 AND n.name = 'blue_bolt'"
)
def trace_len(spark, d):
    g = stored(spark, d)
    return spark.createDataFrame([(len(traversal.trace(g.nodes, g.ways, "red_widget", "blue_bolt")),)], "total_hops long")


@query(BASE + f", walk AS (SELECT id AS node, 0 AS depth FROM nodes WHERE path IN ('src/mod1/brand_1.py', 'src/mod2/brand_2.c', 'src/__tests__/brand_5.test.ts') UNION SELECT e.source_id, w.depth + 1 FROM walk w JOIN edges e ON e.target_id = w.node WHERE w.depth < 3) SELECT DISTINCT path FROM walk JOIN nodes n ON n.id = node WHERE {TEST}")
def affected_tests(spark, d):
    g = stored(spark, d)
    return traversal.affected_tests(g.nodes, g.ways, ["src/mod1/brand_1.py", "src/mod2/brand_2.c", "src/__tests__/brand_5.test.ts"], 3)


def near_sql(own: str, other: str) -> str:
    return f"SELECT c.{own} AS id, string_agg(n.name, ',' ORDER BY c.{other}) AS names FROM (SELECT *, row_number() OVER (PARTITION BY {own} ORDER BY {other}) AS k FROM calls) c JOIN nodes n ON n.id = c.{other} WHERE k <= 5 GROUP BY 1"


@query(BASE + f" SELECT n.id, n.start_line, coalesce(i.names, '') AS callers, coalesce(o.names, '') AS callees FROM nodes n LEFT JOIN ({near_sql('target_id', 'source_id')}) i ON i.id = n.id LEFT JOIN ({near_sql('source_id', 'target_id')}) o ON o.id = n.id WHERE n.path = 'src/mod1/brand_1.py'")
def auto_context(spark, d):
    g = graph(spark, d)
    return analytics.file_context(g.nodes, g.edges, "src/mod1/brand_1.py")


PLAN = ", targets AS (SELECT id FROM nodes WHERE name = 'red_widget')"


@query(BASE + PLAN + ", walk AS (SELECT id AS node, 0 AS depth FROM targets UNION SELECT e.source_id, w.depth + 1 FROM walk w JOIN edges e ON e.target_id = w.node WHERE w.depth < 3) SELECT DISTINCT n.id, n.path FROM walk JOIN nodes n ON n.id = node")
def plan_impacted(spark, d):
    """All that a change touches; the limit of each target's walk is beyond what any of them reaches."""
    return context.plan_risk(stored(spark, d), ["red_widget"], most=1_000_000).impacted.select("id", "path")


@query(BASE + " SELECT target_id AS id, count(*) AS n FROM calls WHERE target_id IN (SELECT id FROM nodes WHERE path IN ('src/mod1/brand_1.py', 'src/mod2/brand_2.c')) GROUP BY 1 HAVING count(*) >= 5")
def plan_warnings(spark, d):
    warned = context.plan_risk(stored(spark, d), files=["src/mod1/brand_1.py", "src/mod2/brand_2.c"], most=1_000_000).warnings
    return warned.select("id", F.regexp_extract("warning", r"has (\d+) callers", 1).cast("long").alias("n"))


@query()
def plan_risk(spark, d):
    """(item, key, n): the parts of the risk of a change, with the limits of its kind of answer."""
    p = context.plan_risk(stored(spark, d), ["red_widget"], ["src/mod1/brand_1.py"])
    part = lambda item, df, key: df.select(F.lit(item).alias("item"), key.cast("string").alias("key"), F.lit(1).cast("long").alias("n"))
    out = spark.createDataFrame([("risk", p.risk, p.score)], "item string, key string, n long")
    out = out.unionByName(p.impacted.select(F.lit("impacted").alias("item"), F.col("id").cast("string").alias("key"), F.col("depth").cast("long").alias("n")))
    for item, df, key in (("file", p.files, F.col("path")), ("test", p.affected_tests, F.col("path")), ("warning", p.warnings, F.col("warning")), ("cycle", p.cycle_risks, F.col("risk"))):
        out = out.unionByName(part(item, df, key))
    return out


def trail_sql(side: str, own: str, other: str) -> str:
    return f"SELECT '{side}' AS side, CAST(row_number() OVER (ORDER BY e.id) AS INT) AS rank, n.id, n.name, n.path FROM edges e JOIN nodes n ON n.id = e.{other} WHERE e.kind = 'calls' AND e.{own} = {MOST_OUT} QUALIFY rank <= 15"


@query(BASE + DEGREES + f" SELECT * FROM ({trail_sql('callers', 'target_id', 'source_id')}) UNION ALL SELECT * FROM ({trail_sql('callees', 'source_id', 'target_id')})")
def node_trail(spark, d):
    g = stored(spark, d)
    return context.node_trail(g.nodes, g.edges, seed(g, "fan_out"))


@query(BASE + DEGREES + f", ends AS (SELECT count(*)::DOUBLE / (SELECT count(*) FROM nodes WHERE name = 'red_widget') AS degree FROM edges e JOIN nodes n ON n.name = 'red_widget' AND n.id IN (e.source_id, e.target_id)), t AS (SELECT (SELECT count(*) FROM nodes) AS n, degree FROM ends) SELECT greatest(1, least(10, 4 + CASE WHEN n < 200 THEN 1 WHEN n > 2000 THEN -1 ELSE 0 END + CASE WHEN degree > 20 THEN -1 WHEN degree < 5 THEN 1 ELSE 0 END))::INT AS depth, greatest(5, least(2000, 80 + CASE WHEN n < 200 THEN 20 WHEN n > 2000 THEN 30 ELSE 0 END + CASE WHEN degree > 20 THEN 20 ELSE 0 END))::INT AS nodes FROM t")
def adaptive_limits(spark, d):
    return spark.createDataFrame([engine.CodeBase(stored(spark, d)).limits("impact", "red_widget")], "depth int, nodes int")


@query(
    BASE
    + ROLES
    + ", own AS (SELECT * FROM roles WHERE path = 'src/mod1/brand_1.py'), far AS (SELECT 'imports_from' AS item, t.path AS key FROM edges e JOIN own o ON o.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.kind = 'imports' UNION SELECT 'imported_by', s.path FROM edges e JOIN own o ON o.id = e.target_id JOIN nodes s ON s.id = e.source_id WHERE e.kind = 'imports')"
    " SELECT 'total' AS item, '' AS key, count(*) AS n FROM own UNION ALL SELECT 'exported', '', count(*) FILTER (exported = 1) FROM own UNION ALL SELECT 'role', role, count(*) FROM own GROUP BY 2 UNION ALL SELECT item, key, 1 FROM far WHERE key <> 'src/mod1/brand_1.py'"
)
def file_stats(spark, d):
    g = graph(spark, d)
    return analytics.file_stats(classify.roles(g.nodes, g.edges), g.edges, "src/mod1/brand_1.py")


# resolution and changes

REFS = ", refs AS (SELECT c.source_id * 16777216 + c.target_id AS ref_id, s.file_id, s.qualified_name AS source_qname, t.name AS target_name, c.source_id FROM calls c JOIN nodes s ON s.id = c.source_id JOIN nodes t ON t.id = c.target_id)"
TARGETS = REFS + ", targets AS (SELECT r.ref_id, r.source_id, n.id AS target_id, CASE WHEN n.file_id = r.file_id THEN 1 WHEN n.exported = 1 THEN 2 ELSE 3 END AS priority, row_number() OVER (PARTITION BY r.ref_id ORDER BY CASE WHEN n.file_id = r.file_id THEN 1 WHEN n.exported = 1 THEN 2 ELSE 3 END, n.id) AS k FROM refs r JOIN nodes n ON n.name = r.target_name QUALIFY k = 1)"


def references(g: storage.Graph) -> DataFrame:
    calls = classify.calls_of(g.edges)
    s = g.nodes.select(F.col("id").alias("source_id"), "file_id", F.col("qualified_name").alias("source_qname"))
    t = g.nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return calls.join(s, "source_id").join(t, "target_id").select((F.col("source_id") * (1 << 24) + F.col("target_id")).alias("id"), "file_id", F.lit("call").alias("kind"), "source_qname", "target_name")


@query(BASE + TARGETS + " SELECT ref_id, target_id, priority FROM targets")
def resolve_targets(spark, d):
    g = graph(spark, d)
    return resolve.resolve_targets(references(g).withColumnRenamed("id", "ref_id"), g.nodes)


@query(BASE + TARGETS + " SELECT DISTINCT source_id, target_id, 'calls' AS kind FROM targets WHERE source_id <> target_id")
def resolve_edges(spark, d):
    g = graph(spark, d)
    return resolve.resolve_edges(references(g), g.nodes)


@query(
    BASE
    + ", wanted AS (SELECT DISTINCT s.file_id, t.name, regexp_replace(t.path, '\\.[^/]*$', '') AS target_path FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.kind = 'imports'),"
    " placed AS (SELECT w.file_id, w.name, min(f.file_id) AS target_file FROM wanted w JOIN files f ON starts_with(f.path, w.target_path) GROUP BY w.file_id, w.name, w.target_path),"
    " first AS (SELECT file_id, min(id) AS source_id FROM nodes GROUP BY 1), out AS (SELECT file_id, name, min(id) AS target_id FROM nodes WHERE exported = 1 GROUP BY 1, 2)"
    " SELECT DISTINCT source_id, target_id FROM placed p JOIN first USING (file_id) JOIN out o ON o.file_id = p.target_file AND o.name = p.name WHERE source_id <> target_id"
)
def import_edges(spark, d):
    g = graph(spark, d)
    s = g.nodes.select(F.col("id").alias("source_id"), "file_id")
    t = g.nodes.select(F.col("id").alias("target_id"), "name", F.regexp_replace("path", r"\.[^/]*$", "").alias("target_path"))
    wanted = g.edges.filter("kind = 'imports'").join(s, "source_id").join(t, "target_id").select("file_id", "name", "target_path").distinct()
    return resolve.import_edges(wanted, g.nodes)


@query(BASE + ", modules AS (SELECT DISTINCT 'src/mod' || (file_id % 4) || '/brand_' || (file_id % 7) AS module FROM files) SELECT module, (SELECT min(f.file_id) FROM files f WHERE starts_with(f.path, module)) AS file_id FROM modules")
def prefix_join(spark, d):
    files = graph(spark, d).files
    modules = files.select(F.concat(F.lit("src/mod"), F.col("file_id") % 4, F.lit("/brand_"), F.col("file_id") % 7).alias("module")).distinct()
    return ranges.by_prefix(modules, "module", files, "path", "file_id")


@query(BASE + ", hunks AS (SELECT path, (file_id * 37) % 4000 AS a, (file_id * 37) % 4000 + 400 AS b FROM files) SELECT DISTINCT n.id, n.qualified_name FROM nodes n JOIN hunks h ON h.path = n.path WHERE n.start_line <= h.b AND n.end_line >= h.a")
def diff_overlap(spark, d):
    g = graph(spark, d)
    start = F.col("file_id") * 37 % 4000
    hunks = g.files.select("path", start.alias("start"), (start + 400).alias("end"))
    return ranges.overlapping(g.nodes, hunks).select("id", "qualified_name")


@query(
    BASE
    + ", changes AS (SELECT path, CASE WHEN file_id % 4 = 0 THEN 'added' ELSE 'modified' END AS status FROM files WHERE file_id % 2 = 0), hunks AS (SELECT path, (file_id * 37) % 4000 AS a, (file_id * 37) % 4000 + 400 AS b FROM files WHERE file_id % 3 <> 0)"
    " SELECT n.qualified_name, min(CASE WHEN c.status = 'added' OR h.path IS NULL THEN 'in_changed_file' ELSE 'in_diff' END) AS reason FROM nodes n JOIN changes c ON c.path = n.path LEFT JOIN hunks h ON h.path = n.path"
    " WHERE c.status = 'added' OR h.path IS NULL OR (n.start_line <= h.b AND n.end_line >= h.a) GROUP BY 1"
)
def changed_symbols(spark, d):
    g = graph(spark, d)
    change = g.files.filter("file_id % 2 = 0").select("path", F.when(F.col("file_id") % 4 == 0, "added").otherwise("modified").alias("status"))
    start = F.col("file_id") * 37 % 4000
    hunks = g.files.filter("file_id % 3 != 0").select("path", start.alias("start"), (start + 400).alias("end"))
    return resolve.changed_symbols(g.nodes, change, hunks)


# reports


@query(BASE + DEGREES + " SELECT id, fan_in, fan_out, fan_in + fan_out AS coupling FROM fans WHERE fan_in + fan_out > 0 ORDER BY coupling DESC, id LIMIT 15")
def hotspots(spark, d):
    g = graph(spark, d)
    return analytics.hotspots(g.nodes, g.edges)


@query(
    BASE
    + ", pairs AS (SELECT DISTINCT s.path AS a, t.path AS b FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.kind = 'imports' AND s.path <> t.path)"
    " SELECT f.path, coalesce(o.c, 0) AS imports_from, coalesce(i.c, 0) AS imported_by, coalesce(o.c, 0) + coalesce(i.c, 0) AS coupling FROM files f LEFT JOIN (SELECT a, count(*) AS c FROM pairs GROUP BY 1) o ON o.a = f.path LEFT JOIN (SELECT b, count(*) AS c FROM pairs GROUP BY 1) i ON i.b = f.path"
)
def file_coupling(spark, d):
    return analytics.file_coupling(graph(spark, d))


@query(
    BASE
    + DEGREES
    + ", ext AS (SELECT c.target_id AS id, s.path AS src, count(*) AS n, min(c.source_id) AS first FROM calls c JOIN nodes s ON s.id = c.source_id JOIN nodes t ON t.id = c.target_id WHERE s.path <> t.path GROUP BY 1, 2),"
    " x AS (SELECT id, sum(n) AS outside, max(n) AS most, arg_max(src, n * 16777216 - first) AS top FROM ext GROUP BY 1),"
    " d AS (SELECT f.*, end_line - start_line + 1 AS body, coalesce(x.outside, 0)::BIGINT AS outside, x.most, x.top FROM fans f LEFT JOIN x ON x.id = f.id),"
    " r AS (SELECT 'extract' AS type, id, name, path, CASE WHEN body > 100 THEN 'high' ELSE 'medium' END AS priority, body || ' lines, ' || fan_out || ' outgoing calls: consider smaller functions' AS reason FROM d WHERE body > 50 AND fan_out >= 5"
    " UNION ALL SELECT 'inline', id, name, path, 'low', 'only 1 caller, ' || body || ' lines: may be inlined' FROM d WHERE fan_in = 1 AND fan_out <= 2 AND body <= 10 AND kind = 'function'"
    " UNION ALL SELECT 'move', id, name, path, CASE WHEN outside >= 4 THEN 'high' ELSE 'medium' END, outside || '/' || fan_in || ' callers are in other files; most from ' || top || ' (' || most || ' calls)' FROM d WHERE fan_in >= 2 AND outside > fan_in - outside AND outside >= 2"
    " UNION ALL SELECT 'dead', id, name, path, 'medium', 'no callers, no callees, not exported: safe to remove' FROM d WHERE fan_in = 0 AND fan_out = 0 AND exported = 0"
    " UNION ALL SELECT 'split', id, name, path, CASE WHEN fan_out >= 15 THEN 'high' ELSE 'medium' END, fan_out || ' outgoing calls: consider splitting what it does' FROM d WHERE fan_out >= 10)"
    " SELECT type, id, priority, reason FROM r QUALIFY row_number() OVER (PARTITION BY type, name, path ORDER BY id) = 1"
)
def suggest(spark, d):
    g = graph(spark, d)
    return analytics.suggestions(g.nodes, g.edges, limit=None).select("type", "id", "priority", "reason")


@query(BASE + " SELECT s.qualified_name AS subject, t.qualified_name AS detail FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE starts_with(s.path, 'src/mod0/') AND starts_with(t.path, 'src/mod1/')")
def lint_deny(spark, d):
    return analytics.lint(graph(spark, d), [analytics.Rule("deny-dependency", "src/mod0/**", "src/mod1/**")]).select("subject", "detail")


@query(BASE + DEGREES + " SELECT qualified_name AS subject, CAST(fan_out AS VARCHAR) AS detail FROM fans WHERE fan_out > 3 AND regexp_matches(path, '^src/[^/]*/brand_')")
def lint_fanout(spark, d):
    return analytics.lint(graph(spark, d), [analytics.Rule("max-fan-out", most=3, scope="src/**")]).select("subject", "detail")


@query(BASE + " SELECT f.path AS subject, CAST(count(*) AS VARCHAR) AS detail FROM files f JOIN nodes n USING (file_id) GROUP BY 1 HAVING count(*) > 30")
def lint_file_symbols(spark, d):
    return analytics.lint(graph(spark, d), [analytics.Rule("max-file-symbols")]).select("subject", "detail")


@query(BASE + " , v AS (SELECT count(*) AS c FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE starts_with(s.path, 'src/mod0/') AND starts_with(t.path, 'src/mod1/')), w AS (SELECT count(*) AS c FROM (SELECT file_id FROM nodes GROUP BY 1 HAVING count(*) > 30)) SELECT v.c AS errors, w.c AS warnings, v.c = 0 AS passed FROM v, w")
def lint_totals(spark, d):
    rules = [analytics.Rule("deny-dependency", "src/mod0/**", "src/mod1/**"), analytics.Rule("max-file-symbols", severity="warn")]
    return analytics.lint_totals(analytics.lint(graph(spark, d), rules))


@query(
    BASE
    + ROLES
    + f", c AS (SELECT count(*) AS n, count(*) FILTER (role = 'dead') AS dead, count(*) FILTER (fan_out >= 10) AS god FROM roles), f AS (SELECT count(*) FILTER ({TEST}) AS t, count(*) FILTER (NOT {TEST}) AS s FROM files)"
    " SELECT CAST(greatest(0, least(100, 100 - floor(dead * 200 / greatest(n, 1)::DOUBLE + 0.5))) AS INT) AS dead, CAST(CASE WHEN s = 0 THEN 0 ELSE greatest(0, least(100, floor(t * 100 / greatest(s, 1)::DOUBLE + 0.5))) END AS INT) AS coverage, CAST(greatest(0, least(100, 100 - floor(god * 1000 / greatest(n, 1)::DOUBLE + 0.5))) AS INT) AS complexity FROM c, f"
)
def dna_scores(spark, d):
    """The scores that need no cycle search."""
    return analytics.health(graph(spark, d)).select("dead", "coverage", "complexity")


@query()
def dna_health(spark, d):
    g = stored(spark, d)
    cycles = components.search_cycles(g.edges.filter(F.col("kind").isin("calls", "imports")), g.nodes)
    return analytics.health(g, cycles=cycles.count())


def style_sql(rows: str) -> str:
    score = lambda names: "len(list_intersect(names, [" + ", ".join(f"'{n}'" for n in names) + "]))"
    layered, components, monolith, modular = analytics.STYLES
    return (
        f"{rows}, s AS (SELECT list(DISTINCT lower(list_reverse(string_split(path, '/'))[2])) FILTER (contains(path, '/')) AS names, count(DISTINCT string_split(path, '/')[1]) AS tops FROM paths)"
        f" SELECT CASE WHEN {score(analytics.LAYERED)} >= 2 THEN '{layered}' WHEN {score(analytics.COMPONENTS)} >= 2 THEN '{components}' WHEN tops <= 2 THEN '{monolith}' ELSE '{modular}' END AS style FROM s"
    )


@query(style_sql(BASE + ", paths AS (SELECT path FROM files)"))
def dna_style(spark, d):
    return analytics.style(graph(spark, d).files)


FOLDERS = ("Handlers", "services", "lib", "models")


@query(style_sql("WITH paths AS (SELECT 'app' || (p_partkey % 3) || '/' || CASE p_partkey % 4 WHEN 0 THEN 'Handlers' WHEN 1 THEN 'services' WHEN 2 THEN 'lib' ELSE 'models' END || '/f' || p_partkey || '.py' AS path FROM part)"))
def dna_style_layers(spark, d):
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    paths = read(spark, d, "part").select(F.concat(F.lit("app"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), folder, F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    return analytics.style(paths)


@query(BASE + DEGREES + " SELECT id, fan_in, fan_out, fan_in + fan_out AS total FROM fans WHERE fan_in >= 3 OR fan_out >= 5 ORDER BY total DESC, id LIMIT 10")
def key_hubs(spark, d):
    g = graph(spark, d)
    return analytics.key_hubs(g.nodes, g.edges)


@query(BASE + ", f AS (SELECT * FROM nodes ORDER BY id LIMIT 200) SELECT path, string_agg('n' || id || CASE kind WHEN 'class' THEN '[[' || name || ']]' WHEN 'interface' THEN '{{' || name || '}}' ELSE '(' || name || ')' END, chr(10) ORDER BY id) AS body FROM f GROUP BY 1")
def export_mermaid(spark, d):
    return analytics.mermaid(graph(spark, d))


@query(BASE + ", f AS (SELECT id FROM nodes ORDER BY id LIMIT 200) SELECT 'n' || source_id || CASE kind WHEN 'imports' THEN ' -.->|imports| ' ELSE ' -->|calls| ' END || 'n' || target_id AS line FROM edges WHERE source_id IN (SELECT id FROM f) AND target_id IN (SELECT id FROM f)")
def export_edges(spark, d):
    return analytics.mermaid_edges(graph(spark, d))


# search

TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({text}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '{punctuation}', ' ', 'g')), '\\s+'), lambda t: length(t) >= 2)"
INDEX_CLASS = T.INDEX_PUNCTUATION.replace("'", "''")
QUERY_CLASS = T.QUERY_PUNCTUATION.replace("'", "''")


def tokens_sql(text: str, punctuation: str = INDEX_CLASS) -> str:
    return TOKENS.format(text=text, punctuation=punctuation)


@query(f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY 1")
def tokens_df(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    return search.inverted_index(docs, "doc_id", T.tokens(F.col("text"))).groupBy("token").agg(F.count("*").alias("df"))


def keyword_sql(raw: list[str], score: str) -> str:
    hit = " OR ".join(f"t = '{x}'" + (f" OR starts_with(t, '{x}')" if len(x) <= 4 else "") for x in raw)
    return f"len(list_filter(toks, lambda t: {hit})) > 0 AND ({score}) > 0"


PART_SCORE = " + ".join(f"CASE WHEN name = '{t}' THEN 100 WHEN starts_with(name, '{t}') THEN 50 WHEN contains(name, '{t}') THEN 20 WHEN contains(lower(qualified_name), '{t}') OR contains(lower(signature), '{t}') THEN 5 ELSE 0 END" for t in ("red", "promo")) + " + CASE WHEN exported = 1 THEN 10 ELSE 0 END"


@query(BASE + ", t AS (SELECT *, " + tokens_sql("name || ' ' || qualified_name || ' ' || signature") + f" AS toks FROM nodes) SELECT id, -({PART_SCORE}) AS rank FROM t WHERE {keyword_sql(['red', 'promo'], PART_SCORE)}")
def fts_parts(spark, d):
    nodes = graph(spark, d).nodes
    return search.keyword_search(nodes, "red promo", None, ("name", "qualified_name", "signature")).select("id", "rank")


DOC_SCORE = " + ".join(f"CASE WHEN lower(source) = '{t}' THEN 100 WHEN starts_with(lower(source), '{t}') THEN 50 WHEN contains(lower(source), '{t}') THEN 20 WHEN contains(lower(text), '{t}') THEN 5 ELSE 0 END" for t in ("license", "src1"))


def indexed_docs(spark, d):
    """documents with their id as id, and the stored index of their sources and texts."""
    docs = read(spark, d, "documents").withColumnRenamed("doc_id", "id")
    return docs, TextIndex.of(docs, search.document_tokens("source", "text"), "id", "documents")


@query("WITH t AS (SELECT *, " + tokens_sql("source || ' ' || text") + f" AS toks FROM documents) SELECT doc_id AS id, -({DOC_SCORE}) AS rank FROM t WHERE {keyword_sql(['license', 'src1'], DOC_SCORE)}")
def fts_docs(spark, d):
    """Candidates come from the stored index, which the first call writes to the shared folder."""
    docs, index = indexed_docs(spark, d)
    return search.keyword_search(docs, "license src1", None, ("source", "text"), None, index).select("id", "rank")


@query("WITH t AS (SELECT *, " + tokens_sql("source || ' ' || text") + f" AS toks FROM documents) SELECT doc_id AS id, -({DOC_SCORE}) AS rank FROM t WHERE {keyword_sql(['license', 'src1'], DOC_SCORE)} ORDER BY rank, id LIMIT 20")
def fts_top(spark, d):
    docs, index = indexed_docs(spark, d)
    return search.keyword_search(docs, "license src1", 20, ("source", "text"), None, index).select("id", "rank")


def trigrams_sql(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length('  ' || {x} || ' ') - 1), lambda i: substr('  ' || {x} || ' ', i, 3)))"


@query(
    f"WITH s AS (SELECT p_partkey AS id, p_name, {trigrams_sql('lower(p_name)')} AS a, {trigrams_sql(chr(39) + 'blue widgte' + chr(39))} AS b FROM part),"
    " j AS (SELECT id, p_name, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS sim FROM s)"
    " SELECT id, -round(0.6::DOUBLE * sim + 0.4::DOUBLE * (1 - levenshtein(lower(p_name), 'blue widgte')::DOUBLE / greatest(length(p_name), 11)), 6) AS rank FROM j WHERE sim >= 0.3::DOUBLE"
)
def fuzzy_parts(spark, d):
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return search.fuzzy_search(parts, "blue widgte", None).select("id", F.round("rank", 6).alias("rank"))


@query()
def symbol_search(spark, d):
    g = graph(spark, d)
    return search.symbol_search(g.nodes.withColumn("doc", F.lit("")), "kind:function red widget", 20).select("id", "rank")


BM25_TERMS = ["license", "the", "version"]


def bm25_sql(rows: str, terms: list[str], n: str) -> str:
    hit = " OR ".join(f"t = '{x}'" + (f" OR starts_with(t, '{x}')" if len(x) <= 4 else "") for x in terms)
    tf = ", ".join(f"len(list_filter(toks, lambda t: t = '{x}')) AS tf{k}" for k, x in enumerate(terms))
    score = " + ".join(f"ln(({n} - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE) + 1) * (tf{k} * 2.2::DOUBLE) / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))" for k in range(len(terms)))
    counts = ", ".join(f"(count(*) FILTER (tf{k} > 0))::DOUBLE AS df{k}" for k in range(len(terms)))
    return f"{rows}, c AS (SELECT id, len(toks) AS dl, {tf} FROM t WHERE len(list_filter(toks, lambda t: {hit})) > 0), m AS (SELECT avg(dl) AS mean, {counts} FROM c) SELECT id, floor(({score}) * 1000 + 0.5) / 1000 AS score FROM c, m WHERE ({score}) > 0"


@query(bm25_sql("WITH t AS (SELECT doc_id AS id, " + tokens_sql("text", QUERY_CLASS) + " AS toks FROM documents)", BM25_TERMS, "(SELECT count(*) FROM documents)"))
def bm25_docs(spark, d):
    return search.bm25_indexed(indexed_texts(spark, d), " ".join(BM25_TERMS)).select("id", "score")


def indexed_texts(spark, d):
    docs = read(spark, d, "documents")
    return TextIndex.of(docs, T.tokens(F.coalesce("text", F.lit("")), T.QUERY_PUNCTUATION), "doc_id", "texts")


TOP_SCORE = " + ".join(f"ln((n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE) + 1) * (tf{k} * 2.2::DOUBLE) / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))" for k in range(len(BM25_TERMS)))


@query(
    "WITH t AS (SELECT doc_id AS id, " + tokens_sql("text", QUERY_CLASS) + " AS toks FROM documents), c AS (SELECT id, len(toks) AS dl, " + ", ".join(f"len(list_filter(toks, lambda t: t = '{x}')) AS tf{k}" for k, x in enumerate(BM25_TERMS)) + " FROM t),"
    " m AS (SELECT count(*) AS n, avg(dl) AS mean, " + ", ".join(f"(count(*) FILTER (tf{k} > 0))::DOUBLE AS df{k}" for k in range(len(BM25_TERMS))) + f" FROM c) SELECT id, round({TOP_SCORE}, 6) AS score FROM c, m WHERE ({TOP_SCORE}) > 0 ORDER BY {TOP_SCORE} DESC, id LIMIT 20"
)
def bm25_top(spark, d):
    """The best twenty by block maxima, with the mean length of all documents."""
    return indexed_texts(spark, d).ranked(BM25_TERMS, 20).withColumn("score", F.round("score", 6))


@query()
def intent_search(spark, d):
    g = stored(spark, d)
    return search.intent_search(g.nodes, g.edges, "red widget promo").withColumn("matched", F.array_join("matched", " "))


@query("SELECT page_id, count(*) AS n, count(DISTINCT h) AS distinct_n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages) GROUP BY 1")
def hrefs(spark, d):
    links = read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("h"))
    return links.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("h").alias("distinct_n"))


# vectors

SCALE = "greatest((s[lo + 1] + (s[least(lo + 2, len(s))] - s[lo + 1]) * ((len(s) - 1) * 0.999::DOUBLE - lo)) / 127, 1e-8::DOUBLE)"
INDEX = f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_sort(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS s, CAST(floor((len(embedding) - 1) * 0.999::DOUBLE) AS INT) AS lo FROM embeddings), sc AS (SELECT vec_id, e, {SCALE} AS scale FROM v), idx AS (SELECT vec_id, e, scale, list_transform(e, lambda x: CAST(least(127, greatest(-127, round_even(x / scale, 0))) AS INT)) AS q FROM sc)"


@query(INDEX + " SELECT vec_id, list_sum(q)::BIGINT AS q_sum, round(scale, 12) AS scale, array_to_string(q, ',') AS q FROM idx")
def quantize(spark, d):
    index = retrieval.build_index(read(spark, d, "embeddings"))
    return index.select("vec_id", F.col("q_sum").cast("long").alias("q_sum"), F.round("scale", 12).alias("scale"), F.array_join(F.col("q").cast("array<string>"), ",").alias("q"))


def topk_sql(score: str) -> str:
    return f"SELECT query_id, rank, doc_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {score} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {score} DESC, b.vec_id) AS rank FROM idx a, idx b WHERE a.vec_id % 50 = 0) WHERE rank <= 10"


EXACT, QUANTISED = "round(list_dot_product(a.e, b.e), 6)", "round(list_dot_product(list_transform(a.q, lambda x: x::DOUBLE), list_transform(b.q, lambda x: x::DOUBLE)) * a.scale * b.scale, 6)"


@query(INDEX + " " + topk_sql(EXACT))
def topk_exact(spark, d):
    vectors = read(spark, d, "embeddings")
    return retrieval.search_exact(vectors, vectors.filter("vec_id % 50 = 0"), 10)


@query(INDEX + " " + topk_sql(QUANTISED))
def topk_int8(spark, d):
    """Through the stored index of the table's vectors, which the first call writes to the shared folder."""
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.VectorIndex.of(vectors).search(vectors.filter("vec_id % 50 = 0"), 10)


@query(INDEX + f" SELECT round(avg(share), 6) AS recall FROM (SELECT t.query_id, count(f.doc_id) / 10.0::DOUBLE AS share FROM ({topk_sql(EXACT)}) t LEFT JOIN ({topk_sql(QUANTISED)}) f ON f.query_id = t.query_id AND f.doc_id = t.doc_id GROUP BY 1)")
def recall(spark, d):
    return retrieval.recall(topk_int8(spark, d), topk_exact(spark, d), 10)


@query(INDEX + " SELECT count(*) AS n, round(avg(e), 6) AS mean_error, round(var_pop(e), 8) AS var_error FROM (SELECT list_dot_product(list_transform(a.q, lambda x: x::DOUBLE), list_transform(b.q, lambda x: x::DOUBLE)) * a.scale * b.scale - list_dot_product(a.e, b.e) AS e FROM idx a, idx b WHERE a.vec_id % 50 = 0)")
def quant_noise(spark, d):
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.score_noise(vectors, vectors.filter("vec_id % 50 = 0"))


@query()
def rht_norm(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding", rotated(F.col("embedding")).alias("r"))
    return v.select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"), F.round(F.sqrt(dot(F.col("r"), F.col("r"))), 5).alias("rotated_norm"))


# ranges, budgets, pages, sessions


@query(
    "WITH r AS (SELECT l_orderkey AS k, l_partkey % 400 AS a, l_partkey % 400 + l_quantity::BIGINT AS b FROM lineitem),"
    " n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 10 THEN 0 ELSE 1 END AS new FROM r),"
    " i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT k, min(a) AS a, max(b) AS b, count(*) AS n FROM i GROUP BY k, island"
)
def range_islands(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 400).alias("a"), (F.col("l_partkey") % 400 + F.col("l_quantity").cast("long")).alias("b"))
    return ranges.islands(rows, "k", "a", "b")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 60000")
def char_budget(spark, d):
    return ranges.within_budget(read(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 60_000).select("doc_id", "source")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_orders(spark, d):
    return ranges.page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3, 50)


@query(
    "WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM l)"
    " SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS \"end\", count(*) AS n, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS items FROM s GROUP BY user_id, k"
)
def session_debounce(spark, d):
    return changes.debounced(read(spark, d, "events"), "4 hours", "user_id", "event_type").withColumn("items", F.array_join("items", ","))


@query(
    "WITH r AS (SELECT user_id, ts, event_id, sum(value::DECIMAL(18,2)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events),"
    " x AS (SELECT *, row_number() OVER (PARTITION BY user_id, l ORDER BY ts, event_id) AS k FROM r, (VALUES (100.0::DOUBLE), (500.0::DOUBLE)) t(l) WHERE running >= l) SELECT user_id, l AS \"limit\", ts, running::DOUBLE AS running FROM x WHERE k = 1"
)
def running_budget(spark, d):
    return changes.threshold_alerts(read(spark, d, "events"), "user_id", "value", (100.0, 500.0))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def change_filter(spark, d):
    named = read(spark, d, "events").withColumn("path", F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("src/"), "event_type", F.lit(".py"))).when(F.col("event_type") == "error", F.lit("node_modules/x.py")).otherwise(F.lit("notes.txt")))
    return changes.relevant(named).groupBy("event_type").agg(F.count("*").alias("n"))


# spending reports over orders


@query("SELECT l_returnflag AS category, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total, floor(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / (SELECT sum(l_extendedprice::DECIMAL(18,2))::DOUBLE FROM lineitem) * 10000 + 0.5) / 100 AS percent FROM lineitem GROUP BY 1")
def spend_by_group(spark, d):
    lines = read(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("x"))
    groups = lines.groupBy(F.col("l_returnflag").alias("category")).agg(F.count("*").alias("n"), F.sum("x").cast("double").alias("total"))
    whole = lines.agg(F.sum("x").cast("double").alias("whole"))
    return groups.crossJoin(F.broadcast(whole)).select("category", "n", "total", T.half_up(F.col("total") / F.col("whole") * 100, 2).alias("percent"))


@query("WITH m AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH))::DATE AS month) SELECT m.month, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F'), 0)::DOUBLE AS income, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus <> 'F'), 0)::DOUBLE AS expense FROM m LEFT JOIN orders ON date_trunc('month', o_orderdate)::DATE = m.month GROUP BY 1")
def monthly_trend(spark, d):
    spine = spark.sql("SELECT explode(sequence(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH)) AS month")
    price, done = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderstatus") == "F"
    sums = read(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum(F.when(done, price)).cast("double").alias("income"), F.sum(F.when(~done, price)).cast("double").alias("expense"))
    return spine.join(sums, "month", "left").fillna(0.0, ["income", "expense"])


@query("SELECT o_orderpriority AS category, floor(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 1e9 * 10000 + 0.5) / 100 AS used, CASE WHEN sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 1e7 >= 100 THEN 'critical' WHEN sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 1e7 >= 80 THEN 'warning' ELSE 'ok' END AS severity FROM orders GROUP BY 1")
def budget_status(spark, d):
    spent = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("s"))
    used = F.col("s") / 1e7
    return spent.select("category", T.half_up(F.col("s") / 1e9 * 100, 2).alias("used"), F.when(used >= 100, "critical").when(used >= 80, "warning").otherwise("ok").alias("severity"))


@query("SELECT n_name, count(*) AS customers, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def account_summary(spark, d):
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return read(spark, d, "customer").join(nations, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("customers"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))


@query("SELECT event_type, count(*) AS n, floor(avg(value) * 100 + 0.5) / 100 AS mean_value, count(*) FILTER (value >= 40) AS large FROM events GROUP BY 1")
def log_rollup(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), T.half_up(F.avg("value"), 2).alias("mean_value"), F.count_if(F.col("value") >= 40).alias("large"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 3")
def last_n(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return read(spark, d, "orders").withColumn("k", F.row_number().over(order)).filter("k <= 3").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")


# joins and reports over accounts, orders and events


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def joined_ordered(spark, d):
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    urgent = read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_totalprice")
    return urgent.join(customers, "o_custkey").select("o_orderkey", "c_name", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT s_suppkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = s_nationkey")
def name_or_id(spark, d):
    known = read(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return read(spark, d, "supplier").join(known, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.col("s_nationkey").cast("string")).alias("nation"))


@query("SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey")
def hierarchy(spark, d):
    children = read(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    return read(spark, d, "region").join(children, "r_regionkey", "left").select("r_name", "n_name")


@query("SELECT n_name, sum(c_acctbal::DECIMAL(18,2))::DOUBLE - coalesce(any_value(s.debt), 0) AS worth FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT s_nationkey, sum(s_acctbal::DECIMAL(18,2))::DOUBLE AS debt FROM supplier GROUP BY 1) s ON s.s_nationkey = n_nationkey GROUP BY n_name")
def net_worth(spark, d):
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    owned = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(money("c_acctbal").alias("owned"))
    owed = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(money("s_acctbal").alias("owed"))
    nations = read(spark, d, "nation").select("n_nationkey", "n_name")
    return nations.join(owned, "n_nationkey").join(owed, "n_nationkey", "left").select("n_name", (F.col("owned") - F.coalesce("owed", F.lit(0.0))).alias("worth"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, floor(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(DISTINCT o_orderdate::DATE) * 100 + 0.5) / 100 AS per_day, floor(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(DISTINCT o_orderdate::DATE) * extract('day' FROM last_day(any_value(o_orderdate)::DATE)) * 100 + 0.5) / 100 AS projected FROM orders GROUP BY 1")
def daily_projection(spark, d):
    day = F.to_date("o_orderdate")
    months = read(spark, d, "orders").groupBy(F.trunc(day, "month").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("s"), F.countDistinct(day).alias("days"))
    per_day = F.col("s") / F.col("days")
    return months.select("month", T.half_up(per_day, 2).alias("per_day"), T.half_up(per_day * F.dayofmonth(F.last_day("month")), 2).alias("projected"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) % 10 AS tag, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) % 10 IN (1, 3, 5) GROUP BY 1")
def by_any_tag(spark, d):
    tag = F.get_json_object("props", "$.k").cast("int") % 10
    tagged = read(spark, d, "events").withColumn("tags", F.array(tag))
    found = tagged.filter(F.arrays_overlap("tags", F.array(F.lit(1), F.lit(3), F.lit(5))))
    return found.groupBy(F.col("tags")[0].alias("tag")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query(
    "WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F'), 0)::DOUBLE AS income, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'O'), 0)::DOUBLE AS expense FROM orders GROUP BY 1)"
    " SELECT month, income - expense AS savings, CASE WHEN income > 0 THEN floor((income - expense) / income * 100 * 100 + 0.5) / 100 ELSE 0 END AS rate FROM m"
)
def savings_rate(spark, d):
    orders = read(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("month"), F.col("o_totalprice").cast("decimal(18,2)").alias("x"), "o_orderstatus")
    return reports.savings(orders, "month", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", "x").select("month", "savings", "rate")


@query(
    "WITH o AS (SELECT * FROM orders WHERE date_trunc('month', o_orderdate) = DATE '1996-03-01'), g AS (SELECT o_orderpriority AS key, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS amount FROM o GROUP BY 1)"
    " SELECT 'income' AS item, '' AS key, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F'), 0)::DOUBLE AS amount FROM o UNION ALL SELECT 'expense', '', coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'O'), 0)::DOUBLE FROM o"
    " UNION ALL SELECT * FROM (SELECT 'top', key, amount FROM g ORDER BY amount DESC, key LIMIT 5) UNION ALL SELECT 'alert', key, amount FROM g WHERE amount >= 0.8::DOUBLE * 1e6"
)
def finance_summary(spark, d):
    month = read(spark, d, "orders").filter(F.trunc("o_orderdate", "month") == "1996-03-01").select("o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("x"))
    return reports.summary(month, F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", "o_orderpriority", "x", 1e6)


RULES_SQL = "SELECT o_orderkey AS id, o_orderdate::DATE AS last, CASE o_orderkey % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'biweekly' WHEN 3 THEN 'monthly' ELSE 'yearly' END AS frequency, (o_orderkey % 3 + 1)::INT AS every, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate::DATE + 10 END AS until FROM orders"
NEXT_SQL = "CASE frequency WHEN 'daily' THEN last + every WHEN 'weekly' THEN last + 7 * every WHEN 'biweekly' THEN last + 14 * every ELSE (date_trunc('month', last)::DATE + to_months(CASE frequency WHEN 'monthly' THEN every ELSE 12 * every END))::DATE + (day(last) - 1)::INT END"


def recurring_rules(spark, d):
    k = F.col("o_orderkey")
    frequency = F.element_at(F.array(*map(F.lit, reports.FREQUENCIES)), (k % 5 + 1).cast("int"))
    day = F.to_date("o_orderdate")
    return read(spark, d, "orders").select(k.alias("id"), day.alias("last"), frequency.alias("frequency"), (k % 3 + 1).cast("int").alias("every"), F.when(k % 7 == 0, F.date_add(day, 10)).alias("until"))


@query(f"SELECT id, next::DATE AS next FROM (SELECT *, {NEXT_SQL} AS next FROM ({RULES_SQL})) WHERE (until IS NULL OR until >= DATE '1996-06-01') AND next <= DATE '1996-06-01'")
def recurring_due(spark, d):
    return reports.due(recurring_rules(spark, d), F.lit("1996-06-01").cast("date")).select("id", "next")


@query(f"SELECT id, next::DATE AS next, (next::DATE - DATE '1996-06-01')::INT AS days FROM (SELECT *, {NEXT_SQL} AS next FROM ({RULES_SQL})) WHERE (until IS NULL OR until >= DATE '1996-06-01') AND next::DATE - DATE '1996-06-01' BETWEEN 0 AND 30")
def recurring_upcoming(spark, d):
    return reports.upcoming(recurring_rules(spark, d), F.lit("1996-06-01").cast("date"), 30).select("id", "next", "days")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events")
def iso_timestamps(spark, d):
    return read(spark, d, "events").select("event_id", T.iso_timestamp(F.unix_millis(F.col("ts").cast("timestamp"))).alias("iso"))


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM orders")
def page_totals(spark, d):
    return ranges.page_totals(read(spark, d, "orders").select("o_orderkey"), 50)


@query(
    INDEX
    + ", b AS (SELECT vec_id, len(e) AS n, list_sum(list_transform(e, lambda x: x * x)) AS norm2, scale FROM idx), q AS (SELECT avg(norm2) AS norm2, avg(4 * scale * scale) AS step2 FROM b WHERE vec_id % 50 = 0)"
    " SELECT vec_id, round(least(1.0::DOUBLE, 2 * n * exp(-n * 0.3::DOUBLE * 0.3::DOUBLE / 2)), 8) AS tail, round(q.norm2 * 4 * scale * scale / 12 + b.norm2 * q.step2 / 12, 12) AS noise FROM b, q"
)
def vector_bounds(spark, d):
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.noise_bounds(vectors, F.col("vec_id") % 50 == 0, 0.3)


@query()
def rotation_table(spark, d):
    """(method, mse, recall): quantisation without rotation, and after the plain and the randomised rotation."""
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.rotation_table(vectors, vectors.filter("vec_id % 50 = 0"), 10)


@query()
def gaussian_clusters(spark, d):
    """The shape of synthetic vectors around centres."""
    v = retrieval.gaussian_clusters(spark, 2_000, 64)
    return v.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))


@query("SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 30 DAY)::DATE AS next FROM orders WHERE (o_orderdate::DATE + INTERVAL 30 DAY)::DATE BETWEEN DATE '1996-06-01' AND DATE '1996-06-15'")
def upcoming(spark, d):
    due = F.date_add(F.to_date("o_orderdate"), 30)
    return read(spark, d, "orders").select("o_orderkey", due.alias("next")).filter(F.col("next").between("1996-06-01", "1996-06-15"))


@query("SELECT user_id, floor(avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0 END) * 10000 + 0.5) / 10000 AS rate, count(*) AS n FROM events GROUP BY 1")
def win_rate(spark, d):
    won = F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)
    return read(spark, d, "events").groupBy("user_id").agg(T.half_up(F.avg(won), 4).alias("rate"), F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN floor(c_acctbal + 0.5) ELSE floor(c_acctbal * 100 + 0.5) / 100 END AS rounded FROM customer")
def money_rounding(spark, d):
    whole = F.col("c_nationkey") % 5 == 0  # currencies without small units
    x = F.col("c_acctbal")
    return read(spark, d, "customer").select("c_custkey", F.when(whole, T.half_up(x)).otherwise(T.half_up(x, 2)).alias("rounded"))


@query(INDEX + f" SELECT avg(hit) AS hit_rate FROM (SELECT t.query_id, max(CASE WHEN q.label = e.label THEN 1.0::DOUBLE ELSE 0 END) AS hit FROM ({topk_sql(EXACT)}) t JOIN embeddings q ON q.vec_id = t.query_id JOIN embeddings e ON e.vec_id = t.doc_id WHERE t.doc_id <> t.query_id GROUP BY 1)")
def hit_rate(spark, d):
    labels = read(spark, d, "embeddings").select("vec_id", "label")
    found = topk_exact(spark, d).filter("doc_id != query_id").join(labels.toDF("query_id", "wanted"), "query_id").join(labels.toDF("doc_id", "got"), "doc_id")
    hits = found.groupBy("query_id").agg(F.max(F.when(F.col("wanted") == F.col("got"), 1.0).otherwise(0.0)).alias("hit"))
    return hits.agg(F.avg("hit").alias("hit_rate"))


@query("SELECT bin, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT CAST(floor(least(value, 99.999) / 10) AS INT) AS bin, value FROM events) GROUP BY 1 HAVING count(*) > 5")
def calibration_bins(spark, d):
    binned = read(spark, d, "events").select(F.floor(F.least("value", F.lit(99.999)) / 10).cast("int").alias("bin"), "value")
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).filter("n > 5")


@query(INDEX + " SELECT vec_id, list_min(list_transform(q, lambda x: x + 128)) AS low, list_max(list_transform(q, lambda x: x + 128)) AS high, round(sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(2 * ln(2 * len(e) / 0.01::DOUBLE) / len(e)), 6) AS coordinate_bound FROM idx")
def query_bias(spark, d):
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    n = F.size("embedding")
    bound = F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(F.ln(n * 2 / F.lit(0.01)) * 2 / n)
    q = retrieval.build_index(vectors).select("vec_id", F.transform("q", lambda x: x + 128).alias("u"))
    return vectors.join(q, "vec_id").select("vec_id", F.array_min("u").alias("low"), F.array_max("u").alias("high"), F.round(bound, 6).alias("coordinate_bound"))


@query(BASE + " SELECT id, '{\"id\":' || id || ',\"name\":\"' || name || '\",\"exported\":' || exported || '}' AS line FROM nodes")
def json_lines(spark, d):
    nodes = graph(spark, d).nodes
    return nodes.select("id", export.json_line(nodes.select("id", "name", "exported")).alias("line"))


@query(BASE + ", f AS (SELECT id FROM nodes ORDER BY id LIMIT 200) SELECT e.id, e.kind FROM edges e WHERE source_id IN (SELECT id FROM f) AND target_id IN (SELECT id FROM f)")
def export_gather(spark, d):
    return export.gathered(graph(spark, d)).edges.select("id", "kind")


@query("SELECT source, target, min(id) AS id FROM (SELECT l_partkey % 50 AS source, l_suppkey % 50 AS target, l_orderkey * 100 + l_linenumber AS id FROM lineitem) GROUP BY 1, 2")
def edge_once(spark, d):
    lines = read(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 50).alias("source_id"), (F.col("l_suppkey") % 50).alias("target_id"), F.lit("calls").alias("kind"))
    return storage.distinct_edges(lines).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "id")


# scalar functions


@query(
    "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, md5(text) AS md5, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, regexp_replace(substr(text, 1, 40), '[^a-zA-Z0-9_]', '_', 'g') AS ident FROM documents"
)
def scalar_text(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), F.md5("text").alias("md5"), T.line_of(F.col("text"), F.length("text")).cast("long").alias("lines"), T.identifier(F.substring("text", 1, 40)).alias("ident"))


@query("SELECT doc_id, length(text) AS length, md5(regexp_replace(text, '[^a-zA-Z0-9_]', '_', 'g')) AS ident_md5 FROM documents")
def scalar_identifiers(spark, d):
    """The identifiers of whole texts, by digest; scalar_text has those of their first 40 characters."""
    ident = T.identifier(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.length(ident).cast("long").alias("length"), F.md5(ident).alias("ident_md5"))


@query(BASE + " SELECT path, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/?[^/]*$', '') AS dir, split_part(path, '/', 1) AS top, split_part(path, '/', 1) || '/lib/' || regexp_extract(path, '[^/]*$') AS sibling FROM files")
def scalar_paths(spark, d):
    p = F.col("path")
    joined = F.concat(T.directory(p), F.lit("/.././lib/"), T.base_name(p))
    return graph(spark, d).files.select("path", T.base_name(p).alias("base"), T.directory(p).alias("dir"), T.top_directory(p).alias("top"), T.normal_path(joined).alias("sibling"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, last_day(o_orderdate::DATE) AS month_end, (o_orderdate::DATE + INTERVAL 30 DAY)::DATE AS later, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS days FROM orders")
def scalar_dates(spark, d):
    day = F.to_date("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", F.trunc(day, "month").alias("month"), F.last_day(day).alias("month_end"), F.date_add(day, 30).alias("later"), F.datediff(day, F.lit("1992-01-01").cast("date")).alias("days"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# lookups, listings and changes that no other query reaches


@query(BASE + DEGREES + f" SELECT 'out' AS side, id, kind FROM edges WHERE source_id = {MOST_OUT} UNION ALL SELECT 'in', id, kind FROM edges WHERE target_id = {MOST_OUT}")
def edges_of_node(spark, d):
    """All edges of a node, from the edges stored by node."""
    g = stored(spark, d)
    start = spark.createDataFrame([(seed(g, "fan_out"),)], "node long")
    near = g.adjacency.of(start, "both", None)
    return near.select(F.when(F.col("dir_rank") == 0, "out").otherwise("in").alias("side"), F.col("edge").alias("id"), "kind")


@query(BASE + " SELECT file_id, language FROM files WHERE path = 'src/mod1/brand_1.py'")
def file_by_path(spark, d):
    return graph(spark, d).files.filter("path = 'src/mod1/brand_1.py'").select("file_id", "language")


@query(BASE + " SELECT id, 0.0::DOUBLE AS rank FROM nodes WHERE kind = 'class' AND contains(path, 'mod1') AND exported = 1 ORDER BY id LIMIT 20")
def filter_only_search(spark, d):
    """A query of filters alone: the first by id."""
    rows = graph(spark, d).nodes.withColumn("role", F.lit(None).cast("string"))
    return search.symbol_search(rows, "kind:class path:mod1 exported:true", 20).select("id", "rank")


@query(BASE + " SELECT id FROM edges WHERE source_id NOT IN (SELECT id FROM nodes WHERE file_id % 5 = 0) AND target_id NOT IN (SELECT id FROM nodes WHERE file_id % 5 = 0)")
def clear_edges(spark, d):
    g = graph(spark, d)
    return g.clear_edges(g.files.filter("file_id % 5 = 0")).edges.select("id")


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents")
def line_slices(spark, d):
    """Lines two to four of each whole text."""
    docs = read(spark, d, "documents")
    return docs.select("doc_id", T.lines_between(F.col("text"), F.lit(2), F.lit(4), 100).alias("lines"))


@query("SELECT 'src/' || o_orderkey || '.py' AS path, CASE o_orderkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS status FROM orders")
def diff_names(spark, d):
    """Lines of `git diff --name-status`, made from the orders, read again."""
    key, way = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    path = F.concat(F.lit("src/"), key, F.lit(".py"))
    line = F.when(way == 0, F.concat(F.lit("A\t"), path)).when(way == 1, F.concat(F.lit("D\t"), path)).when(way == 2, F.concat(F.lit("R100\told/"), key, F.lit("\t"), path)).otherwise(F.concat(F.lit("M\t"), path))
    return code_files.name_status(read(spark, d, "orders").select(line.alias("value")))


@query("SELECT 'f' || l_orderkey AS path, l_partkey::INT AS start, (l_partkey + l_linenumber - 1)::INT AS \"end\" FROM lineitem WHERE l_linenumber > 1 UNION ALL SELECT 'f' || l_orderkey, l_partkey::INT, l_partkey::INT FROM lineitem WHERE l_linenumber = 1")
def diff_hunks(spark, d):
    """Unified diffs, made from the line items (a hunk each, with or without a count), read again."""
    n = F.col("l_linenumber")
    head = F.concat(F.lit("@@ -1,2 +"), F.col("l_partkey").cast("string"), F.when(n > 1, F.concat(F.lit(","), n.cast("string"))).otherwise(""), F.lit(" @@ f\n+x\n"))
    diffs = read(spark, d, "lineitem").groupBy(F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("path")).agg(F.array_join(F.array_sort(F.collect_list(head)), "").alias("diff"))
    return code_files.hunks(diffs)


RULES = [analytics.Rule("deny-dependency", f"src/mod{k % 5}/**", f"**/brand_{k}.{x}", severity="warn" if k % 2 else "error") for k in range(1, 26) for x in ("py", "ts")]


@query(
    BASE
    + ", rules AS (SELECT * FROM (VALUES "
    + ", ".join(f"({k}, '{r.severity}', '{r.source.removesuffix('**')}', '{r.target.removeprefix('**')}')" for k, r in enumerate(RULES))
    + ") r(rule, severity, a, b)) SELECT rule, severity, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id JOIN rules ON starts_with(s.path, a) AND (ends_with(t.path, b) OR '/' || t.path = b) GROUP BY 1, 2"
)
def lint_many(spark, d):
    """Violations of fifty rules, each path and edge looked at once."""
    return analytics.lint(stored(spark, d), RULES).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query(BASE + " SELECT name, count(*) AS n, min(id) AS first FROM nodes GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, name LIMIT 25")
def shared_names(spark, d):
    """The names that most symbols share, with the one that a reference by name alone would mean."""
    return graph(spark, d).nodes.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").orderBy(F.desc("n"), "name").limit(25)
