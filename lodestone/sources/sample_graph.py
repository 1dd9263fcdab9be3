"""A code graph derived from the TPC-H-like tables, in Spark and in DuckDB's SQL.

One file per brand, one node per part, and an edge from a part to the next one of
the same order among its returned lines of 25 pieces or more; imports in the same
way among accepted lines, between files only. An edge's id grows with (source,
target, kind), so it orders ties as a row number would, without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Graph

KINDS = {"STANDARD": "function", "ECONOMY": "function", "SMALL": "function", "MEDIUM": "class", "PROMO": "method", "LARGE": "interface"}
EXTENSIONS = ("ts", "py", "c", "sh")
NAMES = ("typescript", "python", "c", "shell")

#: The tables that the graph is made from.
TABLES = ("part", "lineitem")


def _files(part: DataFrame) -> DataFrame:
    n = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("long")
    path = F.when(n % 5 == 0, F.concat(F.lit("src/__tests__/brand_"), n, F.lit(".test.ts"))).otherwise(
        F.concat(F.lit("src/mod"), n % 3, F.lit("/brand_"), n, F.lit("."), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (n % 4 + 1).cast("int")))
    )
    language = F.when(n % 5 == 0, F.lit("typescript")).otherwise(F.element_at(F.array(*map(F.lit, NAMES)), (n % 4 + 1).cast("int")))
    return part.select(n.alias("file_id"), path.alias("path"), language.alias("language")).distinct()


def _nodes(part: DataFrame, files: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    n = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("long")
    start = (F.col("p_partkey") % 500) * 10 + 1
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    nodes = part.select(
        F.col("p_partkey").alias("id"),
        n.alias("file_id"),
        name.alias("name"),
        kinds[F.col("p_type")].alias("kind"),
        start.alias("start_line"),
        (start + F.col("p_size") * 3).alias("end_line"),
        F.col("p_type").alias("signature"),
        (F.col("p_partkey") % 2).cast("int").alias("exported"),
    )
    # a file for each brand: few, and their number doesn't grow with the parts
    return nodes.join(F.broadcast(files.select("file_id", "path")), "file_id").withColumn("qualified_name", F.concat("path", F.lit("::"), "name", F.lit("_"), "id"))


def _pairs(lines: DataFrame) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    following = lines.select(F.col("l_partkey").alias("source_id"), F.lead("l_partkey").over(order).alias("target_id"))
    return following.filter("target_id IS NOT NULL AND source_id != target_id").distinct()


def _edge_id() -> F.Column:
    return (F.col("source_id") * (1 << 24) + F.col("target_id")) * 2 + (F.col("kind") == "imports").cast("long")


def load(spark: SparkSession, sf_dir: str, dense: bool = False) -> Graph:
    """Nodes have their path; edges of kinds calls and imports."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    files = _files(part)
    nodes = _nodes(part, files)
    returned = lines.filter("l_returnflag = 'R'")
    calls = _pairs(returned if dense else returned.filter("l_quantity >= 25")).withColumn("kind", F.lit("calls"))
    place = part.select("p_partkey", F.regexp_extract("p_brand", r"#(\d+)", 1).cast("long"))
    imports = _pairs(lines.filter("l_returnflag = 'A' AND l_quantity >= 25"))
    imports = imports.join(place.toDF("source_id", "source_file"), "source_id").join(place.toDF("target_id", "target_file"), "target_id").filter("source_file != target_file").select("source_id", "target_id", F.lit("imports").alias("kind"))
    edges = calls.unionByName(imports).select(_edge_id().alias("id"), "source_id", "target_id", "kind")
    return Graph(files, nodes, edges)


def _pairs_sql(condition: str) -> str:
    lead = f"SELECT l_partkey AS source_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target_id FROM lineitem WHERE {condition}"
    return f"SELECT DISTINCT source_id, target_id FROM ({lead}) WHERE target_id IS NOT NULL AND source_id <> target_id"


def sql(dense: bool = False) -> str:
    """files, nodes, calls and edges as common table expressions, after WITH RECURSIVE."""
    number = "CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS BIGINT)"
    pick = lambda values: "CASE n % 4 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"
    kinds = "CASE p_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
    calls = _pairs_sql("l_returnflag = 'R'" + ("" if dense else " AND l_quantity >= 25"))
    imports = _pairs_sql("l_returnflag = 'A' AND l_quantity >= 25")
    return f"""WITH RECURSIVE files AS (
  SELECT DISTINCT n AS file_id,
    CASE WHEN n % 5 = 0 THEN 'src/__tests__/brand_' || n || '.test.ts' ELSE 'src/mod' || (n % 3) || '/brand_' || n || '.' || {pick(EXTENSIONS)} END AS path,
    CASE WHEN n % 5 = 0 THEN 'typescript' ELSE {pick(NAMES)} END AS language
  FROM (SELECT {number} AS n FROM part)),
nodes AS (
  SELECT p_partkey AS id, f.file_id, replace(p_name, ' ', '_') AS name, {kinds} AS kind, (p_partkey % 500) * 10 + 1 AS start_line,
    (p_partkey % 500) * 10 + 1 + p_size * 3 AS end_line, p_type AS signature, CAST(p_partkey % 2 AS INT) AS exported, f.path AS path,
    f.path || '::' || replace(p_name, ' ', '_') || '_' || p_partkey AS qualified_name
  FROM part JOIN files f ON f.file_id = {number}),
calls AS ({calls}),
edges AS (
  SELECT (source_id * 16777216 + target_id) * 2 AS id, source_id, target_id, 'calls' AS kind FROM calls
  UNION ALL
  SELECT (source_id * 16777216 + target_id) * 2 + 1, source_id, target_id, 'imports'
  FROM ({imports}) p JOIN nodes s ON s.id = source_id JOIN nodes t ON t.id = target_id WHERE s.file_id <> t.file_id)"""
