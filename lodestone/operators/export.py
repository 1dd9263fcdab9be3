"""Graphs as DOT and HTML, tables as CSV and back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import identifier
from lodestone.operators import traversal
from lodestone.sources.storage import Graph

MOST = 200
TRANSACTIONS = "id string, date date, type string, amount double, category string, description string, tags string, _bad string"


def gathered(graph: Graph, symbol: str | None = None, depth: int = 4, most: int = 100) -> Graph:
    """The part to export: the neighbourhood of the first symbol of that name, else the first nodes by id; edges between them."""
    if symbol is not None:
        first = graph.nodes.filter(F.col("name") == symbol).orderBy("id").first()
        ids = traversal.traverse(graph.ways, first.id, depth, most, "both", None).nodes.select(F.col("node").alias("id")) if first else graph.nodes.limit(0).select("id")
    else:
        ids = graph.nodes.orderBy("id").limit(MOST).select("id")
    nodes = graph.nodes.join(ids, "id", "left_semi")
    edges = graph.edges.join(ids.toDF("source_id"), "source_id", "left_semi").join(ids.toDF("target_id"), "target_id", "left_semi")
    return Graph(graph.files.join(nodes.select("path"), "path", "left_semi"), nodes, edges)


def dot(part: Graph) -> DataFrame:
    """(k, line): DOT lines in order; a cluster per file, in the order of their first nodes. part is bounded by gathered()."""
    shape = F.when(F.col("kind") == "class", "box3d").when(F.col("kind") == "interface", "diamond").when(F.col("kind") == "route", "hexagon").otherwise("box")
    label = F.concat(F.lit('    "'), identifier(F.col("qualified_name")), F.lit('" [label="'), F.col("name"), F.lit('", shape='), shape, F.lit("];"))
    clusters = part.nodes.groupBy("path").agg(F.min("id").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", label.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    order = Window.orderBy("first")
    body = F.concat(F.lit("  subgraph cluster_"), F.row_number().over(order) - 1, F.lit(' {\n    label="'), F.col("path"), F.lit('";\n'), F.col("body"), F.lit("\n  }"))
    names = part.nodes.select("id", identifier(F.col("qualified_name")).alias("n"))
    ends = part.edges.join(names.toDF("source_id", "s"), "source_id").join(names.toDF("target_id", "t"), "target_id")
    dashed = F.when(F.col("kind") == "imports", F.lit(" [style=dashed]")).otherwise(F.lit(""))
    arrows = ends.select((F.lit(1 << 40) + F.col("id")).alias("k"), F.concat(F.lit('  "'), "s", F.lit('" -> "'), "t", F.lit('"'), dashed, F.lit(";")).alias("line"))
    return clusters.select(F.col("first").alias("k"), body.alias("line")).unionByName(arrows)


def dot_text(part: Graph) -> str:
    lines = [r.line for r in dot(part).orderBy("k").collect()]
    return "\n".join(["digraph G {", "  rankdir=LR;", *lines, "}"])


def html(part: Graph, title: str = "graph") -> str:
    """A page with the nodes and edges as JSON, drawn on a circle."""
    nodes = [r.asDict() for r in part.nodes.select("id", "name", "kind", "path").orderBy("id").collect()]
    edges = [r.asDict() for r in part.edges.select("source_id", "target_id", "kind").orderBy("id").collect()]
    data = json.dumps({"nodes": nodes, "edges": edges}).replace("</", "<\\/")
    script = (
        "const g=JSON.parse(document.getElementById('data').textContent),s=document.getElementById('s'),p={},n=g.nodes.length;"
        "g.nodes.forEach((v,i)=>p[v.id]=[400+350*Math.cos(6.2832*i/n),400+350*Math.sin(6.2832*i/n)]);"
        "const add=(t,a,x)=>{const e=document.createElementNS('http://www.w3.org/2000/svg',t);for(const k in a)e.setAttribute(k,a[k]);if(x)e.textContent=x;s.append(e)};"
        "g.edges.forEach(e=>add('line',{x1:p[e.source_id][0],y1:p[e.source_id][1],x2:p[e.target_id][0],y2:p[e.target_id][1],stroke:'#999'}));"
        "g.nodes.forEach(v=>add('text',{x:p[v.id][0],y:p[v.id][1],'font-size':9},v.name));"
    )
    return f"<!doctype html><title>{title}</title><script id=data type=application/json>{data}</script><svg id=s width=800 height=800></svg><script>{script}</script>"


def json_line(rows: DataFrame) -> Column:
    """Each row's columns as one line of JSON; columns that are null are left out."""
    return F.to_json(F.struct(*rows.columns))


def json_text(rows: DataFrame, pretty: bool = False, most: int = 1_000) -> str:
    """At most so many rows as a JSON array, compact or indented; lines of all rows are written as text by json_line."""
    found = [json.loads(r.line) for r in rows.limit(most).select(json_line(rows).alias("line")).collect()]
    return json.dumps(found, indent=2 if pretty else None)


def write_transactions(rows: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled and tags joined by semicolons."""
    rows.withColumn("tags", F.array_join("tags", ";")).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_transactions(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors (line, reason)) of such files; a line that can't be read or has a wrong type or amount is an error."""
    raw = spark.read.schema(TRANSACTIONS).option("header", True).option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    reason = (
        F.when(F.col("_bad").isNotNull(), "malformed")
        .when(~F.col("type").isin("income", "expense", "transfer") | F.col("type").isNull(), "type")
        .when(F.col("amount").isNull() | (F.col("amount") <= 0), "amount")
    )
    judged = raw.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").drop("reason", "_bad").withColumn("tags", F.split("tags", ";"))
    return good, judged.filter("reason IS NOT NULL").select(F.coalesce("_bad", "id").alias("line"), "reason")
