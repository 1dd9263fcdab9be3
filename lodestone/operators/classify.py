"""Degrees, roles, dead code and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import half_up, is_test_path

BUCKETS = ("0", "1-3", "4-7", "8-15", "16+")


def calls_of(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'calls'").select("source_id", "target_id")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with fan_in and fan_out over calls, zero where there are none."""
    calls = calls_of(edges)
    into = calls.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"))
    out = calls.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("fan_out"))
    return nodes.join(into, "id", "left").join(out, "id", "left").fillna(0, ["fan_in", "fan_out"])


def not_bridging(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id) of candidates with a caller that calls one of their callees itself."""
    calls = calls_of(edges)
    into = candidates.select("id").join(calls.select(F.col("target_id").alias("id"), F.col("source_id").alias("a")), "id")
    wedge = into.join(calls.select(F.col("source_id").alias("id"), F.col("target_id").alias("b")), "id")
    return wedge.join(calls.toDF("a", "b"), ["a", "b"], "left_semi").select("id").distinct()


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): two callers and two callees or more, and no shortcut past the node."""
    candidates = degrees(nodes.select("id"), edges).filter("fan_in >= 2 AND fan_out >= 2")
    return candidates.select("id").join(not_bridging(edges, candidates), "id", "left_anti")


def roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with fan_in, fan_out and role.

    Hubs are told before bridges, so only nodes with two callers or two callees are
    looked at for shortcuts: their wedges are at most twice their other degree.
    """
    d = degrees(nodes, edges)
    open_ = d.filter("fan_in >= 2 AND fan_out >= 2 AND NOT (fan_in >= 3 AND fan_out >= 3)")
    bridging = open_.select("id").join(not_bridging(edges, open_), "id", "left_anti").withColumn("bridging", F.lit(True))
    role = (
        F.when(is_test_path(F.col("path")), "test")
        .when(F.expr("fan_in = 0 AND exported = 0 AND fan_out = 0"), "dead")
        .when(F.expr("fan_in = 0 AND exported = 1"), "entry")
        .when(F.expr("fan_in >= 3 AND fan_out >= 3"), "hub")
        .when(F.coalesce("bridging", F.lit(False)), "bridge")
        .when(F.expr("fan_in >= 3"), "core")
        .when(F.expr("fan_out > 0 AND fan_in = 0"), "leaf")
        .otherwise("utility")
    )
    return d.join(bridging, "id", "left").withColumn("role", role).drop("bridging")


def fan_bucket(x: F.Column) -> F.Column:
    return F.when(x == 0, "0").when(x <= 3, "1-3").when(x <= 7, "4-7").when(x <= 15, "8-15").otherwise("16+")


def fan_out_histogram(degree: DataFrame) -> DataFrame:
    """(bucket, n), each bucket there."""
    spine = degree.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    counts = degree.groupBy(fan_bucket(F.col("fan_out")).alias("bucket")).agg(F.count("*").alias("n"))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def average_fan(degree: DataFrame) -> DataFrame:
    n = F.greatest(F.count("*"), F.lit(1))
    return degree.agg(half_up(F.sum("fan_in") / n, 2).alias("avg_in"), half_up(F.sum("fan_out") / n, 2).alias("avg_out"))


def most_fan(degree: DataFrame) -> DataFrame:
    """(side, id, n): the node with the largest degree on each side, the lowest id of those; none if all are zero."""
    out = []
    for side in ("fan_in", "fan_out"):
        top = degree.filter(f"{side} > 0").agg(F.max(F.struct(F.col(side).alias("n"), (-F.col("id")).alias("m"))).alias("top")).filter("top IS NOT NULL")
        out.append(top.select(F.lit(side).alias("side"), (-F.col("top.m")).alias("id"), F.col("top.n").alias("n")))
    return out[0].unionByName(out[1])


def dead_code(classified: DataFrame, kind: str | None = None, path: str | None = None) -> DataFrame:
    dead = classified.filter("role = 'dead'")
    if kind:
        dead = dead.filter(F.col("kind") == kind)
    return dead.filter(F.col("path").contains(path)) if path else dead


def dead_totals(dead: DataFrame) -> DataFrame:
    """(by, key, n): dead symbols in all, by kind and by file."""
    one = lambda by, key: dead.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(by).alias("by"), "key", "n")
    total = dead.agg(F.count("*").alias("n")).select(F.lit("total").alias("by"), F.lit("").alias("key"), "n")
    return total.unionByName(one("kind", F.col("kind"))).unionByName(one("file", F.col("path")))


def two_cycles(edges: DataFrame, kind: str = "calls") -> DataFrame:
    """(a, b) with a < b that lead to each other."""
    e = edges.filter(F.col("kind") == kind).select("source_id", "target_id")
    back = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return e.filter("source_id < target_id").join(back, ["source_id", "target_id"]).toDF("a", "b")


def three_cycles(edges: DataFrame, kind: str = "calls") -> DataFrame:
    """(a, b, c) with a -> b -> c -> a and a the least of them."""
    e = edges.filter(F.col("kind") == kind).select("source_id", "target_id")
    paths = e.toDF("a", "b").filter("a < b").join(e.toDF("b", "c"), "b").filter("a < c")
    return paths.join(e.toDF("c", "a"), ["c", "a"]).select("a", "b", "c")
