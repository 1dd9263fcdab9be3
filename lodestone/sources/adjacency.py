"""Edges stored by node, for traversals that read the frontier's edges alone."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.storage import read_text, write_text

#: Edges of a folder (hubs have more), folders at most, and nodes of a frontier that are looked for by name.
BUCKET_EDGES, MOST_BUCKETS, FEW = 200_000, 4_096, 1_000
_MARK = "_adjacency.json"
_STORED = "node long, other long, kind string, edge long, side int, bucket int"


@dataclass(frozen=True)
class Adjacency:
    """A folder of edges, each there from both ends (side 0: from its source), in buckets by the node it leaves, sorted by node and edge."""

    spark: SparkSession
    path: str
    buckets: int

    @staticmethod
    def write(edges: DataFrame, path: str) -> Adjacency:
        """Rows are dealt out by ranges of bucket, node and edge, so a hub's edges are runs in files of their own; the mark comes last."""
        spark = edges.sparkSession
        buckets = max(1, min(MOST_BUCKETS, -(-edges.count() // BUCKET_EDGES)))
        sides = [edges.select(F.col(a).alias("node"), F.col(b).alias("other"), "kind", F.col("id").alias("edge"), F.lit(k).alias("side")) for k, (a, b) in enumerate((("source_id", "target_id"), ("target_id", "source_id")))]
        rows = sides[0].unionByName(sides[1]).withColumn("bucket", F.pmod("node", F.lit(buckets)).cast("int"))
        dealt = rows.repartitionByRange("side", "bucket", "node", "edge").sortWithinPartitions("side", "bucket", "node", "edge")
        dealt.write.mode("overwrite").partitionBy("side", "bucket").parquet(f"{path}/rows")
        write_text(spark, f"{path}/{_MARK}", json.dumps({"buckets": buckets}))
        return Adjacency(spark, path, buckets)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Adjacency | None:
        text = read_text(spark, f"{path}/{_MARK}")
        return None if text is None else Adjacency(spark, path, json.loads(text)["buckets"])

    def of(self, frontier: DataFrame, direction: str, kinds: tuple[str, ...] | None) -> DataFrame:
        """frontier (node, ...) joined with its nodes' edges: other, dir_rank, kind, edge. Only their folders are opened; a frontier of a few nodes is sent to the edges, which are not shuffled."""
        sides = {"forward": (0,), "backward": (1,), "both": (0, 1)}[direction]
        rows = self.spark.read.schema(_STORED).parquet(f"{self.path}/rows").filter(F.col("side").isin(*sides))
        if kinds is not None:
            rows = rows.filter(F.col("kind").isin(*kinds))
        ids = [r.node for r in frontier.select("node").distinct().limit(FEW + 1).collect()]
        if len(ids) <= FEW:
            frontier = F.broadcast(frontier) if frontier.limit(10 * FEW + 1).count() <= 10 * FEW else frontier
            rows = rows.filter(F.col("bucket").isin(*{i % self.buckets for i in ids}) & F.col("node").isin(*ids))
        elif self.buckets > 1:
            own = frontier.select(F.pmod("node", F.lit(self.buckets)).alias("b")).distinct().collect()  # at most MOST_BUCKETS
            rows = rows.filter(F.col("bucket").isin(*(int(r.b) for r in own)))
        return frontier.join(rows.select("node", "other", F.col("side").alias("dir_rank"), "kind", "edge"), "node")
