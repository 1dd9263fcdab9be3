"""Tables of a code graph: schemas, results kept between steps, and changes by joins."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from lodestone.sources.adjacency import Adjacency

FILES = "file_id long, path string, hash string, language string, size long, mtime double, indexed_at long"
NODES = "id long, file_id long, name string, qualified_name string, kind string, start_line int, end_line int, signature string, doc string, exported int, role string"
EDGES = "id long, source_id long, target_id long, kind string"
RAW_REFS = "id long, file_id long, kind string, source_qname string, target_name string, target_module string, receiver string, line int"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: the lineage of loops ends here."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, through Spark's file systems; one that is there is replaced."""
    place, fs = _place(spark, path)
    stream = fs.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that must not be there yet."""
    place, fs = _place(spark, path)
    stream = fs.create(place, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no folder."""
    place, fs = _place(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def source_identity(df: DataFrame) -> str:
    """What tells rows from others: the paths, sizes and times of the files they are read from, of which footers alone are read; for rows from elsewhere all their values."""
    try:
        files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
        r = files.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("p", "s", "t")), F.lit(0)).alias("x")).first()
    except AnalysisException:
        r = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64(F.lit(1), *df.columns).cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
        return f"{r.n}-{r.x & (1 << 64) - 1:016x}-{int(r.s) & (1 << 64) - 1:016x}"
    return f"{r.n}-{r.x & (1 << 64) - 1:016x}"


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    place, fs = _place(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


@dataclass(frozen=True)
class Graph:
    """The tables of one code base; each change gives a new value."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    raw_refs: DataFrame | None = None
    adjacency: Adjacency | None = None  # of these edges, where it is stored

    @property
    def ways(self) -> DataFrame | Adjacency:
        """The edges as traversals take them: stored by node if they are, else as a table."""
        return self.edges if self.adjacency is None else self.adjacency

    def save(self, path: str) -> None:
        for name in ("files", "nodes", "edges", "raw_refs"):
            if (df := getattr(self, name)) is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, raw_refs: bool = False) -> Graph:
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        return Graph(read("files", FILES), read("nodes", NODES), read("edges", EDGES), read("raw_refs", RAW_REFS) if raw_refs else None)

    def without_files(self, gone: DataFrame) -> Graph:
        """Without the given file_ids, their nodes, raw references and the edges at either end."""
        ids = gone.select("file_id")
        lost = self.nodes.join(ids, "file_id", "left_semi").select(F.col("id").alias("lost"))
        edges = self.edges.join(lost, F.col("source_id") == F.col("lost"), "left_anti").join(lost, F.col("target_id") == F.col("lost"), "left_anti")
        refs = self.raw_refs.join(ids, "file_id", "left_anti") if self.raw_refs is not None else None
        return Graph(self.files.join(ids, "file_id", "left_anti"), self.nodes.join(ids, "file_id", "left_anti"), edges, refs)

    def keep_only(self, known_paths: DataFrame) -> tuple[Graph, DataFrame]:
        """The graph of the known paths, and the files that went."""
        stale = self.files.join(known_paths.select("path"), "path", "left_anti")
        return self.without_files(stale), stale

    def clear_edges(self, file_ids: DataFrame | None = None) -> Graph:
        """Without the edges that touch the files (all edges if none are given; no file, no change)."""
        if file_ids is None:
            return replace(self, adjacency=None, edges=self.edges.limit(0))
        touched = self.nodes.join(file_ids.select("file_id"), "file_id", "left_semi").select(F.col("id").alias("t"))
        return replace(self, adjacency=None, edges=self.edges.join(touched, F.col("source_id") == F.col("t"), "left_anti").join(touched, F.col("target_id") == F.col("t"), "left_anti"))


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """Of nodes with one (file_id, qualified_name) the one with the highest id."""
    order = Window.partitionBy("file_id", "qualified_name").orderBy(F.desc("id"))
    return nodes.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Of edges with one (source, target, kind) the one with the lowest id."""
    return edges.groupBy("source_id", "target_id", "kind").agg(F.min("id").alias("id")).select("id", "source_id", "target_id", "kind")


def upsert_files(stored: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """(path, change) of incoming files (path, hash): inserted, updated or unchanged; stored ones that didn't come are not listed."""
    old = stored.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("there"))
    same = F.lit(False) if force else F.col("hash").eqNullSafe(F.col("old_hash"))
    change = F.when(F.col("there").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return incoming.join(old, "path", "left").select("path", change.alias("change"))


def change_tiers(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, tier) of a new listing: skipped if mtime and size agree, unchanged if the hash does, else parsed."""
    old = stored.select("path", *(F.col(c).alias(f"old_{c}") for c in ("hash", "size", "mtime")), F.lit(True).alias("there"))
    skip = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    tier = F.when(F.col("there").isNull(), "parsed").when(F.coalesce(skip, F.lit(False)), "skipped").when(F.col("hash") == F.col("old_hash"), "unchanged").otherwise("parsed")
    return listing.join(old, "path", "left").select("path", tier.alias("tier"))


def recent_payloads(payloads: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Stored payloads that are no older than the retention."""
    return payloads.filter(F.col("timestamp") >= now_ms - days * 86_400_000)
