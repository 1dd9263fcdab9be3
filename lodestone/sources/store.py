"""A graph's tables in versioned folders: opened or created, changed in transactions, read while they change."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from lodestone.sources.storage import EDGES, FILES, NODES, RAW_REFS, Graph

TABLES = {"files": FILES, "nodes": NODES, "edges": EDGES, "raw_refs": RAW_REFS}


@dataclass
class Draft:
    """What a transaction will make of the graph and its properties."""

    graph: Graph
    meta: dict[str, str] = field(default_factory=dict)


class GraphStore:
    """Versions of a graph under a path.

    A version is a folder of tables and, last of all, a small file with its
    properties, which is created only if there is none: the version is there with
    that file, or not at all. A reader stays with the version that it opened; a
    transaction that fails, or comes second, changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _mark(self, version: int) -> str:
        return f"{self.path}/versions/{version:09d}.json"

    @property
    def version(self) -> int:
        """The last version; 0 if there is none yet."""
        folder = self._at(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:9]) for n in names if n.endswith(".json") and n[:9].isdigit()), default=0)

    def _marked(self, version: int) -> dict:
        stream = self._fs.open(self._at(self._mark(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def meta(self, version: int | None = None) -> dict[str, str]:
        version = self.version if version is None else version
        return self._marked(version)["meta"] if version else {}

    def open(self, version: int | None = None) -> Graph:
        """The graph of a version; an empty one if there is none."""
        version = self.version if version is None else version
        if not version:
            return Graph(*(self.spark.createDataFrame([], schema) for schema in TABLES.values()))
        marked = self._marked(version)
        read = {name: self.spark.read.parquet(f"{self.path}/tables/{marked['folder']}/{name}") for name in marked["tables"]}
        return Graph(read["files"], read["nodes"], read["edges"], read.get("raw_refs"))

    @contextmanager
    def transaction(self) -> Iterator[Draft]:
        """The last version to be changed; what the draft holds at the end is the next one, unless the block fails or another transaction was first."""
        base = self.version
        draft = Draft(self.open(base), self.meta(base))
        folder = f"{self.path}/tables/{base + 1:09d}-{uuid.uuid4().hex}"
        done = False
        try:
            yield draft
            draft.graph.save(folder)
            tables = [name for name in TABLES if getattr(draft.graph, name) is not None]
            body = json.dumps({"folder": folder.rsplit("/", 1)[1], "tables": tables, "meta": draft.meta})
            try:
                stream = self._fs.create(self._at(self._mark(base + 1)), False)
            except Py4JJavaError as error:
                if "FileAlreadyExists" in error.java_exception.toString():
                    raise RuntimeError(f"version {base + 1} of {self.path} was written by another transaction") from error
                raise
            stream.write(body.encode())
            stream.close()
            done = True
        finally:
            if not done:
                self._fs.delete(self._at(folder), True)
