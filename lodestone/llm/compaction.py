"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as runs of small Parquet files that are never changed. Runs
of one size tier (a tier holds sizes from one power of FAN_IN times the base to the next)
are merged, FAN_IN or more at a time, into a run with files of the target size.
What a reader sees is a manifest: a JSON file with a version, written whole under
another name and then given the next version's name, which only one writer can
bring about: by a rename that does not overwrite, which HDFS and its like do in
one step, or by a hard link on a local file system, whose rename would overwrite.
(A store in which neither is one step needs a lock of its own.) A run that no
manifest names is invisible, so a lost task, a failed job or a lost race leaves
no trace in what is read; vacuum() deletes what the kept versions don't name,
whether an older version named it or none ever did.

All file work goes through Hadoop's file system of the store's path, on the
driver, by names and sizes alone; data is read and written by Spark's tasks.

Defined results: an arrival without rows is committed as a run without files;
rows, nulls and repetitions are kept as they are, columns too, whatever their
names; reading a store without runs needs the schema that the manifest keeps.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
BASE_BYTES = 1 << 20
FAN_IN = 4
KEEP_VERSIONS = 1
#: How long what no manifest names may still be on its way into one.
GRACE_MS = 24 * 3_600_000


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Store:
    """A directory with data/ (runs) and manifest/ (versions)."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, base_bytes: int = BASE_BYTES, fan_in: int = FAN_IN):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.base_bytes, self.fan_in = target_bytes, base_bytes, fan_in
        self._jvm: Any = spark.sparkContext._jvm
        self._none = spark.sparkContext._gateway.new_array(self._jvm.String, 0)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # manifests

    def _name(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:13]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The given version, or the last one: {"version", "schema", "runs": [{"id", "tier", "bytes", "files": [{"path", "bytes"}]}]}."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs.open(self._at(self._name(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, based_on: dict, added: list[dict], removed: set[str] = frozenset(), schema: str | None = None) -> dict:
        """The next version after based_on; Conflict if there is one already, and then nothing is changed."""
        runs = [r for r in based_on["runs"] if r["id"] not in removed] + added
        new = {"version": based_on["version"] + 1, "schema": schema or based_on["schema"], "runs": runs}
        draft = f"{self.path}/manifest/draft-{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(draft), False)
        try:
            stream.write(json.dumps(new).encode())
        finally:
            stream.close()
        if not self._publish(self._at(draft), self._at(self._name(new["version"]))):
            raise Conflict(f"version {new['version']} of {self.path}")
        return new

    def _publish(self, draft, final) -> bool:
        """Gives the draft its final name unless that name is taken; whether it did."""
        jvm = self._jvm
        try:
            if self._fs.getUri().getScheme() == "file":
                places = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), self._none) for p in (final, draft)]
                jvm.java.nio.file.Files.createLink(*places)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                kind = jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(kind, 1)
                options[0] = kind.NONE
                context.rename(draft, final, options)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.toString():
                raise
            return False
        finally:
            self._fs.delete(draft, False)

    # runs

    def tier(self, size: int) -> int:
        """0 below the base size, then one more for each power of FAN_IN."""
        return 0 if size < self.base_bytes else 1 + int(math.log(size / self.base_bytes, self.fan_in) + 1e-9)

    def _run(self, folder: str) -> dict:
        files = []
        if self._fs.exists(self._at(folder)):
            files = sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._at(folder)) if s.getPath().getName().endswith(".parquet"))
        size = sum(n for _, n in files)
        return {"id": folder.removeprefix(f"{self.path}/data/"), "tier": self.tier(size), "bytes": size, "files": [{"path": f"{folder}/{n}", "bytes": b} for n, b in files]}

    def _folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def append(self, rows: DataFrame) -> dict:
        """Commits one arrival as a run."""
        folder = self._folder()
        rows.write.option("compression", "zstd").parquet(folder)
        return self._add(folder, rows)

    def _add(self, folder: str, rows: DataFrame) -> dict:
        """Commits a folder of files as a run, after whatever other writers commit meanwhile."""
        run, schema = self._run(folder), rows.schema.json()
        while True:
            try:
                return self.commit(self.manifest(), [run], schema=schema)
            except Conflict:
                continue

    def append_arrivals(self, rows: DataFrame, arrival: Column) -> int:
        """Commits the arrivals of rows, told apart by the column, in its order: each is a run and a version of its own.

        The files of all of them come from one pass over rows, without a shuffle.
        """
        folder = self._folder()
        name = "_arrival"
        while name in rows.columns:
            name += "_"
        rows.withColumn(name, arrival).write.partitionBy(name).option("compression", "zstd").parquet(folder)
        found = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)) if s.isDirectory() and s.getPath().getName().startswith(name))
        for part in sorted(found, key=lambda p: (len(p), p)):
            self._add(f"{folder}/{part}", rows)
        return len(found)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        manifest = self.manifest(version)
        files = [f["path"] for r in manifest["runs"] for f in r["files"]]
        return self._rows(manifest, files)

    def _rows(self, manifest: dict, files: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"] or '{"type": "struct", "fields": []}'))
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)

    # compaction

    def due(self, manifest: dict) -> list[dict] | None:
        """The runs of the lowest tier that has FAN_IN of them; none if no tier has."""
        tiers: dict[int, list[dict]] = {}
        for r in manifest["runs"]:
            tiers.setdefault(r["tier"], []).append(r)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), None)

    def compact_once(self) -> bool:
        """Merges the runs that are due, if any, and commits; another writer's commit in between is taken over."""
        manifest = self.manifest()
        due = self.due(manifest)
        if due is None:
            return False
        files = [f["path"] for r in due for f in r["files"]]
        folder = self._folder()
        if files:
            wanted = max(1, round(sum(r["bytes"] for r in due) / self.target_bytes))
            self._rows(manifest, files).coalesce(wanted).write.option("compression", "zstd").parquet(folder)
        merged = self._run(folder)
        # a merge always leaves its tier, or runs whose rows shrank would be merged again and again
        merged["tier"] = max(merged["tier"], 1 + max(r["tier"] for r in due))
        removed = {r["id"] for r in due}
        while True:
            now = self.manifest()
            if not removed <= {r["id"] for r in now["runs"]}:
                self._fs.delete(self._at(folder), True)  # merged by another one
                return True
            try:
                self.commit(now, [merged], removed)
                return True
            except Conflict:
                continue

    def compact(self) -> int:
        """Merges until nothing is due; the number of merges."""
        merges = 0
        while self.compact_once():
            merges += 1
        return merges

    def vacuum(self, keep: int = KEEP_VERSIONS, grace_ms: int = GRACE_MS) -> int:
        """Deletes what the last `keep` versions don't need; the number of files deleted. No reader may still use them.

        That is what older versions name, and their manifests, at once; and, where it
        is older than grace_ms, what no version names: runs of failed jobs and lost
        races, and drafts.
        """
        kept = self.versions()[-keep:]
        named = {f["path"] for v in kept for r in self.manifest(v)["runs"] for f in r["files"]}
        gone = 0
        for v in self.versions()[:-keep]:
            for r in self.manifest(v)["runs"]:
                for f in r["files"]:
                    if f["path"] not in named:
                        named.add(f["path"])
                        gone += bool(self._fs.delete(self._at(f["path"]), False))
            self._fs.delete(self._at(self._name(v)), False)
        before = int(time.time() * 1000) - grace_ms
        for s in self._listed(f"{self.path}/manifest"):
            if s.getPath().getName().startswith("draft-") and s.getModificationTime() <= before:
                self._fs.delete(s.getPath(), False)
        # read anew: what was committed since the manifests above is named now
        named |= {f["path"] for v in self.versions() for r in self.manifest(v)["runs"] for f in r["files"]}
        needed = {p[: k] for p in named for k in range(len(p)) if p[k] == "/"}
        for run in self._listed(f"{self.path}/data"):
            path = f"{self.path}/data/{run.getPath().getName()}"
            parts = [(path, run)] if path not in needed else [(f"{path}/{s.getPath().getName()}", s) for s in self._listed(path) if s.isDirectory()]
            for place, status in parts:
                if place not in needed and status.getModificationTime() <= before:
                    gone += sum(s.getPath().getName().endswith(".parquet") for s in self._below(place))
                    self._fs.delete(self._at(place), True)
        return gone

    def _listed(self, folder: str) -> list:
        return list(self._fs.listStatus(self._at(folder))) if self._fs.exists(self._at(folder)) else []

    def _below(self, folder: str) -> Iterator:
        files = self._fs.listFiles(self._at(folder), True)
        while files.hasNext():
            yield files.next()


def compacted(docs: DataFrame, path: str, arrivals: int, arrival: Column, **sizes: int) -> Store:
    """A store to which docs came in so many arrivals, compacted until nothing is due, and vacuumed."""
    store = Store(docs.sparkSession, path, **sizes)
    store.append_arrivals(docs, F.pmod(arrival, F.lit(arrivals)))
    store.compact()
    store.vacuum()
    return store
