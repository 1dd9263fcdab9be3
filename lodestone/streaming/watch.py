"""A source tree that is watched: what comes, changes and goes is taken into the graph, version by version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans import engine
from lodestone.plans.cache import OneAtATime
from lodestone.sources import code_files
from lodestone.sources.storage import kept
from lodestone.sources.store import GraphStore


def listing_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) between two listings (path, size, mtime): new, changed or deleted."""
    old = before.select("path", F.struct("size", "mtime").alias("old"))
    both = now.select("path", F.struct("size", "mtime").alias("now")).join(old, "path", "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("old") != F.col("now"), "changed")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


class Watch:
    """A code base that follows its tree.

    A tick lists the tree, in tasks, and holds the listing against that of the last
    version. Changes wait until a tick finds nothing more; then what changed is
    parsed again, and the graph goes to the store as its next version, in one
    transaction, with the listing's changes told to `heard`. A tick that fails
    changes nothing, and the next one finds the same changes.
    """

    def __init__(self, spark: SparkSession, root: str, store: GraphStore, config: engine.Config | None = None, heard: Callable[[engine.CodeBase, DataFrame], None] | None = None):
        self.spark, self.root, self.store, self.config, self.heard = spark, root, store, config or engine.Config(), heard
        self.code: engine.CodeBase | None = None
        self._before: DataFrame | None = None
        self._waiting: DataFrame | None = None
        self._guard = OneAtATime(self._tick)

    def _listed(self) -> DataFrame:
        tree = code_files.listing(self.spark, self.root, self.config.ignore)
        return kept(tree.files.filter(~code_files.ignored(F.col("path"), code_files.ignore_rules(tree.ignore_files))))

    def _tick(self) -> None:
        now = self._listed()
        before = self._before if self._before is not None else now.limit(0)
        changes = listing_changes(before, now)
        if not changes.limit(1).count() and self.code is not None:
            self._waiting = None
            return
        if self.code is not None and (self._waiting is None or listing_changes(self._waiting, now).limit(1).count()):
            self._waiting = now  # more may come
            return
        found = engine.sources_of(self.spark, self.root, self.config)
        code = engine.index_files(found) if self.code is None else engine.refresh(self.code, found).code
        with self.store.transaction() as draft:
            draft.graph = code.graph
            draft.meta["root"] = self.root
        self.code, self._before, self._waiting = code, now, None
        if self.heard is not None:
            self.heard(code, kept(changes))

    def tick(self) -> bool:
        """Looks at the tree now; False if a look is under way, which is then repeated."""
        return self._guard.ask()

    def start(self, seconds: float = 2.0) -> StreamingQuery:
        """Ticks for as long as the query runs: a stream of moments, each of which is a look at the tree."""
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return clock.writeStream.foreachBatch(lambda _, __: self.tick()).trigger(processingTime=f"{seconds} seconds").start()
