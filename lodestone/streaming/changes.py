"""Change streams: filtered file events, debounced into one batch a quiet gap."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.text import language_of


def relevant(changes: DataFrame, ignored: tuple[str, ...] = ("node_modules", ".git", "dist")) -> DataFrame:
    """Changes (path) of files in a known language outside ignored directories."""
    inside = F.lit(False)
    for name in ignored:
        inside = inside | F.array_contains(F.split("path", "/"), name)
    return changes.filter(language_of(F.col("path")).isNotNull() & ~inside)


def debounced(events: DataFrame, gap: str, key: str, item: str, time: str = "ts") -> DataFrame:
    """(key, start, last_end, n, items): events of a key that follow one another within the gap, as one session."""
    window = F.session_window(time, gap)
    grouped = events.groupBy(key, window.alias("w")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(item)).alias("items"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "items")


def debounce_stream(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, gap: str = "2 seconds", late: str = "10 minutes", key: str = "user_id", item: str = "event_type") -> StreamingQuery:
    """The same over a stream of Parquet files, written as Parquet; ends when all that is there is read."""
    events = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = debounced(events, gap, key, item)
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def threshold_alerts(events: DataFrame, key: str, value: str, limits: tuple[float, ...], time: str = "ts", tie: str = "event_id") -> DataFrame:
    """(key, limit, time, running): the event with which a key's running sum first reaches each limit."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    running = events.select(key, time, tie, F.sum(F.col(value).cast("decimal(18,2)")).over(order).alias("running"))
    spread = running.withColumn("limit", F.explode(F.array(*map(F.lit, limits)))).filter(F.col("running") >= F.col("limit"))
    first = spread.groupBy(key, "limit").agg(F.min(F.struct(time, tie, "running")).alias("f"))
    return first.select(key, "limit", F.col(f"f.{time}").alias(time), F.col("f.running").cast("double").alias("running"))


def file_changes(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (path, size, mtime) of files that are new under root, of known languages; without their contents."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    return relevant(found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")))


def alert_stream(events: DataFrame, key: str, value: str, limits: tuple[float, ...], history: int = 100, time: str = "ts") -> DataFrame:
    """(key, limit, time, running) of a stream: the event with which a key's running sum first reaches each limit.

    A key's state is its sum, the limits that it has reached and the times of its
    last `history` events, so it does not grow with the stream. Events of one
    micro-batch are taken in order of their time.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = events.schema[key].dataType.simpleString()
    ordered = tuple(sorted(limits))

    def step(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, reached, last = state.get if state.exists else (0.0, 0, [])
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        found = []
        for at, x in zip(rows[time], rows[value].fillna(0), strict=True):
            total = round(total + float(x), 2)
            last = [*last, int(at.value // 1_000_000)][-history:]
            while reached < len(ordered) and total >= ordered[reached]:
                found.append((group[0], ordered[reached], at, total))
                reached += 1
        state.update((total, reached, last))
        yield pd.DataFrame(found, columns=[key, "limit", time, "running"])

    out, kept = f"{key} {kind}, limit double, {time} timestamp, running double", "total double, reached int, last array<long>"
    return events.select(key, time, value).groupBy(key).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)
