"""What the operators of this subpackage share: tables, the shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: glibc's malloc_trim, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where that is unset (tests, local use) a folder of our own is made and
    set, so that checkpoint() works as well.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(base)
    return base


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Settings for work on long texts: small batches to and from Python and from Parquet, so that neither side holds many texts at once; and shuffle files go when the query that wrote them has ended, not whenever the driver happens to collect its garbage.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: By what a session is marked that has the settings.
_MARK = "spark.lodestone.tuned"


def tuned(df: DataFrame) -> DataFrame:
    """df in a copy of its session that has SETTINGS; the session that it comes from, and other queries in it, see nothing of that."""
    spark = df.sparkSession
    if spark.conf.get(_MARK, None):
        return df
    copy = spark._jsparkSession.cloneSession()
    for key, value in {**SETTINGS, _MARK: "true"}.items():
        copy.conf().set(key, value)
    plan = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy, df._jdf.logicalPlan())
    return DataFrame(plan, SparkSession(spark.sparkContext, copy))


#: Of each thread the folders that were written inside the scratch blocks that are open, innermost last.
_SCRATCH = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside goes at the end: nothing lazy may come out of the block, only what is staged after it."""
    open_ = _SCRATCH.__dict__.setdefault("open", [])
    open_.append([])
    try:
        yield
    finally:
        hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        for path in open_.pop():
            folder = hadoop.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


#: Tables that are written between two times that the driver and the executors give memory back.
RELIEF = 8
_WRITTEN = itertools.count(1)


def relieve(spark: SparkSession) -> None:
    """JVMs give back what ended queries have left: the driver's its heap's garbage, with the broadcasts that only it holds, and native memory that is free; the executors' their heaps' garbage.

    An operator of many small queries (rounds of components) otherwise makes the
    driver's memory follow the queries that it has planned, and not what is needed.
    An executor's heap stays as large as the stages before have made it, beside the
    Python workers of the next. Each executor that is idle gets one task; one that
    gets none keeps its heap until the next time.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    with suppress(Py4JError):  # a JVM that has no such command
        args = array(jvm.Object, 4)
        args[0], args[1], args[2], args[3] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", array(jvm.Object, 0), array(jvm.String, 0)
        invoke = next(m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # without the driver, which is all there is in local mode
    if executors:
        spark.range(0, executors, 1, executors).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def staged(df: DataFrame, name: str, outside: bool = False, group: int | None = None) -> DataFrame:
    """df, written once to the shared folder and read again: cuts the lineage and survives lost executors. outside: it stays when the innermost scratch block ends.

    group: rows of a row group at most, for rows of a megabyte or so. Parquet looks
    at a group's size after a hundred rows only, and readers take hundreds of rows
    of a group at once, so without it memory grows with the rows of a task.
    """
    df = tuned(df)
    path = staging_path(df.sparkSession, name)
    (df.write if group is None else df.write.option("parquet.block.row.count.limit", str(group))).parquet(path)
    if next(_WRITTEN) % RELIEF == 0:
        relieve(df.sparkSession)
    blocks = _SCRATCH.__dict__.get("open", [])[: -1 if outside else None]
    if blocks:
        blocks[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df, staged, with numbers from 0 in the order: a distributed sort, and one count a partition on the driver."""
    rows = staged(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33).cast("int")
    counts = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before = [0]
    for p in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(p, 0))
    base = F.element_at(F.lit(before).cast("array<bigint>"), part + 1)
    return rows.withColumn(name, base + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m")


#: The operator whose tasks this Python worker ran last, and how its caches are emptied.
_AT_WORK: list = [None, None]


def at_work(operator: str, forget: Callable[[], None] | None = None) -> None:
    """To be called where a task of an operator begins: caches that another operator has left in this worker go."""
    last, empty = _AT_WORK
    if last != operator and empty is not None:
        empty()
        give_back()
    _AT_WORK[:] = operator, forget


def give_back() -> None:
    """Gives memory that was freed back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _bytes_at(column: pa.Array) -> np.ndarray:
    """Where each text of the column ends, in bytes from its first."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets[1:] - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], bytes_: int, column: int = 0, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about so many bytes of a text column (a longer text is a slice of its own) and at most so many rows.

    Small batches are joined and large ones cut, so what one step takes is bounded
    whatever the texts' lengths; what a step freed goes back to the system.
    """
    held: list[pa.RecordBatch] = []
    size = count = 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for batch in batches:
        ends = _bytes_at(batch.column(column)) if batch.num_rows else np.empty(0, np.int64)
        at = base = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, base + bytes_ - size, "right"))
            to = max(min(to, at + rows - count), at + (not held))
            if to > at:
                held.append(batch.slice(at, to - at))
                size, count = size + int(ends[to - 1]) - base, count + to - at
                at, base = to, int(ends[to - 1])
            if at < batch.num_rows or size >= bytes_ or count >= rows:
                yield joined()
                held, size, count = [], 0, 0
                give_back()
    if held:
        yield joined()
        held.clear()
        give_back()


def texts_of(column: pa.Array) -> list[str]:
    """The column's texts; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


@contextmanager
def one_blas_thread() -> Iterator[None]:
    """numpy's matrix products in one thread: for many small ones, threads that wait for each other take longer."""
    found = None
    for path in Path(np.__file__).parent.with_name("numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        found = getattr(library, "scipy_openblas_set_num_threads64_", None), getattr(library, "scipy_openblas_get_num_threads64_", None)
    if not found or None in found:
        yield
        return
    put, get = found
    before = get()
    put(1)
    try:
        yield
    finally:
        put(before)
