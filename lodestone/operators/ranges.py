"""Ranges, budgets, pages and running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.storage import kept

ISLAND_GAP = 10


def islands(rows: DataFrame, key: str, first: str, last: str, gap: int = ISLAND_GAP) -> DataFrame:
    """(key, first, last, n): ranges of a key that overlap or lie within the gap, as one; an end that is null comes last and reaches nothing."""
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last(first), F.asc_nulls_last(last))
    reached = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.when(F.col(first) <= reached + gap, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.groupBy(key, "_island").agg(F.min(first).alias(first), F.max(last).alias(last), F.count("*").alias("n")).drop("_island")


def within_budget(rows: DataFrame, key: str, order: list, size: str, most: int) -> DataFrame:
    """The rows of a key, in order, up to the first that would go beyond the budget; with the running total.

    Rows are dealt out by ranges of key and order, so a key that most rows have lies
    in many parts: a part adds the sums of those before it to its own running
    total, and a part that begins beyond the budget is not sorted at all.
    """
    parts = kept(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_sum").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = parts.groupBy(F.col(key).alias("_key"), "_part").agg(F.sum(size).alias("_sum"))
    # sizes are not negative, so once beyond, always beyond
    begins = sums.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") <= most).select("_key", F.col("_part").alias("_of"), "_before")
    own = parts.join(begins, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    running = F.col("_before") + F.sum(size).over(Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("running", running).filter(F.col("running") <= most).select(*rows.columns, "running")


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of rows in an order that must be total."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(rows: DataFrame, size: int) -> DataFrame:
    """(total, pages): the rows, and the pages of that size that they fill."""
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


#: Lines of a bin, and bins that a range spans at most.
BIN, MOST_BINS = 64, 1_024


def overlapping(rows: DataFrame, hunks: DataFrame, key: str = "path") -> DataFrame:
    """rows (start_line, end_line) that a hunk (start, end) of the same key touches, each once.

    Ranges are spread over bins of lines and meet by key and bin, so a file with many
    rows and hunks isn't a product of both; bins are as wide as the longest
    range asks for.
    """
    longest = [r.n or 0 for r in (rows.agg(F.max(F.col("end_line") - F.col("start_line")).alias("n")).first(), hunks.agg(F.max(F.col("end") - F.col("start")).alias("n")).first())]
    width = max(BIN, -(-(max(longest) + 1) // MOST_BINS))

    def spread(df: DataFrame, first: str, last: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))
        return df.filter(F.col(first) <= F.col(last)).withColumn("_bin", F.explode(bins))

    asked = spread(hunks.select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end")), "_start", "_end").withColumnRenamed("_bin", "_at")
    touched = spread(rows, "start_line", "end_line").join(asked, (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_at")) & (F.col("start_line") <= F.col("_end")) & (F.col("end_line") >= F.col("_start")), "left_semi")
    return touched.select(*rows.columns).distinct()


def by_prefix(rows: DataFrame, column: str, targets: DataFrame, target: str, id_col: str) -> DataFrame:
    """rows with the least id of the targets whose path is the column's value or begins with it.

    A target can only be met by one of its own prefixes, so each target is joined
    by the prefixes whose lengths occur among the values: an equality join.
    """
    values = rows.select(F.col(column).alias("_v")).filter("_v IS NOT NULL").distinct()
    lengths = [r.n for r in values.select(F.length("_v").alias("n")).distinct().collect()]  # at most as many as a path is long
    if not lengths:
        return rows.withColumn(id_col, F.lit(None).cast("long"))
    spread = targets.select(F.col(id_col), F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substring(F.col(target), F.lit(1), n)))).alias("_v"))
    first = spread.groupBy("_v").agg(F.min(id_col).alias(id_col)).join(values, "_v", "left_semi")
    return rows.join(first, F.col(column) == F.col("_v"), "left").drop("_v")
