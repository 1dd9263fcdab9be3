"""Tables of large rows have small row groups, so that neither writers nor readers hold a task's rows at once."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestone.llm import common, phrases


def test_row_groups_of_staged_rows_are_bounded(spark):
    df = spark.range(0, 61, 1, 2).withColumn("stream", F.expr("cast(repeat('x', 5000) as binary)"))
    out = common.staged(df, "groups", group=phrases.GROUP)
    assert out.count() == 61
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in out.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == 61 and max(groups) <= phrases.GROUP


def test_blocks_are_staged_in_such_groups(spark, monkeypatch):
    asked = []

    def staged(df, name, outside=False, group=None, plain=common.staged):
        asked.append((name, group))
        return plain(df, name, outside, group)

    monkeypatch.setattr(phrases, "staged", staged)
    docs = spark.createDataFrame([("a b a b a b", "en")] * 3, "text string, lang string")
    assert phrases.collocations(docs, least=2).count() > 0
    assert {g for n, g in asked if n in ("phrases-blocks", "phrases-level", "phrases-candidates")} == {phrases.GROUP}
