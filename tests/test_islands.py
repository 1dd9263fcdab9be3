"""Ranges of a key against the SQL of range_islands, with ends that are null and ranges that are there twice."""

import duckdb

from lodestone.operators import ranges
from lodestone.plans import catalog


def test_islands_with_nulls_and_repeats(spark):
    rows = [(1, 5, None), (1, 5, 10), (1, 12, 14), (1, 40, 50), (1, 40, 50), (2, None, None), (2, 7, 9), (None, 1, 2), (None, 1, 2)]
    lines = [(k, a, None if b is None else b - a) for k, a, b in rows]
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?)", lines)
    want = con.execute(catalog.SQL["range_islands"]).fetchall()
    got = ranges.islands(spark.createDataFrame(rows, "k long, a long, b long"), "k", "a", "b").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
