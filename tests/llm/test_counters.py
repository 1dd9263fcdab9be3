"""What is shuffled of hashed counters goes by what is counted, not by the counters of each task and pass."""

import numpy as np
import pytest

from lodestone.llm import phrases


@pytest.mark.parametrize("share", [0.001, 0.01, 0.1])
def test_rows_of_sparse_counters_are_small(share):
    r = np.random.default_rng(4)
    slots = phrases.CHUNK_SLOTS
    counts = np.where(r.random(slots) < share, r.integers(1, 300, slots), 0)
    row = phrases._counts_row(3, 5, counts)
    assert len(row["counts"][0].as_py()) < 5 * np.count_nonzero(counts) + 200
    assert (phrases._counts_of(*(row[c][0].as_py() for c in ("width", "slots", "counts"))) == counts).all()


def test_counts_are_summed_exactly_and_buckets_to_the_least_count(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKETS", 64)
    streams = [np.array([1, 2, 1, 2, -1, 3, 4] * n, np.int32).tobytes() for n in (300, 1, 90, 9)]
    level = spark.createDataFrame([(s,) for s in streams], "stream binary").repartition(4)
    bits = np.unpackbits(phrases.frequent_buckets(level, 400, 1, 0))
    keys = np.array([1 << 32 | 2, 2 << 32 | 1, 3 << 32 | 4, 5 << 32 | 6], np.int64)
    at = phrases._bucket(keys, 1, 64)[1]
    want = np.bincount(at, [800, 400, 400, 0], 64) >= 400
    assert (bits == want).all()
