import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import mixing
from lodestone.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_targets(words):
    names = sorted([s for s in words if s is not None]) + [None] * (None in words)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = 1.5 * sum(words.values())
    t = {s: total * weight[s] / sum(weight.values()) for s in names}
    for _ in range(100):
        over = {s: t[s] - 2 * words[s] for s in names if t[s] > 2 * words[s] + 1e-9}
        if not over:
            return t
        for s in over:
            t[s] = 2 * words[s]
        free = [s for s in names if t[s] < 2 * words[s] - 1e-9]
        for s in free:
            t[s] += sum(over.values()) * weight[s] / sum(weight[x] for x in free)
    raise AssertionError


def planned(spark, words, **k):
    rows = spark.createDataFrame([(s, n) for s, n in words.items()] + [(s, 0) for s in words], "source string, size long")
    return {r.source: r for r in mixing.planned_sources(rows, **k).collect()}


def test_targets(spark):
    r = random.Random(1)
    for _ in range(6):
        words = {f"s{k}": r.randrange(0, 1000) for k in range(r.randrange(1, 12))} | {None: 5}
        got, want = planned(spark, words), brute_targets(words)
        assert all(abs(got[s].target - want[s]) < 1e-6 for s in words)
        assert [got[s].source_no for s in sorted(words, key=lambda s: (s is None, s or ""))] == list(range(len(words)))
    words = {"😀": 9, "z": 9, "Z": 9, "ﬀ": 9}  # by code point, not by UTF-16 unit
    assert [s for _, s in sorted((x.source_no, s) for s, x in planned(spark, words).items())] == ["Z", "z", "ﬀ", "😀"]
    assert planned(spark, {}) == {} and planned(spark, {"a": 0})["a"].slots == 0


def test_permutation_and_draws(monkeypatch):
    for size in (1, 2, 3, 17, 1000):
        at = np.arange(size)
        out = mixing.permuted(at, np.full(size, size), np.full(size, 99))
        assert sorted(out.tolist()) == at.tolist()
    monkeypatch.setattr(mixing, "SHARD_CHUNK", 7)
    for slots in (0, 1, 5, 10_000):
        parts = list(mixing.drawn(slots, 20, (3, 4)))
        shard, first, count = (np.concatenate(x) if parts else np.empty(0, int) for x in (zip(*parts) if parts else ((), (), ())))
        assert count.sum() == slots and (count > 0).all() and len(set(shard.tolist())) == len(shard) and set(shard.tolist()) <= set(range(20))
        assert first.tolist() == (np.cumsum(count) - count).tolist()
        assert all(np.array_equal(a, b) for x, y in zip(parts, mixing.drawn(slots, 20, (3, 4)), strict=True) for a, b in zip(x, y, strict=True))
    assert 400 < count.min() and count.max() < 600  # 500 each on the average


def test_prefix_sums(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_BITS", 2)
    r = random.Random(2)
    rows = [(k % 3, at, r.randrange(10)) for k, at in enumerate(r.sample(range(-500, 500), 300))]
    got = {(x.k, x.at): x.before for x in mixing.prefix_sums(spark.createDataFrame(rows, "k int, at long, v long"), ["k"], "at", "v").collect()}
    assert got == {(k, at): sum(v for q, b, v in rows if q == k and b < at) for k, at, _ in rows}


def check(rows, block):
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        x = by.setdefault((r.source_size, r.target), [0, 0])
        x[0] += r.taken
    for (size, target), (taken, _) in by.items():
        assert abs(taken - target) <= 2 * block + 0.01 * size, (size, target, taken)


def test_documents(spark):
    docs = table(spark, SF, "documents")
    rows = mixing.mixed_counts(docs).collect()
    want = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == want and len(rows) == len(want)
    check(rows, mixing.BLOCK_WORDS)
    assert sorted(rows) == sorted(mixing.mixed_counts(docs.repartition(7)).collect())


def test_hard_rows(spark):
    rows = [(k, "w " * (k * 7 % 90), None if k % 5 == 0 else f"s{k % 3}", "x") for k in range(200)]
    rows += [(3, "tie tie", "s1", "x"), (3, "tie tie", "s1", "x"), (500, None, "s0", "x"), (501, "", None, "x"), (502, "long " * 50_000, "s2", "x"), (503, None, "empty", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.mixed_counts(docs, block_words=16).collect()
    assert sorted(out) == sorted(mixing.mixed_counts(docs.orderBy("text").repartition(5), block_words=16).collect())
    assert len(out) == len(rows) and [r.taken for r in out if r.doc_id in (500, 501, 503)] == [0, 0, 0]
    check(out, 16)
    assert mixing.mixed_counts(docs.limit(0)).count() == 0


def test_mixed_texts(spark):
    docs = table(spark, SF, "documents")
    counts = {r.doc_id: r.taken for r in mixing.mixed_counts(docs).collect()}
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    words = dict.fromkeys(counts, 0)
    for r in out.collect():
        assert r.text in text[r.doc_id] and r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    assert words == counts
    assert mixing.passages(" a  b\tc d", 4, [(1, 2), (2, 3)]) == ["b\tc"]


def test_small_sources_meet_their_targets(spark):
    rows, k = [], 0
    for no, words in enumerate([1, 2, 3, 7, 20, 45, 45, 45, 45, 45, 45, 99, 150, 256, 300, 2_000, 30_000]):
        left = words
        while left:
            n = min(left, 1 + (k * 13) % 60)
            rows.append((k, " ".join(f"w{k}x{j}" for j in range(n)), f"s{no:02}"))
            k, left = k + 1, left - n
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source, by = {k: s for k, _, s in rows}, {}
    out = mixing.mixed_counts(docs).collect()
    for r in out:
        assert r.taken <= 2 * r.size
        x = by.setdefault(source[r.doc_id], [r.target, 0])
        x[1] += r.taken
    assert len(by) == 17 and all(abs(taken - target) <= max(1, 0.05 * target) for target, taken in by.values()), by


def test_copies_are_documents_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_BITS", 1)
    rows = [(1, "five words are in here", "s", "x")] * 40 + [(2, "five words are in here", "s", "x")] * 3 + [(None, f"text {k} without id", None, "y") for k in range(30)] + [(3, "other words", "t", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("n_chars", F.lit(1).cast("long")).select("doc_id", "text", "lang", "source", "n_chars")
    out = mixing.mixed_counts(docs, block_words=3).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in out)
    check(out, 3)
    texts = mixing.mixed_texts(docs, block_words=3).collect()
    for i in (1, 2, None, 3):
        assert sum(r.taken for r in out if r.doc_id == i) == sum(len(r.text.split()) for r in texts if r.doc_id == i)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mixed_counts(docs, block_words=3).collect())) == sorted(map(str, out))
