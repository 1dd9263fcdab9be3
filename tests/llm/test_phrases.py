"""Phrase collocations against plain Python; the hash, the cuts of texts, hard rows, many parts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import phrases

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, phrase string, f long, id long, block int, stream string"


def brute(rows, least, longest=5, top=2000, absorbed=100):
    """{lang: [(phrase, a, l, r, n, score)]} in order."""
    total, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = {}
    for lang, f in counts.items():
        there = {w: a for w, a in f.items() if a >= least}
        inside = set()
        for w, a in there.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    if 100 * a >= absorbed * f[w[i : i + k]]:
                        inside.add(w[i : i + k])
        best = []
        for w, a in there.items():
            if len(w) > 1 and w not in inside:
                score, k = min((1000 * a * total[lang] // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
                best.append((" ".join(w), a, f[w[:k]], f[w[k:]], total[lang], score))
        best.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        if best:
            out[lang] = best[:top]
    return out


def made(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, 3, "s") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(parts)


def check(df, rows, least, **more):
    got = defaultdict(list)
    out = df.orderBy("lang", "rank").collect()
    for r in out:
        assert r.rank == len(got[r.lang]) + 1 and len(r.phrase.split(" ")) == r.words
        got[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    want = brute(rows, least, **more)
    assert dict(got) == want
    return want


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = ["a", "B", "the", "é", "É", "x\x00y", "\x1c", "of", "To", "long" * 40, "q", "\xa0"]
    texts = []
    for _ in range(300):
        n = r.choice([0, 1, 3, 20, 120])
        texts.append("".join(r.choice(words[: r.choice([3, 6, 12])]) + r.choice([" ", " ", " ", "\t ", ", ", ".\n", "\x0b", "!"]) for _ in range(n)))
    texts += [" now and then we go home again " * 3] * 60 + [None, "", " \t", ".,;:!?\n\r", "a" * 100_000, "new york new york new york"]
    return [(t, r.choice(["en", "en", "en", "fr", "und", None])) for t in texts]


@pytest.mark.parametrize("least", [2, 9])
def test_against_plain_python(spark, rows, least):
    want = check(phrases.collocations(made(spark, rows), least=least), rows, least)
    assert len(want) == 3 and all(len(v) > 5 for v in want.values())


def test_parts_blocks_and_shares(spark, rows, monkeypatch):
    for name, value in {"PART_KEYS": 50, "PART_WORDS": 5, "BLOCK_BYTES": 700, "HELD_KEYS": 20, "KEY_SHARES": 3, "CHUNK_SLOTS": 16, "BUCKETS": 128, "LOAD": 2.0, "FAN": 2, "SHARES": 3}.items():
        monkeypatch.setattr(phrases, name, value)
    check(phrases.collocations(made(spark, rows, 7), least=9, longest=4, top=6), rows, 9, longest=4, top=6)


def test_parameters(spark, rows):
    check(phrases.collocations(made(spark, rows), least=5, absorbed_percent=60), rows, 5, absorbed=60)
    check(phrases.collocations(made(spark, rows), least=5, longest=2), rows, 5, longest=2)


def test_hard_tables(spark):
    for rows in ([], [(None, None), ("", "en")], [("one two three", "en")] * 3):
        assert phrases.collocations(made(spark, rows), least=100).collect() == []
    rows = [("One two", None)] * 100 + [("one TWO", "und")] * 5
    assert [(r.lang, r.phrase, r.a, r.score) for r in phrases.collocations(made(spark, rows), least=100).collect()] == [("und", "one two", 105, 2000)]


def test_products_beyond_64_bits(spark):
    big = 10**15
    df = spark.createDataFrame([(big, big, [big - 1, big], [big - 3, big])], "f long, n long, firsts array<long>, rests array<long>")
    cut = df.select(phrases._least_cut(2).alias("c")).first().c
    assert cut.score == 1000 * big * big // ((big - 1) * (big - 3)) and (cut.cut, cut.l, cut.r) == (1, big - 1, big - 3)


def test_perfect_hash():
    random_ = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 64, 65, 100_000):
        keys = np.unique(random_.integers(-(1 << 62), 1 << 62, n))
        h = phrases.PerfectHash(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
        assert (h.keys[h.slots(keys)] == keys).all()
        other = random_.integers(-(1 << 62), 1 << 62, 1000)
        assert (h.slots(other)[~np.isin(other, keys)] == -1).all()
    bits = sum(64 * len(t) for _, t, _ in h.levels)
    assert bits < 5 * len(keys)


def test_cut_words():
    texts = ["", "One  two.Three", "\n", "x", "", " é\ty;", "z"]
    words, text, breaks = phrases.cut_words(pa.array(["skip me", *texts]).slice(1))
    assert words.to_pylist() == ["one", "two", "three", "x", "é", "y", "z"]
    assert text.tolist() == [1, 1, 1, 3, 5, 5, 6] and breaks.tolist() == [True, False, True, True, True, False, True]


def test_long_text(spark):
    """A text of 20 MB is one block; its windows are counted over all of it."""
    text = F.concat(F.repeat(F.lit("new york is far "), 1_300_000), F.lit("last words"))
    docs = spark.range(2).coalesce(1).select(text.alias("text"), F.lit("en").alias("lang"))
    got = {r.phrase: r for r in phrases.collocations(docs, least=1000, longest=3).collect()}
    assert got["york is far"].a == 2_600_000 and got["far new york"].a == 2 * 1_299_999 and got["new york is"].n == 2 * (4 * 1_300_000 + 2)
