"""Quality rules against plain Python: suffixes sorted as lists, repeats found by their windows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, kept int, _id long, _text int"


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def inside(size):
        c = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
        return len({j for i in range(len(w) - size + 1) if c[tuple(w[i : i + size])] > 1 for j in range(i, i + size)})

    longest = 0
    for i in range(len(w)):
        for j in range(i):
            k = 0
            while i + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            longest = max(longest, k)
    longest = longest if longest >= q.LEAST_REPEAT else 0
    n, covered, repeat = len(w), inside(q.LEAST_REPEAT), inside(3)
    failed = n < 50 or 100 * repeat > 50 * n
    kept = not failed and 100 * covered <= 30 * n and 100 * longest <= 20 * n
    return n, sum(map(len, w)), len(re.sub(r"[^#*$%&|<>]", "", text)), len(lines) - len(set(lines)), repeat, covered, longest, failed, kept


def brute_repeats(w, least):
    """Maximal repeats (length, count) of a list of words, from all its windows."""
    out = []
    for size in range(least, len(w)):
        places = {}
        for i in range(len(w) - size + 1):
            places.setdefault(tuple(w[i : i + size]), []).append(i)
        for at in places.values():
            left = {w[i - 1] if i else None for i in at}
            right = {w[i + size] if i + size < len(w) else None for i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                out.append((size, len(at)))
    return sorted(out)


def texts():
    r = random.Random(8)
    words = ["a", "b", "É", "x#", "$%", "the", "longer", "\xa0", "\x1c", "é<>"]
    out = [None, "", " \n\t", "one", "\n\none\none\n", "a a a", "x\r\nx\r\n x", "\n", "a\n"]
    for _ in range(120):
        n = r.choice([1, 5, 60, 60, 200])
        own = words[: r.choice([1, 2, 10])] + [f"w{k}" for k in range(r.choice([0, 3, 500]))]
        out.append("".join(r.choice(own) + r.choice([" ", " ", "  ", "\t", "\n", "\x0b"]) for _ in range(n)))
    prose = " ".join(f"w{r.randrange(5000)}" for _ in range(300))
    line = " ".join(f"v{k}" for k in range(30))
    passage = " ".join(f"u{k}" for k in range(75))
    out += [f"{prose} {passage} x {passage}", f"{prose}\n{passage[:200]}\n{passage[:200]}"]
    out += [prose, prose + " " + prose, f"{prose}\n{line}\n{line}", "The " * 90, f"{line}\n" * 20, out[40], out[40]]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, "n", 1, 2, 3) for i, t in enumerate(texts())], SCHEMA).repartition(3)


def test_against_plain_python(rows):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat, r.base_failed, r.kept) for r in q.judged(rows).collect()}
    want = {i: brute(t) for i, t in enumerate(texts())}
    assert got == want and {k[-1] for k in want.values()} == {True, False}
    assert any(not k[-2] and not k[-1] for k in want.values())


def test_maximal_repeats(rows, monkeypatch):
    monkeypatch.setattr(q, "SLICE_BYTES", 500)
    for least in (1, 3):
        for r in q.repeats(rows, least=least).collect():
            w = WORD.findall(texts()[r.doc_id] or "")
            assert sorted((x.length, x["count"]) for x in r.repeats) == brute_repeats(w, least)
            for x in r.repeats:
                own = w[x.start : x.start + x.length]
                assert sum(w[i : i + x.length] == own for i in range(len(w))) == x["count"]


def test_suffix_array_and_prefixes():
    r = random.Random(1)
    lists = [[r.randrange(k) for _ in range(n)] for k, n in ((1, 70), (2, 90), (3, 40), (50, 60), (1, 0), (2, 1), (1, 400))]
    lists[6][200] = 7
    w = q.words_of(pa.array([" ".join(map(str, x)) for x in lists]))
    places, first = q.suffix_array(w.ids, w.text, w.bounds)
    lcp, turns = q.common_prefixes(w, places, first)
    suffix = lambda p: w.ids[p : w.bounds[1:][w.text[p]]].tolist()
    assert [(w.text[p], suffix(p)) for p in places] == sorted((w.text[p], suffix(p)) for p in range(len(places)))
    for k in range(1, len(places)):
        a, b = suffix(places[k - 1]), suffix(places[k])
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (same if w.text[places[k - 1]] == w.text[places[k]] else 0)


def test_agreement_in_blocks():
    r = np.random.default_rng(0)
    ids = np.tile(r.integers(0, 9, 5000), 3)
    ids[12_345] = 11
    a, b = np.array([0, 3, 100]), np.array([5000, 10_003, 5100])
    most = len(ids) - b
    want = [int(np.r_[ids[x : x + m] != ids[y : y + m], True].argmax()) for x, y, m in zip(a, b, most)]
    assert q._agreement(ids, a, b, most).tolist() == want


def test_hard_tables(spark):
    assert q.judged(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([(None, None, None, None, None, None)] * 2, SCHEMA)
    assert [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in q.judged(none).collect()] == [(None, 0, True, False)] * 2


def test_very_long_texts(spark):
    """Texts of 20 MB in one partition: one word again and again, one passage again and again, and none that repeats."""
    once = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2_500_000)), lambda k: k.cast("string")), " ")
    docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("ha "), 6_600_000).alias("text"))
    docs = docs.union(spark.range(1).select(F.lit(2), F.repeat(F.lit("some words of a passage that is here again "), 480_000))).union(spark.range(1).select(F.lit(3), once)).coalesce(1)
    got = {r.doc_id: r for r in q.judged(docs).collect()}
    assert got[1].n_words == got[1].covered_words == 6_600_000 and got[1].longest_repeat == 6_599_999
    assert got[2].n_words == 480_000 * 9 and got[2].longest_repeat == 479_999 * 9 and not got[2].kept
    assert got[3].n_repeat_words == 0 and got[3].kept
