import itertools
import random
import re

import pytest

from lodestone.llm import jaccard_groups
from lodestone.llm.common import table
from lodestone.llm.components import component_labels

R = random.Random(11)


def tokens(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words, percent):
    sets = [tokens(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for k, s in enumerate(sets):
        for t in s:
            index.setdefault(t, []).append(k)
    pairs = {p for ks in index.values() for p in itertools.combinations(ks, 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str((i, len(s), (i if not s else least.get(find(k))))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))))


def family(base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(R.randrange(edits + 1)):
            w[R.randrange(len(w))] = f"e{R.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def random_words(n, kinds=10**6):
    return [f"w{R.randrange(kinds)}" for _ in range(n)]


def hard_rows():
    texts = [None, "", "  \t", "One", "one", "two words", "Two  words", "a b c d", "a b c d e", "AÄ b c d"]
    for size, edits in ((30, 1), (100, 6), (200, 10), (400, 12)):
        texts += family(random_words(size), 25, edits)
    passage = " ".join(random_words(80))
    texts += [f"{' '.join(random_words(60))} {passage} {' '.join(random_words(30))}" for _ in range(60)]
    texts += [f"{passage} {' '.join(random_words(R.randrange(12)))}" for _ in range(30)]
    texts += [" ".join(random_words(R.randrange(1, 9), 4)) for _ in range(150)]
    texts += ["same text over and over again"] * 40 + ["word " * 20_000]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    return [*rows, (5, "tie one two three four"), (5, "other text of one id here"), (None, "no id at all here"), (None, "no id at all here")]


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_hard_rows(spark, words, percent, monkeypatch):
    monkeypatch.setattr(jaccard_groups, "PAIRS_PER_NODE", 0)
    if words == 5:
        monkeypatch.setattr(jaccard_groups, "BROADCAST_ROWS", 0)
    rows = hard_rows()
    R.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node long").repartition(5)
    got = sorted(str(tuple(r)) for r in jaccard_groups.similar_components(docs, words=words, percent=percent).collect())
    assert got == brute(rows, words, percent)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = sorted(str(tuple(r)) for r in jaccard_groups.similar_components(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 4, 85)


def test_no_leaders_at_all(spark, monkeypatch):
    # what the leaders link only saves work: without them the groups' bound finds every link
    monkeypatch.setattr(jaccard_groups, "ROUNDS", 1)
    monkeypatch.setattr(jaccard_groups, "LEADERS", 0)
    rows = hard_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str(tuple(r)) for r in jaccard_groups.similar_components(docs).collect())
    assert got == brute(rows, 4, 85)


def test_empty(spark):
    assert jaccard_groups.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, None), (2, "a")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_groups.similar_components(one).collect())) == [(1, 0, 1), (2, 1, 2)]


def test_components(spark):
    links = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7), (900, 800), (900, 850)] + [(1000, k) for k in range(1001, 1100)]
    labels = {r.node: r.label for r in component_labels(spark.createDataFrame(links, "u long, v long")).collect()}
    assert labels == {k: 0 for k in range(201)} | {500: 500, 501: 500, 800: 800, 850: 800, 900: 800} | {k: 1000 for k in range(1000, 1100)}


def test_many_rows_without_an_id_or_with_one_id(spark, monkeypatch):
    """Each of them has a text of its own; what is looked up for a node is its text, not all texts of its id."""
    rows = [(None if k % 3 else 7, f"text {k % 40} has some words of its own {k % 40} and {k // 80} more of them {k}") for k in range(240)] + [(9, "one text that is there again and again")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    looked_up = []
    real = jaccard_groups.token_sets

    def counted(nodes, *rest):
        out = real(nodes, *rest)
        looked_up.append((nodes.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard_groups, "token_sets", counted)
    out = jaccard_groups.similar_components(docs, words=2, percent=60).collect()
    assert len(out) == len(rows) and {r.component_id for r in out if r.doc_id == 9} == {9}
    assert looked_up and all(found <= 2 * wanted + 8 for wanted, found in looked_up)
