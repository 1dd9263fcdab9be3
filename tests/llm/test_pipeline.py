import hashlib
import re
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_jaccard_groups import tokens
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm.common import staged, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), f"test-{name}")
        found.append(docs)
    return [d.collect() for d in found], [d.columns for d in found]


def test_stages_keep_the_columns(stages):
    _, columns = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_copies", "mixing", "bpe"]
    assert all(c == columns[0] for c in columns[1:-1])


def test_language_stage(stages):
    before, after = stages[0][0], stages[0][1]
    lettered = {r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or "")}
    kept = {r.doc_id for r in after}
    assert kept <= lettered and len(lettered - kept) <= 2


def test_near_copies_stage(stages):
    before, after = stages[0][1], stages[0][2]
    sets = {r.doc_id: tokens(r.text, 5) for r in before}
    linked = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if linked(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r.doc_id for r in after) == [i for i in ids if find(i) == i]
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_mixing_stage(stages):
    before, after = stages[0][2], stages[0][3]
    words = {r.doc_id: len(r.text.split()) for r in before}
    text = {r.doc_id: r.text for r in before}
    taken = Counter()
    for r in after:
        taken[r.doc_id] += len(r.text.split())
        assert r.text in text[r.doc_id] and r.n_chars == len(r.text)
    assert all(taken[i] <= 2 * words[i] for i in taken)
    assert abs(sum(taken.values()) - 1.5 * sum(words.values())) < 0.05 * sum(words.values())


def test_encoding_stage(stages):
    before, after = stages[0][3], stages[0][4]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in before:
        ids = t.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, after)) == want


def test_run(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, stages[0][4]))


def test_hard_documents(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "the same text of some words here", "en", "s", 32), (3, "the same text of some words here", "en", "s", 32), (None, "a text without an id and more", "en", "s", 5), (None, "another text without an id too", "en", None, 5), (4, "long " * 30_000, "en", "t", 5)]
    schema = table(spark, SF, "documents").schema
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SF), f"test-{name}")
        assert bool(docs.count()) == bool(some)


def test_near_copies_keep_a_row_of_each_class_whatever_its_id(spark):
    a, b, c, d = ("one two three four five six seven", "a text of some other words without an id", "more words that no other row has at all", "what is left has one more text of words")
    ids = [(None, a), (None, b), (None, b), (7, c), (7, d), (3, d), (7, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ids], table(spark, SF, "documents").schema)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(7, a), (None, b), (7, c), (3, d)])


#: Names that the stages use inside.
INSIDE = "size copies _a _b _first _last _copies _size a b row runs lang_pred score _id _text _0 _c0 _row component_id n_shingles n id missing".split()


def test_columns_with_any_name_pass_every_stage(spark):
    """Extra columns, named as the stages' own, come through with their values and change no decision."""
    docs = table(spark, SF, "documents").limit(60)
    extra = docs.select(*docs.columns, *(F.concat(F.lit(f"{k}-"), F.col("doc_id")).alias(c) for k, c in enumerate(INSIDE)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, docs = staged(stage(spark, docs, SF), f"test-{name}"), None
        got = staged(stage(spark, extra, SF), f"test-{name}")
        assert got.columns == extra.columns
        assert Counter(tuple(r) for r in got.select(*plain.columns).collect()) == Counter(tuple(r) for r in plain.collect())
        for k, c in enumerate(INSIDE):
            assert got.filter(F.col(c) != F.concat(F.lit(f"{k}-"), F.col("doc_id"))).count() == 0
        docs, extra = plain, got
    assert corpus_pipeline.encode(spark, extra, SF).count() == docs.count()
