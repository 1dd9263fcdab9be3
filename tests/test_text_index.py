"""The stored inverted index against plain Python: changes, merges, candidates, BM25 and the early stop."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import search, text_index
from lodestone.operators.text_index import TextIndex
from lodestone.plans import catalog

R = random.Random(12)
WORDS = ["ab", "abc", "license", "the", "they", "zz", "version", "x1", "café", *(f"w{k}" for k in range(40))]


def drawn(ids):
    return {i: [R.choice(WORDS[: R.choice([3, 9, 49])]) for _ in range(R.choice([0, 1, 5, 30]))] for i in ids}


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t) for i, t in docs.items()], "id long, tokens array<string>").repartition(parts)


def ids(spark, some):
    return spark.createDataFrame([(i,) for i in some], "id long")


def check(index, docs):
    """All that is read from the index is what the documents say."""
    assert index.counts() == (len(docs), sum(map(len, docs.values())))
    for terms in (["the"], ["license", "zz"], ["w"], ["nothing"], ["café", "version", "ab"]):
        hit = {i for i, ts in docs.items() if any(t in terms or any(len(x) <= 4 and t.startswith(x) for x in terms) for t in ts)}
        assert {r.id for r in index.candidates(terms).collect()} == hit
        parts = {r.id: r for r in index.bm25_parts(terms).collect()}
        assert set(parts) == hit and all(parts[i]["size"] == len(docs[i]) and [parts[i][f"tf{k}"] for k in range(len(terms))] == [docs[i].count(t) for t in terms] for i in hit)
        n, mean = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
        best = []
        for i, ts in docs.items():
            s = 0.0
            for t in terms:
                df, tf = sum(t in d for d in docs.values()), ts.count(t)
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / mean)) if tf else 0.0
            if s:
                best.append((-s, i))
        for k in (1, 7):
            got = [(r.score, r.id) for r in index.ranked(terms, k).collect()]
            want = sorted(best)[:k]
            assert len(got) == len(want) and all(abs(s + w) < 1e-9 for (s, _), (w, _) in zip(got, want))


def test_changes_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 5)
    path = f"file://{tmp_path}/index"
    docs = drawn(range(150))
    index = TextIndex.open(spark, path).update(frame(spark, docs))
    check(index, docs)
    changed = drawn([3, 5, 400, 401, 7])
    docs |= changed
    for i in (0, 1, 2, 400):
        docs.pop(i)
    index = index.update(frame(spark, changed), None)
    index = index.update(gone=ids(spark, [0, 1, 2, 400, 9999]))
    again = drawn([400])
    docs |= again
    index = index.update(frame(spark, again))
    check(TextIndex.open(spark, path), docs)
    assert index.version == 4 and len(index.segments) == 3 and len(index.deletions) == 3
    merged = index.merge(all_=True)
    assert len(merged.segments) == 1 and merged.deletions == () and merged.segments[0].docs == len(docs)
    check(merged, docs)
    check(index, docs)  # an older version still stands
    with pytest.raises(Exception, match="(?i)exists"):
        index.update(gone=ids(spark, [4]))  # another writer has made the next version


def test_segments_of_one_size_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "MERGE", 2)
    index = TextIndex.open(spark, f"file://{tmp_path}/i").update(frame(spark, drawn(range(60))))
    for k in range(2):
        index = index.update(frame(spark, drawn(range(100 + 2 * k, 102 + 2 * k))))
    merged = index.merge()
    assert sorted(s.docs for s in merged.segments) == [4, 60] and merged.segments[0] == index.segments[0]
    assert merged.merge() is merged


def test_hard_rows(spark, tmp_path):
    none = TextIndex.open(spark, f"file://{tmp_path}/none")
    assert none.version == 0 and none.candidates(["a"]).count() == 0 and none.ranked(["a"], 3).count() == 0 and none.counts() == (0, 0)
    index = none.update(spark.createDataFrame([(1, None), (2, []), (3, ["one"] * 5000)], "id long, tokens array<string>"))
    assert index.counts() == (3, 5000) and [r.id for r in index.candidates(["one"]).collect()] == [3]
    assert index.candidates([]).count() == 0


def test_few_folders_are_opened(spark, tmp_path):
    index = TextIndex.open(spark, f"file://{tmp_path}/i").update(frame(spark, {k: [f"{a}{b}x" for a in "abcdefgh" for b in "klmnop"] for k in range(20)}))
    files = index.candidates(["akx", "bl"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in files and "PushedFilters: [" in files
    every = spark.read.parquet(f"{index.path}/{index.segments[0].name}/postings").select("bucket").distinct().count()
    assert every > 20


def test_searches_with_and_without_an_index(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("doc_id", "id")
    index = TextIndex.of(docs, search.document_tokens("source", "text"), "id", "documents")
    assert TextIndex.of(docs, search.document_tokens("source", "text"), "id", "documents").version == index.version == 1
    for query in ("license src1", "the", "Nothing_here"):
        a, b = (search.keyword_search(docs, query, None, ("source", "text"), None, i).select("id", "rank").collect() for i in (None, index))
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    tokens = T.tokens(F.coalesce("text", F.lit("")), T.QUERY_PUNCTUATION)
    texts = TextIndex.of(docs, tokens, "id", "texts")
    for query in ("license the version the", "", "src"):
        a, b = search.bm25(docs, query, tokens).collect(), search.bm25_indexed(texts, query).collect()
        assert sorted(map(str, a)) == sorted(map(str, b))
    g = catalog.graph(spark, "/root/testdata/sf0.001")
    own = TextIndex.of(g.nodes, search.document_tokens("name", "qualified_name", "signature"), "id", "symbols")
    a, b = (search.intent_search(g.nodes, g.edges, "red widget promo", index=i).collect() for i in (None, own))
    assert sorted(map(str, a)) == sorted(map(str, b)) and a
    rows = g.nodes.withColumn("doc", F.lit(""))
    a, b = (search.symbol_search(rows, "kind:function red widget", 20, index=i).select("id", "rank").collect() for i in (None, own))
    assert a == b and a
    assert Counter(r.id for r in a).most_common(1)[0][1] == 1
