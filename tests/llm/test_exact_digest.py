import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from lodestone.llm import exact_digest
from lodestone.llm.common import table

TEXTS = ["", None, " ", "Straße", "STRASSE", "strasse ", "Café", "Café", "ﬁne", "fine", "Ａ　B", "a b", "a\n\t b", "ẹ́", "ẹ́", "ΑΣ", "ας", "🎉 party", "x" * 50_000, "long words here " * 9_000, "tie", "tie"]


def form(text):
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"[\s\x1c-\x1f\x85]+", " ", nfkc(nfkc(text or "").casefold())).strip(" ")


def brute(spark, rows):
    """Ids as numbers, descending; ties by the keys that Spark computes for id and text."""
    frame = exact_digest.plain(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    keys = {(r.id, r.text): (r.a, r.b) for r in frame.collect()}
    assert len(set(keys.values())) == len(keys)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), keys[r[0], r[1] or ""]))
    out = []
    for k, (i, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), form(t), form(edited), float(form(t) == form(edited)), float(form(t) == form(following))))
    return out


def same(spark, rows, got):
    want = brute(spark, rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [(r[:3], r[5:]) for r in got] == [(r[:3], r[5:]) for r in want]
    seen = {}
    for g, w in zip(got, want, strict=True):
        for x, y in ((g[3], w[3]), (g[4], w[4])):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_digest, "BROADCAST_HASHES", 3)
    rows = [(k * 11 % 37, t) for k, t in enumerate(TEXTS)] + [(3, "same id"), (3, "other of one id"), (None, "without id"), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, hash string").repartition(4)
    same(spark, rows, exact_digest.edit_likeness(docs).collect())
    groups = {r.doc_id: r for r in exact_digest.exact_groups(docs.filter("doc_id IS NOT NULL AND doc_id != 3")).collect()}
    by = {}
    for i, t in rows:
        if i not in (None, 3):
            by.setdefault(form(t), []).append(i)
    assert all(groups[i].group_id == min(ids) and groups[i].group_size == len(ids) for ids in by.values() for i in ids)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    same(spark, [(1, "abc")], exact_digest.edit_likeness(docs).collect())
    assert exact_digest.edit_likeness(docs.limit(0)).count() == 0


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    same(spark, [(r.doc_id, r.text) for r in docs.collect()], exact_digest.edit_likeness(docs).collect())


def test_forms_with_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_digest, "wide_hash", lambda form: F.concat(F.lit("h"), F.char_length(form).cast("string")))
    rows = [(1, "abc"), (2, "abd"), (3, "ABC"), (4, "xy"), (5, "abe")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in exact_digest.exact_groups(docs).collect()}
    assert got[1].fingerprint == got[3].fingerprint and len({r.fingerprint for r in got.values()}) == 4
    pairs = {r.doc_id: (r.fingerprint, r.near_edited, r.near_next) for r in exact_digest.edit_likeness(docs).collect()}
    assert pairs[2][0] == got[2].fingerprint and pairs[3][1:] == (0.0, 0.0)


def test_plan_is_native(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    plan = exact_digest.edit_likeness(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_ids_of_any_type_and_many_rows(spark):
    """More rows than any bound on ranges once was; text ids are ordered as text."""
    texts = [f"text number {k % 3000} of some words" for k in range(4000)]
    named = spark.createDataFrame([(f"doc-{k:05}", t) for k, t in enumerate(texts)], "doc_id string, text string")
    numbers = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a = {r.doc_id: tuple(r)[1:] for r in exact_digest.edit_likeness(named).collect()}
    b = {f"doc-{r.doc_id:05}": tuple(r)[1:] for r in exact_digest.edit_likeness(numbers).collect()}
    assert a == b and len(a) == 4000
    days = numbers.limit(50).selectExpr("date_add(DATE '2024-01-01', CAST(doc_id AS INT)) AS doc_id", "text")
    assert exact_digest.edit_likeness(days).count() == 50


def test_many_copies_of_one_row(spark):
    rows = [(5, "the same id and text")] * 9000 + [(None, "no id")] * 3 + [(k, f"other {k} text") for k in range(20)]
    got = exact_digest.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    same(spark, rows, got)
