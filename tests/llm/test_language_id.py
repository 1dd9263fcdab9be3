import unicodedata
import zlib

import numpy as np
import pytest

from lodestone.llm import language_id
from lodestone.llm.common import table

SF = "/root/testdata/sf0.01"


def test_gradients_by_differences():
    model = language_id.ByteGru(["a", "b", "c"], hidden=3)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    random = np.random.default_rng(1)
    x, label = random.integers(97, 101, (4, 5)).astype(np.uint8), random.integers(0, 3, 5)
    x[2:, 4] = language_id.PAD  # a window that ends early: what is padding has no loss
    _, grads = model.gradients(x, label)
    for k, v in model.p.items():
        for at in [np.unravel_index(i, v.shape) for i in random.integers(0, v.size, 12)] + ([(98, 2)] if k[0] == "X" else []):
            old = v[at]
            v[at] = old + 1e-5
            up, _ = model.gradients(x, label)
            v[at] = old - 1e-5
            down, _ = model.gradients(x, label)
            v[at] = old
            assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-6, (k, at)


def test_padding_has_no_loss():
    model = language_id.ByteGru(["a", "b"], hidden=3)
    x = np.frombuffer(b"some", np.uint8)[:, None]
    p = model.positions(x)[:, 0, 1]
    assert abs(model.gradients(x, np.array([1]))[0] + np.log(p).mean()) < 1e-5
    padded = np.vstack([x, np.full((3, 1), language_id.PAD, np.uint8)])
    p = model.positions(padded)[:4, 0, 1]
    assert abs(model.gradients(padded, np.array([1]))[0] + np.log(p).mean()) < 1e-5


@pytest.fixture(scope="module")
def found(spark):
    docs = table(spark, SF, "documents")
    return docs, {r.doc_id: r for r in language_id.identify(docs).collect()}


def has_letter(text):
    return any(unicodedata.category(c)[0] == "L" for c in text or "")


def test_held_out_accuracy(found):
    docs, out = found
    rows = docs.collect()
    assert len(out) == len(rows)
    right = [out[r.doc_id].lang_pred == r.lang for r in rows if out[r.doc_id].held_out and out[r.doc_id].lang_pred != "und"]
    assert len(right) > 200 and sum(right) / len(right) > 0.97
    for r in rows:
        assert out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= out[r.doc_id].score <= 1
        assert (out[r.doc_id].lang_pred == "und") == (not has_letter(r.text))


def brute_sums(model, text):
    """The distributions of all bytes of a text, window by window."""
    C, X, pad = language_id.CORE, language_id.CONTEXT, language_id.PAD
    data, total, labels = text.encode(), np.zeros(len(model.languages)), []
    for at in range(0, len(data), C):
        window = [data[k] if 0 <= k < len(data) else pad for k in range(at - X, at + C + X)]
        p = model.positions(np.array(window, np.uint8)[:, None])[X : X + min(C, len(data) - at), 0]
        total += p.sum(axis=0)
        labels += p.argmax(axis=1).tolist()
    return total, labels


def test_brute_force_pooling(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    model = language_id.train(language_id.sample_windows(docs), steps=100)
    some = docs.filter("doc_id < 40")
    got = {r.doc_id: r for r in language_id.predict(some, model).collect()}
    runs = {r.doc_id: r.runs for r in language_id.label_positions(some, model).collect()}
    for r in some.collect():
        total, labels = brute_sums(model, r.text)
        assert model.languages[total.argmax()] == got[r.doc_id].lang_pred
        assert abs(total.max() / total.sum() - got[r.doc_id].score) < 1e-4
        assert [model.languages[k] for k in labels] == [x["lang"] for x in runs[r.doc_id] for _ in range(x["end"] - x["start"])]
        assert all(a["end"] == b["start"] and a["lang"] != b["lang"] for a, b in zip(runs[r.doc_id], runs[r.doc_id][1:]))
    monkeypatch.setattr(language_id, "BLOCK", 3)
    texts = [r.text.encode() for r in some.collect()]
    assert np.allclose(model.text_sums(texts), [brute_sums(model, t.decode())[0] for t in texts], atol=1e-2)


def test_state_crosses_words(spark):
    model = language_id.ByteGru(["a", "b"])
    ends = [model.text_sums([t])[0] for t in (b"one two", b"six two")]
    alone = [model.text_sums([t])[0] for t in (b"one", b"six")]
    assert not np.allclose(ends[0] - ends[1], alone[0] - alone[1])


LETTERLESS = ["½", "10½ ² ³", "Ⅳ ① ٣", "123 !!", "_ _", "🎉"]


def test_hard_rows(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), *((10 + k, t, "en", 1) for k, t in enumerate(LETTERLESS)), (4, "the of and to " * 20_000, "en", 1), (None, "the of and", "en", 1), (6, "der die das", None, 1), (7, "tie", "de", 1), (7, "tie", "de", 1), (8, "x" * 500, "de", 1), (9, " a ", "fr", 1), (30, "ª", "fr", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = language_id.identify(docs).collect()
    assert len(out) == len(rows)
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {1, 2, *(10 + k for k in range(len(LETTERLESS)))}
    assert language_id.identify(docs.limit(0)).count() == 0
    alone = language_id.identify(docs.filter("doc_id = 6")).collect()
    assert alone[0].lang_pred == "und" and alone[0].score == 0


def test_accepted_keeps_columns_and_clean_documents(spark):
    docs = table(spark, SF, "documents")
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns
    lettered = {r.doc_id for r in docs.collect() if has_letter(r.text)}
    assert len(lettered - {r.doc_id for r in kept.collect()}) <= 0.01 * len(lettered)


def test_the_sample_covers_whole_texts_and_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 20)
    rows = [(k, "the words of a text " * 30, "en") for k in range(400)]
    rows += [(k, f"一段没有空格的文字{'甲乙丙丁戊己庚辛'[k % 8]}" * 40, "zh") for k in range(1000, 1008)] + [(2000, "same", "de")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.sample_windows(docs)
    by = {lang: [w for name, w in sample if name == lang] for lang in ("en", "zh")}
    learned = [t for i, t, lang in rows if lang == "zh" and zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(by["en"]) == 6 * 9 and {len(w) for w in by["en"]} == {64}
    assert all(any(t.encode().endswith(w) for w in by["zh"]) and any(t.encode().startswith(w) for w in by["zh"]) for t in learned)
    assert len(by["zh"]) == 18 * min(6, len(learned))
    assert [w for name, w in sample if name == "de"] == ([b"same"] if zlib.crc32(b"2000") % 4 != 2 else [])


def test_scripts_without_spaces(spark):
    zh, ja = "这是一段没有空格的中文文字我们用它来测试语言识别的结果如何", "これはスペースのない日本語の文章でありこの結果を確かめるために使います"
    rows = [(k, (zh if k % 2 else ja)[k % 7 :] * 3, "zh" if k % 2 else "ja") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [i for i, _, _ in rows if out[i].held_out]
    assert held and all(out[i].lang_pred == ("zh" if i % 2 else "ja") for i in held)
