import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from lodestone.llm import bpe, token_files, word_codes
from lodestone.llm.word_codes import chunks

PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    "", None, " ", "\n", "a", " a", "a ", "  two  spaces ", "line\nline\n\nline\n", "tab\tand nbsp x \t y", "Ünïcödé ß ñandú 你好 🎉🎉",
    "don't we'll I'm they're x's 's 'll", ".start, and.mid,dle. end.", "a..b ,c . d", "x\x01y.", "e.g. 1.5,2 (see p. 3.)", ", a", "aaaaaaaaaaaaaaaaaaaa", "abababababab " * 50, "<|endoftext|>", "x<|endoftext|> y <|endoftext|>", "1234567890 12 3",
    "a b   c", "\x1c a \x1d", "x" * 5000, "word " * 3000, "!!! ??? ...", "é" * 300, "\r\n mixed\r\n", "a\x00b",
]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts], t


def random_texts(n):
    r = random.Random(7)
    alphabet = ["a", "e", "th", "ing", " ", " ", "\n", "  ", "'s", "1", ".", ",", "é", "\t", "Z", "<|endoftext|>", "ß", "好"]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)]


def test_chunks_are_lossless():
    for t in [*filter(None, TEXTS), *random_texts(500)]:
        assert "".join(chunks(t)) == t


def test_encode_equals_the_library():
    texts = TEXTS + random_texts(2000)
    ids, t = expected(texts)
    model = bpe.PairIndexBpe(PATH)
    got = model.encode([x or "" for x in texts])
    for x, a, b in zip(texts, ids, got, strict=True):
        assert a == b.tolist(), x
        assert model.decode(a) == t.decode(a, skip_special_tokens=False)
    assert model.decode([200, 140]) == t.decode([200, 140], skip_special_tokens=False)


def test_library_codes_equal_the_library():
    texts = TEXTS + random_texts(2000)
    ids, _ = expected(texts)
    codes = token_files.library_codes(PATH)
    for at in range(0, len(texts), 300):
        flat, bounds = codes.of(pa.array(texts[at : at + 300]))
        assert [flat[x:y].tolist() for x, y in zip(bounds, bounds[1:], strict=False)] == ids[at : at + 300]


def test_cache_generations_do_not_change_results():
    texts = random_texts(300)
    ids, _ = expected(texts)
    model = bpe.PairIndexBpe(PATH)
    model.codes.cache.bound = 10
    for x, a in zip(texts, ids, strict=True):
        assert model.encode([x])[0].tolist() == a


def test_round_trip_query_and_columns(spark):
    rows = [(k, x, "other") for k, x in enumerate(TEXTS)] + [(3, "tie", "x"), (3, "tie", "x"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.round_trip_digests(docs, PATH).collect(), key=str)
    ids, t = expected([r[1] for r in rows])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(((r[0], len(i), sha(",".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for r, i in zip(rows, ids, strict=True)), key=lambda x: str(x))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    encoded = bpe.encode_documents(docs, PATH)
    assert {(r[0], r[1]) for r in bpe.decode_documents(encoded, PATH).collect()} == {(r[0], r[1] or "") for r in rows}
    assert bpe.round_trip_digests(docs.limit(0), PATH).count() == 0


def test_token_files(spark, tmp_path):
    rows = [(k * 3 % 29, x) for k, x in enumerate(TEXTS)] + [(5, "tie"), (5, "tie"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path, PATH, 2)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for (i, x), ids in zip(ordered, expected([x for _, x in ordered])[0], strict=True):
        ids = [*ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.token_digests(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    metadata = token_files.read_token_files(spark, path, ("doc_id", "n_tokens")).filter("doc_id = 6")
    plan = metadata._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,6)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_token_files_encodings_and_indexes(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat(concat('word ', id), 20) AS text").coalesce(1)
    token_files.write_token_files(docs, f"file://{tmp_path}/t", PATH, 2, page_rows=100)
    meta = pq.ParquetFile(max(glob.glob(f"{tmp_path}/t/*.parquet"))).metadata
    group = meta.row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(docs, f"file://{tmp_path}/t", PATH, 2)
    assert token_files.token_digests(spark, f"file://{tmp_path}/t").count() == 0


def test_a_merge_takes_few_bytes_for_each_byte_of_its_words():
    r = random.Random(3)
    words = list({"".join(r.choices("etaoinshrdlu", k=r.randint(3, 14))).encode() for _ in range(40_000)})
    model = bpe.vocabulary(PATH)
    tracemalloc.start()
    try:
        model.merge(words)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 * sum(map(len, words))


def test_gathering_in_blocks_is_gathering_at_once(monkeypatch):
    r = np.random.default_rng(5)
    lengths = r.integers(0, 4, 50)
    pool, index = np.arange(lengths.sum(), dtype="<u4"), r.integers(0, 50, 1000)
    ends = np.cumsum(lengths)
    pieces = [pool[ends[k] - lengths[k] : ends[k]] for k in index]
    for block in (1, 7, 1000, 5000):
        monkeypatch.setattr(word_codes, "GATHERED", block)
        flat, to = word_codes.gather(pool, lengths, index)
        assert flat.tolist() == np.concatenate(pieces).tolist()
        assert to.tolist() == np.cumsum([len(p) for p in pieces]).tolist()
    assert [len(x) for x in word_codes.gather(pool, lengths, index[:0])] == [0, 0]
