"""The registered queries: against their SQL where there is one, and against what their contracts say of all of them."""

import duckdb
import pytest

import __spark_entry__
from lodestone.llm import queries

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "conversations")
COLUMNS = {
    "op1_tiff": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op2_token_files": "doc_id start n_tokens ids_crc32",
    "op4_language_id": "doc_id held_out lang_pred score",
    "op5_chat_windows": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op6_exact_digest": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op8_mixing": "doc_id size source_size target taken",
    "op9_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_jaccard_groups": "doc_id n_shingles component_id",
    "op13_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, con, name):
    df, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert df.columns == want.columns
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    table = spark.read.parquet(f"/root/testdata/sf0.001/{'conversations' if 'chat' in name else 'documents'}.parquet")
    expected = table.select("conv_id").distinct().count() + 1 if "chat" in name else table.count()
    assert df.count() == expected


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.queries()) | {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
