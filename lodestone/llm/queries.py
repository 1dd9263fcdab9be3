"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_windows, compaction, exact_digest, jaccard_groups, language_id, licenses, mixing, phrases, quality_rules, tiff, token_files, whitening
from .common import staged, staging_path, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
SAID = "</s>[INST] ok [/INST]"


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media are written to the shared folder and read back."""
    return tiff.media_digests(staged(tiff.store_texts(table(spark, sf_dir, "documents")), "op1-media"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "op2-tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY), END_ID)
    return token_files.token_digests(spark, path)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in sixteen arrivals, compacted; every row is read back by the last manifest."""
    store = compaction.compacted(table(spark, sf_dir, "documents"), staging_path(spark, "op3-store"), 16, F.coalesce(F.col("doc_id"), F.lit(0)))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows are written to the shared folder and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT col1 AS conv_id, col2 AS turn, col3 AS role, :said AS text FROM VALUES (-1L, 0L, 'user'), (-1L, 1L, 'assistant')", args={"said": SAID})
    return chat_windows.conversation_digests(staged(chat_windows.format_windows(turns.unionByName(extra)), "op5-windows"))


def op6_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_digest.edit_likeness(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.similar_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries become whole numbers of 64ths, a million added; 32 components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 32, 64, 1_000_000)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000).drop("words")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words"]
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(*columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tiff": op1_tiff,
        "op2_token_files": op2_token_files,
        "op4_language_id": op4_language_id,
        "op3_compaction": op3_compaction,
        "op5_chat_windows": op5_chat_windows,
        "op6_exact_digest": op6_exact_digest,
        "op7_licenses": op7_licenses,
        "op8_mixing": op8_mixing,
        "op9_bpe": op9_bpe,
        "op10_jaccard_groups": op10_jaccard_groups,
        "op11_whitening": op11_whitening,
        "op12_phrases": op12_phrases,
        "op13_quality_rules": op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_compaction": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
        "op5_chat_windows": chat_windows.digests_sql(((-1, 0, "user", SAID), (-1, 1, "assistant", SAID))),
        "op7_licenses": licenses.scan_sql(),
        "op10_jaccard_groups": jaccard_groups.components_sql(),
        "op12_phrases": phrases.collocations_sql(),
        "op13_quality_rules": quality_rules.judged_sql(),
    }
