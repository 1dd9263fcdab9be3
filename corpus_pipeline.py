"""The corpus pipeline: language ID, n-gram Jaccard join, mixing, BPE.

STAGES are (name, function) pairs. A function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Each begins by having the
JVMs give back what the stage before has left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, jaccard_groups, language_id, mixing
from lodestone.llm.common import relieve, staged, table, tuned

VOCABULARY = "byte_bpe_50k.json"
#: The column by which rows go here; the documents' own are numbered meanwhile.
KEY = "_row"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang is the predicted one."""
    relieve(spark)
    return language_id.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (five-word shingles, similarity of 0.8 or more), whatever its doc_id is.

    It is the row with the class's least doc_id; a row without one remains only where
    no row of its class has one. Ties go to the least hash of the whole row, and of
    rows that are equal in every column one remains. Rows without words are like
    nothing else and all remain.

    A row goes by the 128-bit hash of all its columns, so no text is written or
    shuffled here; only of rows that are repeated one copy a task is.
    """
    relieve(spark)
    number = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    plain = tuned(docs).toDF(*number.values())
    row = lambda seed: F.xxhash64(F.lit(seed), *(F.col(c) for c in plain.columns))
    doc_id = F.col(number["doc_id"])
    keyed = plain.withColumn(KEY, F.struct(doc_id.isNull().alias("missing"), doc_id.alias("id"), row(1).alias("a"), row(2).alias("b")))
    groups = jaccard_groups.similar_components(keyed, id_col=KEY, text_col=number["text"], words=5, percent=80)
    kept = staged(groups.filter(F.col("component_id") == F.col(KEY)).groupBy(KEY).agg(F.count("*").alias("copies"), F.max("n_shingles").alias("n")), "pipeline-kept")
    once = keyed.join(kept.filter("copies = 1 OR n = 0"), KEY, "left_semi")
    repeated = keyed.join(kept.filter("copies > 1 AND n > 0"), KEY, "left_semi").groupBy(KEY).agg(*(F.first(c).alias(c) for c in plain.columns))
    return once.select(*plain.columns).unionByName(repeated.select(*plain.columns)).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The passages that the mix takes; a document that it takes twice is there twice, one that it doesn't take is gone."""
    relieve(spark)
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each passage's token count and the digests of its ids and of the text that they decode to."""
    relieve(spark)
    return bpe.round_trip_digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the network, the draws or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
