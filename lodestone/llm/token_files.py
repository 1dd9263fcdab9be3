"""Token ids in Parquet list columns, with chosen encodings, row groups and page indexes.

A file has the columns pos (the row's place in the whole order), doc_id,
n_tokens and ids. Ids are dictionary-encoded (a vocabulary of 2^16 ids fits one
dictionary page); pos, doc_id and n_tokens are delta-encoded. Pages are short
and indexed, so a reader that filters on doc_id or pos opens few of them, and one
that asks for the metadata columns never reads ids.

Defined results: null text counts as empty and has the end id alone; rows with
one doc_id stand next to each other, ordered by text, null first; rows without
doc_id come first. An empty table gives empty files. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import at_work, slices, tuned
from .word_codes import ChunkCodes, cuts_hold

#: Bytes of texts that are encoded together, and bytes of chunks whose codes a worker keeps (twice, in two generations).
SLICE_BYTES, CHUNK_BYTES = 12 << 20, 24 << 20
#: Chunks that are encoded in one call.
JOINED = 2_000
#: Bits of pos that count the rows of one file's partition (monotonically_increasing_id's layout).
ROW_BITS = 33


@lru_cache(maxsize=2)
def library_codes(path: str) -> ChunkCodes:
    """The tokenizers library's codes of chunks; one per Python worker.

    Chunks that begin with their only space are joined to long texts, as they may
    be by where chunks are cut, and told apart again by the tokens that begin with
    a space; the rest are encoded one by one. A vocabulary with another
    pre-tokeniser has its texts encoded whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        cut = cuts_hold(json.load(file))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    begins = np.zeros(tokenizer.get_vocab_size(), bool)
    #: Fixed value: how a byte-level vocabulary spells a space.
    begins[[i for token, i in tokenizer.get_vocab().items() if token[0] == "\u0120"]] = True

    def alone(group: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(group, add_special_tokens=False)]

    def joined(group: list[str]) -> list[bytes]:
        """The codes of chunks that each begin with their only space."""
        ids = np.array(tokenizer.encode_batch_fast(["".join(group)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(begins[ids]) * 4).tolist()
        if len(cuts) != len(group) or cuts[0]:
            return alone(group)
        code = ids.tobytes()
        return [code[x:y] for x, y in zip(cuts, [*cuts[1:], len(code)], strict=True)]

    def encode(distinct: list[str]) -> list[bytes]:
        spaced = np.fromiter((c[:1] == " " and c.rfind(" ") == 0 and c.rfind("\n") < 0 for c in distinct), bool, len(distinct))
        out = np.empty(len(distinct), object)
        for places, way in ((np.flatnonzero(spaced), joined), (np.flatnonzero(~spaced), alone)):
            for at in range(0, len(places), JOINED):
                some = places[at : at + JOINED]
                out[some] = way([distinct[k] for k in some.tolist()])
        return out.tolist()

    return ChunkCodes(encode if cut else alone, CHUNK_BYTES, cut)


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 1_000,
) -> None:
    """Writes the ids of every whole text, with end_id appended, in ascending order of id_col.

    Texts are dealt out by ranges of id and encoded where they are written; a
    range's rows are sorted by id, so the files follow one another.
    """
    source = tuned(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = library_codes(vocabulary_path)
        at_work("token_files", codes.cache.forget)
        for batch in slices(batches, SLICE_BYTES, 1):
            flat, bounds = codes.of(batch.column(1))
            ended = np.insert(flat, bounds[1:], end_id).astype("<i4")
            bounds = (bounds + np.arange(len(bounds))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ended))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), ids], ["doc_id", "n_tokens", "ids"])

    kind = source.schema["doc_id"].dataType.simpleString()
    tokens = ordered.mapInArrow(encode, f"doc_id {kind}, n_tokens int, ids array<int>")
    (
        tokens.select(F.monotonically_increasing_id().alias("pos"), "doc_id", "n_tokens", "ids")
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#pos", "false")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, columns: Iterable[str] = ("pos", "doc_id", "n_tokens", "ids")) -> DataFrame:
    """The chosen columns; filters on pos and doc_id reach the page indexes."""
    return spark.read.parquet(path).select(*columns)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of the files, from what is read back.

    start sums in two levels: totals by file partition (their number is that of
    the partitions written) and running sums inside each.
    """
    stored = read_token_files(spark, path)
    kind = stored.schema["doc_id"].dataType.simpleString()

    def crc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            offsets = ids.offsets.to_numpy().tolist()
            values = memoryview(ids.values.to_numpy()).cast("B")
            sums = [zlib.crc32(values[x * 4 : y * 4]) for x, y in zip(offsets, offsets[1:], strict=False)]
            counts = [y - x for x, y in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["pos", "doc_id", "n_tokens", "ids_crc32"])

    rows = stored.select("pos", "doc_id", "ids").mapInArrow(crc, f"pos long, doc_id {kind}, n_tokens long, ids_crc32 long")
    rows = rows.withColumn("part", F.shiftright("pos", ROW_BITS))
    totals = read_token_files(spark, path, ("pos", "n_tokens")).groupBy(F.shiftright("pos", ROW_BITS).alias("part")).agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(starts, "part")
        .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )
