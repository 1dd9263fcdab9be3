"""Mixing sources to target weights by packed blocks.

The words of a source, in the order of its documents' hashes, are packed into
blocks of one length. Each slot of the mix falls to one of the output shards with
the same chance, so a shard's source counts are a multinomial over what the
targets ask for, and all shards together meet the targets to the block. A
source's slots go through a pseudorandom permutation of its block numbers (a new
one for each epoch), and are joined with the blocks' documents by block number. A
source has at most twice as many slots as blocks, so no block, and no document,
is taken more than twice. Blocks have BLOCK_WORDS words; a source whose target is
below BLOCKS of those has shorter ones, so that a small source meets its target
too.

Sources are a table like the others: nothing that grows with their number comes
to the driver or is sent to every task unchecked. Prefix sums go in steps over
groups of bounded size, so no source, id or text is a single group.

Defined results: null and empty texts have size 0 and nothing of them is taken; a
null source is a source of its own, after all others; rows that agree on id,
source and text are copies, each a document of its own, whatever else they say; a
source without words has target 0; an empty table gives an empty table. Other
columns are not read, and neither the order of the rows nor their partitions
change what is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import at_work, numbered, slices, staged, texts_of, tuned

#: Words: what is not a space or one of the controls from tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS, BLOCKS = 128, 200
SHARD_SLOTS = 8_192
#: Rows of a group of prefix sums, as a power of two; shards that are drawn together; slots that are made together.
GROUP_BITS, SHARD_CHUNK, SLOT_CHUNK = 12, 65_536, 200_000
#: Documents of a source that are numbered together.
BUCKET_ROWS = 512
#: Bytes of texts that are taken up together.
SLICE_BYTES = 4 << 20
#: Sources that are sent to every task; beyond that they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
SEED = 20_240


def prefix_sums(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """df with before: for each of the keys the sum of value over the rows with a lower `at` (a number that is there once a key).

    Rows of up to 2^GROUP_BITS neighbouring numbers are a group; groups of groups
    are summed first, so that no window has more rows than a group or there are
    groups of groups.
    """
    up, upper = F.shiftright(at, GROUP_BITS), F.shiftright("_up", GROUP_BITS)
    groups = df.groupBy(*keys, up.alias("_up")).agg(F.sum(value).alias("_words")).withColumn("_top", upper)
    tops = groups.groupBy(*keys, "_top").agg(F.sum("_words").alias("_all"))
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda total, by, order: F.coalesce(F.sum(total).over(earlier(by, order)), F.lit(0))
    tops = tops.select(*keys, "_top", zero("_all", keys, "_top").alias("_t"))
    groups = groups.withColumn("_g", zero("_words", [*keys, "_top"], "_up")).join(tops, [*keys, "_top"]).select(*keys, "_up", (F.col("_g") + F.col("_t")).alias("_base"))
    inside = df.withColumn("_up", up).withColumn("_inside", zero(value, [*keys, "_up"], at))
    return inside.join(groups, [*keys, "_up"]).withColumn("before", F.col("_base") + F.col("_inside")).drop("_up", "_base", "_inside")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index under a pseudorandom permutation of range(size), another one for each key: a Feistel network walked until it lands inside."""
    mask64 = np.uint64(0xFFFFFFFFFFFFFFFF)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64))
    low = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        x, y = out[todo] >> h, out[todo] & m
        for turn in range(4):
            z = (y + k + np.uint64(turn * 0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9) & mask64
            z ^= z >> np.uint64(29)
            z = z * np.uint64(0x94D049BB133111EB) & mask64
            x, y = y, x ^ (z >> np.uint64(32)) & m
        out[todo] = x << h | y
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with a and b: two hashes of id, source and text, by which a document is ordered and found again."""
    half = lambda salt: F.xxhash64(F.lit(salt), F.col(id_col).isNull(), F.col(id_col), F.col(source_col).isNull(), F.col(source_col), F.col(text_col).isNull(), F.col(text_col))
    return tuned(docs).withColumn("_a", half(1)).withColumn("_b", half(2))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, source, size, a, b), staged: row tells the rows apart, size counts a text's words."""
    source = keyed(docs, id_col, text_col, source_col).select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col("_a").alias("a"), F.col("_b").alias("b"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("mixing")
        for batch in slices(batches, SLICE_BYTES):
            sizes = pa.array([len(t.encode().split()) for t in texts_of(batch.column(0))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sizes], ["doc_id", "source", "a", "b", "size"])

    kind = lambda c: source.schema[c].dataType.simpleString()
    rows = source.mapInArrow(count, f"doc_id {kind('doc_id')}, source {kind('source')}, a long, b long, size long")
    return staged(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "mix-sizes")


def planned_sources(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source_no, source, words, target, block_words, blocks, slots, key), staged: one row a source.

    Targets are min(MOST * words, weight * unit); the unit that makes them share
    SHARE of all words grows from round to round, as sources reach their bound. A
    round is one aggregate over the sources, of which one row comes to the driver.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("words"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    sources = staged(numbered(sums, "source_no", F.asc_nulls_last("source")).withColumn("weight", weight), "mix-sources")
    total = sources.agg(F.sum("words").alias("words")).first().words or 0
    unit, capped = 0.0, -1
    while True:
        full = F.col("weight") * unit > F.col("words") * MOST
        state = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("words")).otherwise(0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if state.n == capped or not state.open:
            break
        unit, capped = (SHARE * total - MOST * state.taken) / state.open, state.n
    words, target = F.col("words"), F.col("target")
    sources = sources.withColumn("target", F.least(words * MOST, F.col("weight") * unit))
    sources = sources.withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.least(words, target) / BLOCKS).cast("int"))))
    sources = sources.withColumn("blocks", F.ceil(words / F.col("block_words")))
    slots = F.when(words > 0, F.least(F.col("blocks") * 2, F.round(target * F.col("blocks") / words).cast("long"))).otherwise(0)
    key = F.xxhash64(F.col("source").isNull(), "source").bitwiseAND((1 << 48) - 1)
    return staged(sources.select("source_no", "source", "words", "target", "block_words", "blocks", slots.cast("long").alias("slots"), key.alias("key")), "mix-plan")


def with_source(rows: DataFrame, sources: DataFrame, *columns: str) -> DataFrame:
    """rows with columns of their sources, which are sent to every task if they are few."""
    chosen = sources.select(F.col("source").alias("_source"), *columns)
    if sources.count() <= BROADCAST_SOURCES:
        chosen = F.broadcast(chosen)
    return rows.join(chosen, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def drawn(slots: int, shards: int, seed: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shards, firsts, counts): how many of a source's slots fall to each shard that gets any, and the first of those; each slot has the same chance to fall to each shard."""
    random, left, first = np.random.default_rng(seed), slots, 0
    for at in range(0, shards, SHARD_CHUNK):
        n = min(SHARD_CHUNK, shards - at)
        own = left if at + n == shards else int(random.binomial(left, n / (shards - at)))
        left -= own
        if own:
            counts = random.multinomial(own, np.full(n, 1 / n))
            some = np.flatnonzero(counts)
            counts = counts[some]
            yield some + at, first + np.cumsum(counts) - counts, counts
            first += own


def shard_counts(sources: DataFrame, seed: int) -> DataFrame:
    """(source_no, shard, first, count, blocks, key), staged: the slots of each source by output shard."""
    total = sources.agg(F.sum("slots").alias("n")).first().n or 0
    shards = max(1, -(-total // SHARD_SLOTS))

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, slots, blocks, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for shard, first, count in drawn(slots, shards, (seed, key)):
                    same = [np.full(len(shard), x) for x in (no, blocks, key)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (same[0], shard, first, count, *same[1:])], ["source_no", "shard", "first", "count", "blocks", "key"])

    drawn_ = sources.filter("slots > 0").select("source_no", "slots", "blocks", "key").mapInArrow(draw, "source_no long, shard long, first long, count long, blocks long, key long")
    return staged(drawn_.repartition(F.xxhash64("source_no", "shard")), "mix-shards")


def slot_blocks(counts: DataFrame) -> DataFrame:
    """(shard, place, source_no, epoch, block): the block that each slot takes; place numbers a source's slots."""

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, shard, first, count, blocks, key = (c.to_numpy() for c in batch.columns)
            ends = np.cumsum(count)
            for at in range(0, int(ends[-1]) if len(ends) else 0, SLOT_CHUNK):
                slot = np.arange(at, min(at + SLOT_CHUNK, ends[-1]))
                row = np.searchsorted(ends, slot, "right")
                place = first[row] + slot - (ends - count)[row]
                epoch, size = place // blocks[row], blocks[row]
                columns = [shard[row], place, no[row], epoch, permuted(place % size, size, key[row] * 8 + epoch)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "place", "source_no", "epoch", "block"])

    return counts.mapInArrow(slots, "shard long, place long, source_no long, epoch long, block long")


def _copies(tagged: DataFrame, several: DataFrame) -> DataFrame:
    """(row, copy): numbers the rows of each document that is there several times; rows of neighbouring places are counted first."""
    own = ["source_no", "a", "b"]
    rows = tagged.join(several, own, "left_semi").select(*own, "row", F.shiftright("row", GROUP_BITS).alias("chunk"))
    chunks = prefix_sums(rows.groupBy(*own, "chunk").agg(F.count("*").alias("n")), own, "chunk", "n")
    inside = F.row_number().over(Window.partitionBy(*own, "chunk").orderBy("row")) - 1
    return rows.withColumn("_k", inside).join(chunks.select(*own, "chunk", "before"), [*own, "chunk"]).select("row", (F.col("before") + F.col("_k")).alias("copy"))


def block_pieces(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_no, block, row, a, b, copy, copies, first, last): the words [first, last) of a document that a block holds."""
    tagged = with_source(rows.filter("size > 0").select("row", "source", "size", "a", "b"), sources, "source_no", "block_words").drop("source")
    own = ["source_no", "a", "b"]
    kinds = staged(tagged.groupBy(*own).agg(F.count("*").alias("copies"), F.first("size").alias("each")), "mix-kinds")
    # neighbours by hash are a bucket; inside one, documents are numbered by both hashes
    bits = max(0, (-(-kinds.count() // BUCKET_ROWS) - 1).bit_length())
    bucket = F.shiftright("a", 64 - bits) + (1 << (bits - 1)) if bits else F.lit(0).cast("long")
    placed = kinds.withColumn("bucket", bucket).withColumn("all", F.col("copies") * F.col("each"))
    bases = prefix_sums(placed.groupBy("source_no", "bucket").agg(F.sum("all").alias("n")), ["source_no"], "bucket", "n").select("source_no", "bucket", "before")
    inside = F.sum("all").over(Window.partitionBy("source_no", "bucket").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.withColumn("_i", F.coalesce(inside, F.lit(0))).join(bases, ["source_no", "bucket"]).select(*own, "copies", (F.col("before") + F.col("_i")).alias("start"))
    several = kinds.filter("copies > 1").select(*own)
    at = tagged.join(starts, own)
    if several.limit(1).count():
        at = at.join(_copies(tagged, several), "row", "left").withColumn("copy", F.coalesce("copy", F.lit(0)))
    else:
        at = at.withColumn("copy", F.lit(0).cast("long"))
    n, start, size = F.col("block_words"), F.col("start") + F.col("copy") * F.col("size"), F.col("size")
    spread = at.select("source_no", "row", "a", "b", "copy", "copies", "size", n, start.alias("begin"), F.explode(F.sequence(F.floor(start / n), F.floor((start + size - 1) / n))).alias("block"))
    first, last = F.greatest(F.lit(0), F.col("block") * n - F.col("begin")), F.least(size, (F.col("block") + 1) * n - F.col("begin"))
    return spread.select("source_no", "block", "row", "a", "b", "copy", "copies", first.alias("first"), last.alias("last"))


def mix(rows: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, place, source_no, epoch, block, row, a, b, copy, copies, first, last): what the mix holds, in word ranges of documents."""
    # the slots are many, although they are made from few rows, so the planner must not take them for a small side
    return slot_blocks(shard_counts(sources, seed)).hint("merge").join(block_pieces(rows, sources), ["source_no", "block"])


def mixed_counts(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    rows = sized(docs)
    sources = planned_sources(rows, block_words)
    taken = mix(rows, sources, seed).groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    joined = with_source(rows.join(taken, "row", "left"), sources, F.col("words").alias("source_size"), "target")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs' columns (doc_id, text and source among them): the passages that the mix takes, as rows.

    A passage is a run of words of one document and epoch, in its own spelling
    and spacing; a document that is taken whole once has one row, its text. n_chars,
    where it is there, is the passage's; any other column is the document's, whatever
    its name. Texts are read again and found by their hashes, not stored in between;
    of copies one text a task is moved.
    """
    rows = sized(docs)
    sources = planned_sources(rows, block_words)
    own = ["_a", "_b"]
    ranges = F.sort_array(F.collect_list(F.struct("first", "last")))
    runs = mix(rows, sources, seed).groupBy(F.col("a").alias("_a"), F.col("b").alias("_b"), "copy", "epoch").agg(F.max("copies").alias("_copies"), ranges.alias("runs"))
    sizes = rows.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.first("size").alias("_size"))
    runs = staged(runs.join(sizes, own).select(*own, "_copies", "_size", F.transform("runs", lambda r: r["first"]).alias("_first"), F.transform("runs", lambda r: r["last"]).alias("_last")), "mix-runs")
    # the documents' columns go by number, so that none can clash
    number = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    texts = keyed(docs.toDF(*number.values()), number["doc_id"], number["text"], number["source"])
    several = runs.filter("_copies > 1")
    once = texts.join(runs.filter("_copies = 1"), own)
    moved = texts.join(several.select(*own).distinct(), own, "left_semi").groupBy(*own).agg(*(F.first(c).alias(c) for c in number.values())).join(several, own)
    columns = [*number.values(), "_size", "_first", "_last"]
    out = once.select(*columns).unionByName(moved.select(*columns))
    text_at = docs.columns.index("text")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("mixing")
        for batch in slices(batches, SLICE_BYTES, text_at):
            owners, texts = [], []
            sizes, firsts, lasts = (batch.column(i).to_pylist() for i in (-3, -2, -1))
            for k, (text, size, first, last) in enumerate(zip(batch.column(text_at).to_pylist(), sizes, firsts, lasts, strict=True)):
                for passage in passages(text, size, list(zip(first, last, strict=True))):
                    owners.append(k)
                    texts.append(passage)
            at = pa.array(owners, pa.int64())
            columns = {name: batch.column(k).take(at) for k, name in enumerate(number.values())}
            columns[number["text"]] = pa.array(texts, pa.string())
            if "n_chars" in number:
                columns[number["n_chars"]] = pa.array([len(t) for t in texts], pa.int64()).cast(columns[number["n_chars"]].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return out.mapInArrow(cut, out.select(*number.values()).schema).toDF(*docs.columns)


def passages(text: str, size: int, ranges: list[tuple[int, int]]) -> list[str]:
    """The texts of word ranges (sorted, without overlap), neighbours joined."""
    runs: list[list[int]] = []
    for first, last in ranges:
        if runs and runs[-1][1] == first:
            runs[-1][1] = last
        else:
            runs.append([first, last])
    if runs == [[0, size]]:
        return [text]
    spans = [m.span() for m in WORD.finditer(text)]
    return [text[spans[a][0] : spans[b - 1][1]] for a, b in runs]
