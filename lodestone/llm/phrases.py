"""Phrase collocations: Apriori levels, counted by minimal perfect hashes.

Texts are cut once into blocks of word numbers. Level by level, a phrase of k words
is a candidate where both of its phrases of k - 1 words are frequent: its key is
the pair of their numbers, so keys are exact and no text is compared. Candidates
that a table of hashed counts shows to be rare go first (it never shows a count
that is too small). The rest are put in parts of bounded size, each with a
minimal perfect hash and its keys by slot, against which every hit is verified;
mappers count a part's slots with bincount, and their arrays are summed in a tree.
Counts of a phrase's cuts are then read by number from the levels below.

Blocks and levels are tables in the shared folder, so memory is bounded by a block
or a part, whatever the number of phrases, and no block is shuffled. There is one pass over a level's blocks
for each part of its candidates.

Results for hard inputs: a null text is empty, a null language is `und`, together
with a language of that name; an empty text, or one of stops only, has no words.
Repeated rows count as often as they are there. Words can be of any length and
hold any character besides those that cut. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import at_work, give_back, numbered, scratch, slices, staged, tuned

UNDETERMINED = "und"
#: Bytes of text of a block: what a row holds is then below what a JVM's collector takes for humongous, or not far above.
BLOCK_BYTES = 1 << 20
#: Blocks, levels' rows and arrays of keys that are written and read at once.
GROUP = 8
#: Candidates of a part (8 bytes each for the key, 8 for the count, some 4 bits for the hash), at most.
PART_KEYS = 1 << 20
#: Frequent words that are sent to the mappers at once.
PART_WORDS = 1 << 18
#: Hashed counters of a pass, and the windows that fall on one as a share of the least count; more windows take more passes.
BUCKETS, LOAD = 1 << 22, 0.25
#: Keys that a mapper holds before it hands them on, shares of a pass's keys, slots of a row of counts, rows that are joined at once.
HELD_KEYS, KEY_SHARES, CHUNK_SLOTS, FAN = 1 << 19, 16, 1 << 16, 32
#: Phrases are ranked within so many shares of a language first.
SHARES = 64
_LOW = (1 << 32) - 1
_BREAK = 10
_TABLE = bytes(_BREAK if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, texts, breaks): all words of the texts, lower-cased A-Z; of each the number of its text, and whether it is the first of a piece."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes().translate(_TABLE) if data and len(texts) else b""
    offsets = offsets - offsets[0]
    b = np.frombuffer(raw, np.uint8)
    inside = (b != 32) & (b != _BREAK)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    ends = np.cumsum(inside, dtype=np.int32)
    bounds = np.r_[ends[starts] - 1, ends[-1] if len(b) else 0].astype(np.int32)
    piece = np.cumsum(b == _BREAK, dtype=np.int32)[starts]
    text = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.ones(len(starts), bool)
    breaks[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(b[inside].tobytes())])
    return words, text, breaks


def block_of(texts: pa.Array, langs: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """(languages, words, counts, stream): the distinct words by language, and all words by their number among those, with -1 before each piece."""
    words, text, breaks = cut_words(texts)
    words, langs = words.dictionary_encode(), langs.dictionary_encode()
    own, lang = words.indices.to_numpy(), langs.indices.to_numpy()[text]
    n, m = len(words.dictionary), len(langs.dictionary)
    pair = lang.astype(np.int64) * n + own
    if n * m <= 8 << 20:
        counts = np.bincount(pair, minlength=n * m)
        there = np.flatnonzero(counts)
        number = np.zeros(n * m, np.int32)
        number[there] = np.arange(len(there))
        counts, at = counts[there], number[pair]
    else:
        there, at, counts = np.unique(pair, return_inverse=True, return_counts=True)
    stream = np.full(len(at) + int(breaks.sum()), -1, np.int32)
    stream[np.arange(len(at)) + np.cumsum(breaks)] = at
    return langs.dictionary.take(pa.array(there // max(n, 1))), words.dictionary.take(pa.array(there % max(n, 1))), counts, stream


def word_blocks(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(langs, words, counts, stream), staged: a row a block."""
    source = tuned(docs).select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(F.col(lang_col), F.lit(UNDETERMINED)).alias("_lang"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("phrases")
        for batch in slices(batches, BLOCK_BYTES):
            langs, words, counts, stream = block_of(batch.column(0), batch.column(1))
            if len(words):
                one = pa.array([0, len(words)], pa.int32())
                columns = [*(pa.ListArray.from_arrays(one, x) for x in (langs, words, pa.array(counts, pa.int64()))), pa.array([stream.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["langs", "words", "counts", "stream"])

    return staged(source.mapInArrow(cut, "langs array<string>, words array<string>, counts array<long>, stream binary"), "phrases-blocks", group=GROUP)


def _thin(stream: np.ndarray) -> np.ndarray:
    """Of breaks that follow each other one stays."""
    return stream[(stream >= 0) | np.r_[True, stream[:-1] >= 0]] if len(stream) else stream


def _row(*columns: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["stream", "found"][: len(columns)])


def word_level(blocks: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """(stream), staged: the blocks by the numbers of the frequent words (id, lang, phrase); what isn't frequent is a break. One pass for each part of the words."""
    streams = blocks.select("langs", "words", "stream", F.lit(None).cast("binary").alias("found"))
    parts = -(-n // PART_WORDS)
    for p in range(parts):
        last = p == parts - 1
        own = (words if parts == 1 else words.filter(F.pmod(F.xxhash64("lang", "phrase"), F.lit(parts)) == p)).select("lang", "phrase", "id").toArrow().combine_chunks()
        # words have no newline, so a key is told from any other
        keys = pc.binary_join_element_wise(own.column("lang").combine_chunks(), own.column("phrase").combine_chunks(), "\n")
        sent = blocks.sparkSession.sparkContext.broadcast((keys, np.r_[own.column("id").to_numpy(), -1].astype(np.int32)))

        def put(batches: Iterable[pa.RecordBatch], sent: Broadcast = sent, last: bool = last) -> Iterator[pa.RecordBatch]:
            at_work("phrases")
            keys, ids = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    langs, own, stream, found = (batch.column(c)[i] for c in range(4))
                    at = pc.fill_null(pc.index_in(pc.binary_join_element_wise(langs.values, own.values, "\n"), keys), len(ids) - 1)
                    number = np.r_[ids[at.to_numpy()], -1].astype(np.int32)  # the last is the break's
                    new = number[np.frombuffer(stream.as_py(), np.int32)]
                    if found.as_py() is not None:
                        new = np.maximum(new, np.frombuffer(found.as_py(), np.int32))
                    if last:
                        yield _row(_thin(new).tobytes())
                    else:
                        columns = [batch.column(c).slice(i, 1) for c in range(3)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array([new.tobytes()], pa.binary())], batch.schema.names)
                give_back()

        streams = staged(streams.mapInArrow(put, "stream binary" if last else streams.schema), "phrases-level", group=GROUP)
    return streams


def _pairs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two numbers follow each other, and the keys there."""
    at = np.flatnonzero((stream[:-1] >= 0) & (stream[1:] >= 0))
    return at, stream[at].astype(np.int64) << 32 | stream[at + 1]


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, with the keys by slot.

    Each level is a bit table of about twice the keys that are left; keys that are
    alone at their place stay there, the others go on to the next. A key's slot is
    the number of bits before its own (Limasset et al., 2017).
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        todo, before = np.ascontiguousarray(keys, np.int64), 0
        while len(todo):
            words = -(-2 * len(todo) // 64)
            place = (_mixed(todo, len(self.levels)) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(place, minlength=64 * words)[place] == 1
            bits = np.zeros(64 * words, np.uint8)
            bits[place[alone]] = 1
            table = np.packbits(bits, bitorder="little").view("<u8")
            ranks = np.bitwise_count(table).astype(np.int64)
            self.levels.append((64 * words, table, before + np.cumsum(ranks) - ranks))
            before += int(alone.sum())
            todo = todo[~alone]
        self.keys = np.zeros(0, np.int64)
        slots = self._slots(np.ascontiguousarray(keys, np.int64))
        self.keys = np.empty(len(keys), np.int64)
        self.keys[slots] = keys

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for seed, (size, table, ranks) in enumerate(self.levels):
            place = (_mixed(keys[todo], seed) % np.uint64(size)).astype(np.int64)
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            hit = table[word] >> bit & np.uint64(1) == 1
            word, bit = word[hit], bit[hit]
            out[todo[hit]] = ranks[word] + np.bitwise_count(table[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            todo = todo[~hit]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that isn't stored."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self._slots(keys)
        out[(out >= 0) & (self.keys[out] != keys)] = -1
        return out


def _streams(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    at_work("phrases")
    for batch in batches:
        for stream in batch.column(0):
            yield np.frombuffer(stream.as_py(), np.int32)
        give_back()


_COUNTED = "chunk long, task long, width int, slots int, counts binary"


def _counts_row(chunk: int, task: int, counts: np.ndarray) -> dict[str, pa.Array]:
    """Counters of a chunk, in as few bytes as its largest needs, compressed: with many passes most of them are 0, and what is shuffled goes by the windows, not by tasks times counters."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << 8 * w)
    packed = pa.compress(counts.astype(f"<u{width}").tobytes(), "zstd", asbytes=True)
    return {"chunk": pa.array([chunk], pa.int64()), "task": pa.array([task], pa.int64()), "width": pa.array([width], pa.int32()), "slots": pa.array([len(counts)], pa.int32()), "counts": pa.array([packed], pa.binary())}


def _counts_of(width: int, slots: int, counts: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(counts, width * slots, "zstd"), f"<u{width}").astype(np.int64)


def _counted(total: np.ndarray, chunk_slots: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for chunk, at in enumerate(range(0, len(total), chunk_slots)):
        counts = total[at : at + chunk_slots]
        if counts.any():
            row = _counts_row(chunk, task, counts)
            yield pa.RecordBatch.from_arrays(list(row.values()), list(row))


def _in_tree(rows: DataFrame, tasks: int, key: str, schema: str, join: Callable[[int, int, pa.Table], pa.Table]) -> DataFrame:
    """rows (key, task, ...) until one row a key is left: those of FAN neighbouring tasks are joined at a time."""

    def add(at: tuple, table: pa.Table) -> pa.Table:
        return join(at[0].as_py(), at[1].as_py(), table)

    while True:
        rows = rows.groupBy(key, F.floor(F.col("task") / FAN).cast("long").alias("of")).applyInArrow(add, schema)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return rows.drop("task")


def tree_summed(counts: DataFrame, tasks: int) -> DataFrame:
    """(chunk, width, slots, counts): the arrays of each chunk, summed."""

    def join(chunk: int, task: int, table: pa.Table) -> pa.Table:
        total = sum(_counts_of(*row) for row in zip(*(table.column(c).to_pylist() for c in ("width", "slots", "counts")), strict=True))
        return pa.table(_counts_row(chunk, task, total))

    return _in_tree(counts, tasks, "chunk", _COUNTED, join)


def _bucket(keys: np.ndarray, passes: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(pass, bucket) of each key."""
    h = _mixed(keys, 99)
    return (h >> np.uint64(40)) % np.uint64(passes), (h & np.uint64(buckets - 1)).astype(np.int64)


def frequent_buckets(level: DataFrame, least: int, passes: int, at: int) -> np.ndarray:
    """Bits (packed, BUCKETS of them): which buckets of the keys of a pass have `least` occurrences or more."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for stream in _streams(batches):
            own, bucket = _bucket(_pairs(stream)[1], passes, BUCKETS)
            which, n = np.unique(bucket[own == at], return_counts=True)
            total[which] += n.astype(np.int32)
        yield from _counted(np.minimum(total, least), CHUNK_SLOTS)  # more than the least count tells nothing

    counts = tree_summed(level.mapInArrow(count, _COUNTED), level.rdd.getNumPartitions())

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(_counts_of(*row) >= least).tobytes() for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["chunk", "bits"])

    out = np.zeros(BUCKETS // 8, np.uint8)
    for row in counts.mapInArrow(mark, "chunk long, bits binary").collect():  # BUCKETS / 8 bytes
        out[row.chunk * CHUNK_SLOTS // 8 :][: len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


_KEYS = "share long, task long, n long, keys binary"


def _keys_row(share: int, task: int, keys: np.ndarray) -> dict[str, pa.Array]:
    return {"share": pa.array([share], pa.int64()), "task": pa.array([task], pa.int64()), "n": pa.array([len(keys)], pa.int64()), "keys": pa.array([keys.tobytes()], pa.binary())}


def _shared(keys: np.ndarray, at: int, shares: int) -> Iterator[pa.RecordBatch]:
    """Distinct sorted keys as an array for each share of a pass."""
    share = (_mixed(keys, 7) % np.uint64(shares)).astype(np.int64)
    for k in range(shares):
        if len(own := keys[share == k]):
            row = _keys_row(at * shares + k, TaskContext.get().partitionId(), own)
            yield pa.RecordBatch.from_arrays(list(row.values()), list(row))


def candidate_keys(level: DataFrame, least: int) -> DataFrame:
    """(share, n, keys), staged: the keys that occur and whose bucket is frequent, each once, as arrays; as many passes as keep the buckets from filling up."""
    windows = (level.agg(F.sum(F.length("stream"))).first()[0] or 0) // 4
    passes = max(1, math.ceil(windows / (LOAD * least) / BUCKETS))
    found = []
    for at in range(passes):
        bits = frequent_buckets(level, least, passes, at)

        def find(batches: Iterable[pa.RecordBatch], at: int = at, bits: np.ndarray = bits) -> Iterator[pa.RecordBatch]:
            held, known = [np.empty(0, np.int64)], 0
            for stream in _streams(batches):
                keys = _pairs(stream)[1]
                own, bucket = _bucket(keys, passes, BUCKETS)
                held.append(np.unique(keys[(own == at) & (bits[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8) & 1 == 1)]))
                if sum(map(len, held)) > known + HELD_KEYS:
                    held = [np.unique(np.concatenate(held))]
                    known = len(held[0])
                    if known > HELD_KEYS:
                        yield from _shared(held[0], at, KEY_SHARES)
                        held, known = [held[0][:0]], 0
            yield from _shared(np.unique(np.concatenate(held)), at, KEY_SHARES)

        def join(share: int, task: int, table: pa.Table) -> pa.Table:
            return pa.table(_keys_row(share, task, np.unique(np.concatenate([np.frombuffer(b, np.int64) for b in table.column("keys").to_pylist()]))))

        found.append(staged(_in_tree(level.mapInArrow(find, _KEYS), level.rdd.getNumPartitions(), "share", _KEYS, join), "phrases-candidates", group=GROUP))
    return reduce(DataFrame.unionByName, found)


def key_parts(keys: DataFrame) -> Iterator[np.ndarray]:
    """All keys in parts of at most PART_KEYS, each by itself on the driver."""
    shares: list[int] = []
    size = 0
    sizes = [tuple(r) for r in keys.select("share", "n").orderBy("share").collect()]  # KEY_SHARES rows a pass
    for share, n in [*sizes, (None, 0)]:
        if shares and (share is None or size + n > PART_KEYS):
            rows = keys.filter(F.col("share").isin(shares)).select("keys").toArrow()
            own = np.concatenate([np.frombuffer(b, np.int64) for b in rows.column("keys").to_pylist()])
            yield from (own[at : at + PART_KEYS] for at in range(0, len(own), PART_KEYS))
            shares, size = [], 0
        shares.append(share)
        size += n


def phrase_parts(phrases: DataFrame, n: int) -> Iterator[pa.Table]:
    """The n phrases' (key, id) in parts of about PART_KEYS, each by itself on the driver."""
    parts = -(-n // PART_KEYS)
    for p in range(parts):
        own = phrases if parts == 1 else phrases.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == p)
        yield own.select("key", "id").toArrow()


def slot_counts(level: DataFrame, hashed: Broadcast, least: int) -> DataFrame:
    """(key, f): of a part's keys those that occur `least` times or more."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: PerfectHash = hashed.value
        total = np.zeros(len(part.keys), np.int64)
        for stream in _streams(batches):
            slots = part.slots(_pairs(stream)[1])
            total += np.bincount(slots[slots >= 0], minlength=len(total))
        yield from _counted(total, CHUNK_SLOTS)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: PerfectHash = hashed.value
        for batch in batches:
            for chunk, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = _counts_of(*counts)
                some = np.flatnonzero(f >= least)
                yield pa.RecordBatch.from_arrays([pa.array(part.keys[some + chunk * CHUNK_SLOTS]), pa.array(f[some])], ["key", "f"])

    counts = tree_summed(level.mapInArrow(count, _COUNTED), level.rdd.getNumPartitions())
    return counts.mapInArrow(read, "key long, f long")


def next_level(level: DataFrame, phrases: DataFrame, n: int) -> DataFrame:
    """(stream), staged: where phrases (key, id) of one word more begin, by their numbers; one pass for each part of them."""
    streams = level.select("stream", F.lit(None).cast("binary").alias("found"))
    parts = -(-n // PART_KEYS)
    for p, part in enumerate(phrase_parts(phrases, n)):
        last = p == parts - 1
        hashed = PerfectHash(part.column("key").to_numpy())
        ids = np.empty(len(hashed.keys), np.int32)
        ids[hashed.slots(part.column("key").to_numpy())] = part.column("id").to_numpy()
        sent = level.sparkSession.sparkContext.broadcast((hashed, ids))

        def put(batches: Iterable[pa.RecordBatch], sent: Broadcast = sent, last: bool = last) -> Iterator[pa.RecordBatch]:
            at_work("phrases")
            hashed, ids = sent.value
            for batch in batches:
                for old, found in zip(batch.column(0), batch.column(1), strict=True):
                    stream = np.frombuffer(old.as_py(), np.int32)
                    new = np.full(len(stream), -1, np.int32) if found.as_py() is None else np.frombuffer(found.as_py(), np.int32).copy()
                    at, keys = _pairs(stream)
                    slots = hashed.slots(keys)
                    new[at[slots >= 0]] = ids[slots[slots >= 0]]
                    if not last:
                        yield _row(old.as_py(), new.tobytes())
                    elif (new >= 0).any():
                        yield _row(_thin(new).tobytes())
                give_back()

        streams = staged(streams.mapInArrow(put, "stream binary" if last else "stream binary, found binary"), "phrases-level", group=GROUP)
    return streams


def levels(blocks: DataFrame, least: int, longest: int) -> list[DataFrame]:
    """For 1 to `longest` words (id, lang, phrase, last, f, first, rest, firsts, rests), staged: the phrases with `least` occurrences.

    first and rest are the numbers, in the level below, of a phrase without its last
    and without its first word; firsts and rests the counts of its 1, 2 ... first
    and last words, up to the whole.
    """
    entries = blocks.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("w"))
    words = entries.groupBy(F.col("w.langs").alias("lang"), F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("f")).filter(F.col("f") >= least)
    none = F.lit(None).cast("long")
    words = numbered(words, "id", "lang", "phrase").select("id", "lang", "phrase", F.col("phrase").alias("last"), "f", none.alias("first"), none.alias("rest"), F.array("f").alias("firsts"), F.array("f").alias("rests"))
    out, level = [words], None
    for k in range(2, longest + 1):
        n = out[-1].count()
        if n > 1 << 31:
            raise ValueError(f"{n} phrases of {k - 1} words: numbers have 31 bits")
        if not n:
            break
        level = word_level(blocks, words, n) if level is None else next_level(level, out[-1], n)
        found = []
        for part in key_parts(candidate_keys(level, least)):
            hashed = level.sparkSession.sparkContext.broadcast(PerfectHash(part))
            found.append(staged(slot_counts(level, hashed, least), "phrases-counts"))
            hashed.unpersist()
        if not found:
            break
        pairs = numbered(reduce(DataFrame.unionByName, found), "id", "key").select("id", "key", "f", F.shiftright("key", 32).alias("first"), F.col("key").bitwiseAND(_LOW).alias("rest"))
        a = out[-1].select(F.col("id").alias("first"), "lang", F.col("phrase").alias("_p"), "firsts")
        b = out[-1].select(F.col("id").alias("rest"), F.col("last"), "rests")
        grown = [F.concat(F.col(c), F.array("f")).alias(c) for c in ("firsts", "rests")]
        out.append(staged(pairs.join(a, "first").join(b, "rest").select("id", "key", "lang", F.concat_ws(" ", "_p", "last").alias("phrase"), "last", "f", "first", "rest", *grown), "phrases-phrases"))
    return out


def _least_cut(k: int) -> Column:
    """struct(score, cut, l, r): the lowest floor(1000 * a * n / (l * r)) over the cuts; ties to the shortest first part."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    cuts = []
    for j in range(1, k):
        left, right = F.element_at("firsts", j), F.element_at("rests", k - j)
        above = wide(F.col("f"), 16) * F.lit(1000).cast("decimal(4,0)") * wide(F.col("n"), 16)
        # a whole division, exact to 38 digits
        score = F.call_function("div", above, wide(left, 18) * wide(right, 18))
        cuts.append(F.struct(score.alias("score"), F.lit(j).alias("cut"), left.alias("l"), right.alias("r")))
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, absorbed_percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, words), staged: each language's best phrases of 2 to `longest` words.

    a counts a phrase, n all words of its language, l and r the two parts of its
    lowest cut. A phrase goes where a longer one that holds it occurs at least
    absorbed_percent as often; as counts never grow with length, one word more tells.
    """
    with scratch(docs.sparkSession):
        blocks = word_blocks(docs, text_col, lang_col)
        totals = staged(blocks.select(F.explode(F.arrays_zip("langs", "counts")).alias("w")).groupBy(F.col("w.langs").alias("lang")).agg(F.sum("w.counts").alias("n")), "phrases-totals")
        found = levels(blocks, least, longest)
        scored = []
        for k, phrases in enumerate(found[1:], 2):
            own = phrases
            if k < len(found):
                longer = found[k].select(F.explode(F.array("first", "rest")).alias("id"), F.col("f").alias("_f")).groupBy("id").agg(F.max("_f").alias("_f"))
                own = phrases.join(longer, "id", "left").filter(F.coalesce(F.col("_f") * 100 < F.col("f") * absorbed_percent, F.lit(True)))
            cut = own.join(totals, "lang").withColumn("_cut", _least_cut(k))
            scored.append(cut.select("lang", "phrase", F.col("f").alias("a"), F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"), F.lit(k).alias("words")))
        if not scored:
            return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long, words int")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
        rows = reduce(DataFrame.unionByName, scored).withColumn("_at", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).filter(F.col("_at") <= top).drop("_at")
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
        return staged(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words"), "phrases-result", outside=True)


def collocations_sql(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    """DuckDB's SQL for the same rows, without the column words."""
    grams = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i:i + {k - 1}], ' ') AS phrase, {k} AS k FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in range(1, longest + 1))
    return f"""
WITH cut AS (SELECT coalesce(lang, '{UNDETERMINED}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
counts AS (SELECT lang, phrase, k, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, j, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM counts WHERE k > 1) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:j], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT DISTINCT o.lang, array_to_string(o.w[i:i + m - 1], ' ') AS phrase, o.f FROM (SELECT lang, f, k, m, string_split(phrase, ' ') AS w, unnest(range(1, k - m + 2)) AS i FROM counts, range(2, {longest}) s(m) WHERE k > m) o),
kept AS (SELECT * FROM lowest x WHERE NOT EXISTS (SELECT 1 FROM inner_ y WHERE y.lang = x.lang AND y.phrase = x.phrase AND 100 * y.f >= 100 * x.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= {top}
"""
