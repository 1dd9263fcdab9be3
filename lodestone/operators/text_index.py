"""A stored inverted index: immutable segments of postings under versioned manifests, with deletions, merges and ranked search."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.storage import create_text, kept, list_names, read_text, shared_folder, source_identity

K1, B = 1.2, 0.75
#: Terms of so many letters or fewer also find tokens that begin with them.
SHORT_TERM = 4
#: Folders of a segment's postings (a token's is told by its first two letters), postings of a block, and segments of about one size (within TIER times) that are merged.
BUCKETS, BLOCK, TIER, MERGE = 64, 1_024, 4, 4
#: Tokens that a task counts at once.
SLICE = 1 << 20
_BLOCKS = "bucket int, token string, ids array<long>, tfs array<int>, sizes array<int>, n int, most_tf int, least_size int"


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(BUCKETS)).cast("int")


#: What a task hands on: the postings of a token in some rows (data: ids as 8 bytes each, then counts and sizes as 4); or without a token the rows themselves (counts are not used).
_RUNS = "token string, first long, data binary"
_POSTING = np.dtype([("id", "<i8"), ("tf", "<i4"), ("size", "<i4")])


def _runs(code: np.ndarray, tokens: pa.Array, ids: np.ndarray, tfs: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """A row (token, first, data) for each token of postings, whose tokens are given by their number."""
    order = np.lexsort((ids, code))
    code = code[order]
    data = np.empty(len(code), _POSTING)
    data["id"], data["tf"], data["size"] = ids[order], tfs[order], sizes[order]
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
    offsets = (np.r_[begin, len(code)] * _POSTING.itemsize).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([tokens.take(pa.array(code[begin])), pa.array(data["id"][begin]), binary], ["token", "first", "data"])


def _counted(rows: DataFrame) -> DataFrame:
    """_RUNS of rows (id, tokens): how often each has a token, and its number of tokens; SLICE tokens at a time, or one row's."""
    most = SLICE

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy().astype(np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
                yield from counted(batch.slice(at, to - at))
                at = to

    def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists, ids = batch.column(1), batch.column(0).to_numpy()
        flat = lists.flatten().dictionary_encode()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int32)
        row = np.repeat(np.arange(len(sizes)), sizes)
        pair, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * len(sizes) + row, return_counts=True)
        code, row = np.divmod(pair, len(sizes))
        if len(code):
            yield _runs(code, flat.dictionary, ids[row], tf, sizes[row])
        yield _runs(np.zeros(len(ids), np.int64), pa.array([None], pa.string()), ids, np.zeros(len(ids)), sizes)

    filled = rows.select(F.col("id").cast("long").alias("id"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    return filled.mapInArrow(count, _RUNS)


def _regrouped(postings: DataFrame) -> DataFrame:
    """_RUNS of postings (token, id, tf, size)."""

    def group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = batch.column(0).dictionary_encode()
            yield _runs(token.indices.to_numpy(), token.dictionary, *(batch.column(c).to_numpy() for c in (1, 2, 3)))

    return postings.select("token", "id", "tf", "size").mapInArrow(group, _RUNS)


def _opened_rows(runs: DataFrame) -> DataFrame:
    """(id, size) of the rows that runs without a token tell of."""

    def open_(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                own = np.frombuffer(data.as_py(), _POSTING)
                yield pa.RecordBatch.from_arrays([pa.array(own["id"]), pa.array(own["size"])], ["id", "size"])

    return runs.filter("token IS NULL").select("data").mapInArrow(open_, "id long, size int")


def _blocks(runs: DataFrame) -> DataFrame:
    """_RUNS as rows of at most BLOCK postings, by token, and in a block by id. They are dealt out by ranges of token and first id, so a token that most rows have is split."""
    most = BLOCK

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        held: list[bytes] = []
        size = 0
        done: list[tuple] = []
        waiting = 0

        def cut(whole: bool) -> None:
            """Blocks of the held postings of a token; a rest below a block's length stays unless the token has ended."""
            nonlocal held, size, waiting
            own = np.frombuffer(b"".join(held), _POSTING)
            own = own[np.argsort(own["id"], kind="stable")]
            to = len(own) if whole else len(own) // most * most
            for at in range(0, to, most):
                part = own[at : min(at + most, to)]
                done.append((*last, part["id"], part["tf"], part["size"]))
                waiting += len(part)
            held, size = [own[to:].tobytes()] if to < len(own) else [], len(own) - to

        def handed() -> pa.RecordBatch:
            nonlocal waiting
            buckets, tokens, *lists = zip(*done, strict=True)
            lengths = np.array([len(x) for x in lists[0]])
            offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            begin = np.r_[0, np.cumsum(lengths)[:-1]]
            ids, tfs, sizes = (np.concatenate(x) for x in lists)
            columns = [pa.array(buckets, pa.int32()), pa.array(tokens, pa.string()), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, tfs, sizes)), pa.array(lengths.astype(np.int32)), pa.array(np.maximum.reduceat(tfs, begin)), pa.array(np.minimum.reduceat(sizes, begin))]
            done.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            for bucket, token, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if last != (bucket, token):
                    if held:
                        cut(True)
                    last = bucket, token
                held.append(data)
                size += len(data) // _POSTING.itemsize
                if size >= 16 * most:
                    cut(False)
                if waiting >= 64 * most or len(done) >= 10_000:
                    yield handed()
        if held:
            cut(True)
        if done:
            yield handed()

    named = runs.filter("token IS NOT NULL").withColumn("bucket", _bucket(F.col("token")))
    dealt = named.repartitionByRange("bucket", "token", "first").sortWithinPartitions("bucket", "token", "first")
    return dealt.select("bucket", "token", "data").mapInArrow(pack, _BLOCKS)


@dataclass(frozen=True)
class Segment:
    name: str
    number: int  # deletions with a higher number hold for it
    docs: int
    tokens: int


@dataclass(frozen=True)
class TextIndex:
    """A version of an index under a folder: its segments, and the numbers of its deletions (folders of ids)."""

    spark: SparkSession
    path: str
    version: int = 0
    segments: tuple[Segment, ...] = ()
    deletions: tuple[int, ...] = ()
    note: dict = field(default_factory=dict)

    @staticmethod
    def open(spark: SparkSession, path: str) -> TextIndex:
        """The last version; the empty version 0 where there is none."""
        versions = [int(n[1:-5]) for n in list_names(spark, path) if n.startswith("v") and n.endswith(".json")]
        if not versions:
            return TextIndex(spark, path)
        m = json.loads(read_text(spark, f"{path}/v{max(versions):09}.json"))
        return TextIndex(spark, path, max(versions), tuple(Segment(**s) for s in m["segments"]), tuple(m["deletions"]), m["note"])

    @staticmethod
    def of(rows: DataFrame, tokens: Column, id_col: str = "id", label: str = "") -> TextIndex:
        """The index of the rows' tokens in the shared folder, built where there is none yet of these rows (told by their files, or else by their contents) under this label."""
        spark = rows.sparkSession
        own = source_identity(rows)
        index = TextIndex.open(spark, f"{shared_folder(spark)}/text-index-{label}-{own}")
        return index if index.version else index.update(rows.select(F.col(id_col).alias("id"), tokens.alias("tokens")), note={"of": own})

    def _commit(self, segments: Iterable[Segment], deletions: Iterable[int], note: dict | None = None) -> TextIndex:
        """The next version; an error if another writer has made it meanwhile."""
        new = TextIndex(self.spark, self.path, self.version + 1, tuple(segments), tuple(deletions), note or self.note)
        text = json.dumps({"segments": [vars(s) for s in new.segments], "deletions": list(new.deletions), "note": new.note})
        create_text(self.spark, f"{self.path}/v{new.version:09}.json", text)
        return new

    def _write(self, runs: DataFrame, docs: DataFrame, number: int) -> Segment:
        name = f"seg-{number:09}-{uuid.uuid4().hex}"
        _blocks(runs).write.partitionBy("bucket").parquet(f"{self.path}/{name}/postings")
        docs.write.parquet(f"{self.path}/{name}/docs")
        counts = self.spark.read.parquet(f"{self.path}/{name}/docs").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()
        return Segment(name, number, counts.n, counts.t)

    def update(self, rows: DataFrame | None = None, gone: DataFrame | None = None, note: dict | None = None) -> TextIndex:
        """With rows (id, tokens) in place of those with their ids, and without the rows of gone (id); ids are whole numbers, each once in rows. Written is what is new alone."""
        number = max([0, *(s.number for s in self.segments), *self.deletions]) + 1
        ids = [d.select(F.col("id").cast("long").alias("id")) for d in (rows, gone) if d is not None]
        deletions, segments = self.deletions, self.segments
        if self.segments and ids:
            reduce(DataFrame.unionByName, ids).distinct().write.parquet(f"{self.path}/del-{number:09}")
            deletions += (number,)
        if rows is not None:
            runs = kept(_counted(rows.select("id", "tokens")))
            segments += (self._write(runs, _opened_rows(runs), number),)
        return self._commit(segments, deletions, note)

    def _alive(self, rows: DataFrame, segment: Segment) -> DataFrame:
        """A segment's rows (id, ...) without those that were deleted after it was written."""
        late = [self.spark.read.schema("id long").parquet(f"{self.path}/del-{d:09}") for d in self.deletions if d > segment.number]
        return rows.join(reduce(DataFrame.unionByName, late).distinct(), "id", "left_anti") if late else rows

    def _postings(self, segment: Segment, where: Column | None = None) -> DataFrame:
        """(token, id, tf, size) of a segment, of the blocks that the condition holds for."""
        stored = self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/{segment.name}/postings")
        some = stored if where is None else stored.filter(where)
        return self._opened(some, segment)

    def _opened(self, blocks: DataFrame, segment: Segment) -> DataFrame:
        flat = blocks.select("token", F.explode(F.arrays_zip("ids", "tfs", "sizes")).alias("p")).select("token", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.sizes").alias("size"))
        return self._alive(flat, segment)

    def _docs(self, segment: Segment) -> DataFrame:
        return self._alive(self.spark.read.schema("id long, size int").parquet(f"{self.path}/{segment.name}/docs"), segment)

    def merge(self, all_: bool = False) -> TextIndex:
        """MERGE or more segments of about one size become one, without what was deleted; deletions that hold for none any more go."""
        tiers: dict[int, list[Segment]] = {}
        for s in self.segments:
            tiers.setdefault(0 if all_ else int(math.log(max(1, s.docs), TIER)), []).append(s)
        segments = list(self.segments)
        for group in tiers.values():
            if len(group) >= (1 if all_ else MERGE):
                postings = reduce(DataFrame.unionByName, [self._postings(s) for s in group])
                docs = reduce(DataFrame.unionByName, [self._docs(s) for s in group])
                # as old as the youngest: what was deleted later still holds for it
                new = self._write(_regrouped(postings), docs, max(s.number for s in group))
                segments = [s for s in segments if s not in group] + [new]
        oldest = min((s.number for s in segments), default=0)
        return self._commit(segments, [d for d in self.deletions if d > oldest]) if segments != list(self.segments) else self

    def counts(self) -> tuple[int, int]:
        """Documents, and their tokens, that are there."""
        if not any(d > s.number for s in self.segments for d in self.deletions):
            return sum(s.docs for s in self.segments), sum(s.tokens for s in self.segments)
        r = reduce(DataFrame.unionByName, [self._docs(s) for s in self.segments]).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()
        return r.n, r.t

    def _where(self, terms: list[str], begins: bool) -> Column:
        """The blocks of the terms, and of tokens that begin with a short one; only their folders are opened."""
        hit = F.col("token").isin(*terms)
        for term in terms:
            if begins and len(term) <= SHORT_TERM:
                hit = hit | F.col("token").startswith(term)
        if begins and any(len(t) < 2 for t in terms):  # a beginning of one letter can be in any folder
            return hit
        folders = self.spark.range(1).select(*(_bucket(F.lit(t)) for t in terms)).first()
        return F.col("bucket").isin(*{int(b) for b in folders}) & hit

    def _found(self, terms: list[str], begins: bool = True) -> DataFrame:
        none = self.spark.createDataFrame([], "token string, id long, tf int, size int")
        if not terms:
            return none
        where = self._where(terms, begins)
        return reduce(DataFrame.unionByName, [self._postings(s, where) for s in self.segments], none)

    def candidates(self, terms: list[str]) -> DataFrame:
        """(id) of the rows with a token that is a term, or begins with one of four letters or fewer."""
        return self._found(list(dict.fromkeys(terms))).select("id").distinct()

    def bm25_parts(self, terms: list[str]) -> DataFrame:
        """(id, size, tf0, tf1 ...) of the candidates, a count for each term."""
        counts = [F.coalesce(F.sum(F.when(F.col("token") == t, F.col("tf"))), F.lit(0)).alias(f"tf{k}") for k, t in enumerate(terms)]
        return self._found(list(dict.fromkeys(terms))).groupBy("id").agg(F.max("size").alias("size"), *counts)

    def ranked(self, terms: list[str], k: int) -> DataFrame:
        """(id, score): the k best by BM25 with the mean length of all documents, ties to the lower id.

        Blocks keep their largest count and least length, so a block's best score is
        known before it is opened. The best blocks of each term give a score that k
        documents reach; blocks that can't reach it, whatever the other terms add, stay
        closed.
        """
        terms = list(dict.fromkeys(terms))
        n, tokens = self.counts()
        mean = tokens / n if n else 1.0
        none = self.spark.createDataFrame([], "id long, score double")
        if not terms or not n:
            return none
        stored = [(s, self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/{s.name}/postings").filter(self._where(terms, False))) for s in self.segments]
        lessened = {s.name for s, _ in stored if any(d > s.number for d in self.deletions)}
        sizes = [self._postings(s, self._where(terms, False)).select("token", F.lit(1).alias("n")) if s.name in lessened else b.select("token", "n") for s, b in stored]
        df = {r.token: r.n for r in reduce(DataFrame.unionByName, sizes).groupBy("token").agg(F.sum("n").alias("n")).collect()}  # a row a term
        if not df:
            return none
        weight = F.create_map(*[F.lit(x) for t, c in df.items() for x in (t, math.log((n - c + 0.5) / (c + 0.5) + 1))])

        def gain(tf: Column, size: Column) -> Column:
            return weight[F.col("token")] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))

        bound = gain(F.col("most_tf").cast("double"), F.col("least_size"))
        heads = kept(reduce(DataFrame.unionByName, [b.select(F.lit(i).alias("segment"), "token", F.col("ids")[0].alias("first"), "n", bound.alias("bound")) for i, (_, b) in enumerate(stored)]))
        best = {r.token: r.b for r in heads.groupBy("token").agg(F.max("bound").alias("b")).collect()}
        lead = heads.orderBy(F.desc("bound")).limit(max(4, -(-4 * k // BLOCK))).collect()

        def summed(postings: list[DataFrame]) -> DataFrame:
            return reduce(DataFrame.unionByName, postings).groupBy("id").agg(F.sum(gain(F.col("tf").cast("double"), F.col("size"))).alias("score"))

        def scored(least: float) -> DataFrame:
            total = sum(best.values())
            others = F.create_map(*[F.lit(x) for t, b in best.items() for x in (t, total - b)])
            return summed([self._opened(b.filter(bound + others[F.col("token")] >= least), s) for s, b in stored])

        threshold = 0.0
        if lead:
            heads_of = self.spark.createDataFrame([(r.segment, r.token, r.first) for r in lead], "segment int, token string, first long")
            opened = []
            for i, (s, b) in enumerate(stored):
                own = F.broadcast(heads_of.filter(F.col("segment") == i).select("token", "first"))  # as many rows as lead has
                opened.append(self._opened(b.withColumn("first", F.col("ids")[0]).join(own, ["token", "first"], "left_semi"), s))
            some = summed(opened).orderBy(F.desc("score")).limit(k).collect()
            threshold = some[-1].score * (1 - 1e-9) if len(some) == k else 0.0
        return scored(threshold).orderBy(F.desc("score"), "id").limit(k)
