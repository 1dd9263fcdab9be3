"""Dense-vector retrieval: quantised index, inner-product top-k, recall, noise."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.vector import LEAST_SCALE, QUANTILE, dot, hadamard, quantised, robust_scale, rotated, total
from lodestone.sources.storage import kept, read_text, shared_folder, write_text

#: Queries, and bytes of their vectors, that are sent to every task at once; more of them go in blocks, each with a pass over the documents.
QUERY_BLOCK, QUERY_BYTES = 4_096, 32 << 20
#: Scores, or numbers of vectors, that a task has at once, whatever the number of queries.
TILE = 1 << 20
#: Vectors of a stored index's block, and the name of its manifest.
BLOCK_ROWS, MANIFEST = 4_096, "_manifest.json"


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as doubles, one row a list."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column):
        return values.reshape(0, 0)
    if len(values) % len(column) or set(np.diff(column.offsets.to_numpy()).tolist()) - {len(values) // len(column)}:
        raise ValueError("vectors differ in length")
    return values.reshape(len(column), -1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score): the k best of each row of scores, ties to the lower id."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        row, at = np.nonzero(scores >= kth[:, None])
    else:
        row, at = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[at], -scores[row, at], row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, at = row[place < k], at[place < k]
    return row, ids[at], scores[row, at]


def _sent(queries: DataFrame) -> Iterator[dict]:
    """The queries (id, vector) in blocks that are bounded in rows and bytes: ids, and vectors as a matrix."""
    id_col, vector = queries.columns[:2]
    queries = queries.filter(F.col(vector).isNotNull())
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
    blocks = max(1, -(-size.n // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * (size.width or 1))))))
    part = F.pmod(F.xxhash64(id_col), F.lit(blocks))
    for b in range(blocks):
        block = queries.filter(part == b).toArrow().combine_chunks()
        yield {"id": block.column(0).to_numpy(), "v": matrix(block.column(1).combine_chunks())}


def _tiles(rows: int, queries: int, width: int) -> Iterator[slice]:
    """Runs of vectors whose scores with all queries, and whose numbers, are TILE at most."""
    step = max(1, TILE // max(1, queries, width))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def _vectors(batches: Iterable[pa.RecordBatch], queries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of batches (id, vector), a tile at a time."""
    for batch in batches:
        if batch.num_rows and queries:
            for part in _tiles(batch.num_rows, queries, len(batch.column(1)[0])):
                some = batch.slice(part.start, part.stop - part.start)
                yield some.column(0).to_numpy(), matrix(some.column(1))


def _kept_best(scored: Iterable[tuple[np.ndarray, np.ndarray]], query_ids: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Of (ids, scores of all queries with them) the k best of each query."""
    held = None
    least = np.full(len(query_ids), -np.inf)  # what a score has to reach, once k are held
    for ids, scores in scored:
        if held is None:
            row, ids, s = _best(scores, ids, k)
        else:
            row, at = np.nonzero(scores >= least[:, None])
            if not len(row):
                continue
            row, ids, s = (np.r_[a, x] for a, x in zip(held, (row, ids[at], scores[row, at]), strict=True))
            order = np.lexsort((ids, -s, row))
            row, ids, s = row[order], ids[order], s[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, ids, s = row[top], ids[top], s[top]
        held = row, ids, s
        last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
        least[row[last]] = s[last]
    if held is not None:
        row, ids, s = held
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(ids), pa.array(s)], ["query_id", "doc_id", "score"])


def search_exact(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best inner products in double of a stated set of queries with all documents, both (vec_id, embedding).

    Scored as products of matrices; a task keeps k rows a query, and only those are
    shuffled. Rows without a vector are left out.
    """
    docs = docs.select("vec_id", "embedding").filter("embedding IS NOT NULL")
    kind, found = docs.schema["vec_id"].dataType.simpleString(), []
    for sent in _sent(queries.select("vec_id", "embedding")):

        def best(batches: Iterable[pa.RecordBatch], sent: dict = sent) -> Iterator[pa.RecordBatch]:
            yield from _kept_best(((ids, np.round(sent["v"] @ x.T, 6)) for ids, x in _vectors(batches, len(sent["id"]))), sent["id"], k)

        found.append(docs.mapInArrow(best, f"query_id {kind}, doc_id {kind}, score double"))
    return top_k(reduce(DataFrame.unionByName, found), k)


def quantised_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, sums) of a matrix's rows, as robust_scale, quantised and total give them for lists."""
    sizes = np.sort(np.abs(x), axis=1)
    place = (x.shape[1] - 1) * QUANTILE
    low = int(place)
    below, above = sizes[:, low], sizes[:, min(low + 1, x.shape[1] - 1)]
    scale = np.maximum((below + (above - below) * (place - low)) / 127, LEAST_SCALE)
    q = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    return q, scale, q.sum(axis=1, dtype=np.int64)


@dataclass(frozen=True)
class VectorIndex:
    """A stored index of one corpus: blocks of 8-bit vectors with a scale and a sum for each, under a manifest that names the corpus."""

    blocks: DataFrame
    rows: int
    width: int

    @staticmethod
    def identity(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> dict[str, int | str]:
        """What tells a corpus from others: its rows, and two sums over the hashes of all ids and vectors, in any order."""
        h = F.xxhash64(F.col(id_col), F.col(vector_col))
        r = vectors.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
        return {"rows": r.n, "digest": f"{r.x & (1 << 64) - 1:016x}-{int(r.s) & (1 << 128) - 1:032x}", "id": id_col, "vector": vector_col}

    @staticmethod
    def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        """Writes the index; the manifest comes last, so what has one is whole. Vectors that are null, empty or hold a null or a non-finite entry are left out."""
        spark = vectors.sparkSession
        source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v IS NOT NULL AND size(v) > 0")

        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1))
                good = np.flatnonzero(np.isfinite(x).all(axis=1))
                for at in range(0, len(good), BLOCK_ROWS):
                    own = good[at : at + BLOCK_ROWS]
                    q, scale, sums = quantised_rows(x[own])
                    ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), batch.column(0).take(pa.array(own)))
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), ids, *(pa.array([b.tobytes()], pa.binary()) for b in (q, scale, sums))], ["width", "ids", "q", "scale", "sums"])

        data = f"{path}/data-{uuid.uuid4().hex}"
        kind = source.schema["id"].dataType.simpleString()
        source.mapInArrow(pack, f"width int, ids array<{kind}>, q binary, scale binary, sums binary").write.parquet(data)
        widths = spark.read.parquet(data).agg(F.min("width").alias("a"), F.max("width").alias("b"), F.sum(F.size("ids")).alias("n")).first()
        if widths.a != widths.b:
            raise ValueError("vectors differ in length")
        manifest = {**VectorIndex.identity(vectors, id_col, vector_col), "indexed": widths.n or 0, "width": widths.b or 0, "data": data.rsplit("/", 1)[1]}
        write_text(spark, f"{path}/{MANIFEST}", json.dumps(manifest))
        return VectorIndex.open(vectors, path)

    @staticmethod
    def open(vectors: DataFrame, path: str) -> VectorIndex:
        """The index under path, if it is that of these vectors and all of it is there; an error otherwise."""
        spark = vectors.sparkSession
        text = read_text(spark, f"{path}/{MANIFEST}")
        if text is None:
            raise FileNotFoundError(f"no index under {path}")
        m = json.loads(text)
        if any(m[k] != v for k, v in VectorIndex.identity(vectors, m["id"], m["vector"]).items()):
            raise ValueError(f"the index under {path} is that of another corpus")
        blocks = spark.read.parquet(f"{path}/{m['data']}")
        if (blocks.agg(F.sum(F.size("ids"))).first()[0] or 0) != m["indexed"]:
            raise ValueError(f"the index under {path} is not whole")
        return VectorIndex(blocks, m["indexed"], m["width"])

    @staticmethod
    def of(vectors: DataFrame, path: str | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        """The stored index of these vectors, built where there is none of them yet; without a path in the shared folder, under the corpus's identity."""
        own = VectorIndex.identity(vectors, id_col, vector_col)
        path = path or f"{shared_folder(vectors.sparkSession)}/vector-index-{own['digest']}"
        try:
            return VectorIndex.open(vectors, path)
        except (FileNotFoundError, ValueError):
            return VectorIndex.build(vectors, path, id_col, vector_col)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, doc_id, score) for queries (id, vector): whole-number inner products of the biased queries, the bias taken out again by the documents' sums, then scaled."""
        kind, found = self.blocks.schema["ids"].dataType.elementType.simpleString(), []
        for sent in _sent(queries):
            q, scale, _ = quantised_rows(sent["v"]) if len(sent["id"]) else (np.zeros((0, 1), np.int8), np.zeros(0), None)
            if len(sent["id"]) and self.rows and q.shape[1] != self.width:
                raise ValueError(f"queries of {q.shape[1]} numbers for vectors of {self.width}")
            mine = {"id": sent["id"], "q": q.astype(np.float64) + 128, "scale": scale}

            def scores(batches: Iterable[pa.RecordBatch], mine: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for batch in batches:
                    for i in range(batch.num_rows if len(mine["id"]) else 0):
                        ids = batch.column(0)[i].values.to_numpy()
                        own, scale, sums = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in ((1, np.int8), (2, np.float64), (3, np.int64)))
                        own = own.reshape(len(ids), -1)
                        for t in _tiles(len(ids), len(mine["id"]), own.shape[1]):
                            plain = mine["q"] @ own[t].T.astype(np.float64) - sums[t] * 128.0  # whole numbers far below 2^53
                            yield ids[t], np.round(plain * mine["scale"][:, None] * scale[t], 6)

            def best(batches: Iterable[pa.RecordBatch], mine: dict = mine) -> Iterator[pa.RecordBatch]:
                yield from _kept_best(scores(batches, mine), mine["id"], k)

            found.append(self.blocks.select("ids", "q", "scale", "sums").mapInArrow(best, f"query_id {kind}, doc_id {kind}, score double"))
        return top_k(reduce(DataFrame.unionByName, found), k)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, q, scale, q_sum): one byte's worth of information a dimension."""
    scaled = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col), F.col(vector_col).alias("v"), robust_scale(F.col(vector_col)).alias("scale"))
    q = scaled.withColumn("q", quantised(F.col("v"), F.col("scale")))
    return q.select(id_col, "q", "scale", total(F.col("q")).alias("q_sum"))


def top_k(scores: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, rank, doc, score): ties go to the lower doc; only k rows a query and partition are shuffled."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(query, "rank", doc, "score")


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall): the mean over the queries of the share of the truth's k that was found."""
    hits = truth.join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    by_query = hits.groupBy("query_id").agg((F.coalesce(F.sum("hit"), F.lit(0)) / k).alias("share"))
    return by_query.agg(F.round(F.avg("share"), 6).alias("recall"))


def score_noise(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(n, mean_error, var_error) of quantised against exact inner products of a stated set of queries with all vectors (vec_id, embedding).

    Both products are blocks of matrices, and a task hands on the sums of its errors.
    """
    docs, found = vectors.select("vec_id", "embedding").filter("embedding IS NOT NULL"), []
    moments = "n long, s double, s2 double"
    for sent in _sent(queries.select("vec_id", "embedding")):
        if not len(sent["id"]):
            continue
        q, scale, _ = quantised_rows(sent["v"])
        mine = {"v": sent["v"], "q": q.astype(np.float64), "scale": scale}

        def errors(batches: Iterable[pa.RecordBatch], mine: dict = mine) -> Iterator[pa.RecordBatch]:
            for _, x in _vectors(batches, len(mine["v"])):
                own, scale, _ = quantised_rows(x)
                e = (mine["q"] @ own.T.astype(np.float64)) * mine["scale"][:, None] * scale - mine["v"] @ x.T
                yield pa.RecordBatch.from_arrays([pa.array([e.size]), pa.array([e.sum()]), pa.array([(e * e).sum()])], ["n", "s", "s2"])

        found.append(docs.mapInArrow(errors, moments))
    sums = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], moments)
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    return sums.agg(F.coalesce(n, F.lit(0)).alias("n"), F.round(mean, 6).alias("mean_error"), F.round(F.sum("s2") / n - mean * mean, 8).alias("var_error"))


def noise_bounds(vectors: DataFrame, is_query: Column, t: float) -> DataFrame:
    """(vec_id, tail, noise) of each vector.

    tail: a bound of the chance that a rotated unit vector has a coordinate above t.
    noise: the variance of a quantised score as two terms predict it, the
    document's steps against the queries' mean square length and the other way round.
    """
    n, norm2, step = F.size("embedding"), dot(F.col("embedding"), F.col("embedding")), robust_scale(F.col("embedding")) * 2
    own = vectors.select("vec_id", n.alias("n"), norm2.alias("norm2"), (step * step).alias("step2"), is_query.alias("is_query"))
    q = own.filter("is_query").agg(F.avg("norm2").alias("q_norm2"), F.avg("step2").alias("q_step2"))
    tail = F.least(F.lit(1.0), F.col("n") * 2 * F.exp(-F.col("n") * t * t / 2))
    noise = F.col("q_norm2") * F.col("step2") / 12 + F.col("norm2") * F.col("q_step2") / 12
    return own.crossJoin(F.broadcast(q)).select("vec_id", F.round(tail, 8).alias("tail"), F.round(noise, 12).alias("noise"))


def flip_probability(gap: Column, noise: Column) -> Column:
    """The chance that noise of that variance on both scores turns two items whose true scores differ by gap: the normal distribution below -gap / sqrt(2 noise)."""

    @F.pandas_udf("double")
    def below(z: pd.Series) -> pd.Series:
        from math import erfc, sqrt

        return z.map(lambda x: None if x is None else erfc(x / sqrt(2)) / 2)

    return below(gap / F.sqrt(noise * 2))


def rotation_table(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(method, mse, recall): what quantisation loses as it is, after the plain Hadamard transform, and after the randomised one."""

    @F.pandas_udf("array<double>")
    def transformed(v: pd.Series) -> pd.Series:
        return pd.Series(list(hadamard(np.stack(v.to_numpy())))) if len(v) else v

    vectors = vectors.filter("embedding IS NOT NULL")
    truth = search_exact(vectors, queries, k)
    ids = queries.select("vec_id")
    out = None
    for method, turned in (("none", F.col("embedding")), ("hadamard", transformed(F.col("embedding"))), ("randomised", rotated(F.col("embedding")))):
        own = kept(vectors.select("vec_id", turned.cast("array<double>").alias("embedding")))
        index = build_index(own)
        loss = own.join(index, "vec_id").select(F.aggregate(F.zip_with("embedding", "q", lambda x, q: (x.cast("double") - q * F.col("scale")) ** 2), F.lit(0.0), lambda a, x: a + x).alias("e")).agg(F.round(F.avg("e"), 9).alias("mse"))
        hit = recall(VectorIndex.of(own).search(own.join(ids, "vec_id", "left_semi"), k), truth, k)
        row = loss.crossJoin(hit).select(F.lit(method).alias("method"), "mse", "recall")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def gaussian_clusters(spark: SparkSession, n: int, width: int, centres: int = 20, sigma: float = 0.5, seed: int = 1234) -> DataFrame:
    """(vec_id, label, embedding): n vectors of length one around so many centres; a row depends on its id and the seed alone."""
    block = 1_024

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.random.default_rng(seed).standard_normal((centres, width))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for b in np.unique(ids // block).tolist():
                random = np.random.default_rng([seed, b])
                label = random.integers(0, centres, block)
                x = middle[label] + sigma * random.standard_normal((block, width))
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                own = ids[ids // block == b]
                at = own - b * block
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * width), pa.array(x[at].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(label[at].astype(np.int32)), lists], ["vec_id", "label", "embedding"])

    return spark.range(n).mapInArrow(draw, "vec_id long, label int, embedding array<float>")
