"""Embedding whitening by LOBPCG: leading eigenvectors of a covariance that is never built.

Vectors are stored once as blocks of numbers. A product of the covariance with a
few columns is one pass over the blocks: each task centres its rows, multiplies,
and adds up, and the tasks' sums are added in a tree. The locally optimal block
preconditioned conjugate gradient method (Knyazev, 2001) does a Rayleigh-Ritz step
on the span of the iterate, the residuals and the previous directions, and needs
one such product a step, with the new residuals; those of the rest follow from
their coefficients. Residuals that end it are certified by a product made anew.

Results for hard inputs: a vector that is null, empty, or has an entry that is
null, infinite or no number is left out, and so is one whose length isn't the
most frequent (ties: the longer). A null id is a row like any other; repeated rows
count as often as they are there. Directions without variance (below 1e-12 of the
largest) are no components, so a table without vectors, or with equal ones only,
has no result. Whole entries are kept within 62 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_work, one_blas_thread, staged

#: Rows and bytes (as doubles) of a block.
BLOCK_ROWS, BLOCK_BYTES = 4_096, 8 << 20
#: So many sums are added at once.
FAN = 64
#: Directions beside those that are asked for; a residual counts as zero, and a variance as none, below these shares of the largest eigenvalue.
GUARD, TOLERANCE, NO_VARIANCE = 8, 1e-12, 1e-12
MOST_STEPS = 500
_BIT_62 = 1 << 62


@dataclass
class Fit:
    """centre: the whole part of the means (0 for real vectors), rest: what is missing to the means; vectors: a column a component."""

    n: int
    sums: list[int] | None
    centre: np.ndarray
    rest: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    steps: int


def store_blocks(rows: DataFrame, id_col: str, vector_col: str, scale: float | None = None, offset: int = 0) -> DataFrame:
    """(width, n, ids, kind, low, data, whole, real), staged: the usable vectors in blocks, and the blocks' sums by dimension.

    With a scale, an entry c is the whole number floor(scale * c) + offset, stored in
    as few bytes as the block needs; without one it is a double.
    """
    source = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    id_kind = source.schema["_id"].dataType.simpleString()

    def block(ids: pa.Array, x: np.ndarray) -> dict:
        low, kind = 0, "<f8"
        if scale is None:
            whole, real = [None] * x.shape[1], x.sum(axis=0).tolist()
        else:
            x = np.clip(np.floor(x * scale), -_BIT_62, _BIT_62 - abs(offset) - 1).astype(np.int64) + offset
            low = int(x.min())
            most = int(x.max()) - low
            kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * int(k[2]))
            x = (x - low).astype(kind)
            exact = x.sum(axis=0, dtype=np.int64) if most * len(x) < _BIT_62 else x.astype(object).sum(axis=0)
            whole = [Decimal(int(s) + low * len(x)) for s in exact.tolist()]
            real = [float(s) for s in whole]
        return {"width": x.shape[1], "n": len(x), "ids": ids, "kind": kind, "low": low, "data": np.ascontiguousarray(x).tobytes(), "whole": whole, "real": real}

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("whitening")
        ids_type = None
        held: dict[int, tuple[list[pa.Array], list[np.ndarray]]] = {}

        def out(width: int) -> pa.RecordBatch:
            ids, parts = held.pop(width)
            b = block(pa.concat_arrays(ids), np.concatenate(parts))
            lists = pa.ListArray.from_arrays(pa.array([0, b["n"]], pa.int32()), b["ids"])
            columns = [pa.array([b["width"]], pa.int32()), pa.array([b["n"]], pa.int64()), lists.cast(pa.list_(ids_type)), pa.array([b["kind"]]), pa.array([b["low"]], pa.int64()), pa.array([b["data"]], pa.binary()), pa.array([b["whole"]], pa.list_(pa.decimal128(38, 0))), pa.array([b["real"]], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, ["width", "n", "ids", "kind", "low", "data", "whole", "real"])

        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            ids_type = ids.type
            widths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(widths)
            bad = np.bincount(np.repeat(np.arange(len(widths)), widths)[~np.isfinite(values)], minlength=len(widths)) > 0
            for width in np.unique(widths[(widths > 0) & ~bad]).tolist():
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
                own = np.flatnonzero((widths == width) & ~bad)
                while len(own):
                    there = held.setdefault(width, ([], []))
                    now = own[: most - sum(map(len, there[1]))]
                    there[0].append(ids.take(pa.array(now)))
                    there[1].append(values[(ends[now] - width)[:, None] + np.arange(width)])
                    own = own[len(now) :]
                    if sum(map(len, there[1])) >= most:
                        yield out(width)
            while sum(len(x) * w for w, (_, xs) in held.items() for x in xs) > BLOCK_BYTES // 8:  # vectors of many lengths
                yield out(next(iter(held)))
        while held:
            yield out(next(iter(held)))

    return staged(source.mapInArrow(pack, f"width int, n long, ids array<{id_kind}>, kind string, low long, data binary, whole array<decimal(38,0)>, real array<double>"), "whitening-blocks")


def _centred(kind: str, low: int, data: bytes, centre: np.ndarray, rest: np.ndarray) -> np.ndarray:
    x = np.frombuffer(data, kind).reshape(-1, len(centre))
    if kind == "<f8":
        return (x - centre) - rest
    return (x.astype(np.int64) + (low - centre)).astype(np.float64) - rest


def summed(blocks: DataFrame, centre: np.ndarray, rest: np.ndarray, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all blocks of part(centred rows), which has the same shape for each: added within tasks, then in a tree."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("whitening")
        total = None
        with one_blas_thread():
            for batch in batches:
                for kind, low, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = part(_centred(kind, low, data, centre, rest))
                    total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sum"])

    def join(key: tuple, batch: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in batch.column("sum").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "sum": pa.array([total.tobytes()], pa.binary())})

    sums = blocks.select("kind", "low", "data").mapInArrow(add, "part long, sum binary")
    tasks = blocks.rdd.getNumPartitions()
    while tasks > FAN:
        sums = sums.groupBy(F.floor(F.col("part") / FAN).cast("long").alias("key")).applyInArrow(join, "part long, sum binary")
        tasks = -(-tasks // FAN)
    rows = sorted(sums.collect(), key=lambda r: r.part)  # at most FAN
    return sum(np.frombuffer(r["sum"], np.float64) for r in rows) if rows else None


def _basis(w: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """An orthonormal basis of w's columns (each of length one or nothing), without directions that are nearly dependent."""
    size = np.linalg.norm(w, axis=0)
    w = w[:, size > 0] / size[size > 0]
    if not w.shape[1]:
        return w
    u, s, _ = np.linalg.svd(w, full_matrices=False)
    return u[:, s > least * s[0]]


def _apart(w: np.ndarray, known: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what w has outside the span of known (orthonormal)."""
    size = np.linalg.norm(w, axis=0)
    w = w[:, size > 0] / size[size > 0]
    for _ in range(2):
        w = w - known @ (known.T @ w)
    w = w[:, np.linalg.norm(w, axis=0) > 1e-10]
    w = _basis(w)[:, : known.shape[0] - known.shape[1]]
    w = w - known @ (known.T @ w)
    return np.linalg.qr(w)[0] if w.shape[1] else w


def lobpcg(product: Callable[[np.ndarray], np.ndarray], width: int, k: int, tolerance: float = TOLERANCE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(values, vectors, residuals, steps): the k largest eigenpairs of a symmetric operator, given by its product with a block of columns.

    The residuals are those of a product with the final vectors, relative to the
    largest value. An error if they stay above the tolerance for MOST_STEPS.
    """
    m = min(width, k + GUARD)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, m)))[0]
    cx, fresh = product(x), True
    p = cp = np.empty((width, 0))
    for step in range(MOST_STEPS):
        t = x.T @ cx
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, cx = x @ turn, cx @ turn
        residual = cx - x * values
        sizes = np.linalg.norm(residual, axis=0) / max(values[0], np.finfo(float).tiny)
        if values[0] <= 0 or (sizes[:k] <= tolerance).all():
            if fresh:
                return values[:k], x[:, :k], sizes[:k], step
            x = np.linalg.qr(x)[0]
            cx, fresh = product(x), True
            continue
        w = _apart(residual[:, sizes > tolerance / 10], np.c_[x, p])
        if not w.shape[1]:  # rounding is all that is left of the residuals
            p = cp = np.empty((width, 0))
            x = np.linalg.qr(x)[0]
            cx, fresh, tolerance = product(x), True, tolerance * 2
            continue
        z, cz = np.c_[x, p, w], np.c_[cx, cp, product(w)]
        g = z.T @ cz
        y = np.linalg.eigh((g + g.T) / 2)[1][:, ::-1][:, :m]
        away = y.copy()
        away[:m] = 0
        away = _apart(away, y)
        x, cx, p, cp, fresh = z @ y, cz @ y, z @ away, cz @ away, False
    raise ArithmeticError(f"residuals of {sizes[:k].max():.1e} after {MOST_STEPS} steps")


def fit(blocks: DataFrame, components: int, tolerance: float = TOLERANCE) -> Fit | None:
    """The leading components of the blocks' covariance (divisor n); None without vectors or variance."""
    found = blocks.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if found is None:
        return None
    width, n = found.width, found.n
    own = blocks.filter(F.col("width") == width)
    parts = own.select(F.posexplode(F.arrays_zip("whole", "real")).alias("at", "s")).groupBy("at").agg(F.sum("s.whole").alias("whole"), F.sum("s.real").alias("real")).orderBy("at").collect()
    if parts[0].whole is not None:
        sums = [int(r.whole) for r in parts]
        whole = [round(Fraction(s, n)) for s in sums]
        centre, rest = np.array(whole, np.int64), np.array([float(Fraction(s - n * c, n)) for s, c in zip(sums, whole, strict=True)])
    else:
        sums, centre = None, np.array([r.real / n for r in parts])
        rest = summed(own, centre, np.zeros(width), lambda x: x.sum(axis=0)) / n
    trace = float(summed(own, centre, rest, lambda x: np.einsum("ij,ij->", x, x).reshape(1))[0]) / n
    if not trace > 0:
        return None
    product = lambda w: summed(own, centre, rest, lambda x: x.T @ (x @ w)).reshape(width, -1) / n
    values, vectors, residuals, steps = lobpcg(product, width, min(components, width), tolerance)
    some = values > NO_VARIANCE * values[0]
    return Fit(n, sums, centre, rest, trace, values[some], vectors[:, some], residuals[some], steps)


def identity_error(blocks: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity: a pass for the means, one for the products."""
    own, turn = blocks.filter(F.col("width") == len(model.centre)), model.vectors / np.sqrt(model.values)
    mean = summed(own, model.centre, model.rest, lambda x: (x @ turn).sum(axis=0)) / model.n

    def products(x: np.ndarray) -> np.ndarray:
        z = x @ turn - mean
        return z.T @ z

    k = len(model.values)
    return float(np.abs(summed(own, model.centre, model.rest, products).reshape(k, k) / model.n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """For rows of whole numbers less their centres: the sums of (n * x - rest)^2, exact; None beyond 63 bits."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, rest))
    if most < 1 << 62 and x.shape[1] * most * most < 1 << 63:
        t = x * n - np.array(rest, np.int64)
        return np.einsum("ij,ij->i", t, t).tolist()
    exact = [sum((n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whitened(blocks: DataFrame, model: Fit, id_col: str) -> DataFrame:
    """(id, component, deviation, whitened, explained, eigenvalue, residual): a row for each vector and component.

    deviation is the sum over the dimensions of (n * x - sum)^2, for whole vectors;
    explained the component's share of all variance.
    """
    turn, k = model.vectors / np.sqrt(model.values), len(model.values)
    rest = None if model.sums is None else [s - model.n * c for s, c in zip(model.sums, model.centre.tolist(), strict=True)]
    names = ["_id", "component", "deviation", "whitened", "explained", "eigenvalue", "residual"]

    def turned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("whitening")
        with one_blas_thread():
            for batch in batches:
                for i, (kind, low, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                    z = _centred(kind, low, data, model.centre, model.rest) @ turn
                    far: list[int | None] = [None] * len(z)
                    if rest is not None:
                        far = deviations(np.frombuffer(data, kind).reshape(z.shape[0], -1).astype(np.int64) + (low - model.centre), model.n, rest)
                    owner = np.repeat(np.arange(len(z)), k)
                    at = lambda v, n=len(z): pa.array(np.tile(v, n))
                    columns = [batch.column(0)[i].values.take(pa.array(owner)), at(np.arange(1, k + 1, dtype=np.int32)), pa.array(far, pa.int64()).take(pa.array(owner)), pa.array(z.ravel()), at(model.values / model.trace), at(model.values), at(model.residuals)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    own = blocks.filter(F.col("width") == len(model.centre)).select("ids", "kind", "low", "data")
    return own.mapInArrow(turned, f"_id {kind}, component int, deviation long, whitened double, explained double, eigenvalue double, residual double").withColumnRenamed("_id", id_col)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: float | None = None, offset: int = 0) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, eigenvalue, residual) of all usable vectors; the fit is over all of them."""
    blocks = store_blocks(rows, id_col, vector_col, scale, offset)
    model = fit(blocks, components)
    if model is None:
        empty = "component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, residual double"
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {empty}")
    error = F.lit(identity_error(blocks, model))
    out = whitened(blocks, model, id_col)
    return out.select(id_col, "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", error.alias("identity_error"), "eigenvalue", "residual")
