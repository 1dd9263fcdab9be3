"""Vector functions: robust 8-bit quantisation, inner products, randomised Hadamard rotation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_SCALE = 1e-8
QUANTILE = 0.999


def robust_scale(vector: Column, quantile: float = QUANTILE) -> Column:
    """The quantile of the absolute values (interpolated) over 127, at least LEAST_SCALE."""
    sizes = F.array_sort(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    place = (F.size(vector) - 1) * F.lit(quantile)
    low = F.floor(place).cast("int")
    below = F.element_at(sizes, low + 1)
    above = F.element_at(sizes, F.least(low + 2, F.size(vector)))
    return F.greatest((below + (above - below) * (place - low)) / 127, F.lit(LEAST_SCALE))


def quantised(vector: Column, scale: Column) -> Column:
    """Whole numbers from -127 to 127, halves to even."""
    return F.transform(vector, lambda x: F.least(F.lit(127.0), F.greatest(F.lit(-127.0), F.rint(x.cast("double") / scale))).cast("int"))


def biased(q: Column) -> Column:
    """The query side's unsigned form."""
    return F.transform(q, lambda x: x + 128)


def total(q: Column) -> Column:
    return F.aggregate(q, F.lit(0), lambda a, x: a + x)


def dot(a: Column, b: Column, kind: str = "double") -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast(kind) * y.cast(kind))
    return F.aggregate(products, F.lit(0).cast(kind), lambda s, x: s + x)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (a power of two long), which keeps lengths."""
    n = x.shape[1]
    if n & (n - 1):
        raise ValueError(f"{n} is no power of two")
    x, half = x.astype(np.float64), 1
    while half < n:
        x = x.reshape(len(x), -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), -1)
        half *= 2
    return x / np.sqrt(n)


def rotated(vector: Column, seed: int = 1234) -> Column:
    """The randomised Hadamard rotation: signs drawn from the seed, then the transform."""

    @F.pandas_udf("array<double>")
    def rotate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            x = np.stack(vectors.to_numpy()) if len(vectors) else np.empty((0, 1))
            signs = np.where(np.random.default_rng(seed).random(x.shape[1]) < 0.5, -1.0, 1.0)
            yield pd.Series(list(hadamard(x * signs)))

    return rotate(vector)
