"""Vectors of whole numbers from arrays of numbers, and exact products of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers at or beyond this are refused: below it, sums of 64 squared differences fit into 63 bits.
MOST = 1 << 27


def usable(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def scaled(vector: Column, by: int) -> Column:
    """floor(by * component) of each component, taken as double, as array<int>."""

    def whole(x: Column) -> Column:
        y = F.floor(F.lit(float(by)) * x.cast("double"))
        return F.when(F.abs(y) < MOST, y).otherwise(F.raise_error(F.lit("a component is too large for exact products")).cast("long")).cast("int")

    return F.transform(vector, whole)


def longest(rows: DataFrame, vector: str) -> int:
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b, both int32, as int64."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    kind = np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
