"""Vectors of whole numbers, shared by the clustering and the coding operator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components under this size keep squared distances of some hundred components exact in a double.
LIMIT = 1 << 21


def integer_vectors(embeddings: DataFrame, scale: int, dim: int, *more: str) -> DataFrame:
    """(vec_id, q, *more) of the rows whose vector has ``dim`` components, none null, NaN or infinite.

    ``q`` holds floor(scale * x) of each component x.  Other rows go; repeated
    rows and null ids stay; a component whose product reaches ``LIMIT`` is an
    error, as distances would not be exact any more.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    good = embeddings.where(F.coalesce((F.size(x) == dim) & finite, F.lit(False)))
    fits = F.forall(x, lambda e: F.abs(e.cast("double") * F.lit(float(scale))) < F.lit(float(LIMIT)))
    q = F.when(fits, F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("int"))).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>"))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"), *more)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column without nulls as doubles, which hold these integers exactly."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, dim = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(values.reshape(-1)))


def no_lists(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, pa.list_(kind))


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all centers; exact, as every term is a whole number under 2**53."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(1)[None, :]


def joined(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ",")
