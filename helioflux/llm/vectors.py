"""Checks of vector columns and their passage through Arrow as dense matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    big = float("inf")
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < big))
    return F.col(column).isNotNull() & F.coalesce(whole, F.lit(False))


def usual_width(df: DataFrame, column: str, multiple: int = 1) -> int:
    """The most frequent length (then the longest) of vectors that ``multiple`` divides; 0 without any."""
    sizes = df.groupBy(F.size(column).alias("n")).agg(F.count(F.lit(1)).alias("rows")).where((F.col("n") > 0) & (F.col("n") % multiple == 0))
    best = sizes.agg(F.max(F.struct("rows", "n")).alias("best")).first()["best"]
    return best["n"] if best else 0


def matrix(column: pa.Array, width: int, dtype: type = np.float64) -> np.ndarray:
    """Rows of a list column whose lists all have ``width`` components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), width)


def raw(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    """Rows of a binary column of ``width`` values each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def packed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    size = values.dtype.itemsize * values.shape[1]
    data = np.ascontiguousarray(values).tobytes()
    return pa.array([data[i * size : (i + 1) * size] for i in range(len(values))], pa.binary())
