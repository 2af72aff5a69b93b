"""Helpers for tables of vectors."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(col: str) -> Column:
    """The vector is there, and so are all its entries, none of them NaN or infinite."""
    return F.col(col).isNotNull() & F.forall(
        col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))


def width(df: DataFrame, col: str) -> int:
    """Entries of the longest vector; 0 without rows."""
    return int(df.agg(F.max(F.size(col))).first()[0] or 0)


def matrix(column: pa.Array | pa.ChunkedArray, d: int, dtype=np.float64) -> np.ndarray:
    """Vectors as rows of a matrix with ``d`` columns; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == d).all():
        return flat.reshape(len(column), d).astype(dtype, copy=False)
    out = np.zeros((len(column), d), dtype)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for k in range(len(column)):
        out[k, :sizes[k]] = flat[starts[k]:starts[k + 1]]
    return out
