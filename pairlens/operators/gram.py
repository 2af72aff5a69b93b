"""Cross products of many columns in one pass: tasks fold blocks of rows, p * p numbers travel."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship

BLOCK = 8192


@dataclass
class Gram:
    """For every pair of columns, over the rows where both are there: their number, the sums of
    the first column and of its square, and the sum of products; columns are shifted by ``centre``."""

    columns: list[str]
    centre: np.ndarray
    n: np.ndarray
    s: np.ndarray
    ss: np.ndarray
    sp: np.ndarray

    def correlation(self) -> np.ndarray:
        """Pearson correlations; NaN where a column does not vary."""
        n = np.maximum(self.n, 1)
        cov = self.sp / n - (self.s / n) * (self.s.T / n)
        var = np.maximum(self.ss / n - np.square(self.s / n), 0.0)
        # What rounding leaves of a constant column is not a variance.
        var[var <= 1e-13 * (self.ss / n + 1e-300)] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.clip(cov / np.sqrt(var * var.T), -1.0, 1.0)


def gram(df: DataFrame, columns: Sequence[str]) -> Gram:
    """Pairwise-complete sums of all columns; null and NaN are missing."""
    columns, p = list(columns), len(columns)
    value = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in columns}
    means = df.agg(*[F.avg(v).alias(f"_m{k}") for k, v in enumerate(value.values())]).first()
    centre = np.array([m or 0.0 for m in means])
    rows = df.select(F.array(*[F.coalesce(v, F.lit(float("nan"))) for v in value.values()]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, p, p))
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, p) - centre
                there = ~np.isnan(x)
                x, m = np.where(there, x, 0.0), there.astype(float)
                total += np.stack([m.T @ m, x.T @ m, np.square(x).T @ m, x.T @ x])
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "v"])

    ship(df.sparkSession)
    cells = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(4 * p * p)
    flat[cells.column("at").to_numpy()] = cells.column("v").to_numpy()
    return Gram(columns, centre, *flat.reshape(4, p, p))
