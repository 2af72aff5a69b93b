"""Whitening of vectors by Chebyshev-filtered subspace iteration."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .common import arrow
from .vectors import finite, matrix, width

#: Entries are floor(GRID * c) + SHIFT.
GRID, SHIFT = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 32
#: Degree of the filter: passes over the rows between two QR steps.
DEGREE = 10
#: Steps of the Lanczos run that bounds the spectrum from below.
BOUND_STEPS = 8
#: Rounds after which the iteration gives up.
ROUNDS = 40
#: Residuals are certified below this part of the largest eigenvalue.
RESIDUAL = 2e-13
#: Rows that are multiplied at once.
ROWS = 4096


@dataclass
class Whitener:
    """Means as sums and a count, eigenvalues (falling) and unit eigenvectors of the covariance, and how they were certified."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    rounds: int

    @property
    def d(self) -> int:
        return len(self.sums)


def gridded(df: DataFrame, col: str, keep: str) -> tuple[DataFrame, int]:
    """(keep, x) with x = floor(64 * c) + 1000000 as longs, and the width.

    Vectors that are null or hold null, NaN or infinite entries are left out;
    missing entries at the end of shorter vectors are zero. Entries beyond the
    longs are held at their ends.
    """
    whole = df.select(F.col(keep).alias("keep"), F.col(col).alias("v")).where(finite("v"))
    d = width(whole, "v")
    most = float(1 << 62)
    cells = F.transform("v", lambda c: F.floor(F.greatest(F.least(c.cast("double") * GRID, F.lit(most)), F.lit(-most))) + SHIFT)
    filled = F.concat(cells, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(d) - F.size("v")))
    return stage(whole.select("keep", filled.alias("x"))), d


def _sums(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], d: int, kind: str) -> np.ndarray:
    """``part`` of blocks of rows added up: by tasks first, then by Spark per cell; the driver gets one array."""
    name = "long" if kind == "long" else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column(0).slice(at, ROWS), d, np.int64)
                got = part(x)
                total = got if total is None else total + got
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int64)), pa.array(flat, type=pa.int64() if name == "long" else pa.float64())], names=["at", "v"])

    cells = arrow(rows.select("x"), run, f"at long, v {name}").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(int(cells["at"].max()) + 1 if len(cells) else 0, np.int64 if name == "long" else float)
    out[cells["at"].to_numpy()] = cells["v"].to_numpy()
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, from the exact n*x - S where that fits a double."""
    s = np.array(sums, dtype=np.int64)
    base = s // n
    return ((x - base) * n - (s - base * n)).astype(float) / n


class Covariance:
    """Products of the covariance of the rows with a block of vectors; each is one pass over the rows."""

    def __init__(self, rows: DataFrame, d: int):
        self.rows, self.d = rows, d
        got = _sums(rows, lambda x: np.append(x.sum(0), len(x)), d, "long")
        self.n = int(got[-1]) if len(got) else 0
        self.sums = [int(v) for v in got[:-1]]
        self.passes = 1

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        n, sums, b = self.n, self.sums, q.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, sums)
            return y.T @ (y @ q)

        self.passes += 1
        return _sums(self.rows, part, self.d, "double").reshape(self.d, b) / n

    def trace(self) -> float:
        n, sums = self.n, self.sums
        return float(_sums(self.rows, lambda x: np.array([np.square(centred(x, n, sums)).sum()]), self.d, "double")[0]) / n


def _lowest(cov: Covariance, seed: np.random.Generator) -> float:
    """A bound below the spectrum from a few Lanczos steps with full orthogonalisation: smallest Ritz value less its residual."""
    v = seed.standard_normal(cov.d)
    basis, alpha, beta = [v / np.linalg.norm(v)], [], []
    for _ in range(min(BOUND_STEPS, cov.d)):
        w = (cov @ basis[-1][:, None])[:, 0]
        alpha.append(float(basis[-1] @ w))
        for _ in range(2):
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(alpha):
            break
        basis.append(w / beta[-1])
    k = len(alpha)
    e, u = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:k - 1], 1) + np.diag(beta[:k - 1], -1))
    return max(0.0, float(e[0] - beta[-1] * abs(u[-1, 0])) * 0.98)


def _filtered(cov: Covariance, q: np.ndarray, vq: np.ndarray, low: float, cut: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of V that is small on [low, cut] and 1 at ``top``; ``vq`` is V @ q."""
    half, mid = (cut - low) / 2, (cut + low) / 2
    first = half / (top - mid)
    sigma, before = first, q
    now = (vq - mid * q) * (sigma / half)
    for _ in range(DEGREE - 1):
        after = 1 / (2 / first - sigma)
        now, before = ((cov @ now) - mid * now) * (2 * after / half) - (sigma * after) * before, now
        sigma = after
    return now


def _ritz(cov: Covariance, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors and V @ vectors of the block's span."""
    q, _ = np.linalg.qr(block)
    vq = cov @ q
    h = q.T @ vq
    e, s = np.linalg.eigh((h + h.T) / 2)
    s = s[:, ::-1]
    return e[::-1], q @ s, vq @ s


def fit(rows: DataFrame, d: int, components: int = COMPONENTS, seed: int = 7) -> Whitener | None:
    """The leading eigenvectors of the covariance of all rows; None if there are none.

    A block of half as many vectors again as asked for is filtered, made
    orthogonal and turned to Ritz vectors, until every wanted residual is below
    2e-13 of the largest eigenvalue (or no longer falls below 1e-11 of it). Then
    the spare vectors are drawn anew: if a filtered round with them leaves the
    wanted eigenvalues as they are, none was missed. Eigenvalues that are zero to
    rounding have no whitened column and are left out.
    """
    cov = Covariance(rows, d)
    if cov.n < 2 or d == 0:
        return None
    trace = cov.trace()
    if trace <= 0:
        return None
    random = np.random.default_rng(seed)
    wanted = min(components, d)
    size = min(d, wanted + max(8, wanted // 2))
    low = _lowest(cov, random) if size < d else 0.0
    values, q, vq = _ritz(cov, random.standard_normal((d, size)))
    best, checked = np.inf, False
    for rounds in range(1, ROUNDS + 1):
        top = values[0]
        live = int((values[:wanted] > 1e-12 * top).sum())
        residual = float(np.abs(np.linalg.norm(vq - q * values, axis=0)[:live]).max()) / top
        settled = residual <= RESIDUAL or (residual <= 1e-11 and residual > best / 2) or size == d
        best = min(best, residual)
        if settled and (checked or size == d):
            break
        if settled:
            checked, held = True, values[:wanted].copy()
            q = np.hstack([q[:, :wanted], random.standard_normal((d, size - wanted))])
            q, _ = np.linalg.qr(q)
            vq = cov @ q
            values, q, vq = _ritz(cov, _filtered(cov, q, vq, low, _cut(values, low), top))
            if np.abs(values[:wanted] - held).max() > 1e-10 * top:
                checked, best = False, np.inf
            continue
        values, q, vq = _ritz(cov, _filtered(cov, q, vq, low, _cut(values, low), top))
    else:
        raise RuntimeError(f"no certified eigenvectors after {ROUNDS} rounds: residual {residual:.2g}")
    keep = int((values[:wanted] > d * np.finfo(float).eps * values[0]).sum())
    return Whitener(cov.n, cov.sums, values[:keep], q[:, :keep], trace, residual, rounds)


def _cut(values: np.ndarray, low: float) -> float:
    """End of the unwanted interval: the smallest Ritz value of the block."""
    return max(float(values[-1]), low + 1e-3 * float(values[0]))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n*x - S)^2 per row in integers; null beyond the longs."""
    s = np.array(sums, dtype=object)
    most = max(abs(int(x.max())), abs(int(x.min())), 1) * n + max(abs(v) for v in sums)
    if most * most * len(sums) < 2**63:
        return np.square(x * n - np.array(sums, dtype=np.int64)).sum(1).tolist()
    base = np.array(sums, dtype=np.int64) // n
    near = x - base
    most = (max(abs(int(near.max())), abs(int(near.min()))) + 1) * n
    if most * most * len(sums) < 2**63:
        return np.square(near * n - (np.array(sums, dtype=np.int64) - base * n)).sum(1).tolist()
    exact = [int(v) for v in np.square(x.astype(object) * n - s).sum(1)]
    return [v if v < 2**63 else None for v in exact]


def whiten_vectors(df: DataFrame, col: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    One row for every vector that is left (``gridded``; repeated rows stay
    repeated, a null key stays null) and component. Components with an
    eigenvalue of zero are left out, so fewer than two rows or equal rows give
    no rows. The model is fitted on all rows; its sums, blocks and matrices are
    as large as the vectors are wide, not as many.
    """
    rows, d = gridded(df, col, key)
    model = fit(rows, d, components)
    out = f"{key} {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double"
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], f"{out}, identity_error double")
    n, sums, c = model.n, model.sums, len(model.values)
    turn = model.vectors / np.sqrt(model.values)
    explained = model.values / model.trace

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ turn
        return np.vstack([w.T @ w, w.sum(0)])

    both = _sums(rows, moments, d, "double").reshape(c + 1, c) / n
    error = float(np.abs(both[:c] - np.outer(both[c], both[c]) - np.eye(c)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x, m = matrix(some.column(1), d, np.int64), some.num_rows
                w = centred(x, n, sums) @ turn
                yield pa.RecordBatch.from_arrays([
                    some.column(0).take(pa.array(np.repeat(np.arange(m), c))), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * c, n, np.int64)),
                    pa.array(_deviations(x, n, sums), type=pa.int64()).take(pa.array(np.repeat(np.arange(m), c))),
                    pa.array(w.ravel()), pa.array(np.tile(explained, m))],
                    names=[key, "component", "n", "deviation", "whitened", "explained"])

    return arrow(rows, run, out).withColumn("identity_error", F.lit(error))
