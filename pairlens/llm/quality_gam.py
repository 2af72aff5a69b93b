"""Quality classifier: an additive model with pairwise interactions.

Each feature is cut into bins; boosting visits the features in turn and fits a
shallow tree on one feature's bins, which is added to that feature's lookup
table. Then the strongest pairs get small tables of their own. A score is the
sum of table entries, so that scoring is indexing and adding over whole columns.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .common import arrow
from .text_stats import FEATURES, with_stats

#: Bound on the labelled rows that are learned from, taken by the hash of their id.
SAMPLE_ROWS = 20_000


@dataclass(frozen=True)
class Gam:
    """Cut points and lookup tables; ``predict`` gives probabilities."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cuts, x[:, j])]
        if self.pairs:
            coarse = [np.searchsorted(c, x[:, j]) for j, c in enumerate(self.pair_cuts)]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                out += table[coarse[i], coarse[j]]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _cuts(col: np.ndarray, bins: int) -> np.ndarray:
    """Cut points half way between neighbouring values at quantiles of the distinct values."""
    values = np.unique(col)
    if len(values) < 2:
        return np.zeros(0)
    k = np.unique(np.linspace(0, len(values) - 1, min(bins, len(values)) + 1)[1:-1].astype(int)) if len(values) > 2 else np.array([0])
    k = k[k < len(values) - 1]
    return (values[k] + values[k + 1]) / 2


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values per bin of the best tree with at most ``leaves`` leaves over ordered bins."""
    gs, hs = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])

    def worth(a: int, b: int) -> float:
        return (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)

    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-12, None, None)
        for n, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = (gs[m] - gs[a]) ** 2 / (hs[m] - hs[a] + ridge) + (gs[b] - gs[m]) ** 2 / (hs[b] - hs[m] + ridge) - worth(a, b)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], n, int(m[k]))
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1]:best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a table into four, as gain and values per cell."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    top, left, ga, ha = gs[:-1, -1:], gs[-1:, :-1], gs[-1, -1], hs[-1, -1]
    htop, hleft = hs[:-1, -1:], hs[-1:, :-1]
    q = [gs[:-1, :-1], top - gs[:-1, :-1], left - gs[:-1, :-1]]
    hq = [hs[:-1, :-1], htop - hs[:-1, :-1], hleft - hs[:-1, :-1]]
    q.append(ga - q[0] - q[1] - q[2])
    hq.append(ha - hq[0] - hq[1] - hq[2])
    if not q[0].size:
        return 0.0, np.zeros_like(g)
    gain = sum(a * a / (b + ridge) for a, b in zip(q, hq)) - ga * ga / (ha + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for part, (rows, cols) in enumerate([(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
                                         (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))]):
        out[rows, cols] = q[part][i, j] / (hq[part][i, j] + ridge)
    return float(gain[i, j]), out


def fit_gam(x: np.ndarray, y: np.ndarray, *, bins: int = 64, pair_bins: int = 12, rounds: int = 200, pair_rounds: int = 60,
            n_pairs: int = 5, rate: float = 0.1, leaves: int = 3, ridge: float = 5.0) -> Gam:
    """Cyclic boosting of the log loss. One class alone, or no rows, gives a constant score."""
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, j], bins) for j in range(width)]
    pair_cuts = [_cuts(x[:, j], pair_bins) for j in range(width)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if n == 0 or y.min() == y.max():
        return Gam(bias, cuts, tables, pair_cuts, [], [])
    at = [np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]
    logit = np.full(n, bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            size = len(tables[j])
            if size < 2:
                continue
            g, h = slopes()
            step = rate * _tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size), leaves, ridge)
            tables[j] += step
            logit += step[at[j]]
    coarse = [np.searchsorted(c, x[:, j]) for j, c in enumerate(pair_cuts)]
    shapes = [len(c) + 1 for c in pair_cuts]

    def table(i: int, j: int) -> tuple[float, np.ndarray]:
        cell, size = coarse[i] * shapes[j] + coarse[j], shapes[i] * shapes[j]
        g, h = slopes()
        return _quadrants(np.bincount(cell, g, size).reshape(shapes[i], shapes[j]),
                          np.bincount(cell, h, size).reshape(shapes[i], shapes[j]), ridge)

    ranked = sorted(((table(i, j)[0], i, j) for i, j in combinations(range(width), 2)), reverse=True)
    pairs = [(i, j) for gain, i, j in ranked[:n_pairs] if gain > 0]
    pair_tables = [np.zeros((shapes[i], shapes[j])) for i, j in pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(pairs):
            step = rate * table(i, j)[1]
            pair_tables[k] += step
            logit += step[coarse[i], coarse[j]]
    return Gam(bias, cuts, tables, pair_cuts, pairs, pair_tables)


def held_out() -> Column:
    """Rows that are never learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _matrix(frame) -> np.ndarray:
    return frame[list(FEATURES)].to_numpy(float)


def train(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> Gam:
    """Learn from the labelled rows of ``stats`` that are not held out."""
    known = labels.where("quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = stats.join(known, "doc_id").select(
        "doc_id", "quality", *(F.expr(f"double({e})").alias(n) for n, e in FEATURES.items()))
    rows = rows.groupBy("doc_id", "quality").agg(*(F.min(n).alias(n) for n in FEATURES))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).toPandas()
    return fit_gam(_matrix(sample), (sample["quality"].to_numpy() != 0).astype(float), **options)


def score_rows(stats: DataFrame, model: Gam, keep: list[str]) -> DataFrame:
    """``keep`` and the score of every row of ``stats``."""
    names = list(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names])
            kept = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.predict(x))], names=[*keep, "score"])

    features = stats.select(*keep, *(F.expr(f"double({e})").alias(n) for n, e in FEATURES.items()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.select(*keep).schema.fields)
    return arrow(features, run, f"{schema}, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    Only the text is an input of a score. Null texts score as empty ones; a null
    id is held out.
    """
    stats = stage(with_stats(docs, ["doc_id"]))
    model = train(stats, labels, **options)
    scored = score_rows(stats, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
