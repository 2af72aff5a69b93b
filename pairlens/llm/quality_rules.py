"""Quality rules: a decision list learned from labelled statistics.

Sequential covering grows one conjunction of thresholds after another on two
thirds of the sample, prunes it on the rest and removes what it covers. The
ordered list becomes one Spark conditional expression over columns, so that
judging rows needs no Python and no model file.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .common import free_name, map_rows, text_bytes
from .text_stats import FEATURES, STATS, stats_of, with_stats

#: Bound on the labelled rows the list is learned from, taken by the hash of their id.
SAMPLE_ROWS = 20_000


@dataclass(frozen=True)
class Rule:
    """Thresholds that must all hold: (feature, "<=" or ">", value)."""

    tests: tuple[tuple[str, str, float], ...]

    def condition(self) -> Column:
        out = F.lit(True)
        for name, op, value in self.tests:
            col = F.expr(FEATURES[name])
            out = out & ((col <= F.lit(value)) if op == "<=" else (col > F.lit(value)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {v:.6g}" for n, op, v in self.tests)


def _tests(x: np.ndarray, names: list[str], cuts: int) -> tuple[list[tuple[str, str, float]], np.ndarray]:
    tests, masks = [], []
    for j, name in enumerate(names):
        values = np.unique(x[:, j])
        if len(values) < 2:
            continue
        at = np.unique(np.quantile(values, np.linspace(0, 1, cuts + 2)[1:-1], method="lower"))
        for v in at[at < values[-1]]:
            # Half way to the next value, so that rows near a cut do not flip.
            v = float(v + values[np.searchsorted(values, v, side="right")]) / 2
            tests += [(name, "<=", v), (name, ">", v)]
            masks += [x[:, j] <= v, x[:, j] > v]
    return tests, np.array(masks).T if masks else np.zeros((len(x), 0), bool)


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], *, cuts: int = 48, precision: float = 0.95,
          least: int = 5, max_tests: int = 4, max_rules: int = 16) -> list[Rule]:
    """A list of rules for the rows marked ``bad``.

    Rows are in random order; every third one prunes. A rule is taken while its
    precision on all uncovered rows is at least ``precision`` and it covers
    ``least`` bad rows. No bad or no good rows give an empty list.
    """
    bad = bad.astype(bool)
    tests, masks = _tests(x, names, cuts)
    if not tests or not bad.any() or bad.all():
        return []
    left, prune = np.ones(len(x), bool), np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < max_rules and (left & bad).any():
        grow, chosen, inside = left & ~prune, [], np.ones(len(x), bool)
        while len(chosen) < max_tests:
            pos, neg = grow & inside & bad, grow & inside & ~bad
            p0, n0 = pos.sum(), neg.sum()
            if not p0 or not n0:
                break
            p, n = masks[pos].sum(0), masks[neg].sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)
            best = int(np.argmax(gain))
            if gain[best] <= 1e-9:
                break
            chosen.append(best)
            inside &= masks[:, best]

        def worth(k: int) -> tuple[float, int]:
            hit = left & prune & np.all(masks[:, chosen[:k]], axis=1)
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / max(p + n, 1), -k

        if not chosen:
            break
        chosen = chosen[:max(range(1, len(chosen) + 1), key=worth)]
        hit = left & np.all(masks[:, chosen], axis=1)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < least or p < precision * (p + n):
            break
        rules.append(Rule(tuple(tests[k] for k in chosen)))
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The 1-based number of the first rule that holds, null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].condition(), F.lit(k)).otherwise(out)
    return out


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> list[Rule]:
    """Learn from the rows of ``stats`` whose ``doc_id`` has a quality label (0 is bad)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = stats.join(known, "doc_id").select(
        F.xxhash64("doc_id").alias("h"), "doc_id", "quality", *(F.expr(f"double({e})").alias(n) for n, e in FEATURES.items()))
    # One row per label, so that the sample stays within its bound when rows are repeated.
    rows = rows.groupBy("h", "doc_id", "quality").agg(*(F.min(n).alias(n) for n in FEATURES))
    at = rows.orderBy("h", "doc_id").limit(sample_rows).toPandas()
    names = list(FEATURES)
    return learn(at[names].to_numpy(float), at["quality"].to_numpy() == 0, names, **options)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics and verdict of every row of ``docs`` (doc_id, text).

    A null text has no words and fails the base rule; null and repeated ids are
    judged row by row. ``rule`` is the first learned rule that rejects the row.
    """
    stats = stage(with_stats(docs, ["doc_id"]))
    rules = fit(stats, labels, **options)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    The counts travel beside each row, so that nothing is joined back.
    """
    rules = fit(stage(with_stats(docs, ["doc_id"])), labels, **options)
    body, own = free_name(docs, "body__"), free_name(docs, "row__")
    # The row goes along as one struct: its columns cannot clash with the counts.
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias(own), text_bytes().alias(body))
    judged = map_rows(packed, stats_of, [body], STATS)
    return judged.where(~base_failed() & verdict(rules).isNull()).select(f"{own}.*")
