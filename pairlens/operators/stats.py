"""Statistical operators: rows are reduced in Spark, tails run on what is left."""
from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import tails
from ..functions.tails import Z95
from .compare import wide
from .gram import gram
from .keys import key_join
from .ranks import ranked
from .staging import scratch, stage


# --- contingency tables -----------------------------------------------------------

def contingency_2x2(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """a, b, c, d, prevalence and risks of many binary features against a target.

    Present means a value above zero. Two sums per feature and two for the
    target are taken in one pass without widening the rows.
    """
    y = F.coalesce(F.col(target).cast("int"), F.lit(0))
    present = {f: (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) > 0).cast("long") for f in features}
    sums = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("y"),
        *[F.sum(x).alias(f"x_{f}") for f, x in present.items()],
        *[F.sum(x * y).alias(f"xy_{f}") for f, x in present.items()],
    )
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col("n").alias("n_total"), F.col("y").alias("_y"),
                 F.col(f"x_{f}").alias("n_present"), F.col(f"xy_{f}").alias("a"))
        for f in features
    ])
    t = sums.select(F.explode(rows).alias("_r")).select("_r.*")
    t = t.withColumns({
        "n_absent": F.col("n_total") - F.col("n_present"), "b": F.col("n_present") - F.col("a"),
        "c": F.col("_y") - F.col("a"),
    })
    t = t.withColumn("d", F.col("n_absent") - F.col("c"))
    t = t.withColumns({
        "prevalence": F.try_divide("n_present", "n_total"),
        "risk_present": F.try_divide("a", "n_present"), "risk_absent": F.try_divide("c", "n_absent"),
    })
    return t.withColumn("risk_difference", F.col("risk_present") - F.col("risk_absent")).drop("_y")


def _half_corrected(df: DataFrame) -> list[Column]:
    cells = [F.col(x).cast("double") for x in "abcd"]
    add = F.when(F.least(*cells) == 0, 0.5).otherwise(0.0)
    return [c + add for c in cells]


def risk_ratio(df: DataFrame) -> DataFrame:
    """Risk ratio with its log-scale 95 % interval; half a count is added to zero tables."""
    a, b, c, d = _half_corrected(df)
    rr = (a / (a + b)) / (c / (c + d))
    se = F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    return df.withColumns({
        "risk_ratio": rr, "rr_ci95_low": F.exp(F.log(rr) - Z95 * se), "rr_ci95_high": F.exp(F.log(rr) + Z95 * se),
    })


def odds_ratio(df: DataFrame) -> DataFrame:
    """Odds ratio with its log-scale 95 % interval; half a count is added to zero tables."""
    a, b, c, d = _half_corrected(df)
    ratio = (a * d) / (b * c)
    se = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return df.withColumns({
        "odds_ratio": ratio, "or_ci95_low": F.exp(F.log(ratio) - Z95 * se),
        "or_ci95_high": F.exp(F.log(ratio) + Z95 * se),
    })


def fisher_exact(df: DataFrame, out: str = "fisher_p_value") -> DataFrame:
    """Two-sided hypergeometric p of each 2x2 row."""
    return df.withColumn(out, tails.fisher_col("a", "b", "c", "d"))


def bh_adjust(df: DataFrame, p: str, out: str = "fdr_bh", family: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg adjustment per family; null p-values stay out.

    Ranks over range buckets, with the suffix minimum carried across the
    buckets, so that a family of millions is not one task.
    """
    family = list(family)
    head = family or [F.lit(0)]
    table = ranked(df, family, p)
    raw = table.withColumn("_q", F.col(p) * F.col("total") / (F.col("below") + F.col("n")))
    after = W.partitionBy(*head).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    tail = raw.groupBy(*family, "_b").agg(F.min("_q").alias("_m")).select(
        *family, "_b", F.min("_m").over(after).alias("_later")
    )
    inside = W.partitionBy(*family, "_b").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    q = key_join(raw, tail, [*family, "_b"]).select(
        *family, p, F.least(F.lit(1.0), F.min("_q").over(inside), "_later").alias(out)
    )
    return key_join(df, q, [*family, p], "left")


def effect_label(df: DataFrame, ratio: str, low: str, high: str, q: str, out: str = "effect",
                 higher: str = "higher risk", lower: str = "lower risk") -> DataFrame:
    """Direction of an effect whose interval and adjusted p agree, else inconclusive."""
    sure = F.coalesce(F.col(q) < 0.05, F.lit(False)) & F.col(ratio).isNotNull()
    return df.withColumn(
        out,
        F.when(sure & (F.col(low) > 1), higher).when(sure & (F.col(high) < 1), lower).otherwise("inconclusive"),
    )


def feature_risk_table(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """2x2 table, ratios, Fisher test, FDR and effect label for every feature."""
    t = fisher_exact(odds_ratio(risk_ratio(contingency_2x2(df, features, target))))
    t = bh_adjust(t, "fisher_p_value", "fisher_fdr_bh")
    return effect_label(t, "risk_ratio", "rr_ci95_low", "rr_ci95_high", "fisher_fdr_bh")


# --- correlation --------------------------------------------------------------------

def spearman(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rank correlation of each feature with the target, with p and FDR.

    Rows are first counted per (feature, value, target); both margins of these
    counts are ranked, so that no rank is joined back to rows.
    """
    from .descriptives import long

    rows = df.select(
        F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("_y"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
    )
    counts = stage(long(rows, ["_y"], features, "feature").groupBy("feature", "value", "_y").agg(F.count(F.lit(1)).alias("_c")))
    # Every row stands once per feature, so that one feature has all of the target.
    margin = counts.where(F.col("feature") == features[0]).groupBy("_y").agg(F.sum("_c").alias("_c"))
    of_y = ranked(margin, [], "_y", weight="_c").select("_y", F.col("avg_rank").alias("_ry"))
    r = F.col("_c") * F.col("_ry")
    table = ranked(key_join(counts, of_y, ["_y"]).withColumns({"_s": r, "_s2": r * F.col("_ry")}).select(
        "feature", "value", "_c", F.col("_s").alias("_ry"), F.col("_s2").alias("_ry2")), ["feature"], "value", sums=["_ry", "_ry2"], weight="_c")
    g = table.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_unique_values"),
        F.sum(F.col("avg_rank") * F.col("_ry")).alias("sxy"),
        F.sum(F.col("avg_rank") * F.col("avg_rank") * F.col("n")).alias("sxx"), F.sum("_ry2").alias("syy"),
    )
    n = F.col("n").cast("double")
    mean = (n + 1) / 2
    num = F.col("sxy") - n * mean * mean
    vx, vy = F.col("sxx") - n * mean * mean, F.col("syy") - n * mean * mean
    rho = F.when((vx > 0) & (vy > 0), num / F.sqrt(vx * vy))
    out = g.select("feature", "n", "n_unique_values", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)).alias("spearman_rho"))
    r = F.col("spearman_rho")
    t = F.when(F.abs(r) < 1.0, r * F.sqrt((F.col("n") - 2) / ((1 - r) * (1 + r))))
    p = F.when(F.abs(r) >= 1.0, F.lit(0.0)).otherwise(tails.t_two_sided_col(t, (F.col("n") - 2).cast("double")))
    out = out.withColumn("spearman_p_value", F.when(r.isNotNull(), p))
    return bh_adjust(out, "spearman_p_value", "spearman_fdr_bh")


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation matrix in long form from one pass; null for a column that does not vary."""
    columns = list(columns)
    r = gram(df, columns).correlation()
    cells = [(a, b, 1.0 if i == j else None if np.isnan(r[i, j]) else float(r[i, j]))
             for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(cells, "feature_a string, feature_b string, r double")


def median_fill(df: DataFrame, columns: Sequence[str], train: Column | None = None) -> DataFrame:
    """Nulls replaced by the exact median of the (training) rows, then by zero."""
    from .descriptives import long
    from .ranks import quantiles

    rows = df if train is None else df.where(train)
    mid = quantiles(long(rows, [], columns), ["metric"], "value", {"m": 0.5})
    fill = mid.agg(F.map_from_entries(F.collect_list(F.struct("metric", "m")))).scalar()
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.try_element_at(fill, F.lit(c)), F.lit(0.0)) for c in columns
    })


def rank_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` replaced by the average ranks of their values.

    All columns are ranked in one pass over their distinct values; the value
    tables are written apart, so that the size of each decides how it is joined.
    """
    from .descriptives import long

    path = scratch(df.sparkSession)
    tables = ranked(long(df, [], columns, "feature"), ["feature"], "value").select("feature", "value", F.col("avg_rank").alias("_r"))
    tables.write.partitionBy("feature").parquet(path)
    tables = df.sparkSession.read.schema("value double, _r double, feature string").parquet(path)
    out = df.withColumns({c: F.col(c).cast("double") for c in columns})
    for c in columns:
        own = tables.where(F.col("feature") == c).select(F.col("value").alias("_v"), F.col("_r").alias(f"_r_{c}"))
        out = out.join(own, out[c] == own["_v"], "left").drop("_v").withColumn(c, F.col(f"_r_{c}")).drop(f"_r_{c}")
    return out


def rank_correlation_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Column pairs whose rank correlation reaches the threshold in size, with p."""
    columns = list(columns)
    g = gram(rank_columns(median_fill(df.select(*columns), columns), columns), columns)
    r, n = g.correlation(), int(g.n.max(initial=0))
    found = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            if a < b and not np.isnan(r[i, j]) and abs(r[i, j]) >= threshold:
                x = float(r[i, j])
                p = tails.t_two_sided(x * math.sqrt((n - 2) / ((1 - x) * (1 + x))), n - 2) if abs(x) < 1 else 0.0
                found.append((a, b, x, abs(x), p))
    return df.sparkSession.createDataFrame(found, "feature_a string, feature_b string, spearman_rho double, abs_rho double, p_value double")


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation factors from the inverse correlation matrix (p x p numbers)."""
    spark = df.sparkSession
    p = len(columns)
    if p == 1:
        return spark.createDataFrame([(columns[0], 1.0)], "feature string, vif double")
    filled = median_fill(df.select(*columns), columns)
    at = {c: i for i, c in enumerate(columns)}
    m = gram(filled, columns).correlation()
    m[np.diag_indices(p)] = 1.0
    flat = np.isnan(m).any(axis=1) & (np.isnan(m).sum(axis=1) >= p - 1)
    m = np.nan_to_num(m)
    inv = np.linalg.pinv(m) if np.linalg.matrix_rank(m) < p else np.linalg.inv(m)
    out = []
    for c, i in at.items():
        if flat[i]:
            # A constant column is fitted without error by its mean.
            out.append((c, float("inf")))
            continue
        others = [k for k in range(p) if k != i]
        r2 = float(m[i, others] @ np.linalg.pinv(m[np.ix_(others, others)]) @ m[others, i])
        out.append((c, float("inf") if r2 >= 0.999999 else float(max(inv[i, i], 1.0) if np.linalg.matrix_rank(m) == p else 1 / (1 - r2))))
    return spark.createDataFrame(out, "feature string, vif double")


# --- paired tests over groups ---------------------------------------------------------

def cochran_q(df: DataFrame, unit: Sequence[str], group: str, y: str, members: Sequence[str]) -> DataFrame:
    """Cochran's Q over units that have every member; null without discordance."""
    k = len(members)
    w = wide(df, unit, group, y, members)
    total = F.lit(0)
    for i in range(k):
        total = total + F.col(f"m_{i}")
    s = w.agg(
        F.count(F.lit(1)).alias("n_units"), *[F.sum(f"m_{i}").cast("double").alias(f"c_{i}") for i in range(k)],
        F.sum(total * total).cast("double").alias("_r2"),
    )
    t, c2 = F.lit(0.0), F.lit(0.0)
    for i in range(k):
        t, c2 = t + F.col(f"c_{i}"), c2 + F.col(f"c_{i}") * F.col(f"c_{i}")
    den = k * t - F.col("_r2")
    q = F.when(den > 0, (k - 1) * (k * c2 - t * t) / den)
    out = s.select("n_units", q.alias("cochran_q"), F.lit(k - 1).alias("df"))
    return out.withColumn("p_value", tails.chi2_sf_col(F.col("cochran_q"), F.col("df").cast("double")))


def mcnemar_exact(df: DataFrame, unit: Sequence[str], group: str, y: str, members: Sequence[str]) -> DataFrame:
    """All member pairs: discordant counts, matched odds ratio, exact p, rates, FDR."""
    w = wide(df, unit, group, y, members)
    idx = list(combinations(range(len(members)), 2))

    def both(i, a, j, b):
        return ((F.col(f"m_{i}") == a) & (F.col(f"m_{j}") == b))

    s = w.agg(
        F.count(F.lit(1)).alias("n_units"),
        *[F.sum(F.col(f"m_{i}").cast("long")).alias(f"s_{i}") for i in range(len(members))],
        *[F.count_if(both(i, 1, j, 0)).alias(f"p_{i}_{j}") for i, j in idx],
        *[F.count_if(both(i, 0, j, 1)).alias(f"q_{i}_{j}") for i, j in idx],
    )
    rows = F.array(*[
        F.struct(F.lit(members[i]).alias("group_a"), F.lit(members[j]).alias("group_b"), F.col("n_units"),
                 (F.col(f"s_{i}") / F.col("n_units")).alias("rate_a"), (F.col(f"s_{j}") / F.col("n_units")).alias("rate_b"),
                 F.col(f"p_{i}_{j}").alias("a1_b0"), F.col(f"q_{i}_{j}").alias("a0_b1"))
        for i, j in idx
    ])
    out = s.select(F.explode(rows).alias("_r")).select("_r.*")
    a, b = F.col("a1_b0"), F.col("a0_b1")
    out = out.withColumns({
        "risk_difference": F.col("rate_a") - F.col("rate_b"),
        "matched_odds_ratio": F.when(b > 0, a / b).when(a > 0, F.lit(float("inf"))),
        "p_value": tails.sign_test_col("a1_b0", "a0_b1"),
    })
    return bh_adjust(out, "p_value")


def friedman(df: DataFrame, unit: Sequence[str], group: str, value: str, members: Sequence[str]) -> DataFrame:
    """Tie-corrected Friedman chi-square; ranks are taken inside each unit's row."""
    k = len(members)
    w = wide(df, unit, group, value, members)
    cols = [F.col(f"m_{i}") for i in range(k)]

    def rank(i):
        less, equal = F.lit(0), F.lit(0)
        for c in cols:
            less, equal = less + (c < cols[i]).cast("int"), equal + (c == cols[i]).cast("int")
        return less + (equal + 1) / 2.0, equal

    ties = F.lit(0)
    picks = []
    for i in range(k):
        r, equal = rank(i)
        picks.append(r.alias(f"r_{i}"))
        # Summing t^2 - 1 over the members of a tie group gives t^3 - t.
        ties = ties + (equal * equal - 1)
    s = w.select(*picks, ties.alias("_t")).agg(
        F.count(F.lit(1)).alias("n_units"), *[F.sum(f"r_{i}").alias(f"R_{i}") for i in range(k)],
        F.sum("_t").cast("double").alias("_t"),
    )
    n = F.col("n_units").cast("double")
    ss = F.lit(0.0)
    for i in range(k):
        ss = ss + F.col(f"R_{i}") * F.col(f"R_{i}")
    c = 1 - F.col("_t") / (k * (k * k - 1) * n)
    chi = F.when(c > 0, (12.0 / (k * n * (k + 1)) * ss - 3 * n * (k + 1)) / c)
    out = s.select("n_units", chi.alias("friedman_chi2"), F.lit(k - 1).alias("df"))
    return out.withColumn("p_value", tails.chi2_sf_col(F.col("friedman_chi2"), F.col("df").cast("double")))


def signed_rank_sums(df: DataFrame, by: Sequence[str], delta: str, buckets: int | None = None) -> DataFrame:
    """Per group: n non-zero, n_zero, W+, W- and the tie term of the signed ranks.

    Zeros are ranked along with the rest and taken off afterwards: they are the
    lowest values, so every other rank is n_zero too high.
    """
    by = list(by)
    rows = df.where(F.col(delta).isNotNull()).select(
        *by, F.abs(F.col(delta).cast("double")).alias("_a"), (F.col(delta) > 0).cast("long").alias("_pos")
    )
    t = ranked(rows, by, "_a", sums=["_pos"], buckets=buckets)
    real, n = F.col("_a") > 0, F.col("n").cast("double")

    def total(c):
        return F.sum(F.when(real, c).otherwise(0.0))

    g = t.groupBy(*by).agg(
        F.sum(F.when(real, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(real, 0).otherwise(F.col("n"))).alias("n_zero"),
        total(F.col("_pos").cast("double")).alias("_np"),
        total(F.col("avg_rank") * F.col("_pos")).alias("_wp"),
        total(F.col("avg_rank") * (F.col("n") - F.col("_pos"))).alias("_wm"),
        total(n * n * n - n).alias("tie_term"),
    )
    return g.select(
        *by, "n", "n_zero", (F.col("_wp") - F.col("n_zero") * F.col("_np")).alias("w_plus"),
        (F.col("_wm") - F.col("n_zero") * (F.col("n") - F.col("_np"))).alias("w_minus"), "tie_term",
    )


def signed_rank_p(side: str = "two-sided") -> Column:
    """p-value column over the columns of ``signed_rank_sums``."""
    p = tails.signed_rank_col(F.col("w_plus"), F.col("n"), F.col("n_zero"), F.col("tie_term"), side)
    return F.when(F.col("n") > 0, p).otherwise(1.0)


def signed_rank_effect() -> Column:
    total = F.col("w_plus") + F.col("w_minus")
    return F.when(total > 0, (F.col("w_plus") - F.col("w_minus")) / total).otherwise(0.0)


def wilcoxon(df: DataFrame, by: Sequence[str], delta: str, side: str = "two-sided", buckets: int | None = None) -> DataFrame:
    """Signed-rank sums, statistic, p-value and rank-biserial effect per group.

    Zeros are dropped. Without ties or zeros and up to 50 differences the null
    is exact, otherwise the tie-corrected normal is used.
    """
    g = signed_rank_sums(df, by, delta, buckets)
    w = F.least("w_plus", "w_minus") if side == "two-sided" else F.col("w_plus")
    return g.select(
        *by, "n", "n_zero", "w_plus", "w_minus", w.alias("statistic"),
        signed_rank_p(side).alias("p_value"), signed_rank_effect().alias("rank_biserial"),
    )


def rank_biserial(df: DataFrame, by: Sequence[str], delta: str, **kw) -> DataFrame:
    """(W+ - W-) / (W+ + W-), zero without non-zero differences."""
    return wilcoxon(df, by, delta, **kw).select(*by, "rank_biserial")


def run_deltas(runs: DataFrame, run: Sequence[str], arm: str, a: str, b: str, metrics: Sequence[str]) -> DataFrame:
    """Per run and metric the values of both arms and a minus b."""
    from .descriptives import long

    rows = long(runs.where(F.col(arm).isin(a, b)), [*run, arm], metrics)
    g = rows.groupBy(*run, "metric").agg(
        F.max(F.when(F.col(arm) == a, F.col("value"))).alias("value_a"),
        F.max(F.when(F.col(arm) == b, F.col("value"))).alias("value_b"),
    ).where(F.col("value_a").isNotNull() & F.col("value_b").isNotNull())
    return g.withColumn("delta", F.col("value_a") - F.col("value_b"))


def paired_delta(runs: DataFrame, run: Sequence[str], arm: str, a: str, b: str, metrics: Sequence[str],
                 replicates: int = 10_000, seed: int = 2026) -> DataFrame:
    """Summary of paired runs: means, signs, bootstrap interval, tests and FDR."""
    from .ranks import quantiles
    from .replicates import bootstrap_mean_ci

    d = stage(run_deltas(runs, run, arm, a, b, metrics))
    base = d.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("value_a").alias("mean_a"), F.avg("value_b").alias("mean_b"),
        F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("std_delta"),
        F.count_if(F.col("delta") > 0).alias("a_wins"), F.count_if(F.col("delta") < 0).alias("b_wins"),
        F.count_if(F.col("delta") == 0).alias("ties"),
    )
    mid = quantiles(d, ["metric"], "delta", {"median_delta": 0.5}).drop("count")
    ci = bootstrap_mean_ci(d, ["metric"], "delta", [*run, "metric"], replicates, seed).drop("replicates")
    test = signed_rank_sums(d, ["metric"], "delta").select(
        "metric", F.least("w_plus", "w_minus").alias("wilcoxon_stat"), signed_rank_effect().alias("rank_biserial"),
        signed_rank_p().alias("p_two_sided"), signed_rank_p("greater").alias("p_a_greater"),
        signed_rank_p("less").alias("p_b_greater"),
    )
    out = base.join(mid, "metric").join(ci, "metric").join(test, "metric")
    out = out.withColumn(
        "winner_by_mean", F.when(F.col("mean_delta") > 0, a).when(F.col("mean_delta") < 0, b).otherwise("tie"))
    for p, q in (("p_two_sided", "q_two_sided"), ("p_a_greater", "q_a_greater"), ("p_b_greater", "q_b_greater")):
        out = bh_adjust(out, p, q)
    return out


# --- adjusted odds ratios ----------------------------------------------------------------

def adjusted_odds_ratios(df: DataFrame, continuous: Sequence[str], binary: Sequence[str], target: str,
                         group: str | None = None, members: Sequence[str] = (), max_iter: int = 200,
                         tol: float = 1e-8) -> DataFrame:
    """Unpenalised logistic regression by Newton steps, with intervals and FDR.

    Continuous columns are standardised, binaries kept, the group enters as
    k-1 dummies. Each step is one pass: tasks fold their rows into a gradient
    and an information matrix, only those p + p*p sums travel.
    """
    from pyspark import StorageLevel

    spark = df.sparkSession
    dummies = [m for m in members][1:] if group else []
    names = ["intercept", *continuous, *binary, *[f"{group}_{m}" for m in dummies]]
    p = len(names)
    if continuous:
        stat = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in continuous],
                      *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in continuous]).first()
    cols = [F.lit(1.0)]
    for c in continuous:
        scale = stat[f"s_{c}"] or 1.0
        cols.append((F.col(c).cast("double") - float(stat[f"m_{c}"])) / float(scale))
    cols += [F.col(c).cast("double") for c in binary]
    cols += [(F.col(group) == m).cast("double") for m in dummies]
    design = df.select(F.col(target).cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(cols)])
    design = design.persist(StorageLevel.MEMORY_AND_DISK)

    def step(beta):
        def fold(batches):
            import pandas as pd

            total = np.zeros(p + p * p)
            for pdf in batches:
                x = pdf[[f"_x{i}" for i in range(p)]].to_numpy(float)
                mu = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
                w = np.maximum(mu * (1 - mu), 1e-8)
                total[:p] += x.T @ (pdf["_y"].to_numpy(float) - mu)
                total[p:] += ((x.T * w) @ x).ravel()
            yield pd.DataFrame({"i": np.arange(p + p * p), "v": total})

        sums = design.mapInPandas(fold, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(p + p * p)
        for r in sums:
            flat[r["i"]] = r["v"]
        return flat[:p], flat[p:].reshape(p, p)

    beta, converged = np.zeros(p), False
    try:
        for _ in range(max_iter):
            grad, info = step(beta)
            try:
                move = np.linalg.solve(info, grad)
            except np.linalg.LinAlgError:
                move = np.linalg.pinv(info) @ grad
            beta = beta + move
            if np.max(np.abs(move)) < tol:
                converged = True
                break
        _, info = step(beta)
    finally:
        design.unpersist()
    try:
        cov = np.linalg.inv(info)
    except np.linalg.LinAlgError:
        cov = np.linalg.pinv(info)
    se = np.sqrt(np.diag(cov))
    out = spark.createDataFrame(
        [(n, float(b), float(s), bool(converged)) for n, b, s in zip(names, beta, se)],
        "feature string, coef double, std_error double, converged boolean",
    )
    out = out.withColumns({
        "adjusted_odds_ratio": F.exp("coef"),
        "or_ci95_low": F.exp(F.col("coef") - Z95 * F.col("std_error")),
        "or_ci95_high": F.exp(F.col("coef") + Z95 * F.col("std_error")),
        "z_value": F.col("coef") / F.col("std_error"),
    })
    out = out.withColumn("p_value", tails.normal_two_sided_col(F.col("z_value")))
    out = bh_adjust(out, "p_value")
    return effect_label(out, "adjusted_odds_ratio", "or_ci95_low", "or_ci95_high", "fdr_bh", "direction",
                        "higher adjusted risk", "lower adjusted risk")
