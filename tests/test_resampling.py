"""Resampling operators against direct simulation on small samples."""
import math
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens.operators import replicates as rp


def test_bootstrap_mean_close_to_direct(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(10, 3, 400)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "i": range(400), "x": x}))
    r = rp.bootstrap_mean_ci(df, ["g"], "x", ["i"], 2000, 1).first()
    direct = [rng.choice(x, 400).mean() for _ in range(4000)]
    lo, hi = np.quantile(direct, [0.025, 0.975])
    assert r["ci_low"] == pytest.approx(lo, abs=0.05) and r["ci_high"] == pytest.approx(hi, abs=0.05)
    again = rp.bootstrap_mean_ci(df.repartition(13), ["g"], "x", ["i"], 2000, 1).first()
    assert again["ci_low"] == pytest.approx(r["ci_low"], rel=1e-12)


@pytest.mark.parametrize("n", [41, 60])
def test_bootstrap_median_close_to_direct(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.exponential(5, n), 2)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "i": range(n), "x": x}))
    r = rp.bootstrap_median_ci(df, ["g"], "x", ["i"], 8000, 1).first()
    direct = [np.median(rng.choice(x, n)) for _ in range(8000)]
    lo, hi = np.quantile(direct, [0.025, 0.975])
    assert r["ci_low"] == pytest.approx(lo, abs=0.45) and r["ci_high"] == pytest.approx(hi, abs=0.45)


def test_sign_flip_close_to_exact(spark):
    d = np.array([3.0, -1, 2, 5, 4, -2, 1, 6, 2, 1])
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(d)), "d": d}))
    r = rp.sign_flip_test(df, [], "d", ["i"], 4000, 3).first()
    sums = [abs(np.dot(s, d)) for s in product([1, -1], repeat=len(d))]
    exact = np.mean([s >= abs(d.sum()) for s in sums])
    assert r["p_value"] == pytest.approx(exact, abs=0.012)


@pytest.mark.parametrize("shard_cells", [None, 2])
def test_permutation_chi_square(spark, monkeypatch, shard_cells):
    if shard_cells:
        real = rp.permutation_counts
        monkeypatch.setattr(rp, "permutation_counts", lambda *a, **k: real(*a, **k, shard_cells=shard_cells))
    rng = np.random.default_rng(4)
    g = np.array(["x"] * 60 + ["y"] * 40)
    c = np.where(rng.random(100) < np.where(g == "x", 0.55, 0.3), "k1", rng.choice(["k2", "k3", "k4"], 100))
    df = spark.createDataFrame(pd.DataFrame({"g": g, "c": c}))
    r = rp.permutation_chi_square(df, "g", "c", 2000, 9).first()

    def chi(labels):
        t = pd.crosstab(labels, c).to_numpy(float)
        e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
        return ((t - e) ** 2 / e).sum()

    assert r["chi2"] == pytest.approx(chi(g))
    direct = np.mean([chi(rng.permutation(g)) >= r["chi2"] - 1e-9 for _ in range(1500)])
    assert r["p_perm"] == pytest.approx(direct, abs=0.035)


@pytest.mark.parametrize("shard_cells", [None, 7])
def test_permutation_anova(spark, monkeypatch, shard_cells):
    if shard_cells:
        real = rp.permutation_counts
        monkeypatch.setattr(rp, "permutation_counts", lambda *a, **k: real(*a, **k, shard_cells=shard_cells))
    rng = np.random.default_rng(6)
    g = np.repeat(["a", "b", "c"], [20, 25, 15])
    v = np.round(rng.normal(0, 1, 60) + (g == "b") * 0.5, 1)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))
    r = rp.permutation_anova(df, "g", "v", 2000, 2).first()

    def f(labels):
        groups = [v[labels == k] for k in "abc"]
        within = sum(((x - x.mean()) ** 2).sum() for x in groups)
        between = sum(len(x) * (x.mean() - v.mean()) ** 2 for x in groups)
        return (between / 2) / (within / 57)

    assert r["f_stat"] == pytest.approx(f(g))
    direct = np.mean([f(rng.permutation(g)) >= r["f_stat"] - 1e-12 for _ in range(2000)])
    assert r["p_perm"] == pytest.approx(direct, abs=0.035)


def test_anova_without_inner_variance(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    assert math.isinf(rp.anova(df, "g", "v").first()["f_stat"])
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    r = rp.permutation_anova(one, "g", "v", 50).first()
    assert r["f_stat"] == 0.0 and r["p_perm"] == 1.0


def _moments(good, bad, sample):
    n = good + bad
    mean = sample * (good / n)
    return mean, mean * (bad / n) * ((n - sample) / (n - 1))


@pytest.mark.parametrize("good, bad, sample", [
    (3_000_000_000, 1_000_000_000, 1_000_000), (6_000_000_000, 4_000_000_000, 5_000_000_000), (4_000_000_000, 6_000_000_000, 9_000_000_000),
    (40, 10**10, 2 * 10**9), (10**10, 7, 9 * 10**9), (10**15, 3 * 10**15, 10**14), (10**10, 10**10, 3)])
def test_hypergeometric_of_any_size(good, bad, sample):
    """Mean and variance of the law where numpy's generator ends; counts stay inside the margins."""
    from pairlens.functions.hypergeometric import hypergeometric

    reps = 60_000
    out = hypergeometric(np.random.default_rng(0), np.full(reps, good), np.full(reps, bad), np.full(reps, sample))
    mean, var = _moments(good, bad, sample)
    assert abs(out.mean() - mean) < 5 * math.sqrt(var / reps) + 1e-9 and abs(out.var() / var - 1) < 0.04
    assert out.min() >= max(0, sample - bad) and out.max() <= min(good, sample)


def test_rejection_has_the_law_of_small_margins():
    """The sampler for large margins, used on small ones, against the exact probabilities."""
    from pairlens.functions.hypergeometric import _rejected

    for good, bad, sample in ((12, 9, 7), (5, 30, 20), (3, 3, 3), (1, 50, 50)):
        out = _rejected(np.random.default_rng(1), np.full(80_000, good), np.full(80_000, bad), np.full(80_000, sample))
        for k in range(sample + 1):
            want = math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample) if sample - k <= bad else 0
            assert abs((out == k).mean() - want) < 0.008


def test_hypergeometric_without_choice():
    from pairlens.functions.hypergeometric import hypergeometric

    out = hypergeometric(np.random.default_rng(0), [0, 5, 10**10, 7, 0], [5, 0, 0, 10**10, 0], [3, 3, 10**9, 0, 0])
    assert out.tolist() == [0, 3, 10**9, 0, 0]


def test_ids_that_share_their_first_word_get_different_weights():
    """Row ids of 62 bits: with 31 bits two such rows would have one weight in every replicate."""
    from pairlens.functions.draws import PRIME, replicate_constants

    a, c, b = replicate_constants(5, 4000)
    x, y1, y2 = 123456, 777, 778
    u1, u2 = (a * x + c * y1 + b) % PRIME, (a * x + c * y2 + b) % PRIME
    assert abs(np.corrcoef(u1, u2)[0, 1]) < 0.06 and abs(u1.mean() / PRIME - 0.5) < 0.02


def _paths(spark, totals, levels):
    rows = spark.createDataFrame([("k", levels, c, t) for c, t in enumerate(totals)], "g string, levels int, cell long, size long")
    return {r["cell"]: [s.asDict() for s in r["path"]] for r in rp.tree_paths(rows, ["g"], "levels", "cell", "size").collect()}


def test_tree_allocation_keeps_margins_and_means(spark):
    totals, sizes, reps = [40, 10, 25, 0, 25, 100], [120, 80], 3000
    paths = _paths(spark, totals, 3)
    assert [len(p) for p in paths.values()] == [3] * 6 and paths[5][0]["total"] == 200 and paths[5][0]["left"] == 75
    parts = np.stack([rp._descend(3, paths[k], sizes, reps) for k in range(len(totals))])
    assert (parts.sum(axis=1) == np.array(totals)[:, None]).all()
    assert (parts.sum(axis=0) == np.array(sizes)[:, None]).all()
    want = np.array(totals)[:, None] * np.array(sizes) / 200
    assert np.abs(parts.mean(axis=2) - want).max() < 0.4
    # The variance of a hypergeometric count.
    v = 100 * 0.6 * 0.4 * (100 / 199)
    assert abs(parts[5, 0].var() / v - 1) < 0.15


@pytest.mark.parametrize("cell", [16, 4096])
def test_multinomial_weights_sum_to_the_rows(spark, monkeypatch, cell):
    """Every replicate draws as many rows as there are, over one cell or many; means have the bootstrap's deviation."""
    monkeypatch.setattr(rp, "CELL_ROWS", cell)
    rng = np.random.default_rng(2)
    x = rng.normal(5, 2, 700)
    rows = pd.DataFrame({"g": np.where(np.arange(700) < 30, "few", "many"), "i": range(700), "x": x, "one": 1.0})
    rows.loc[5, "x"] = None
    df = spark.createDataFrame(rows).withColumn("x", F.nanvl("x", F.lit(None)))
    sums = rp.multinomial_sums(df, ["g"], "x", ["i"], 600, 4).toPandas()
    assert sums[sums.g == "few"].w.eq(29).all() and sums[sums.g == "many"].w.eq(670).all() and len(sums) == 1200
    ones = rp.multinomial_sums(df, ["g"], "one", ["i"], 50, 4).toPandas()
    assert (ones.wv == ones.w).all()
    for g in ("few", "many"):
        v = rows[rows.g == g].x.dropna()
        m = (sums[sums.g == g].wv / sums[sums.g == g].w)
        assert abs(m.mean() - v.mean()) < 6 * v.std() / math.sqrt(len(v) * 600) and abs(m.std() / (v.std(ddof=0) / math.sqrt(len(v))) - 1) < 0.12


@pytest.mark.parametrize("cell", [8, 4096])
@pytest.mark.parametrize("n", [101, 240])
def test_order_statistics_have_the_law_of_sorted_draws(monkeypatch, cell, n):
    monkeypatch.setattr(rp, "CELL_ROWS", cell)
    places = [0, n // 2 - 1, n // 2, n - 1]
    got = rp.order_statistics(3, "k", n, places, 6000)
    want = np.sort(np.random.default_rng(8).integers(0, n, (6000, n)), axis=1)[:, places]
    assert (np.diff(got, axis=1) >= 0).all()
    assert np.abs(got.mean(0) - want.mean(0)).max() < 0.06 * n ** 0.5 and np.abs(got[:, 1:3].std(0) / want[:, 1:3].std(0) - 1).max() < 0.06
