"""Distributed ranks and quantiles against pandas, for any bucketing and partitioning."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens.operators import ranks, sampling, stats, triage
from pairlens.operators.findings import case_model_summary, multiset_diff


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 4000
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcd"), n))
    # A third of the rows share one value.
    v = np.where(rng.random(n) < 0.33, 7.0, np.round(rng.normal(0, 5, n), 1))
    return pd.DataFrame({"id": range(n), "g": g, "v": v, "y": rng.integers(0, 2, n)})


@pytest.mark.parametrize("buckets,parts", [(1, 1), (5, 7), (64, 16), (300, 3)])
def test_ranked(spark, frame, buckets, parts):
    df = spark.createDataFrame(frame).repartition(parts)
    got = ranks.avg_rank(df, ["g"], "v", buckets=buckets).toPandas().sort_values("id")
    want = frame.groupby("g")["v"].rank(method="average")
    assert np.allclose(got["rank"].to_numpy(), want.to_numpy())
    table = ranks.ranked(df, [], "v", sums=["y"], buckets=buckets).toPandas().sort_values("v")
    assert table["n"].sum() == len(frame) and (table["total"] == len(frame)).all()
    assert np.allclose(table["y_below"], table["y"].cumsum() - table["y"])


@pytest.mark.parametrize("buckets", [1, 9])
def test_quantiles(spark, frame, buckets):
    df = spark.createDataFrame(frame)
    got = ranks.quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.99}, buckets=buckets).toPandas().set_index("g")
    for g, sub in frame.groupby("g"):
        for c, p in (("a", 0.1), ("m", 0.5), ("z", 0.99)):
            assert got.loc[g, c] == pytest.approx(np.quantile(sub["v"], p))


@pytest.mark.parametrize("buckets,desc", [(1, False), (12, False), (12, True)])
def test_positions(spark, frame, buckets, desc):
    df = spark.createDataFrame(frame)
    got = ranks.positions(df, ["g"], "v", ["id"], descending=desc, buckets=buckets).toPandas()
    for _, sub in got.groupby("g"):
        sub = sub.sort_values("position")
        assert list(sub["position"]) == list(range(1, len(sub) + 1))
        step = np.diff(sub["v"])
        assert (step <= 0).all() if desc else (step >= 0).all()


def test_draw_positions_keep(spark, frame):
    df = spark.createDataFrame(frame)
    full = ranks.draw_positions(df, ["g"], F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long"))
    kept = ranks.draw_positions(df, ["g"], F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long"), keep=25)
    a = full.where("position <= 25").select("id", "position").toPandas().sort_values("id").reset_index(drop=True)
    b = kept.select("id", "position").toPandas().sort_values("id").reset_index(drop=True)
    assert a.equals(b)
    other = full.repartition(31).select("id", "position").toPandas().sort_values("id").reset_index(drop=True)
    assert other.equals(full.select("id", "position").toPandas().sort_values("id").reset_index(drop=True))


def test_auc_is_pair_counting(spark, frame):
    df = spark.createDataFrame(frame)
    got = triage.curve_metrics(df, ["g"], "y", "v").toPandas().set_index("g")
    for g, sub in frame.groupby("g"):
        pos, neg = sub.v[sub.y == 1].to_numpy(), sub.v[sub.y == 0].to_numpy()
        diff = pos[:, None] - neg[None, :]
        assert got.loc[g, "roc_auc"] == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())
        ap = 0.0
        for v in sorted(set(sub.v), reverse=True):
            sel = sub.v >= v
            ap += (sub.y[sub.v == v].sum() / sub.y.sum()) * sub.y[sel].mean()
        assert got.loc[g, "pr_auc"] == pytest.approx(ap)


def test_threshold_and_top_fraction(spark, frame):
    df = spark.createDataFrame(frame)
    t = triage.threshold_for_recall(df, ["g"], "y", "v", {"r": 0.9}).toPandas().set_index("g")
    top = sampling.top_fraction(df, ["g"], "v", 0.2, ["id"]).toPandas()
    for g, sub in frame.groupby("g"):
        best = max(v for v in set(sub.v) if sub.y[sub.v >= v].sum() / sub.y.sum() >= 0.9)
        assert t.loc[g, "r"] == best
        k = max(1, int(np.ceil(len(sub) * 0.2)))
        mine = top[top.g == g]
        assert len(mine) == k and sorted(mine.v) == sorted(sorted(sub.v)[-k:])


def test_threshold_without_positives(spark):
    df = spark.createDataFrame([(0, 0.3), (0, 0.7)], "y int, v double")
    assert triage.threshold_for_recall(df, [], "y", "v", {"r": 0.9}).first()["r"] == pytest.approx(0.3 - 1e-12)


def test_bh(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([np.round(rng.random(40) ** 3, 2), [np.nan] * 3])
    pdf = pd.DataFrame({"i": range(len(p)), "f": ["x", "y"] * 21 + ["x"], "p": p})
    df = spark.createDataFrame(pdf).withColumn("p", F.nanvl("p", F.lit(None)))
    for _ in (1,):
        got = stats.bh_adjust(df, "p", family=["f"]).toPandas().set_index("i")["fdr_bh"]
        for _, sub in pdf.groupby("f"):
            s = sub.dropna().sort_values("p")
            q = s.p.to_numpy() * len(s) / np.arange(1, len(s) + 1)
            q = np.minimum(1, np.minimum.accumulate(q[::-1])[::-1])
            assert np.allclose(got.loc[s.i].to_numpy(), q)
            # A larger p never gets a smaller adjusted value.
            assert (np.diff(got.loc[s.i].to_numpy()) >= -1e-15).all()
        assert got.loc[[40, 41, 42]].isna().all()


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_multiset_diff(spark, parts):
    from collections import Counter

    rng = np.random.default_rng(2)

    def rows(n, tag):
        return pd.DataFrame({
            "case": "c", "model": "m", "finding_fingerprint": np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcde"), n)),
            "line_number": np.where(rng.random(n) < 0.5, 3, rng.integers(1, 40, n)), "row_key": [f"{tag}{i}" for i in range(n)],
            "severity": rng.choice(["LOW", "HIGH"], n)})

    b, a = rows(300, "b"), rows(500, "a")
    sb, sa = spark.createDataFrame(b).repartition(parts), spark.createDataFrame(a).repartition(parts)
    got = multiset_diff(sb, sa).toPandas()
    assert len(got) == len(a) and (got.is_new_finding + got.existed_before == 1).all()
    nb, na = Counter(b.finding_fingerprint), Counter(a.finding_fingerprint)
    for fp, sub in got.groupby("finding_fingerprint"):
        assert sub.is_new_finding.sum() == max(0, na[fp] - nb[fp])
        old, new = sub[sub.is_new_finding == 0], sub[sub.is_new_finding == 1]
        if len(old) and len(new):
            assert old.line_number.max() <= new.line_number.min()
    again = multiset_diff(sa, sa).toPandas()
    assert again.is_new_finding.sum() == 0
    s = case_model_summary(sb, multiset_diff(sb, sa)).first()
    matched = sum(min(nb[k], na[k]) for k in nb)
    assert s["findings_resolved_est"] == len(b) - matched and s["findings_new"] == len(a) - matched


@pytest.mark.parametrize("buckets", [1, 60])
def test_merge_intervals(spark, monkeypatch, buckets):
    monkeypatch.setattr(ranks, "bucket_count", lambda df: buckets)
    rng = np.random.default_rng(3)
    s = rng.integers(0, 400, 300)
    pdf = pd.DataFrame({"k": np.where(rng.random(300) < 0.6, "hot", "cold"), "s": s, "e": s + rng.integers(0, 12, 300)})
    got = sampling.merge_intervals(spark.createDataFrame(pdf), ["k"], "s", "e").toPandas()
    for k, sub in pdf.groupby("k"):
        want = []
        for a, b in sorted(zip(sub.s, sub.e)):
            if want and a <= want[-1][1] + 1:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        mine = got[got.k == k].sort_values("s")
        assert [list(x) for x in zip(mine.s, mine.e)] == want


def test_many_bounds_are_searched_not_listed(spark):
    inf, nan = float("inf"), float("nan")
    bounds = [-inf, *np.round(np.linspace(-30, 30, 601), 6), inf]
    values = [None, nan, -inf, inf, -0.0, 0.0, -30.0, 30.0, *np.random.default_rng(3).normal(0, 15, 500).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranks.bucketed(df, "v", bounds)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and len(plan) < 2000
    cuts = np.unique(bounds[1:-1])
    for v, b in got.collect():
        assert b == (0 if v is None else len(cuts) if np.isnan(v) else np.searchsorted(cuts, v, "right"))
    assert ranks.bucketed(df, "v", []).where("_b <> 0").count() == 0
