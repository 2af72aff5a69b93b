"""Models, splits and scoring: optimum, determinism, and batch equals stream."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens.operators import models as md, review, splits as sp, stats
from pairlens.operators.compare import wide
from pairlens.streaming import scoring


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    n = 500
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.5 * x[:, 1] - 0.7)))).astype(int)
    return pd.DataFrame({"id": range(n), "grp": rng.integers(0, 25, n), "a": x[:, 0] * 3 + 1, "b": x[:, 1], "c": x[:, 2], "y": y,
                         "bin": (x[:, 2] > 0).astype(int)})


def newton(x, y, w, ridge):
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        mu = 1 / (1 + np.exp(-x @ beta))
        g = x.T @ (w * (y - mu)) - ridge * beta
        h = (x.T * (w * mu * (1 - mu))) @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        beta += step
        if abs(step).max() < 1e-12:
            break
    return beta


def test_balanced_lr_is_the_penalised_optimum(spark, data):
    m = md.balanced_lr(spark.createDataFrame(data), ["a", "b", "c"], "y")
    x = data[["a", "b", "c"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    y = data.y.to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta = newton(np.c_[np.ones(len(y)), z], y, w, np.array([0.0, 1, 1, 1]))
    assert np.allclose([m.intercept, *m.coefficients], beta, atol=1e-5)
    got = m.transform(spark.createDataFrame(data)).orderBy("id").toPandas()["y_score"].to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-(beta[0] + z @ beta[1:]))), atol=1e-5)
    assert md.balanced_lr(spark.createDataFrame(data).where("y = 1"), ["a"], "y") is None


def test_adjusted_odds_ratios(spark, data):
    r = stats.adjusted_odds_ratios(spark.createDataFrame(data), ["a", "b"], ["bin"], "y").toPandas().set_index("feature")
    a = (data.a - data.a.mean()) / data.a.std(ddof=0)
    b = (data.b - data.b.mean()) / data.b.std(ddof=0)
    x = np.c_[np.ones(len(data)), a, b, data.bin]
    beta = newton(x, data.y.to_numpy(), np.ones(len(data)), np.zeros(4))
    mu = 1 / (1 + np.exp(-x @ beta))
    se = np.sqrt(np.diag(np.linalg.inv((x.T * (mu * (1 - mu))) @ x)))
    names = ["intercept", "a", "b", "bin"]
    assert np.allclose(r.loc[names, "coef"], beta, atol=1e-7) and np.allclose(r.loc[names, "std_error"], se, atol=1e-7)
    assert r.converged.all() and r.loc["a", "direction"] == "higher adjusted risk"


def test_splits_are_grouped_and_repeatable(spark, data):
    df = spark.createDataFrame(data)
    s = sp.group_splits(df, "grp", 6, 0.2, 42)
    assert sp.leaked_groups(s, "grp").count() == 0
    per = s.groupBy("run").agg(F.sum("is_test").alias("t"), F.count("*").alias("n")).collect()
    groups = data.grp.nunique()
    assert all(r["t"] == math.ceil(0.2 * groups) and r["n"] == groups for r in per)
    key = ["run", "grp"]
    again = sp.group_splits(df.repartition(17), "grp", 6, 0.2, 42)
    assert s.toPandas().sort_values(key).reset_index(drop=True).equals(again.toPandas().sort_values(key).reset_index(drop=True))
    f = sp.group_folds(df, "grp", "y", 5).toPandas()
    assert f.groupby("fold").size().max() - f.groupby("fold").size().min() <= 1


def test_train_only_statistics(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 8.0), (0, None), (0, 100.0)], "tr int, x double")
    filled = sp.train_median_impute(df, ["x"], F.col("tr") == 1)
    assert sorted(r["x"] for r in filled.collect()) == [1.0, 3.0, 3.0, 8.0, 100.0]
    std = sp.scale(df, ["x"], F.col("tr") == 1).where("tr = 1").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert std[0] == pytest.approx(0, abs=1e-12) and std[1] == pytest.approx(1)


def test_permutation_importance_finds_the_signal(spark, data):
    df = spark.createDataFrame(data)
    m = md.balanced_lr(df, ["a", "b", "c"], "y")
    drops = md.permutation_importance(m, df, "y", ["id"], repeats=4)
    assert drops.count() == 12
    imp = {r["feature"]: r["permutation_importance"] for r in md.importance_of(drops).collect()}
    assert imp["a"] > imp["b"] > 0.01 and abs(imp["c"]) < 0.02


def test_evaluate_and_triage(spark, data):
    df = spark.createDataFrame(data)
    s = sp.group_splits(df, "grp", 2, 0.3, 42)
    e = md.evaluate_sets(df, {"all": ["a", "b"], "noise": ["c"]}, md.LR, s, "grp", "y").toPandas()
    auc = e.groupby("feature_set")["roc_auc"].mean()
    assert len(e) == 4 and auc["all"] > 0.6 > auc["noise"]
    p = md.triage_runs(df, ["a", "b"], "y", "grp", ["id"], runs=1).toPandas().set_index("policy")
    assert set(p.index) == {"always", "fixed_50", "recall_90", "recall_95", "top_20", "top_50"}
    assert (p.tp + p.fp + p.fn + p.tn == p.n_test).all() and p.loc["always", "coverage"] == 1.0
    assert p.loc["recall_95", "coverage"] >= p.loc["recall_90", "coverage"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"c{i}", f"diff --git a/f b/f\n@@ -1 +1 @@\n" + "+x\n" * (i % 9), i) for i in range(60)]
    df = spark.createDataFrame(rows, "case string, patch string, i int")
    feats = df.selectExpr("case", "i * 40 AS prompt_chars", "i AS prompt_lines", "i * 10 AS prompt_tokens")
    m = md.LinearModel(["patch_churn", "prompt_chars", "patch_density"], {}, [1.0, 2.0, 0.0], [2.0, 100.0, 1.0], [0.4, -0.2, 0.3], 0.1)
    batch = md.batch_score(m, df.select("case", "patch"), feats, "case", "patch")
    df.select("case", "patch").repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("case string, patch string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scores = scoring.score_stream(stream, m, feats, "case", "patch")
    scoring.run_scoring(scores, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 60 and got.exceptAll(batch).count() == 0


def test_wilson_and_ratios_published(spark):
    k = spark.createDataFrame([(13, 19), (0, 0)], "k int, n int")
    lo, hi = review.wilson_ci(F.col("k"), F.col("n"))
    r = k.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert r[0]["lo"] == pytest.approx(0.46010407675327475) and r[0]["hi"] == pytest.approx(0.8463562091220773)
    assert r[1]["lo"] is None
    t = spark.createDataFrame([("f", 69, 35, 245, 331)], "feature string, a long, b long, c long, d long")
    q = stats.odds_ratio(stats.risk_ratio(t)).first()
    assert round(q["risk_ratio"], 4) == 1.5598 and round(q["rr_ci95_low"], 4) == 1.3205
    assert round(q["rr_ci95_high"], 4) == 1.8425 and round(q["odds_ratio"], 4) == 2.6634


def test_single_rater(spark):
    key = spark.createDataFrame([("i1",), ("i2",)], "review_id_v2 string")
    r1 = spark.createDataFrame([("i1", "uncertain ", "PRE_EXISTING")], "review_id_v2 string, validity string, patch_attribution string")
    got = {r["review_id_v2"]: (r["final_validity"], r["disagree"]) for r in review.adjudicate(key, r1, None, None).collect()}
    assert got == {"i1": ("UNCERTAIN", 0), "i2": ("", 0)}


def test_vif_of_collinear_columns(spark, data):
    d = data.assign(d=data.a * 2 + data.b, k=1.0)
    v = {r["feature"]: r["vif"] for r in stats.vif(spark.createDataFrame(d), ["a", "b", "d"]).collect()}
    assert all(math.isinf(x) for x in v.values())
    w = {r["feature"]: r["vif"] for r in stats.vif(spark.createDataFrame(d), ["a", "b", "c"]).collect()}
    m = np.corrcoef(data[["a", "b", "c"]].T.to_numpy())
    assert np.allclose([w[x] for x in "abc"], np.diag(np.linalg.inv(m)))


def test_incomplete_units_are_left_out(spark):
    df = spark.createDataFrame([("u", "x", 1), ("u", "y", 0), ("v", "x", 1)], "u string, g string, y int")
    assert wide(df, ["u"], "g", "y", ["x", "y"]).count() == 1
    q = stats.cochran_q(spark.createDataFrame([("u", "x", 1), ("u", "y", 1)], "u string, g string, y int"), ["u"], "g", "y", ["x", "y"])
    assert q.first()["cochran_q"] is None and q.first()["p_value"] is None


def test_model_queries_take_all_runs_and_features(spark, sf, monkeypatch):
    """30 runs and the 49 statement features reach the operators."""
    from pairlens.functions.text import statement_features
    from pairlens.plans import q_models as q

    made = statement_features(spark.createDataFrame([("x",)], "text string"), "text").columns[1:]
    assert len(made) == 49 and sorted(q.TEXT_FEATURES) == sorted(made)
    seen = {}

    def take(name):
        monkeypatch.setattr(q.md, name, lambda *a, **k: seen.setdefault(name, (a, k)))

    for name in ("evaluate_sets", "leave_group_out", "interaction_test", "triage_runs", "oof_scores"):
        take(name)
    for run in (q.h9, q.h10, q.h13, q.h15t, q.h14o):
        run(spark, sf)
    assert set(q.TEXT_FEATURES) <= set(seen["evaluate_sets"][0][0].columns)
    for name, at in (("evaluate_sets", 3), ("leave_group_out", 3), ("interaction_test", 4)):
        assert seen[name][0][at].select("run").distinct().count() == 30
    assert seen["triage_runs"][1]["runs"] == 30
    assert seen["evaluate_sets"][0][1]["full"] == q.TEXT_FEATURES
    assert sorted(f for fs in seen["leave_group_out"][0][1].values() for f in fs) == sorted(made)
    for name in ("interaction_test", "triage_runs", "oof_scores"):
        assert sorted(seen[name][0][1]) == sorted(made)


def test_splits_fitted_together_equal_single_fits(spark, data):
    """Every split and set of one table against Newton on its own rows, gaps filled with their median."""
    from pairlens.operators.newton import SplitTable

    holes = data.assign(a=data.a.where(data.id % 7 != 0), k=2.5)
    df = spark.createDataFrame(holes).withColumn("a", F.nanvl("a", F.lit(None)))
    splits = sp.group_splits(df, "grp", 3, 0.3, 42)
    roles = splits.select((F.col("run") - 1).alias("no"), "grp", (1 - F.col("is_test")).alias("is_train"), F.col("is_test").alias("is_score"))
    table = SplitTable(df, ["a", "b", "c", "k"], "y", "grp", roles, 3, ["id"])
    sets = {"all": ["a", "b", "c", "k"], "two": ["c", "a"]}
    fits = table.fit(sets, table.usable(score=True))
    test = splits.where("is_test = 1").toPandas()
    scored = table.scored(fits).toPandas()
    for no in range(3):
        left = set(test[test.run == no + 1].grp)
        train = holes[~holes.grp.isin(left)]
        mid = train.a.median()
        y = train.y.to_numpy()
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        for name, fs in sets.items():
            x = train[fs].fillna({"a": mid}).to_numpy()
            z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
            beta = newton(np.c_[np.ones(len(y)), z], y, w, np.array([0.0] + [1.0] * len(fs)))
            assert np.allclose(fits[no, name].beta, beta, atol=1e-8)
            other = holes[holes.grp.isin(left)]
            v = (other[fs].fillna({"a": mid}).to_numpy() - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
            got = scored[(scored.no == no) & (scored.feature_set == name)].sort_values("id")
            assert got.id.tolist() == sorted(other.id)
            assert np.allclose(got.y_score, 1 / (1 + np.exp(-(beta[0] + v @ beta[1:])))[np.argsort(other.id.to_numpy())], atol=1e-8)


def test_balanced_lr_equals_spark_ml(spark, data):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    df = spark.createDataFrame(data)
    m = md.balanced_lr(df, ["a", "b", "c"], "y")
    n, pos = len(data), int(data.y.sum())
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df.withColumn("w", F.when(F.col("y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))))
    v = StandardScaler(inputCol="v", outputCol="x", withMean=True).fit(v).transform(v)
    fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1 / n, standardization=False, maxIter=500, tol=1e-12).fit(v)
    # The scaler divides by the sample deviation, a factor that the penalty sees.
    assert np.allclose(fit.coefficients.toArray(), m.coefficients, rtol=5e-3) and fit.intercept == pytest.approx(m.intercept, abs=1e-4)


def test_runs_with_a_single_class_are_left_out(spark):
    rows = [(i, f"g{i % 6}", float(i % 7), int(i % 6 < 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, grp string, a double, y int")
    splits = spark.createDataFrame([(r, 41 + r, f"g{k}", int(k in t)) for r, t in ((1, (0, 3)), (2, (4, 5)), (3, (0, 1))) for k in range(6)],
                                   "run int, seed int, grp string, is_test int")
    e = md.evaluate_sets(df, {"a": ["a"]}, md.LR, splits, "grp", "y").collect()
    assert [r["run"] for r in e] == [1]
    with pytest.raises(ValueError):
        md.evaluate_sets(df, {"a": ["a"]}, md.LR, splits.where("run > 1"), "grp", "y")


def test_forests_of_all_splits(spark):
    """Trees find what a line cannot, do not depend on the order of rows, and keep groups apart."""
    from pairlens.operators import forest as fo
    from pairlens.operators.newton import SplitTable

    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (600, 4))
    rows = pd.DataFrame({"id": range(600), "grp": rng.integers(0, 20, 600), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "d": 1.0,
                         "y": ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)})
    rows.loc[::11, "c"] = None
    df = spark.createDataFrame(rows).withColumn("c", F.nanvl("c", F.lit(None)))
    splits = sp.group_splits(df, "grp", 2, 0.3, 42)
    sets = {"all": ["a", "b", "c", "d"], "noise": ["c", "d"]}
    e = md.evaluate_sets(df, sets, md.LR_RF, splits, "grp", "y").toPandas().set_index(["algorithm", "feature_set", "run"])
    assert len(e) == 8 and (e.loc["random_forest", "all"].roc_auc > 0.93).all()
    assert (e.loc["random_forest", "noise"].roc_auc < 0.65).all() and (e.loc["logistic_regression", "all"].roc_auc < 0.7).all()

    def scores(frame, **more):
        roles = splits.select((F.col("run") - 1).alias("no"), "grp", (1 - F.col("is_test")).alias("is_train"), F.col("is_test").alias("is_score"))
        table = SplitTable(frame, sets["all"], "y", "grp", roles, 2, ["id"])
        forests = fo.grow_forests(table, {"all": sets["all"]}, [0, 1], trees=30, **more)
        got = fo.scored_by(table, forests, {"all": sets["all"]}).toPandas().sort_values(["no", "id"]).reset_index(drop=True)
        imp = fo.forest_importance(forests, {"all": sets["all"]}, 30).toPandas()
        return got, imp

    got, imp = scores(df)
    again, _ = scores(df.repartition(7))
    assert (got.y_score == again.y_score).all() and got.y_score.between(0, 1).all()
    few, _ = scores(df, sample_rows=100)
    assert len(few) == len(got) and ((few.y_score > 0.5) == few.y_true).mean() > 0.7
    per = imp.pivot(index="no", columns="feature", values="importance")
    assert np.allclose(per.sum(axis=1), 1) and (per[["a", "b"]].sum(axis=1) > 0.7).all() and (per["d"] == 0).all()


def test_one_tree_is_the_best_split():
    from pairlens.operators.forest import _pack, _unpack, grow

    x = np.array([[1.0, 5], [2, 5], [3, 5], [10, 5]])
    y = np.array([0.0, 0, 1, 1])
    t = grow(x, y, np.array([1.0, 1, 1, 2]), np.random.default_rng(0), 3, 1)
    assert t.feature.tolist() == [0, -1, -1] and t.threshold[0] == 2.5 and t.score(x).tolist() == [0, 0, 1, 1]
    assert _unpack(_pack([t, t]))[1].score(x).tolist() == [0, 0, 1, 1]
    flat = grow(np.ones((3, 2)), np.array([0.0, 1, 1]), np.ones(3), np.random.default_rng(0), 3, 1)
    assert flat.feature.tolist() == [-1] and flat.value[0] == pytest.approx(2 / 3)


def test_exchanged_scores_over_many_ranges(spark, monkeypatch):
    """Rank sums of many ranges, ties, null keys and a single class against the ranked table of all rows."""
    from pairlens.operators import exchange
    from pairlens.operators.triage import curve_metrics

    rng = np.random.default_rng(3)
    n = 3000
    rows = [(None if k % 3 == 0 else int(k % 3), i, int(k % 3 != 2 and rng.random() < 0.4), float(a + b), [float(a), float(b)],
             [float(c), float("nan") if i % 50 == 0 else float(d)])
            for i, (k, a, b, c, d) in enumerate(zip(rng.integers(0, 3, n), *np.round(rng.normal(size=(4, n)) * [[1], [4], [1], [4]], 1)))]
    pairs = spark.createDataFrame(rows, "g int, i int, y_true int, _m double, _c array<double>, o__c array<double>").withColumn("repeat", F.col("i") % 2)
    monkeypatch.setattr(exchange, "RANGE_SCORES", 500)
    assert len(exchange._cuts(pairs, n, 2)) > 5
    long = pairs.select("g", "repeat", "y_true", F.posexplode(F.zip_with("_c", "o__c", lambda a, b: F.col("_m") - a + b)).alias("_f", "y_score"))
    want = {(r["g"], r["_f"], r["repeat"]): r["roc_auc"] for r in curve_metrics(long, ["g", "_f", "repeat"]).collect()}
    got = {(r["g"], r["_f"], r["repeat"]): r["roc_auc"] for r in exchange.exchanged_auc(pairs, pairs, ["g"]).collect()}
    assert got == pytest.approx(want, abs=1e-12) and len(got) == 12 and got[2, 0, 0] is None
    assert got[None, 0, 0] is not None


def test_exchanged_scores_do_not_travel_as_rows(spark):
    """A shuffle of rows times features took most of the time of the permutation importance."""
    from pairlens.operators import exchange

    pairs = spark.range(2000).selectExpr("CAST(id AS INT) AS i", "CAST(id % 2 AS INT) AS y_true", "CAST(id AS DOUBLE) AS _m",
                                         "transform(sequence(1, 40), k -> CAST(k AS DOUBLE)) AS _c", "transform(sequence(1, 40), k -> CAST(id AS DOUBLE)) AS o__c",
                                         "1 AS repeat")
    plan = exchange.exchanged_auc(pairs, pairs, [])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_fits_of_all_splits_share_a_block(spark, monkeypatch):
    """Fits from one scaled block for all splits and sets equal those scaled one by one; gaps go the second way."""
    from pairlens.operators import newton

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 18)) * np.logspace(-3, 3, 18) + np.logspace(3, -3, 18)
    y = (x[:, 0] * 1e3 + rng.normal(size=600) > 1e6).astype(int)
    cols = [f"f{k}" for k in range(18)]
    df = spark.createDataFrame([(int(i % 12), int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x))],
                               "g int, y int, " + ", ".join(f"{c} double" for c in cols))
    roles = spark.range(36).selectExpr("CAST(id DIV 12 AS INT) AS no", "CAST(id % 12 AS INT) AS g",
                                       "CAST(id % 3 <> id DIV 12 AS INT) AS is_train", "CAST(id % 3 = id DIV 12 AS INT) AS is_score")
    for names in (cols, cols[:6]):
        sets = {"all": names, "some": names[1:4]}
        table = newton.SplitTable(df, names, "y", "g", roles, 3)
        assert table._common() is not None
        assert table.train_counts[0] == (int((y[np.arange(600) % 12 % 3 != 0] == 0).sum()), int(y[np.arange(600) % 12 % 3 != 0].sum()))
        got = table.fit(sets, [0, 1, 2])
        with monkeypatch.context() as m:
            m.setattr(newton.SplitTable, "_common", lambda self: None)
            want = table.fit(sets, [0, 1, 2])
        for k, f in want.items():
            assert got[k].beta == pytest.approx(f.beta, abs=1e-7)
    gaps = newton.SplitTable(df.withColumn("f1", F.when(F.col("g") != 3, F.col("f1"))), cols, "y", "g", roles, 3)
    assert gaps._common() is None and len(gaps.fit({"all": cols}, [0])) == 1


def test_split_table_is_packed(spark):
    """Passes read blocks, not rows; the flags of any number of splits and the kept columns come back as they were."""
    import numpy as np
    from pairlens.operators import newton

    n, groups = 130, 40
    roles = [(s, g, int((s + g) % 3 > 0), int((s + g) % 3 == 0)) for s in range(n) for g in range(groups)]
    splits = spark.createDataFrame(roles, "no int, g int, is_train int, is_score int")
    df = spark.range(0, 3000, 1, 1).selectExpr(
        "CAST(id % 40 AS INT) AS g", "CASE WHEN id % 7 > 0 THEN 'k' || id END AS name", "CAST(id % 2 AS INT) AS y", "id % 11 AS a", "id % 5 AS b")
    table = newton.SplitTable(df, ["a", "b"], "y", "g", splits, n, ["name"])
    assert table.packed.count() < 3000 / 100
    got = table.rows.collect()
    want = {(r["g"], r["name"], float(r["y"]), (float(r["a"]), float(r["b"]))) for r in df.collect()}
    assert len(got) == 3000 and {(r["g"], r["name"], r["_y"], tuple(r["_x"])) for r in got} == want
    for r in got[:200]:
        assert r["_train"] == [s for s in range(n) if (s + r["g"]) % 3 > 0] and r["_score"] == [s for s in range(n) if (s + r["g"]) % 3 == 0]
    fits = table.fit({"": ["a", "b"]}, [0, 129])
    scored = table.scored(fits).toPandas()
    assert len(scored) == sum((s + i % 40) % 3 == 0 for s in (0, 129) for i in range(3000)) and np.isfinite(scored.y_score).all()
    assert list(table.scored(fits, ()).columns) == ["no", "feature_set", "y_true", "y_score", "y_pred"]


def test_binary_metrics_reads_once(spark):
    """Both kinds of metrics come from one read of the predictions; missing scores count as rows only."""
    from pyspark.sql import functions as F
    from pairlens.operators import triage

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    made = spark.range(0, 400, 1, 4).selectExpr(
        "id % 3 AS k", "CAST(id % 2 AS INT) AS y_true", "CASE WHEN id % 50 = 0 THEN double('NaN') ELSE (id * 37 % 100) / 100 END AS y_score")
    made = made.withColumn("y_pred", F.when(F.isnan("y_score"), 0).otherwise((F.col("y_score") >= 0.5).cast("int")))
    got = triage.binary_metrics(made.mapInArrow(seen, made.schema), ["k"]).toPandas().set_index("k").sort_index()
    assert read.value == 400
    one = triage.confusion_metrics(made, ["k"]).join(triage.curve_metrics(made, ["k"]).drop("n"), "k").toPandas().set_index("k").sort_index()
    assert (got[one.columns] - one).abs().to_numpy().max() < 1e-12
