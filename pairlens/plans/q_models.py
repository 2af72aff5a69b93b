"""Queries for splits, models, triage and streaming (H, I)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx, text as tx
from ..functions.bijection import ROUNDS
from ..operators import models as md, splits as sp, stats, triage as tr
from ..operators.staging import scratch, stage
from ..streaming import scoring
from . import fixtures as fx
from .q_stats import NUMERIC, boot_sql, num, r, rs
from .registry import query
from .sql_fits import balanced_sql

# All 49 statement features, by group.
SETS = {
    "density_complexity": [f"ps_{c}" for c in (
        "chars", "lines", "words", "questions", "numeric_literal_count", "identifier_count", "bullet_count", "constraint_count",
        "modal_count", "chars_per_line", "words_per_line", "identifier_density", "numeric_density")],
    "technical_evidence": [f"ps_{c}" for c in (
        "file_path_count", "unique_file_path_count", "test_reference_count", "traceback_count", "url_count", "code_fence_count")],
    "security_semantics": [
        *[f"ps_domain_{d}" for d in lx.STATEMENT_DOMAINS], *[f"ps_domain_{d}_count" for d in lx.STATEMENT_DOMAINS],
        "ps_security_relevant_domain_count", "ps_explicit_security_term_count"],
}
TEXT_FEATURES = [f for fs in SETS.values() for f in fs]


def labelled_text(spark, sf):
    """Labelled documents with statement features; group = source."""
    d = fx.table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    j = fx.table(spark, sf, "labels").join(d, "doc_id").withColumn("y", F.col("quality"))
    return stage(tx.statement_features(j, "text").select("doc_id", "source", "lang", "y", "toxic", *TEXT_FEATURES))


@query("h1_group_splits", f"""
WITH g AS (SELECT DISTINCT source FROM documents), k AS (SELECT COUNT(*) AS n FROM g),
p AS (SELECT CAST(run AS INTEGER) AS run, CAST(41 + run AS INTEGER) AS seed, source, ROW_NUMBER() OVER (PARTITION BY run
  ORDER BY {fx.h32("(41 + run) || '|' || source")}, source) AS rn FROM g, range(1, 31) t(run))
SELECT run, seed, source, CAST(rn <= ceil(0.2 * n) AS INTEGER) AS is_test FROM p, k""")
def h1(spark, sf):
    return sp.group_splits(fx.table(spark, sf, "documents"), "source", 30, 0.2, 42)


_GAPS = {**NUMERIC, "k": "l_orderkey", "pk": "l_partkey", "sk": "l_suppkey", "train": "l_linestatus = 'O'",
         "x": "CASE WHEN l_discount > 0.08 THEN NULL ELSE l_extendedprice END"}
fx.SQL["gaps"] = ([], f"SELECT {fx._select(_GAPS)} FROM lineitem")


@query("h2_train_median_impute", """
SELECT k, run, pk, sk, ROUND(COALESCE(x, (SELECT quantile_cont(x, 0.5) FROM gaps WHERE train)), 4) AS x,
  ROUND(qty, 2) AS qty FROM gaps""", ["gaps"])
def h2(spark, sf):
    g = fx.view(spark, sf, "lineitem", _GAPS)
    d = sp.train_median_impute(g, ["x", "qty"], F.col("train"))
    return d.select("k", "run", "pk", "sk", F.round("x", 4).alias("x"), F.round("qty", 2).alias("qty"))


@query("h3_scale_standard", """
, f AS (SELECT AVG(price) AS mu, stddev_pop(price) AS sd FROM gaps WHERE train)
SELECT k, run, pk, sk, ROUND((price - mu) / sd, 6) AS price FROM gaps, f""", ["gaps"])
def h3(spark, sf):
    d = sp.scale(fx.view(spark, sf, "lineitem", _GAPS), ["price"], F.col("train"))
    return d.select("k", "run", "pk", "sk", F.round("price", 6).alias("price"))


@query("h3_scale_minmax", """
, f AS (SELECT MIN(price) AS a, MAX(price) AS b FROM gaps WHERE train)
SELECT k, run, pk, sk, ROUND((price - a) / (b - a), 6) AS price FROM gaps, f""", ["gaps"])
def h3m(spark, sf):
    d = sp.scale(fx.view(spark, sf, "lineitem", _GAPS), ["price"], F.col("train"), "minmax")
    return d.select("k", "run", "pk", "sk", F.round("price", 6).alias("price"))


NUM_FEATURES = ["qty", "disc", "tax", "price"]


@query("h4_balanced_lr")
def h4(spark, sf):
    d = labelled_text(spark, sf)
    m = md.balanced_lr(d, TEXT_FEATURES, "y")
    return md.coefficients(spark, [(0, "full", "logistic_regression", m)])


_PLAIN = f"SELECT 1 AS r, y, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in NUM_FEATURES)} FROM num"


@query("h4_balanced_lr_numbers", f", q AS ({_PLAIN}), " + balanced_sql("q", "true", NUM_FEATURES, "nt") + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND(b[{k}], 7) AS coefficient, ROUND(b[{k}] / d_{c}, 9) AS raw_coefficient FROM nt, nt_f"
    for k, c in enumerate(NUM_FEATURES, 2)), ["num"])
def h4n(spark, sf):
    m = md.balanced_lr(num(spark, sf), NUM_FEATURES, "y")
    return md.coefficients(spark, [(0, "full", "logistic_regression", m)]).select(
        "feature", F.round("coefficient", 7).alias("coefficient"), F.round("raw_coefficient", 9).alias("raw_coefficient"))


@query("h5_balanced_rf")
def h5(spark, sf):
    d = labelled_text(spark, sf)
    m = md.balanced_rf(d, TEXT_FEATURES, "y", trees=100, depth=15)
    return m.transform(d).select("doc_id", "y", "y_score", "y_pred")


# Predictions: score from the price, threshold one half.
def preds(spark, sf):
    return num(spark, sf).selectExpr("run", "y AS y_true", "score AS y_score", "CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS y_pred")


_CONF = """
, c AS (SELECT run, COUNT(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn, COUNT(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp,
  COUNT(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, COUNT(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp FROM num GROUP BY 1)
SELECT run, tn, fp, fn, tp, """ + rs({
    "accuracy": "(tp + tn) / (tp + tn + fp + fn)", "balanced_accuracy": "(tp / (tp + fn) + tn / (tn + fp)) / 2",
    "precision_1": "tp / (tp + fp)", "recall_1": "tp / (tp + fn)", "f1_1": "2.0 * tp / (2 * tp + fp + fn)"}, 8) + " FROM c"


@query("h6_confusion_metrics", _CONF, ["num"])
def h6(spark, sf):
    m = tr.confusion_metrics(preds(spark, sf), ["run"])
    return m.withColumns(r(["accuracy", "balanced_accuracy", "precision_1", "recall_1", "f1_1"], 8))


@query("h7_roc_auc", """
, k AS (SELECT run, y, RANK() OVER (PARTITION BY run ORDER BY score) + (COUNT(*) OVER (PARTITION BY run, score) - 1) / 2.0 AS rk FROM num)
SELECT run, ROUND((SUM(rk) FILTER (WHERE y = 1) - SUM(y) * (SUM(y) + 1) / 2) / (SUM(y) * (COUNT(*) - SUM(y))), 8) AS roc_auc FROM k GROUP BY 1""", ["num"])
def h7(spark, sf):
    return tr.roc_auc(preds(spark, sf), ["run"]).withColumns(r(["roc_auc"], 8))


@query("h8_average_precision", """
, d AS (SELECT run, score, SUM(y) AS p, COUNT(*) AS n FROM num GROUP BY 1, 2),
c AS (SELECT *, SUM(p) OVER w AS tp, SUM(n) OVER w AS sel FROM d WINDOW w AS (PARTITION BY run ORDER BY score DESC))
SELECT run, ROUND(SUM(p * tp / sel) / SUM(p), 8) AS pr_auc FROM c GROUP BY 1""", ["num"])
def h8(spark, sf):
    return tr.average_precision(preds(spark, sf), ["run"]).withColumns(r(["pr_auc"], 8))


# Runs of the split-based queries, as published, and the metrics that are compared.
RUNS = 30
METRICS = ["accuracy", "balanced_accuracy", "precision_1", "recall_1", "f1_1", "roc_auc", "pr_auc"]


@query("h9_evaluate_sets")
def h9(spark, sf):
    d = labelled_text(spark, sf)
    s = sp.group_splits(d, "source", RUNS, 0.2, 42)
    return md.evaluate_sets(d, {**SETS, "full": TEXT_FEATURES}, md.LR_RF, s, "source", "y")


@query("h9_regression_against_forest")
def h9p(spark, sf):
    """Both classifiers on the same splits: paired differences of every metric."""
    d = labelled_text(spark, sf)
    m = stage(md.evaluate_sets(d, {"full": TEXT_FEATURES}, md.LR_RF, sp.group_splits(d, "source", RUNS, 0.2, 42), "source", "y"))
    return stats.paired_delta(m, ["run"], "algorithm", "logistic_regression", "random_forest", METRICS)


# Line items by supplier: the same fits, scores and metrics of every run in SQL.
NUMBER_RUNS = 3
NUMBER_SETS = {"all": NUM_FEATURES, "two": ["qty", "disc"]}
fx.SQL["by_supplier"] = ([], f"SELECT l_suppkey AS sk, {fx.FINDING['row_key']} AS row_key, {NUMERIC['y']} AS y, "
                         + ", ".join(f"CAST({NUMERIC[c]} AS DOUBLE) AS {c}" for c in NUM_FEATURES) + " FROM lineitem")


def by_supplier(spark, sf):
    return fx.view(spark, sf, "lineitem", {"sk": "l_suppkey", "row_key": fx.FINDING["row_key"], **{c: NUMERIC[c] for c in ("y", *NUM_FEATURES)}})


def _score(name: str, features) -> str:
    margin = " + ".join(f"b[{k}] * (({c} - m_{c}) / d_{c})" for k, c in enumerate(features, 2))
    return f"1 / (1 + exp(-(b[1] + {margin})))"


_RUNS_SQL = f"""
, g AS (SELECT DISTINCT sk FROM by_supplier), c AS (SELECT COUNT(*) AS n FROM g),
u AS (SELECT run AS r, sk, CAST(ROW_NUMBER() OVER (PARTITION BY run ORDER BY {fx.h32("(41 + run) || '|' || sk")}, sk) <= ceil(0.2 * n) AS INTEGER) AS is_test
  FROM g, range(1, {NUMBER_RUNS + 1}) t(run), c),
q AS (SELECT u.r, u.is_test, d.* FROM by_supplier d JOIN u ON d.sk = u.sk), """

_TESTED = " UNION ALL ".join(
    f"SELECT q.r AS run, '{n}' AS feature_set, y, {_score(n, fs)} AS s FROM q JOIN {n}_n b ON q.r = b.r JOIN {n}_n_f f ON q.r = f.r WHERE is_test = 1"
    for n, fs in NUMBER_SETS.items())


@query("h9_evaluate_numbers", _RUNS_SQL + ", ".join(balanced_sql("q", "is_test = 0", fs, f"{n}_n") for n, fs in NUMBER_SETS.items()) + f""",
o AS ({_TESTED}), k AS (SELECT run, feature_set, COUNT(*) FILTER (WHERE y = 0 AND s < 0.5) AS tn, COUNT(*) FILTER (WHERE y = 0 AND s >= 0.5) AS fp,
  COUNT(*) FILTER (WHERE y = 1 AND s < 0.5) AS fn, COUNT(*) FILTER (WHERE y = 1 AND s >= 0.5) AS tp FROM o GROUP BY 1, 2),
a AS (SELECT run, feature_set, (SUM(rk) FILTER (WHERE y = 1) - SUM(y) * (SUM(y) + 1) / 2) / (SUM(y) * (COUNT(*) - SUM(y))) AS auc FROM (
  SELECT *, RANK() OVER (PARTITION BY run, feature_set ORDER BY ROUND(s, 12)) + (COUNT(*) OVER (PARTITION BY run, feature_set, ROUND(s, 12)) - 1) / 2.0 AS rk FROM o) GROUP BY 1, 2)
SELECT CAST(k.run AS INTEGER) AS run, k.feature_set, tn, fp, fn, tp, {rs({"accuracy": "(tp + tn) / (tp + tn + fp + fn)", "recall_1": "tp / (tp + fn)"})},
  ROUND(auc, 6) AS roc_auc FROM k JOIN a ON k.run = a.run AND k.feature_set = a.feature_set""", ["by_supplier"])
def h9n(spark, sf):
    d = by_supplier(spark, sf)
    m = md.evaluate_sets(d, NUMBER_SETS, md.LR, sp.group_splits(d, "sk", NUMBER_RUNS, 0.2, 42), "sk", "y")
    return m.select(F.col("run").cast("int").alias("run"), "feature_set", "tn", "fp", "fn", "tp", F.round("accuracy", 6).alias("accuracy"),
                    F.round("recall_1", 6).alias("recall_1"), F.round("roc_auc", 6).alias("roc_auc"))


@query("h10_leave_group_out")
def h10(spark, sf):
    d = labelled_text(spark, sf)
    s = sp.group_splits(d, "source", RUNS, 0.2, 42)
    return md.leave_group_out(d, SETS, md.LR_RF, s, "source", "y")


NUMBER_GROUPS = {"amount": ["qty", "price"], "rates": ["disc", "tax"]}
_LEFT = {"full": [f for fs in NUMBER_GROUPS.values() for f in fs], "amount": NUMBER_GROUPS["rates"], "rates": NUMBER_GROUPS["amount"]}


@query("h10_leave_group_numbers", _RUNS_SQL + ", ".join(balanced_sql("q", "is_test = 0", fs, f"{n}_n") for n, fs in _LEFT.items()) + ", o AS (" + " UNION ALL ".join(
    f"SELECT q.r AS run, '{n}' AS left_out, y, ROUND({_score(n, fs)}, 12) AS s FROM q JOIN {n}_n b ON q.r = b.r JOIN {n}_n_f f ON q.r = f.r WHERE is_test = 1"
    for n, fs in _LEFT.items()) + """),
a AS (SELECT run, left_out, (SUM(rk) FILTER (WHERE y = 1) - SUM(y) * (SUM(y) + 1) / 2) / (SUM(y) * (COUNT(*) - SUM(y))) AS auc FROM (
  SELECT *, RANK() OVER (PARTITION BY run, left_out ORDER BY s) + (COUNT(*) OVER (PARTITION BY run, left_out, s) - 1) / 2.0 AS rk FROM o) GROUP BY 1, 2)
SELECT CAST(a.run AS INTEGER) AS run, a.left_out AS group_removed, 2 AS n_removed, ROUND(f.auc, 6) AS auc_full, ROUND(a.auc, 6) AS auc_without_group
FROM a JOIN a f ON a.run = f.run AND f.left_out = 'full' WHERE a.left_out <> 'full'""", ["by_supplier"])
def h10n(spark, sf):
    d = by_supplier(spark, sf)
    m = md.leave_group_out(d, NUMBER_GROUPS, md.LR, sp.group_splits(d, "sk", NUMBER_RUNS, 0.2, 42), "sk", "y")
    return m.select(F.col("run").cast("int").alias("run"), "group_removed", F.col("n_removed").cast("int").alias("n_removed"),
                    F.round("auc_full", 6).alias("auc_full"), F.round("auc_without_group", 6).alias("auc_without_group"))


@query("h11_permutation_importance")
def h11(spark, sf):
    d = labelled_text(spark, sf)
    return md.importance_runs(d, TEXT_FEATURES, sp.group_splits(d, "source", RUNS, 0.2, 42), "source", "y", ["doc_id"], repeats=10)


# A fixed scorer over all line items; the shuffles are the same bijection of row numbers in SQL, its walk unrolled.
SHUFFLED = md.LinearModel(["qty", "disc", "tax"], {}, [25.0, 0.05, 0.04], [16.0, 0.03125, 0.03125], [0.5, -0.75, 0.25], -0.125)
SHUFFLES, SHUFFLE_SEED = 2, 42


def _walk(source: str, steps: int) -> str:
    """CTEs that send column x of ``source`` (x, n, key) through the rounds, and again where it is not below n."""
    out = f"p0 AS (SELECT *, true AS go, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM {source})"
    for w in range(steps):
        out += f", p{w}d AS (SELECT *, x // b AS l, x % b AS r FROM p{w})"
        at = f"p{w}d"
        for k in range(ROUNDS):
            own, other, size = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
            draw = fx.h32(f"key || '|{k}|' || {other}")
            out += f", p{w}r{k} AS (SELECT * REPLACE (({own} + {draw}) % {size} AS {own}) FROM {at})"
            at = f"p{w}r{k}"
        out += f", p{w + 1} AS (SELECT * EXCLUDE (l, r) REPLACE (CASE WHEN go THEN l * b + r ELSE x END AS x, go AND l * b + r >= n AS go) FROM {at})"
    return out


def _part(k: int) -> str:
    m = SHUFFLED
    value = f"CAST({m.features[k]} AS DOUBLE)"
    return f"CAST({m.coefficients[k]} AS DOUBLE) * (({value} - CAST({m.means[k]} AS DOUBLE)) / CAST({m.scales[k]} AS DOUBLE))"


_AUC = """SELECT {by}, (SUM(rk) FILTER (WHERE y = 1) - SUM(y) * (SUM(y) + 1) / 2) / (SUM(y) * (COUNT(*) - SUM(y))) AS auc FROM (
  SELECT {by}, y, RANK() OVER (PARTITION BY {by} ORDER BY s) + (COUNT(*) OVER (PARTITION BY {by}, s) - 1) / 2.0 AS rk FROM {rows}) GROUP BY {by}"""

fx.SQL["kept"] = ([], f"SELECT {fx._select({**NUMERIC, 'row_key': fx.FINDING['row_key']})} FROM lineitem")


@query("h11_keyed_shuffle", f"""
, s AS (SELECT run, y, row_key, {_part(0)} AS c0, {_part(1)} AS c1, {_part(2)} AS c2 FROM kept),
m AS (SELECT *, CAST({SHUFFLED.intercept} AS DOUBLE) + (((CAST(0.0 AS DOUBLE) + c0) + c1) + c2) AS m,
  ROW_NUMBER() OVER (PARTITION BY run ORDER BY {fx.h32(f"'{SHUFFLE_SEED}|' || row_key")}, row_key) AS rn, COUNT(*) OVER (PARTITION BY run) AS n FROM s),
q AS (SELECT run, rep, n, rn - 1 AS x, '{SHUFFLE_SEED}|' || rep || '|' || run AS key, c0, c1, c2 FROM m, range(1, {SHUFFLES + 1}) t(rep)),
{_walk("q", 6)},
j AS (SELECT m.run, p.rep, m.y, m.m - m.c0 + p.c0 AS s0, m.m - m.c1 + p.c1 AS s1, m.m - m.c2 + p.c2 AS s2
  FROM p6 p JOIN m ON p.run = m.run AND p.x = m.rn - 1),
f AS (SELECT run, rep, y, 'qty' AS feature, s0 AS s FROM j UNION ALL SELECT run, rep, y, 'disc', s1 FROM j UNION ALL SELECT run, rep, y, 'tax', s2 FROM j),
o AS (SELECT run, y, m AS s FROM m), w AS ({_AUC.format(by="run", rows="o")}), d AS ({_AUC.format(by="run, feature, rep", rows="f")})
SELECT d.run, d.feature, CAST(d.rep AS INTEGER) AS repeat, ROUND(w.auc - d.auc, 8) AS auc_drop FROM d JOIN w ON d.run = w.run""", ["kept"])
def h11s(spark, sf):
    rows = fx.view(spark, sf, "lineitem", {**NUMERIC, "row_key": fx.FINDING["row_key"]})
    d = md.permutation_importance(SHUFFLED, rows, "y", ["row_key"], SHUFFLES, SHUFFLE_SEED, ["run"])
    return d.withColumns(r(["auc_drop"], 8))


@query("h12_impurity_importance")
def h12(spark, sf):
    d = labelled_text(spark, sf)
    m = md.balanced_rf(d, TEXT_FEATURES, "y", trees=100, depth=15)
    return md.impurity_importance(spark, [(0, "full", "random_forest", m)])


@query("h13_interaction_test")
def h13(spark, sf):
    d = labelled_text(spark, sf)
    s = sp.group_splits(d, "source", RUNS, 0.2, 42)
    return md.interaction_test(d, TEXT_FEATURES, "lang", ["de", "en", "es", "fr"], s, "source", "y", 10_000)


@query("h14_group_folds", """
WITH g AS (SELECT d.source, CAST(SUM(l.quality) AS BIGINT) AS positives FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1),
p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY positives DESC, md5('42|' || source)) - 1 AS p FROM g)
SELECT source, positives, CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INTEGER) AS fold FROM p""")
def h14(spark, sf):
    return sp.group_folds(fx.scored(spark, sf), "source", "y", 5, 42)


@query("h14_oof_scores")
def h14o(spark, sf):
    return md.oof_scores(labelled_text(spark, sf), TEXT_FEATURES, "y", "source", 5, 42, keep=["doc_id"])


@query("h14_oof_numbers", f"""
, g AS (SELECT sk, CAST(SUM(y) AS BIGINT) AS positives FROM by_supplier GROUP BY 1),
p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY positives DESC, md5('42|' || sk)) - 1 AS p FROM g),
f AS (SELECT sk, CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INTEGER) AS fold FROM p),
q AS (SELECT k.k AS r, f.fold, d.* FROM by_supplier d JOIN f ON d.sk = f.sk, range(0, 5) k(k)), """ + balanced_sql("q", "fold <> q.r", NUM_FEATURES, "nt") + f"""
SELECT sk, fold, row_key, y AS y_true, ROUND({_score("nt", NUM_FEATURES)}, 8) AS y_score FROM q JOIN nt b ON q.r = b.r JOIN nt_f f ON q.r = f.r WHERE fold = q.r""",
       ["by_supplier"])
def h14n(spark, sf):
    o = md.oof_scores(by_supplier(spark, sf), NUM_FEATURES, "y", "sk", 5, 42, keep=["row_key"])
    return o.withColumns({"fold": F.col("fold").cast("int"), **r(["y_score"], 8)})


_IDS = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"
fx.SQL["sc"] = ([], f"SELECT l_linenumber AS run, {NUMERIC['y']} AS y, {NUMERIC['score']} AS score, {_IDS} AS id FROM lineitem")

_POLICY = """
, t AS (SELECT run, MAX(score) FILTER (WHERE tp >= 0.9 * pos - 1e-9) AS recall_90, MAX(score) FILTER (WHERE tp >= 0.95 * pos - 1e-9) AS recall_95
  FROM (SELECT run, score, SUM(SUM(y)) OVER (PARTITION BY run ORDER BY score DESC) AS tp, SUM(SUM(y)) OVER (PARTITION BY run) AS pos FROM sc GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT sc.*, ROW_NUMBER() OVER (PARTITION BY sc.run ORDER BY score DESC, md5(id)) AS rn, COUNT(*) OVER (PARTITION BY sc.run) AS n, recall_90, recall_95 FROM sc JOIN t ON sc.run = t.run),
a AS (SELECT run, y, 'always' AS policy, true AS s FROM k UNION ALL SELECT run, y, 'fixed_50', score >= 0.5 FROM k UNION ALL
  SELECT run, y, 'recall_90', score >= recall_90 FROM k UNION ALL SELECT run, y, 'recall_95', score >= recall_95 FROM k UNION ALL
  SELECT run, y, 'top_20', rn <= greatest(1, ceil(n * 0.2)) FROM k UNION ALL SELECT run, y, 'top_50', rn <= greatest(1, ceil(n * 0.5)) FROM k),
c AS (SELECT run, policy, COUNT(*) FILTER (WHERE y = 1 AND s) AS tp, COUNT(*) FILTER (WHERE y = 0 AND s) AS fp, COUNT(*) FILTER (WHERE y = 1 AND NOT s) AS fn,
  COUNT(*) FILTER (WHERE y = 0 AND NOT s) AS tn FROM a GROUP BY 1, 2),
m AS (SELECT *, tp + fp + fn + tn AS n_test, tp + fp AS n_selected, tp + fn AS positives FROM c)"""
_PCOLS = {"coverage": "n_selected / n_test", "workload_reduction": "1 - n_selected / n_test", "finding_recall": "tp / positives",
          "miss_rate": "fn / positives", "precision_selected": "tp / n_selected", "baseline_prevalence": "positives / n_test",
          "lift": "(tp / n_selected) / (positives / n_test)"}


def _policies(spark, sf):
    s = fx.view(spark, sf, "lineitem", {"run": "l_linenumber", "y": NUMERIC["y"], "score": NUMERIC["score"], "id": _IDS})
    t = tr.threshold_for_recall(s, ["run"], "y", "score", tr.RECALL_TARGETS)
    return tr.policy_metrics(s, ["run"], "y", "score", ["id"], t)


@query("h15_policy_metrics", _POLICY + "SELECT run, policy, tp, fp, fn, tn, n_test, n_selected, positives, " + rs(_PCOLS, 8) + " FROM m", ["sc"])
def h15(spark, sf):
    return _policies(spark, sf).withColumns(r(_PCOLS, 8))


@query("h15_triage_runs")
def h15t(spark, sf):
    return md.triage_runs(labelled_text(spark, sf), TEXT_FEATURES, "y", "source", ["doc_id"], runs=RUNS)


# Two runs over line items by supplier with everything in SQL: outer fits, five inner folds each, thresholds, policies.
_TRIAGE = 2


@query("h15_triage_numbers", f"""
, g AS (SELECT sk, CAST(SUM(y) AS BIGINT) AS positives FROM by_supplier GROUP BY 1), gn AS (SELECT COUNT(*) AS n FROM g),
u AS (SELECT run, sk, positives, CAST(ROW_NUMBER() OVER (PARTITION BY run ORDER BY {fx.h32("(41 + run) || '|' || sk")}, sk) <= ceil(0.2 * n) AS INTEGER) AS is_test
  FROM g, range(1, {_TRIAGE + 1}) t(run), gn),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY positives DESC, md5((41 + run) || '|' || sk)) - 1 AS p FROM u WHERE is_test = 0),
f AS (SELECT run, sk, CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS fold FROM p),
w AS (SELECT run, 6 * (run - 1) AS r, sk, is_test = 0 AS tr, is_test = 1 AS ts FROM u
  UNION ALL SELECT run, 6 * (run - 1) + 1 + k, sk, fold <> k, fold = k FROM f, range(0, 5) t(k)),
q AS (SELECT w.run, w.r, w.tr, w.ts, d.* FROM by_supplier d JOIN w ON d.sk = w.sk), """ + balanced_sql("q", "tr", NUM_FEATURES, "nt") + f""",
scored AS (SELECT CAST(run AS INTEGER) AS run, q.r % 6 AS inner_fold, y, row_key AS id, {_score("nt", NUM_FEATURES)} AS score
  FROM q JOIN nt b ON q.r = b.r JOIN nt_f z ON q.r = z.r WHERE ts),
oof AS (SELECT * FROM scored WHERE inner_fold > 0), sc AS (SELECT * FROM scored WHERE inner_fold = 0)""" + _POLICY.replace(
    "AS pos FROM sc GROUP BY 1, 2", "AS pos FROM oof GROUP BY 1, 2") +
       "SELECT run, policy, tp, fp, fn, tn, n_test, n_selected, positives, " + rs(_PCOLS, 8) + " FROM m", ["by_supplier"])
def h15n(spark, sf):
    t = md.triage_runs(by_supplier(spark, sf), NUM_FEATURES, "y", "sk", ["row_key"], runs=_TRIAGE)
    return t.withColumns({"run": F.col("run").cast("int"), **r(_PCOLS, 8)})


_H16_ID = "run || '|' || policy || '|' || metric"


@query("h16_policy_summary", _POLICY + ", l AS (" + " UNION ALL ".join(
    f"SELECT run, policy, '{c}' AS metric, CAST({_PCOLS[c]} AS DOUBLE) AS v FROM m" for c in tr.POLICY_METRICS) + f"""),
src AS (SELECT policy || '|' || metric AS g, v, {fx.h32(_H16_ID)} AS x, {fx.h32(_H16_ID, 1)} AS y FROM l WHERE v IS NOT NULL),
{boot_sql("src", 2026, 20_000)}
SELECT policy, metric, COUNT(v) AS n_runs, {rs({"mean": "AVG(v)", "std": "stddev_samp(v)"}, 8)}, ROUND(ANY_VALUE(ci_low), 8) AS ci_low,
  ROUND(ANY_VALUE(ci_high), 8) AS ci_high FROM l JOIN boot ON boot.g = policy || '|' || metric GROUP BY 1, 2""", ["sc"])
def h16(spark, sf):
    s = tr.policy_summary(stage(_policies(spark, sf)), "policy", ["run"], replicates=20_000)
    return s.withColumns(r(["mean", "std", "ci_low", "ci_high"], 8))


@query("h17_linear_attribution", "SELECT k, run, pk, sk, 'qty' AS feature, ROUND(qty, 4) AS value, ROUND(0.5 * (qty - 25.0) / 14.0, 8) + 0.0 AS attribution FROM gaps "
       "UNION ALL SELECT k, run, pk, sk, 'tax', ROUND(tax, 4), ROUND(-2.0 * (tax - 0.04) / 0.025, 8) + 0.0 FROM gaps", ["gaps"])
def h17(spark, sf):
    m = md.LinearModel(["qty", "tax"], {}, [25.0, 0.04], [14.0, 0.025], [0.5, -2.0], 0.1)
    a = md.linear_attribution(m, fx.view(spark, sf, "lineitem", _GAPS), ["k", "run", "pk", "sk"])
    return a.withColumns({"value": F.round("value", 4), "attribution": F.round("attribution", 8) + F.lit(0.0)})


SCORER = md.LinearModel(
    ["patch_churn", "patch_hunks", "patch_files_touched", "patch_density", "prompt_chars", "prompt_size_category"], {},
    [0.0] * 6, [1.0] * 6, [0.02, 0.3, -0.1, 0.7, -0.0001, 0.2], -0.8)

_SCORE_SQL = """
, m AS (SELECT d."case", d.patch, length(o.text) AS chars FROM diffs d JOIN documents o ON d."case" = 'doc-' || o.doc_id),
f AS (SELECT "case", chars, len(regexp_extract_all(patch, '(?m)^\\+')) - len(regexp_extract_all(patch, '(?m)^\\+\\+\\+')) AS ad,
  len(regexp_extract_all(patch, '(?m)^-')) - len(regexp_extract_all(patch, '(?m)^---')) AS rm, len(regexp_extract_all(patch, '(?m)^@@')) AS hk,
  CASE WHEN starts_with(patch, '--- ') THEN 1 ELSE 2 END AS fl, len(string_split(patch, E'\\n')) - 1 AS ls FROM m),
s AS (SELECT "case", -0.8 + 0.02 * (ad + rm) + 0.3 * hk - 0.1 * fl + 0.7 * ((ad + rm) / (ls + 1.0)) - 0.0001 * chars +
  0.2 * CASE WHEN chars <= 500 THEN 0 WHEN chars <= 1000 THEN 1 WHEN chars <= 2000 THEN 2 ELSE 3 END AS z FROM f)
SELECT "case", ROUND(CAST(1 / (1 + exp(-z)) AS DOUBLE), 8) AS y_score, CAST(1 / (1 + exp(-z)) >= 0.5 AS INTEGER) AS y_pred FROM s"""


def case_features(spark, sf, wanted=None):
    d = fx.documents(spark, sf, wanted).select(F.concat(F.lit("doc-"), "doc_id").alias("case"), "text")
    return tx.text_size(d, "text").drop("text")


@query("h18_batch_score", _SCORE_SQL, ["diffs"])
def h18(spark, sf):
    d = fx.diffs(spark, sf).select("case", "patch")
    return md.batch_score(SCORER, d, case_features(spark, sf), "case", "patch").withColumns(r(["y_score"], 8))


@query("i1_score_stream", _SCORE_SQL, ["diffs"])
def i1(spark, sf):
    """All diffs are written as files, scored as a stream, and read back."""
    base = scratch(spark)
    fx.diffs(spark, sf).select("case", "patch").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("case string, patch string").parquet(f"{base}/in")
    scores = scoring.score_stream(stream, SCORER, stage(case_features(spark, sf)), "case", "patch")
    scoring.run_scoring(scores, f"{base}/out", f"{base}/ck").awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumns(r(["y_score"], 8))


# The same features under a model fitted on the labelled documents.
_PATCH = {"patch_churn": "ad + rm", "patch_hunks": "hk", "patch_files_touched": "fl", "patch_density": "(ad + rm) / (ls + 1.0)", "prompt_chars": "chars",
          "prompt_size_category": "CASE WHEN chars <= 500 THEN 0 WHEN chars <= 1000 THEN 1 WHEN chars <= 2000 THEN 2 ELSE 3 END"}
_FITTED_SQL = _SCORE_SQL[:_SCORE_SQL.index(",\ns AS (")] + """,
v AS (SELECT 1 AS r, "case", """ + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _PATCH.items()) + """ FROM f),
q AS (SELECT v.*, quality AS y FROM v JOIN labels l ON v."case" = 'doc-' || l.doc_id), """ + balanced_sql("q", "true", list(_PATCH), "nt") + f""",
o AS (SELECT "case", {_score("nt", _PATCH)} AS z FROM v, nt b, nt_f)
SELECT "case", ROUND(z, 7) AS y_score, CAST(z >= 0.5 AS INTEGER) AS y_pred FROM o"""


def fitted_rows(spark, sf):
    """Patch and prompt features with quality; diffs are only built where there is a label."""
    labels = fx.table(spark, sf, "labels")
    made = md.patch_features(fx.diffs(spark, sf, labels).select("case", "patch"), case_features(spark, sf, labels), "case", "patch")
    return made.join(labels.select(F.concat(F.lit("doc-"), "doc_id").alias("case"), "quality"), "case")


def fitted_scorer(spark, sf):
    """The logistic regression of quality on patch and prompt features of the labelled documents."""
    return md.balanced_lr(fitted_rows(spark, sf), list(_PATCH), "quality")


@query("h18_fitted_score", _FITTED_SQL, ["diffs"])
def h18f(spark, sf):
    d = fx.diffs(spark, sf).select("case", "patch")
    return md.batch_score(fitted_scorer(spark, sf), d, case_features(spark, sf), "case", "patch").withColumns(r(["y_score"], 7))


@query("i1_fitted_stream", _FITTED_SQL, ["diffs"])
def i1f(spark, sf):
    """A model fitted on what is labelled scores diffs as they arrive."""
    base = scratch(spark)
    fx.diffs(spark, sf).select("case", "patch").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("case string, patch string").parquet(f"{base}/in")
    scores = scoring.score_stream(stream, fitted_scorer(spark, sf), stage(case_features(spark, sf)), "case", "patch")
    scoring.run_scoring(scores, f"{base}/out", f"{base}/ck").awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumns(r(["y_score"], 7))


_ATTRIBUTED = ["qty", "disc", "tax", "price"]


@query("h17_fitted_attribution", f", q AS ({_PLAIN}), " + balanced_sql("q", "true", _ATTRIBUTED, "nt") + " " + " UNION ALL ".join(
    f"SELECT row_key, '{c}' AS feature, ROUND(CAST({c} AS DOUBLE), 4) AS value, ROUND(b[{k}] * ((CAST({c} AS DOUBLE) - m_{c}) / d_{c}), 7) + 0.0 AS attribution "
    "FROM kept, nt, nt_f" for k, c in enumerate(_ATTRIBUTED, 2)), ["num", "kept"])
def h17f(spark, sf):
    """Every line item's parts of its score under the regression fitted on all of them."""
    rows = fx.view(spark, sf, "lineitem", {**NUMERIC, "row_key": fx.FINDING["row_key"]})
    a = md.linear_attribution(md.balanced_lr(rows, _ATTRIBUTED, "y"), rows, ["row_key"])
    return a.withColumns({"value": F.round("value", 4), "attribution": F.round("attribution", 7) + F.lit(0.0)})
