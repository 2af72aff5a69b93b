"""Queries for descriptives and statistics (D5-D7, D13-D25, E2, E7, E8, E13, G)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import DRAW_STEP, MIX, PRIME, STEP
from ..functions.tails import Z95
from ..operators import compare, descriptives as de, ranks, replicates as rp, review, sampling, stats
from . import fixtures as fx
from .q_joins import adjudicated
from .registry import query
from .sql_fits import newton_sql, solve_sql


def r(cols, places=6):
    return {c: F.round(F.col(c).cast("double"), places) for c in cols}


def rs(cols, places=6):
    return ", ".join(f"ROUND(CAST({e} AS DOUBLE), {places}) AS {n}" for n, e in cols.items())


# Numeric rows with a binary target, one per line item.
NUMERIC = {"y": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "g": "l_returnflag", "s": "l_linestatus",
           "run": "l_linenumber", "qty": "l_quantity", "disc": "l_discount", "tax": "l_tax",
           "price": "l_extendedprice", "balance": "l_quantity - 25.0",
           "score": "ROUND(l_extendedprice / 110000.0, 3)"}
fx.SQL["num"] = ([], f"SELECT {fx._select(NUMERIC)} FROM lineitem")
FEATURES = ["qty", "disc", "tax", "price"]


def num(spark, sf):
    return fx.view(spark, sf, "lineitem", NUMERIC)


def num_long(cols=FEATURES, name="feature"):
    return "(" + " UNION ALL ".join(
        f"SELECT '{c}' AS {name}, CAST({c} AS DOUBLE) AS value, y, g FROM num" for c in cols) + ")"


# --- descriptives ---------------------------------------------------------------------

@query("d5_quality_audit", """
SELECT model, COUNT(*) AS n_rows, COUNT(DISTINCT "case") AS n_cases, """ + rs({
    "has_finding_after_mean": "AVG(has_finding_after)", "has_finding_after_sum": "SUM(has_finding_after)",
    "has_new_high_mean": "AVG(has_new_high)", "has_new_high_sum": "SUM(has_new_high)"}) + " FROM summary GROUP BY 1", ["summary"])
def d5(spark, sf):
    a = de.quality_audit(fx.summary(spark, sf), "model", "case", ["has_finding_after", "has_new_high"])
    return a.withColumns(r(c for c in a.columns if c.startswith("has_")))


_METRICS = ["findings_before", "findings_after", "findings_new", "high_after", "delta_risk", "has_new_high"]


@query("d6_group_descriptives", ", l AS (" + " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM cohort" for m in _METRICS) + """)
SELECT model, metric, COUNT(*) AS n, """ + rs({"mean": "AVG(v)", "sum": "SUM(v)", "median": "quantile_cont(v, 0.5)"}) +
       " FROM l GROUP BY 1, 2", ["cohort"])
def d6(spark, sf):
    d = de.group_descriptives(fx.cohort(spark, sf), "model", _METRICS)
    return d.withColumns(r(["mean", "sum", "median"]))


_ERFC = ("CASE WHEN {x} > 4 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda k: "
         "CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END * exp((2 * k + 1) * ln(greatest({x}, 1e-300)) - lgamma(k + 1.0)) / (2 * k + 1))) END")


def _signed_rank(source: str, by: str) -> str:
    """Signed-rank sums and normal p over ``source`` (by, d)."""
    return f"""
z AS (SELECT {by}, COUNT(*) FILTER (WHERE d = 0) AS n_zero FROM {source} GROUP BY ALL),
a AS (SELECT {by}, abs(d) AS a, d > 0 AS pos, RANK() OVER (PARTITION BY {by} ORDER BY abs(d)) AS lo,
  COUNT(*) OVER (PARTITION BY {by}, abs(d)) AS t FROM {source} WHERE d <> 0),
w AS (SELECT {by}, COUNT(*) AS n, SUM(CASE WHEN pos THEN lo + (t - 1) / 2.0 ELSE 0 END) AS w_plus,
  SUM(CASE WHEN pos THEN 0 ELSE lo + (t - 1) / 2.0 END) AS w_minus, SUM(CAST(t AS DOUBLE) * t - 1) AS tie FROM a GROUP BY ALL),
s AS (SELECT *, (w_plus - n * (n + 1) / 4.0) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24.0 - tie / 48.0) AS zz FROM w)"""


def normal_two_sided_sql(z: str) -> str:
    """Two-sided tail of the normal by the series of its integral, for arguments up to 8."""
    a = f"abs({z})"
    terms = f"list_sum(list_transform(range(0, 240), lambda k: exp((2 * k + 1) * ln({a}) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"
    return f"CASE WHEN {a} < 1e-12 THEN 1.0 WHEN {a} > 8 THEN 0.0 ELSE greatest(0.0, 1 - 2 * exp(-{a} * {a} / 2) / sqrt(2 * pi()) * {terms}) END"


def signed_rank_sql(by: str) -> str:
    """CTE p: tails of the signed-rank test over the tables s and z, exact without ties or zeros up to 50 differences."""
    size = "CAST(n * (n + 1) // 2 AS BIGINT) + 1"
    counts = (f"list_reduce(list_transform(range(1, n + 1), lambda k: [k]), lambda c, k: list_transform(range(0, {size}), "
              f"lambda i: c[i + 1] + CASE WHEN i >= k[1] THEN c[i - k[1] + 1] ELSE 0 END), "
              f"list_transform(range(0, {size}), lambda i: CASE WHEN i = 0 THEN CAST(1 AS BIGINT) ELSE 0 END))")
    return f"""
x AS (SELECT s.*, n_zero, n <= 50 AND n_zero = 0 AND tie = 0 AS exact FROM s JOIN z USING ({by})),
x1 AS (SELECT *, CASE WHEN exact THEN {counts} END AS c FROM x),
x2 AS (SELECT *, list_sum(c[1:CAST(w_plus AS BIGINT) + 1]) / list_sum(c) AS below, list_sum(c[CAST(w_plus AS BIGINT) + 1:]) / list_sum(c) AS above,
  CASE WHEN NOT exact THEN {normal_two_sided_sql("zz")} END AS pn FROM x1),
p AS (SELECT *, CASE WHEN exact THEN least(1.0, 2 * least(below, above)) ELSE pn END AS p_two_sided,
  CASE WHEN exact THEN above WHEN zz > 0 THEN pn / 2 ELSE 1 - pn / 2 END AS p_a_greater,
  CASE WHEN exact THEN below WHEN zz > 0 THEN 1 - pn / 2 ELSE pn / 2 END AS p_b_greater FROM x2)"""


@query("d7_before_after", ", pairs_ AS (" + " UNION ALL ".join(
    f"SELECT model, '{b}' AS before_metric, '{a}' AS after_metric, {b} AS b, {a} AS a, {a} - {b} AS d FROM cohort"
    for b, a in (("findings_before", "findings_after"), ("risk_before", "risk_after"))) + ")," +
       _signed_rank("pairs_", "model, before_metric, after_metric") + ", g AS (SELECT model, before_metric, after_metric, COUNT(*) AS n_cases, "
       + rs({"before_mean": "AVG(b)", "after_mean": "AVG(a)", "mean_delta": "AVG(d)", "median_delta": "quantile_cont(d, 0.5)"}) +
       """, COUNT(*) FILTER (WHERE d < 0) AS improved_cases, COUNT(*) FILTER (WHERE d > 0) AS worsened_cases,
  COUNT(*) FILTER (WHERE d = 0) AS unchanged_cases FROM pairs_ GROUP BY 1, 2, 3),""" + signed_rank_sql("model, before_metric, after_metric") + """
SELECT g.*, CAST(least(w_plus, w_minus) AS DOUBLE) AS statistic, ROUND(p_two_sided, 6) AS p_value, CAST(n + n_zero AS BIGINT) AS n_used FROM g
JOIN p USING (model, before_metric, after_metric)""", ["cohort"])
def d7(spark, sf):
    pairs = [("findings_before", "findings_after"), ("risk_before", "risk_after")]
    b = de.before_after(fx.cohort(spark, sf), "model", pairs)
    return b.withColumns(r(["before_mean", "after_mean", "mean_delta", "median_delta", "p_value"])).withColumn(
        "n_used", F.col("n_cases"))


@query("d13_run_summary", ", l AS (" + " UNION ALL ".join(
    f"SELECT s, '{c}' AS metric, CAST({c} AS DOUBLE) AS v FROM num" for c in FEATURES) + """)
SELECT s, metric, COUNT(*) AS n_runs, """ + rs({"mean": "AVG(v)", "std": "stddev_samp(v)", "min": "MIN(v)", "max": "MAX(v)"}, 4) +
       " FROM l GROUP BY 1, 2", ["num"])
def d13(spark, sf):
    d = de.run_summary(num(spark, sf), ["s"], FEATURES)
    return d.withColumns(r(["mean", "std", "min", "max"], 4))


_SIGNS = """COUNT(*) FILTER (WHERE balance > 0) AS positive_runs, COUNT(*) FILTER (WHERE balance < 0) AS negative_runs,
  COUNT(*) FILTER (WHERE balance = 0) AS zero_runs"""


@query("d14_sign_consistency", "SELECT g, " + rs({
    "mean": "AVG(balance)", "std": "stddev_samp(balance)", "abs_mean": "AVG(abs(balance))",
    "abs_std": "stddev_samp(abs(balance))"}) + f""", {_SIGNS}, ROUND(greatest(COUNT(*) FILTER (WHERE balance > 0),
  COUNT(*) FILTER (WHERE balance < 0)) / COUNT(*), 6) AS sign_consistency FROM num GROUP BY 1""", ["num"])
def d14(spark, sf):
    d = de.sign_consistency(num(spark, sf), ["g"], "balance")
    return d.withColumns(r(["mean", "std", "abs_mean", "abs_std", "sign_consistency"]))


@query("d15_importance_summary", "SELECT run, " + rs({
    "mean": "AVG(balance)", "std": "stddev_samp(balance)", "min": "MIN(balance)", "max": "MAX(balance)"}) +
       f", {_SIGNS} FROM num GROUP BY 1", ["num"])
def d15(spark, sf):
    return de.importance_summary(num(spark, sf), ["run"], "balance").withColumns(r(["mean", "std", "min", "max"]))


@query("d16_latency_summary", """
, u AS (SELECT l_suppkey, l_returnflag, quantile_cont(l_extendedprice, 0.5) AS ms FROM lineitem GROUP BY 1, 2),
c AS (SELECT 'OVERALL' AS scope, ms FROM u UNION ALL SELECT 'MODEL:' || l_returnflag, ms FROM u)
SELECT scope, COUNT(*) AS n, """ + rs({
    "mean": "AVG(ms)", "min": "MIN(ms)", "max": "MAX(ms)", "q1": "quantile_cont(ms, 0.25)", "median": "quantile_cont(ms, 0.5)",
    "q3": "quantile_cont(ms, 0.75)", "p95": "quantile_cont(ms, 0.95)",
    "iqr": "quantile_cont(ms, 0.75) - quantile_cont(ms, 0.25)"}, 6) + " FROM c GROUP BY 1")
def d16(spark, sf):
    raw = fx.table(spark, sf, "lineitem")
    d = de.latency_summary(raw, ["l_suppkey", "l_returnflag"], "l_returnflag", "l_extendedprice")
    return d.withColumns(r(["mean", "min", "max", "q1", "median", "q3", "p95", "iqr"], 6))


@query("d17_ratio_summary", """
SELECT 'price/tax' AS ratio, COUNT(*) AS n, """ + rs({
    "q1": "quantile_cont(price / tax, 0.25)", "median": "quantile_cont(price / tax, 0.5)",
    "q3": "quantile_cont(price / tax, 0.75)"}, 3) + """ FROM num WHERE tax > 0 UNION ALL SELECT 'price/qty', COUNT(*), """ + rs({
    "q1": "quantile_cont(price / qty, 0.25)", "median": "quantile_cont(price / qty, 0.5)",
    "q3": "quantile_cont(price / qty, 0.75)"}, 3) + " FROM num WHERE qty > 0", ["num"])
def d17(spark, sf):
    d = de.ratio_summary(num(spark, sf), {"price/tax": ("price", "tax"), "price/qty": ("price", "qty")})
    return d.withColumns(r(["q1", "median", "q3"], 3))


_ATTEMPT = "o_orderpriority AS model, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS stage"


@query("d18_failure_summary", f"""
SELECT model, stage, COUNT(*) AS n_failures FROM (SELECT {_ATTEMPT} FROM orders) WHERE stage IS NULL OR stage <> 'F' GROUP BY 1, 2""")
def d18(spark, sf):
    o = fx.table(spark, sf, "orders").selectExpr(*_ATTEMPT.split(", "))
    return de.failure_summary(o, "model", "stage", ["F"])


@query("d18_success_summary", f"""
SELECT model, COUNT(*) AS attempts, COUNT(*) FILTER (WHERE stage = 'F') AS successful,
  ROUND(COUNT(*) FILTER (WHERE stage = 'F') / COUNT(*), 8) AS success_rate FROM (SELECT {_ATTEMPT} FROM orders) GROUP BY 1""")
def d18s(spark, sf):
    o = fx.table(spark, sf, "orders").selectExpr(*_ATTEMPT.split(", "))
    return de.success_summary(o, "model", "stage", ["F"]).withColumns(r(["success_rate"], 8))


@query("d18_missing_inputs", """
SELECT concat_ws('|', CASE WHEN o_orderstatus = 'P' THEN 'MISSING_REPO' END, CASE WHEN o_totalprice < 50000 THEN 'MISSING_PATCH' END)
  AS error, COUNT(*) AS n FROM orders GROUP BY 1""")
def d18m(spark, sf):
    o = fx.table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderstatus <> 'P' THEN 'x/y' END AS repo", "CASE WHEN o_totalprice < 50000 THEN '' ELSE 'p' END AS patch")
    return de.missing_inputs(o, {"REPO": "repo", "PATCH": "patch"}).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("d19_composition", f"SELECT model, stage, COUNT(*) AS n FROM (SELECT {_ATTEMPT} FROM orders) GROUP BY 1, 2")
def d19(spark, sf):
    return de.composition(fx.table(spark, sf, "orders").selectExpr(*_ATTEMPT.split(", ")), ["model", "stage"])


@query("d20_prevalence_audit", f"""
SELECT feature, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE value <> 0) AS nonzero_rows, COUNT(DISTINCT value) AS distinct_values, """ + rs({
    "max": "MAX(value)", "median": "quantile_cont(value, 0.5)", "fraction_nonzero": "AVG(CAST(value <> 0 AS DOUBLE))",
    "mean": "AVG(value)"}, 4) + f" FROM {num_long()} GROUP BY 1", ["num"])
def d20(spark, sf):
    d = de.prevalence_audit(num(spark, sf), FEATURES)
    return d.withColumns({**r(["max", "median", "fraction_nonzero", "mean"], 4), "nonzero_rows": F.col("nonzero_rows").cast("long")})


@query("d21_class_histogram", f"""
, l AS (SELECT * FROM {num_long(FEATURES + ['balance'])}),
q AS (SELECT feature, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99, MIN(value) AS lo FROM l GROUP BY 1),
e AS (SELECT feature, CASE WHEN lo < 0 THEN p1 ELSE greatest(0, lo) END AS lower, p99 AS upper FROM q)
SELECT l.feature, y, CAST(least(28, floor((value - lower) / ((upper - lower) / 29))) AS INTEGER) AS bin, ROUND(lower, 6) AS lower,
  ROUND(upper, 6) AS upper, COUNT(*) AS n FROM l JOIN e ON l.feature = e.feature WHERE value BETWEEN lower AND upper GROUP BY 1, 2, 3, 4, 5""",
       ["num"])
def d21(spark, sf):
    h = de.class_histogram(num(spark, sf), FEATURES + ["balance"], "y")
    return h.withColumns({**r(["lower", "upper"]), "n": F.col("n").cast("long")})


@query("d21_score_histogram", """
SELECT y, CAST(least(14, floor(score * 15)) AS INTEGER) AS bin, COUNT(*) AS n FROM num WHERE score BETWEEN 0 AND 1 GROUP BY 1, 2""", ["num"])
def d21s(spark, sf):
    return de.score_histogram(num(spark, sf), ["y"], "score")


_Z = "1.959963984540054"


def _wilson(k, n, sign):
    body = f"(({k}) / ({n}) + {_Z} * {_Z} / (2 * ({n}))) / (1 + {_Z} * {_Z} / ({n}))"
    half = f"{_Z} * sqrt(({k}) / ({n}) * (1 - ({k}) / ({n})) / ({n}) + {_Z} * {_Z} / (4.0 * ({n}) * ({n}))) / (1 + {_Z} * {_Z} / ({n}))"
    edge = f"greatest(0, {body} - {half})" if sign < 0 else f"least(1, {body} + {half})"
    return f"CASE WHEN ({n}) > 0 THEN ROUND({edge}, 8) END"


@query("d22_scoped_rates", f"""
, a AS (SELECT 'ALL' AS scope, final_validity AS v, final_patch_attribution AS p FROM adjudicated UNION ALL
  SELECT sample_group_v2, final_validity, final_patch_attribution FROM adjudicated),
c AS (SELECT scope, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE v <> '') AS n_final_labeled,
  COUNT(*) FILTER (WHERE v = 'VALID_SECURITY_FINDING') AS valid, COUNT(*) FILTER (WHERE v = 'LIKELY_FALSE_POSITIVE') AS likely_false_positive,
  COUNT(*) FILTER (WHERE v = 'UNCERTAIN') AS uncertain, COUNT(*) FILTER (WHERE p = 'INTRODUCED_OR_AFFECTED_BY_PATCH') AS introduced_or_affected,
  COUNT(*) FILTER (WHERE p = 'PRE_EXISTING') AS pre_existing, COUNT(*) FILTER (WHERE p = 'UNCERTAIN') AS attribution_uncertain FROM a GROUP BY 1)
SELECT *, ROUND(valid / nullif(valid + likely_false_positive, 0), 8) AS valid_rate_among_decidable,
  {_wilson('valid', 'valid + likely_false_positive', -1)} AS valid_rate_ci95_low, {_wilson('valid', 'valid + likely_false_positive', 1)} AS valid_rate_ci95_high,
  ROUND(introduced_or_affected / nullif(introduced_or_affected + pre_existing, 0), 8) AS introduced_rate_among_decidable,
  {_wilson('introduced_or_affected', 'introduced_or_affected + pre_existing', -1)} AS introduced_rate_ci95_low,
  {_wilson('introduced_or_affected', 'introduced_or_affected + pre_existing', 1)} AS introduced_rate_ci95_high FROM c""", ["adjudicated"])
def d22(spark, sf):
    s = review.scoped_rates(adjudicated(spark, sf))
    return s.withColumns(r((c for c in s.columns if "rate" in c), 8))


@query("d24_attempt_funnel", """
, e AS (SELECT event_type, CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 WHEN value < 90 THEN 2 ELSE 3 END AS k FROM events)
SELECT event_type, COUNT(*) FILTER (WHERE k > 0) AS attempted, COUNT(*) FILTER (WHERE k = 3) AS valid, COUNT(*) FILTER (WHERE k = 2) AS generation_reused,
  COUNT(*) FILTER (WHERE k = 1) AS generation_failed, COUNT(*) FILTER (WHERE k = 2) AS apply_failed,
  CAST(SUM(CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END) AS BIGINT) AS total_attempts,
  CASE WHEN COUNT(*) FILTER (WHERE k = 3) > 0 THEN 3.0::DOUBLE END AS mean_first_success FROM e GROUP BY 1""")
def d24(spark, sf):
    one = "named_struct('stage', '{}', 'success', {}, 'reused', {})"
    gen_bad, gen_ok = one.format("generation", "false", "false"), one.format("generation", "true", "false")
    gen_re, app_bad = one.format("generation", "true", "true"), one.format("apply", "false", "false")
    app_ok = one.format("apply", "true", "false")
    e = fx.table(spark, sf, "events").selectExpr(
        "event_type",
        f"CASE WHEN value < 20 THEN NULL WHEN value < 60 THEN array({gen_bad}) WHEN value < 90 THEN array({gen_re}, {app_bad}) "
        f"ELSE array({gen_ok}, {app_bad}, {app_ok}) END AS attempts")
    return de.attempt_funnel(e, "event_type")


@query("d25_pivot_feedback", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'UNCERTAIN' ELSE 'LIKELY_FALSE_POSITIVE' END AS judge_validity,
  CASE WHEN event_type IN ('error', 'view') THEN 'UNCERTAIN' ELSE '2.0' END AS judge_patch_attribution,
  CASE WHEN event_type = 'click' THEN 4 ELSE 1 END AS judge_confidence,
  CASE WHEN event_type = 'error' THEN '' ELSE 'note' END AS judge_reasoning FROM events""")
def d25(spark, sf):
    def entry(key, value, score, note):
        return (f"named_struct('key', '{key}', 'value', {value}, 'score', CAST({score} AS DOUBLE), 'comment', {note})")

    v = entry("validity", "'LIKELY_FALSE_POSITIVE'", "NULL", "'note'")
    p, c = entry("patch_attribution", "CAST(NULL AS STRING)", "2", "''"), entry("confidence", "'9'", "4", "''")
    e = fx.table(spark, sf, "events").selectExpr(
        "event_id", f"CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN array({v}) WHEN 'click' THEN array({v}, {p}, {c}) "
        f"ELSE array({v}, {p}) END AS results")
    return review.pivot_feedback(e, "event_id")


# --- windows and ranks -------------------------------------------------------------------

@query("e2_rankings", ", l AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, model, AVG({m}) AS v FROM cohort GROUP BY 2" for m in _METRICS) + """)
SELECT metric, model, ROUND(v, 8) AS value, CAST(ROW_NUMBER() OVER (PARTITION BY metric ORDER BY ROUND(v, 8) DESC, model) AS INTEGER) AS rank_desc FROM l""",
       ["cohort"])
def e2(spark, sf):
    d = de.long(fx.cohort(spark, sf), ["model"], _METRICS).groupBy("metric", "model").agg(
        F.round(F.avg("value"), 8).alias("value"))
    return sampling.rankings(d, "metric", "model", "value")


@query("e7_threshold_for_recall", """
, c AS (SELECT run, score, SUM(SUM(y)) OVER (PARTITION BY run ORDER BY score DESC) AS tp, SUM(SUM(y)) OVER (PARTITION BY run) AS pos
  FROM num GROUP BY run, score)
SELECT run, ROUND(MAX(score), 6) AS threshold FROM c WHERE tp >= 0.9 * pos - 1e-9 GROUP BY 1""", ["num"])
def e7(spark, sf):
    from ..operators.triage import threshold_for_recall

    t = threshold_for_recall(num(spark, sf), ["run"], "y", "score", {"threshold": 0.9})
    return t.select("run", F.round("threshold", 6).alias("threshold"))


@query("e8_avg_rank", """
SELECT run, score, ANY_VALUE(rk) AS avg_rank, COUNT(*) AS n FROM (SELECT run, score, RANK() OVER (PARTITION BY run ORDER BY score) +
  (COUNT(*) OVER (PARTITION BY run, score) - 1) / 2.0 AS rk FROM num) GROUP BY 1, 2""", ["num"])
def e8(spark, sf):
    t = ranks.ranked(num(spark, sf), ["run"], "score")
    return t.select("run", "score", "avg_rank", "n")


@query("e8_null_group", """
, n AS (SELECT CASE WHEN g <> 'N' THEN g END AS flag, score FROM num)
SELECT flag, score, ANY_VALUE(rk) AS avg_rank, COUNT(*) AS n FROM (SELECT flag, score, RANK() OVER (PARTITION BY flag ORDER BY score) +
  (COUNT(*) OVER (PARTITION BY flag, score) - 1) / 2.0 AS rk FROM n) GROUP BY 1, 2""", ["num"])
def e8n(spark, sf):
    rows = num(spark, sf).selectExpr("CASE WHEN g <> 'N' THEN g END AS flag", "score")
    return ranks.ranked(rows, ["flag"], "score").select("flag", "score", "avg_rank", "n")


@query("e8_global_quantiles", "SELECT " + rs({
    "q05": "quantile_cont(price, 0.05)", "median": "quantile_cont(price, 0.5)", "q95": "quantile_cont(price, 0.95)"}, 4) +
       ", COUNT(*) AS \"count\" FROM num", ["num"])
def e8q(spark, sf):
    q = ranks.quantiles(num(spark, sf), [], "price", {"q05": 0.05, "median": 0.5, "q95": 0.95})
    return q.withColumns(r(["q05", "median", "q95"], 4))


@query("e13_quartile_contrast", f"""
, q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {num_long()} GROUP BY 1),
c AS (SELECT l.feature, q1, q3, COUNT(*) FILTER (WHERE value <= q1) AS low_n, COUNT(*) FILTER (WHERE value >= q3) AS high_n,
  AVG(y) FILTER (WHERE value <= q1) AS lo, AVG(y) FILTER (WHERE value >= q3) AS hi FROM {num_long()} l JOIN q ON l.feature = q.feature GROUP BY 1, 2, 3)
SELECT feature, ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, low_n, high_n, ROUND(lo, 8) AS risk_bottom_quartile, ROUND(hi, 8) AS risk_top_quartile,
  ROUND(hi - lo, 8) AS risk_difference, ROUND(hi / lo, 8) AS risk_ratio FROM c""", ["num"])
def e13(spark, sf):
    q = de.quartile_contrast(num(spark, sf), FEATURES, "y")
    return q.withColumns({**r(["q1", "q3"]), **r(["risk_bottom_quartile", "risk_top_quartile", "risk_difference", "risk_ratio"], 8)})


# --- G: contingency ------------------------------------------------------------------------

@query("g1_chi_square", """
, n AS (SELECT cwe, model, COUNT(*) AS o FROM raw_findings GROUP BY 1, 2), t AS (SELECT SUM(o) AS t FROM n),
e AS (SELECT a.cwe, b.model, a.s * b.s / t.t AS e FROM (SELECT cwe, SUM(o) AS s FROM n GROUP BY 1) a,
  (SELECT model, SUM(o) AS s FROM n GROUP BY 1) b, t),
c AS (SELECT SUM((COALESCE(n.o, 0) - e) * (COALESCE(n.o, 0) - e) / e) AS chi2 FROM e LEFT JOIN n ON e.cwe = n.cwe AND e.model = n.model)
SELECT CAST(t.t AS BIGINT) AS n, CAST(20 AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_cols, ROUND(CAST(chi2 AS DOUBLE), 6) AS chi2,
  CAST(38 AS BIGINT) AS df, ROUND(sqrt(chi2 / (t.t * 2)), 8) AS cramers_v FROM c, t""", ["raw_findings"])
def g1(spark, sf):
    c = compare.chi_square(fx.raw_findings(spark, sf), "cwe", "model")
    return c.withColumns({**r(["chi2"]), **r(["cramers_v"], 8)})


@query("g2_permutation_chi_square")
def g2(spark, sf):
    return rp.permutation_chi_square(fx.raw_findings(spark, sf), "model", "cwe", 500)


@query("g3_anova", """
, g AS (SELECT event_type, COUNT(*) AS n, AVG(total) AS m, SUM(total) AS s FROM outcomes GROUP BY 1),
w AS (SELECT SUM((o.total - g.m) * (o.total - g.m)) AS ssw, COUNT(*) AS n FROM outcomes o JOIN g ON o.event_type = g.event_type),
b AS (SELECT SUM(g.n * (g.m - t.m) * (g.m - t.m)) AS ssb, COUNT(*) AS k FROM g, (SELECT AVG(total) AS m FROM outcomes) t)
SELECT k AS n_groups, w.n, ROUND((ssb / (k - 1)) / (ssw / (w.n - k)), 6) AS f_stat FROM w, b""", ["outcomes"])
def g3a(spark, sf):
    a = rp.anova(fx.outcomes(spark, sf), "event_type", "total")
    return a.withColumns(r(["f_stat"]))


@query("g3_permutation_anova")
def g3(spark, sf):
    return rp.permutation_anova(fx.outcomes(spark, sf), "event_type", "n", 1000)


_REPS, _BOOT_REPS = 1000, 10_000


def _replicates(seed: int, n: int = _REPS) -> str:
    def word(kind: str) -> str:
        return fx.h32(f"'{seed}|' || r || '|{kind}'")

    return (f"k AS (SELECT r, 1 + {word('a')} % {PRIME - 1} AS a, 1 + {word('c')} % {PRIME - 1} AS c, {word('b')} % {PRIME} AS b "
            f"FROM range(1, {n + 1}) t(r))")


def _mixed(source: str, c: str) -> str:
    """``source`` with column ``c`` through the rounds of the 32-bit draws."""
    for shift, factor in MIX:
        source = f"(SELECT * REPLACE (CAST((CAST(xor({c}, {c} >> {shift}) AS HUGEINT) * {factor}) % 4294967296 AS BIGINT) AS {c}) FROM {source})"
    return source


def boot_sql(src: str, seed: int, replicates: int, name: str = "boot", order: str = "x, y, v", stat: str = "AVG(v)") -> str:
    """CTEs: table ``name`` (g, ci_low, ci_high) of the bootstrap of ``src`` (g, v, x, y), whose groups are one cell each."""
    q, s = f"{name}_q", f"{name}_s"
    seeds = _mixed(f"(SELECT g, n, r, (b + r * {STEP}) % 4294967296 AS s FROM (SELECT g, ANY_VALUE(n) AS n, ANY_VALUE({fx.h32(f"'{seed}|' || g || '|0'")}) AS b "
                   f"FROM {q} GROUP BY g), range(0, {replicates}) t(r))", "s")
    draws = _mixed(f"(SELECT g, n, r, (s + j * {DRAW_STEP}) % 4294967296 AS u FROM (SELECT *, UNNEST(range(0, n)) AS j FROM {s}))", "u")
    return (f"{q} AS (SELECT g, v, ROW_NUMBER() OVER (PARTITION BY g ORDER BY {order}) - 1 AS i, COUNT(*) OVER (PARTITION BY g) AS n FROM {src}), "
            f"{s} AS (SELECT * FROM {seeds}), {name}_d AS (SELECT g, r, CAST((CAST(u AS HUGEINT) * n) // 4294967296 AS BIGINT) AS i FROM {draws}), "
            f"{name}_m AS (SELECT d.g, d.r, {stat} AS m FROM {name}_d d JOIN {q} q ON d.g = q.g AND d.i = q.i GROUP BY 1, 2), "
            f"{name} AS (SELECT g, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, COUNT(*) AS replicates FROM {name}_m GROUP BY 1)")


@query("g4_sign_flip_test", f"""
, d AS (SELECT a.user_id, a.n - b.n AS d FROM outcomes a JOIN outcomes b ON a.user_id = b.user_id AND a.event_type = 'click'
  AND b.event_type = 'view'), {_replicates(7)},
x AS (SELECT r, abs(SUM(CASE WHEN (a * ({fx.h32('CAST(user_id AS VARCHAR)')} % {PRIME}) + c * ({fx.h32('CAST(user_id AS VARCHAR)', 1)} % {PRIME}) + b) % {PRIME} < {PRIME // 2} THEN d ELSE -d END)) AS s FROM d, k GROUP BY 1),
o AS (SELECT COUNT(*) AS n, abs(SUM(d)) AS s FROM d)
SELECT o.n, ROUND(CAST(o.s AS DOUBLE) / o.n, 8) AS abs_mean, COUNT(*) FILTER (WHERE x.s >= o.s) AS n_extreme,
  ROUND((COUNT(*) FILTER (WHERE x.s >= o.s) + 1) / {_REPS + 1}.0, 8) AS p_value FROM x, o GROUP BY o.n, o.s""", ["outcomes"])
def g4(spark, sf):
    p = compare.wide(fx.outcomes(spark, sf), ["user_id"], "event_type", "n", ["click", "view"])
    t = rp.sign_flip_test(p.withColumn("d", F.col("m_0") - F.col("m_1")), [], "d", ["user_id"], _REPS, 7)
    return t.withColumns(r(["abs_mean", "p_value"], 8))


_BIN = {"high_qty": "CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END", "no_tax": "CASE WHEN l_tax = 0 THEN 2 ELSE 0 END",
        "never": "0", "old": "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END"}
_Y = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"
fx.SQL["tables2x2"] = ([], " UNION ALL ".join(
    f"SELECT '{f}' AS feature, COUNT(*) AS n_total, COUNT(*) FILTER (WHERE ({e}) > 0) AS n_present, COUNT(*) FILTER (WHERE ({e}) <= 0) AS n_absent, "
    f"COUNT(*) FILTER (WHERE ({e}) > 0 AND ({_Y}) = 1) AS a, COUNT(*) FILTER (WHERE ({e}) > 0 AND ({_Y}) = 0) AS b, "
    f"COUNT(*) FILTER (WHERE ({e}) <= 0 AND ({_Y}) = 1) AS c, COUNT(*) FILTER (WHERE ({e}) <= 0 AND ({_Y}) = 0) AS d FROM lineitem"
    for f, e in _BIN.items()))


def _bin(spark, sf):
    return fx.view(spark, sf, "lineitem", {**_BIN, "y": _Y})


@query("g5_contingency_2x2", """
SELECT *, ROUND(n_present / n_total, 8) AS prevalence, ROUND(a / nullif(n_present, 0), 8) AS risk_present,
  ROUND(c / nullif(n_absent, 0), 8) AS risk_absent, ROUND(a / nullif(n_present, 0) - c / nullif(n_absent, 0), 8) AS risk_difference FROM tables2x2""",
       ["tables2x2"])
def g5(spark, sf):
    t = stats.contingency_2x2(_bin(spark, sf), list(_BIN), "y")
    return t.withColumns(r(["prevalence", "risk_present", "risk_absent", "risk_difference"], 8))


@query("g6_risk_and_odds_ratio", f"""
, h AS (SELECT feature, a + z AS a, b + z AS b, c + z AS c, d + z AS d FROM (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0.0 END AS z FROM tables2x2)),
k AS (SELECT *, (a / (a + b)) / (c / (c + d)) AS rr, sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)) AS sr, (a * d) / (b * c) AS orr,
  sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS so FROM h)
SELECT feature, """ + rs({"risk_ratio": "rr", "rr_ci95_low": f"exp(ln(rr) - {_Z} * sr)", "rr_ci95_high": f"exp(ln(rr) + {_Z} * sr)",
                          "odds_ratio": "orr", "or_ci95_low": f"exp(ln(orr) - {_Z} * so)", "or_ci95_high": f"exp(ln(orr) + {_Z} * so)"}) +
       " FROM k", ["tables2x2"])
def g6(spark, sf):
    t = stats.odds_ratio(stats.risk_ratio(stats.contingency_2x2(_bin(spark, sf), list(_BIN), "y")))
    cols = ["risk_ratio", "rr_ci95_low", "rr_ci95_high", "odds_ratio", "or_ci95_low", "or_ci95_high"]
    return t.select("feature", *cols).withColumns(r(cols))


# The hypergeometric support written out per table.
fx.SQL["fisher"] = (["tables2x2"], """
SELECT feature, least(1.0, SUM(p) FILTER (WHERE p <= seen * (1 + 1e-7))) AS p FROM (
  SELECT feature, x, exp(lp - MAX(lp) OVER w) / SUM(exp(lp)) OVER w * exp(MAX(lp) OVER w) AS p,
    MAX(CASE WHEN x = a THEN exp(lp - mx) END) OVER w / SUM(exp(lp - mx)) OVER w AS seen FROM (
    SELECT *, MAX(lp) OVER (PARTITION BY feature) AS mx FROM (
      SELECT feature, a, x, -(lgamma(x + 1.0) + lgamma(a + b - x + 1.0) + lgamma(a + c - x + 1.0) + lgamma(d - a + x + 1.0)) +
        lgamma(a + b + 1.0) + lgamma(c + d + 1.0) + lgamma(a + c + 1.0) + lgamma(b + d + 1.0) - lgamma(a + b + c + d + 1.0) AS lp
      FROM (SELECT *, UNNEST(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM tables2x2)))
  WINDOW w AS (PARTITION BY feature)) GROUP BY 1""")


@query("g7_fisher_exact", "SELECT feature, ROUND(p, 6) AS fisher_p_value FROM fisher", ["fisher"])
def g7(spark, sf):
    t = stats.fisher_exact(stats.contingency_2x2(_bin(spark, sf), list(_BIN), "y"))
    return t.select("feature", F.round("fisher_p_value", 6).alias("fisher_p_value"))


@query("g8_bh_adjust", """
, p AS (SELECT g, run, CASE WHEN qty < 3 THEN NULL ELSE ROUND(score, 3) END AS p FROM num),
k AS (SELECT g, p, COUNT(*) AS n FROM p WHERE p IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, SUM(n) OVER (PARTITION BY g ORDER BY p) AS cum, SUM(n) OVER (PARTITION BY g) AS m FROM k),
q AS (SELECT g, p, n, least(1.0, MIN(p * m / cum) OVER (PARTITION BY g ORDER BY p DESC)) AS q FROM c)
SELECT g, p, CAST(n AS BIGINT) AS n, ROUND(q, 8) AS fdr_bh FROM q""", ["num"])
def g8(spark, sf):
    p = num(spark, sf).selectExpr("g", "CASE WHEN qty < 3 THEN NULL ELSE ROUND(score, 3) END AS p")
    a = stats.bh_adjust(p, "p", family=["g"]).where("p IS NOT NULL")
    return a.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"), F.max(F.round("fdr_bh", 8)).alias("fdr_bh"))


@query("g8_null_family", """
, p AS (SELECT CASE WHEN g <> 'N' THEN g END AS g, CASE WHEN qty < 3 THEN NULL ELSE ROUND(score, 3) END AS p FROM num),
k AS (SELECT g, p, COUNT(*) AS n FROM p WHERE p IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, SUM(n) OVER (PARTITION BY g ORDER BY p) AS cum, SUM(n) OVER (PARTITION BY g) AS m FROM k),
q AS (SELECT g, p, n, least(1.0, MIN(p * m / cum) OVER (PARTITION BY g ORDER BY p DESC)) AS q FROM c)
SELECT g, p, CAST(n AS BIGINT) AS n, ROUND(q, 8) AS fdr_bh FROM q""", ["num"])
def g8n(spark, sf):
    p = num(spark, sf).selectExpr("CASE WHEN g <> 'N' THEN g END AS g", "CASE WHEN qty < 3 THEN NULL ELSE ROUND(score, 3) END AS p")
    a = stats.bh_adjust(p, "p", family=["g"]).where("p IS NOT NULL")
    return a.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"), F.max(F.round("fdr_bh", 8)).alias("fdr_bh"))


@query("g9_effect_label", f"""
, h AS (SELECT feature, a + z AS a, b + z AS b, c + z AS c, d + z AS d FROM (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0.0 END AS z FROM tables2x2)),
k AS (SELECT feature, (a / (a + b)) / (c / (c + d)) AS rr, sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)) AS sr FROM h),
f AS (SELECT k.*, p, RANK() OVER (ORDER BY p) + COUNT(*) OVER (PARTITION BY p) - 1 AS rk, COUNT(*) OVER () AS m FROM k JOIN fisher ON k.feature = fisher.feature),
q AS (SELECT *, least(1.0, MIN(p * m / rk) OVER (ORDER BY p DESC)) AS fdr FROM f)
SELECT feature, ROUND(fdr, 6) AS fisher_fdr_bh, CASE WHEN fdr < 0.05 AND exp(ln(rr) - {_Z} * sr) > 1 THEN 'higher risk'
  WHEN fdr < 0.05 AND exp(ln(rr) + {_Z} * sr) < 1 THEN 'lower risk' ELSE 'inconclusive' END AS effect FROM q""", ["tables2x2", "fisher"])
def g9(spark, sf):
    t = stats.feature_risk_table(_bin(spark, sf), list(_BIN), "y")
    return t.select("feature", F.round("fisher_fdr_bh", 6).alias("fisher_fdr_bh"), "effect")


# --- G: correlation ---------------------------------------------------------------------------

def t_two_sided_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t with whole degrees of freedom, by its finite series."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = (f"sin({angle}) * list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), "
            f"lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) - 0.5 * ln(pi()) + 2 * j * ln(cos({angle})))))")
    odd = (f"(2 / pi()) * ({angle} + sin({angle}) * list_sum(list_transform(range(0, CAST(({df} - 1) // 2 AS BIGINT)), "
           f"lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5) + 0.5 * ln(pi()) - ln(2) + (2 * j + 1) * ln(cos({angle}))))))")
    return f"greatest(0.0, 1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def bh_sql(p: str) -> str:
    """Benjamini-Hochberg adjustment of column ``p`` over the rows, as window expressions."""
    return f"least(1.0, MIN({p} * n_all / rank_{p}) OVER (ORDER BY {p} DESC ROWS UNBOUNDED PRECEDING))"


@query("g10_spearman", f"""
, l AS (SELECT feature, y, RANK() OVER (PARTITION BY feature ORDER BY value) + (COUNT(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
  RANK() OVER (PARTITION BY feature ORDER BY y) + (COUNT(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry, value FROM {num_long()}),
c AS (SELECT feature, COUNT(*) AS n, COUNT(DISTINCT value) AS n_unique_values, corr(rx, ry) AS rho FROM l GROUP BY 1),
t AS (SELECT *, rho * sqrt((n - 2) / ((1 - rho) * (1 + rho))) AS t FROM c),
q AS (SELECT *, {t_two_sided_sql("t", "(n - 2)")} AS p FROM t),
k AS (SELECT *, COUNT(*) OVER () AS n_all, ROW_NUMBER() OVER (ORDER BY p) AS rank_p FROM q)
SELECT feature, n, n_unique_values, ROUND(rho, 8) AS spearman_rho, ROUND(p, 6) AS spearman_p_value, ROUND({bh_sql("p")}, 6) AS spearman_fdr_bh FROM k""", ["num"])
def g10(spark, sf):
    s = stats.spearman(num(spark, sf), FEATURES, "y")
    return s.select("feature", "n", "n_unique_values", F.round("spearman_rho", 8).alias("spearman_rho"),
                    F.round("spearman_p_value", 6).alias("spearman_p_value"), F.round("spearman_fdr_bh", 6).alias("spearman_fdr_bh"))


@query("g11_rank_correlation_pairs", """
, w AS (SELECT """ + ", ".join(
    f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in (*FEATURES, "balance")) + """ FROM num),
p AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS rho, COUNT(*) AS n FROM w"
    for a in sorted((*FEATURES, "balance")) for b in sorted((*FEATURES, "balance")) if a < b) + f"""),
t AS (SELECT *, CASE WHEN abs(rho) < 1 - 1e-12 THEN rho * sqrt((n - 2) / ((1 - rho) * (1 + rho))) END AS t FROM p WHERE abs(rho) >= 0.005)
SELECT feature_a, feature_b, ROUND(rho, 8) AS spearman_rho, ROUND(abs(rho), 8) AS abs_rho,
  ROUND(CASE WHEN t IS NULL THEN 0.0 ELSE {t_two_sided_sql("t", "(n - 2)")} END, 6) AS p_value FROM t""", ["num"])
def g11(spark, sf):
    s = stats.rank_correlation_pairs(num(spark, sf), [*FEATURES, "balance"], 0.005)
    return s.withColumns({**r(["spearman_rho", "abs_rho"], 8), **r(["p_value"])})


# The 49 statement features of all documents, one pass over their products.
@query("g13_vif_statement")
def g13s(spark, sf):
    from ..functions import text as tx
    from .q_models import TEXT_FEATURES

    return stats.vif(tx.statement_features(fx.problem(spark, sf), "text"), TEXT_FEATURES)


fx.SQL["cc"] = (["num"], "SELECT " + ", ".join(
    f"corr({a}, {b}) AS r_{a}_{b}" for a in FEATURES for b in FEATURES if a < b) + " FROM num")


@query("g12_pearson_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, ROUND({'CAST(1 AS DOUBLE)' if a == b else 'r_' + min(a, b) + '_' + max(a, b)}, 8) AS r FROM cc"
    for a in FEATURES for b in FEATURES), ["cc"])
def g12(spark, sf):
    return stats.pearson_matrix(num(spark, sf), FEATURES).withColumns(r(["r"], 8))


@query("g13_vif", """
SELECT 'qty' AS feature, ROUND(1 / (1 - c * c), 6) AS vif FROM (SELECT corr(qty, price) AS c FROM num)
UNION ALL SELECT 'price', ROUND(1 / (1 - c * c), 6) FROM (SELECT corr(qty, price) AS c FROM num)""", ["num"])
def g13(spark, sf):
    return stats.vif(num(spark, sf), ["qty", "price"]).withColumns(r(["vif"]))


# --- G: paired groups ---------------------------------------------------------------------------

_W = "w AS (SELECT user_id, " + ", ".join(
    f"MAX({{v}}) FILTER (WHERE event_type = '{e}') AS m{i}" for i, e in enumerate(fx.EVENT_TYPES)) + \
    " FROM outcomes GROUP BY 1 HAVING COUNT(*) = 5)"


@query("g14_cochran_q", ", " + _W.format(v="y") + """,
c AS (SELECT COUNT(*) AS n_units, SUM(m0 + m1 + m2 + m3 + m4) AS t, SUM((m0 + m1 + m2 + m3 + m4) * (m0 + m1 + m2 + m3 + m4)) AS r2,
  SUM(m0) * SUM(m0) + SUM(m1) * SUM(m1) + SUM(m2) * SUM(m2) + SUM(m3) * SUM(m3) + SUM(m4) * SUM(m4) AS c2 FROM w),
q AS (SELECT n_units, 4.0 * (5 * c2 - t * t) / (5 * t - r2) AS q FROM c)
SELECT n_units, ROUND(CAST(q AS DOUBLE), 6) AS cochran_q, 4 AS df, ROUND(exp(-q / 2) * (1 + q / 2), 8) AS p_value FROM q""", ["outcomes"])
def g14(spark, sf):
    q = stats.cochran_q(fx.outcomes(spark, sf), ["user_id"], "event_type", "y", fx.EVENT_TYPES)
    return q.withColumns({**r(["cochran_q"]), **r(["p_value"], 8)})


@query("g15_mcnemar_exact", """
, p AS (SELECT a.event_type AS group_a, b.event_type AS group_b, COUNT(*) AS n_units, AVG(a.y) AS rate_a, AVG(b.y) AS rate_b,
  COUNT(*) FILTER (WHERE a.y = 1 AND b.y = 0) AS a1_b0, COUNT(*) FILTER (WHERE a.y = 0 AND b.y = 1) AS a0_b1
  FROM outcomes a JOIN outcomes b ON a.user_id = b.user_id AND a.event_type < b.event_type
  WHERE a.user_id IN (SELECT user_id FROM outcomes GROUP BY 1 HAVING COUNT(*) = 5) GROUP BY 1, 2),
t AS (SELECT *, a1_b0 + a0_b1 AS n, least(a1_b0, a0_b1) AS k FROM p),
v AS (SELECT *, CASE WHEN 2 * k = n THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i:
  exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0))))) END AS pv FROM t)
SELECT group_a, group_b, n_units, ROUND(rate_a, 8) AS rate_a, ROUND(rate_b, 8) AS rate_b, a1_b0, a0_b1, ROUND(rate_a - rate_b, 8) AS risk_difference,
  ROUND(CASE WHEN a0_b1 > 0 THEN a1_b0 / a0_b1 WHEN a1_b0 > 0 THEN 'inf'::DOUBLE END, 8) AS matched_odds_ratio, ROUND(pv, 8) AS p_value,
  ROUND(least(1.0, MIN(pv * 10 / rk) OVER (ORDER BY pv DESC)), 8) AS fdr_bh FROM (SELECT *, RANK() OVER (ORDER BY pv) + COUNT(*) OVER (PARTITION BY pv) - 1 AS rk FROM v)""",
       ["outcomes"])
def g15(spark, sf):
    m = stats.mcnemar_exact(fx.outcomes(spark, sf), ["user_id"], "event_type", "y", fx.EVENT_TYPES)
    return m.withColumns(r(["rate_a", "rate_b", "risk_difference", "matched_odds_ratio", "p_value", "fdr_bh"], 8))


@query("g16_friedman", """
, f AS (SELECT * FROM outcomes WHERE user_id IN (SELECT user_id FROM outcomes GROUP BY 1 HAVING COUNT(*) = 5)),
k AS (SELECT user_id, event_type, RANK() OVER (PARTITION BY user_id ORDER BY n) + (COUNT(*) OVER (PARTITION BY user_id, n) - 1) / 2.0 AS rk,
  COUNT(*) OVER (PARTITION BY user_id, n) AS t FROM f),
s AS (SELECT SUM(s * s) AS ss FROM (SELECT event_type, SUM(rk) AS s FROM k GROUP BY 1)),
c AS (SELECT COUNT(DISTINCT user_id) AS n, SUM(t * t - 1) AS ties FROM k),
x AS (SELECT n, (12.0 / (5 * n * 6) * ss - 3 * n * 6) / (1 - ties / (5 * 24.0 * n)) AS q FROM s, c)
SELECT n AS n_units, ROUND(CAST(q AS DOUBLE), 6) AS friedman_chi2, 4 AS df, ROUND(exp(-q / 2) * (1 + q / 2), 8) AS p_value FROM x""", ["outcomes"])
def g16(spark, sf):
    f = stats.friedman(fx.outcomes(spark, sf), ["user_id"], "event_type", "n", fx.EVENT_TYPES)
    return f.withColumns({**r(["friedman_chi2"]), **r(["p_value"], 8)})


# Deltas between event types on shared users, per pair.
fx.SQL["deltas"] = (["outcomes"], """
SELECT a.user_id, a.event_type || '-' || b.event_type AS pair, CAST(a.n AS DOUBLE) - b.n AS d, a.n AS va, b.n AS vb
FROM outcomes a JOIN outcomes b ON a.user_id = b.user_id AND a.event_type < b.event_type""")


def deltas(spark, sf):
    p = compare.pairwise(fx.outcomes(spark, sf), ["user_id"], "event_type", "n", fx.EVENT_TYPES)
    return p.select("user_id", F.concat_ws("-", "group_a", "group_b").alias("pair"),
                    (F.col("value_a").cast("double") - F.col("value_b")).alias("d"))


@query("g17_wilcoxon", "," + _signed_rank("deltas", "pair") + f""", e AS (SELECT s.*, z.n_zero, abs(zz) / sqrt(2.0) AS x FROM s JOIN z ON s.pair = z.pair)
SELECT pair, n, n_zero, CAST(w_plus AS DOUBLE) AS w_plus, CAST(w_minus AS DOUBLE) AS w_minus, CAST(least(w_plus, w_minus) AS DOUBLE) AS statistic,
  ROUND({_ERFC.format(x='x')}, 6) AS p_value, ROUND((w_plus - w_minus) / (w_plus + w_minus), 8) AS rank_biserial FROM e""", ["deltas"])
def g17(spark, sf):
    w = stats.wilcoxon(deltas(spark, sf), ["pair"], "d")
    return w.withColumns({**r(["p_value"]), **r(["rank_biserial"], 8)})


fx.SQL["src"] = (["outcomes"], f"""
SELECT event_type AS g, CAST(total AS DOUBLE) AS v, {fx.h32("user_id || '|' || event_type")} AS x, {fx.h32("user_id || '|' || event_type", 1)} AS y FROM outcomes""")


_BOOT = ", {}SELECT g AS event_type, ROUND(ci_low, 6) AS ci_low, ROUND(ci_high, 6) AS ci_high, replicates FROM boot"


@query("g18_bootstrap_ci", _BOOT.format(boot_sql("src", 2026, _BOOT_REPS) + " "), ["src"])
def g18(spark, sf):
    b = rp.bootstrap_mean_ci(fx.outcomes(spark, sf), ["event_type"], "total", ["user_id", "event_type"], _BOOT_REPS, 2026)
    return b.withColumns(r(["ci_low", "ci_high"]))


@query("g18_bootstrap_median_ci", _BOOT.format(boot_sql("src", 2026, _BOOT_REPS, order="v", stat="quantile_cont(v, 0.5)") + " "), ["src"])
def g18m(spark, sf):
    b = rp.bootstrap_median_ci(fx.outcomes(spark, sf), ["event_type"], "total", ["user_id", "event_type"], _BOOT_REPS)
    return b.withColumns(r(["ci_low", "ci_high"]))


# All line items: groups of many cells, whose draws are not in SQL; their numbers are.
@query("g18_bootstrap_weights", """
SELECT l_linenumber, COUNT(*) AS least, COUNT(*) AS most, CAST(200 AS BIGINT) AS replicates FROM lineitem GROUP BY 1""")
def g18w(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_linenumber", "l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey")
    sums = rp.multinomial_sums(rows, ["l_linenumber"], "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 200, 7)
    return sums.groupBy("l_linenumber").agg(F.min("w").alias("least"), F.max("w").alias("most"), F.count(F.lit(1)).alias("replicates"))


@query("g19_rank_biserial", "," + _signed_rank("deltas", "pair") + """
SELECT pair, ROUND((w_plus - w_minus) / (w_plus + w_minus), 8) AS rank_biserial FROM w""", ["deltas"])
def g19(spark, sf):
    return stats.rank_biserial(deltas(spark, sf), ["pair"], "d").withColumns(r(["rank_biserial"], 8))


fx.SQL["pair_deltas"] = (["outcomes"], """
WITH l AS (SELECT user_id, 'total' AS metric, event_type, CAST(total AS DOUBLE) AS v FROM outcomes UNION ALL SELECT user_id, 'n', event_type, n FROM outcomes)
SELECT a.user_id, a.metric, a.v AS va, b.v AS vb, a.v - b.v AS d FROM l a JOIN l b ON a.user_id = b.user_id AND a.metric = b.metric
  AND a.event_type = 'click' AND b.event_type = 'view'""")
_PAIR_ID = "user_id || '|' || metric"
_P3 = ["p_two_sided", "p_a_greater", "p_b_greater"]


@query("g20_paired_delta", ", d AS (SELECT * FROM pair_deltas)," + _signed_rank("d", "metric") + """,
g AS (SELECT metric, COUNT(*) AS n_runs, """ + rs({
    "mean_a": "AVG(va)", "mean_b": "AVG(vb)", "mean_delta": "AVG(d)", "std_delta": "stddev_samp(d)", "median_delta": "quantile_cont(d, 0.5)"}, 5) +
       """, COUNT(*) FILTER (WHERE d > 0) AS a_wins, COUNT(*) FILTER (WHERE d < 0) AS b_wins, COUNT(*) FILTER (WHERE d = 0) AS ties,
  CASE WHEN AVG(d) > 0 THEN 'click' WHEN AVG(d) < 0 THEN 'view' ELSE 'tie' END AS winner_by_mean FROM d GROUP BY 1),
src AS (SELECT metric AS g, d AS v, """ + fx.h32(_PAIR_ID) + " AS x, " + fx.h32(_PAIR_ID, 1) + """ AS y FROM d),
""" + boot_sql("src", 2026, _BOOT_REPS) + """,
""" + signed_rank_sql("metric").strip() + """,
k AS (SELECT *, COUNT(*) OVER () AS n_all, """ + ", ".join(f"ROW_NUMBER() OVER (ORDER BY {n}) AS rank_{n}" for n in _P3) + """ FROM p)
SELECT g.*, CAST(least(w_plus, w_minus) AS DOUBLE) AS wilcoxon_stat, ROUND((w_plus - w_minus) / (w_plus + w_minus), 8) AS rank_biserial,
  ROUND(ci_low, 5) AS ci_low, ROUND(ci_high, 5) AS ci_high, """ + rs({n: n for n in _P3}) + ", " +
       ", ".join(f"ROUND({bh_sql(n)}, 6) AS {n.replace('p_', 'q_', 1)}" for n in _P3) + """
FROM g JOIN k ON g.metric = k.metric JOIN boot ON boot.g = g.metric""", ["pair_deltas"])
def g20(spark, sf):
    p = stats.paired_delta(fx.outcomes(spark, sf), ["user_id"], "event_type", "click", "view", ["total", "n"])
    return p.withColumns({**r(["mean_a", "mean_b", "mean_delta", "std_delta", "median_delta", "ci_low", "ci_high"], 5), **r(["rank_biserial"], 8),
                          **r([*_P3, *(n.replace("p_", "q_", 1) for n in _P3)])})


_TERMS = ["intercept", "qty", "disc", "tax", "s_O"]
_N = len(_TERMS)


@query("g21_adjusted_odds_ratios", """
, f AS (SELECT """ + ", ".join(f"AVG({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in _TERMS[1:4]) + """ FROM num),
rows_ AS (SELECT 1 AS r, CAST(y AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS w, [1.0, """ + ", ".join(f"(CAST({c} AS DOUBLE) - m_{c}) / d_{c}" for c in _TERMS[1:4]) + """,
  CAST(s = 'O' AS DOUBLE)] AS z FROM num, f), """ + newton_sql("rows_", _N) + f""",
i0 AS (SELECT b, list_transform(h, lambda row, i: list_concat(row, list_transform(range(1, {_N + 1}), lambda j: CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE 0 END))) AS m FROM nt),
{solve_sql("i0", "inv", _N)},
t AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, b[{k}] AS coef, sqrt(m[{k}][{_N + k}]) AS se FROM inv" for k, c in enumerate(_TERMS, 1)) + f"""),
e AS (SELECT *, coef / se AS zz, exp(coef) AS ratio, exp(coef - {Z95} * se) AS low, exp(coef + {Z95} * se) AS high FROM t),
v AS (SELECT *, {normal_two_sided_sql("zz")} AS p FROM e),
k AS (SELECT *, COUNT(*) OVER () AS n_all, ROW_NUMBER() OVER (ORDER BY p) AS rank_p FROM v), q AS (SELECT *, {bh_sql("p")} AS fdr FROM k)
SELECT feature, ROUND(coef, 7) AS coef, ROUND(se, 7) AS std_error, true AS converged, ROUND(ratio, 7) AS adjusted_odds_ratio, ROUND(low, 6) AS or_ci95_low,
  ROUND(high, 6) AS or_ci95_high, ROUND(p, 6) AS p_value, ROUND(fdr, 6) AS fdr_bh,
  CASE WHEN fdr < 0.05 AND low > 1 THEN 'higher adjusted risk' WHEN fdr < 0.05 AND high < 1 THEN 'lower adjusted risk' ELSE 'inconclusive' END AS direction FROM q""", ["num"])
def g21(spark, sf):
    t = stats.adjusted_odds_ratios(num(spark, sf), ["qty", "disc", "tax"], [], "y", "s", ["F", "O"])
    return t.drop("z_value").withColumns({**r(["coef", "std_error", "adjusted_odds_ratio"], 7), **r(["or_ci95_low", "or_ci95_high", "p_value", "fdr_bh"])})


@query("g22_wilson_ci", f"""
, c AS (SELECT event_type, SUM(y) AS k, COUNT(*) AS n FROM outcomes GROUP BY 1)
SELECT event_type, CAST(k AS BIGINT) AS k, n, {_wilson('k', 'n', -1)} AS low, {_wilson('k', 'n', 1)} AS high FROM c""", ["outcomes"])
def g22(spark, sf):
    c = fx.outcomes(spark, sf).groupBy("event_type").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = review.wilson_ci(F.col("k"), F.col("n"))
    return c.withColumns({"low": F.round(lo, 8), "high": F.round(hi, 8)})


def _kappa_sql(extra: str = "") -> str:
    return f"""
, p AS (SELECT upper(trim(validity_r1)) AS a, upper(trim(validity_r2)) AS b FROM ratings),
q AS (SELECT * FROM p WHERE a <> '' AND b <> ''{extra}), n AS (SELECT COUNT(*) AS n, AVG(CAST(a = b AS DOUBLE)) AS po FROM q),
e AS (SELECT SUM(x.c * y.c) AS s FROM (SELECT a, COUNT(*) AS c FROM q GROUP BY 1) x JOIN (SELECT b, COUNT(*) AS c FROM q GROUP BY 1) y ON x.a = y.b)
SELECT n AS n_double_rated, ROUND(po, 8) AS raw_agreement, ROUND((po - s / (n * n)) / (1 - s / (n * n)), 8) AS cohen_kappa FROM n, e"""


@query("g23_kappa", _kappa_sql(), ["ratings"])
def g23(spark, sf):
    k = review.kappa(fx.ratings(spark, sf), "validity_r1", "validity_r2")
    return k.withColumns(r(["raw_agreement", "cohen_kappa"], 8))


@query("g23_kappa_decidable", _kappa_sql(" AND a <> 'UNCERTAIN' AND b <> 'UNCERTAIN'"), ["ratings"])
def g23d(spark, sf):
    k = review.kappa(fx.ratings(spark, sf), "validity_r1", "validity_r2", decidable_only=True)
    return k.withColumns(r(["raw_agreement", "cohen_kappa"], 8))


@query("g24_hellinger", """
, n AS (SELECT cwe, COUNT(*) FILTER (WHERE model = 'A') AS a, COUNT(*) FILTER (WHERE model = 'R') AS r FROM raw_findings GROUP BY 1),
t AS (SELECT SUM(a) AS ta, SUM(r) AS tr FROM n)
SELECT CAST(ta AS BIGINT) AS ta, CAST(tr AS BIGINT) AS tb, ROUND(sqrt(SUM((sqrt(a / ta) - sqrt(r / tr)) * (sqrt(a / ta) - sqrt(r / tr)))) / sqrt(2.0), 6)
  AS hellinger FROM n, t GROUP BY 1, 2""", ["raw_findings"])
def g24(spark, sf):
    h = compare.hellinger(fx.raw_findings(spark, sf), "model", "A", "R", "cwe")
    return h.withColumns(r(["hellinger"]))


@query("g25_two_corpus_shift", """
, n AS (SELECT model, cwe, COUNT(*) FILTER (WHERE phase = 'before') AS a, COUNT(*) FILTER (WHERE phase = 'after') AS b FROM raw_findings GROUP BY 1, 2),
t AS (SELECT model, SUM(a) AS ta, SUM(b) AS tb FROM n GROUP BY 1)
SELECT t.model, CAST(ta AS BIGINT) AS before_total, CAST(tb AS BIGINT) AS after_total, CAST(tb - ta AS BIGINT) AS delta,
  ROUND(CAST((tb - ta) / greatest(ta, 1) * 100.0 AS DOUBLE), 6) AS pct_change,
  ROUND(sqrt(SUM((sqrt(a / ta) - sqrt(b / tb)) * (sqrt(a / ta) - sqrt(b / tb)))) / sqrt(2.0), 6) AS hellinger
FROM n JOIN t ON n.model = t.model GROUP BY t.model, ta, tb""", ["raw_findings"])
def g25(spark, sf):
    s = compare.two_corpus_shift(fx.raw_findings(spark, sf), "phase", "before", "after", "cwe", "model")
    return s.withColumns(r(["pct_change", "hellinger"]))


@query("g25_category_delta", """
, n AS (SELECT cwe, model, COUNT(*) FILTER (WHERE phase = 'after') - COUNT(*) FILTER (WHERE phase = 'before') AS d FROM raw_findings GROUP BY 1, 2)
SELECT cwe, CAST(SUM(d) FILTER (WHERE model = 'A') AS BIGINT) AS "A_delta", CAST(SUM(d) FILTER (WHERE model = 'N') AS BIGINT) AS "N_delta",
  CAST(SUM(d) FILTER (WHERE model = 'R') AS BIGINT) AS "R_delta", CAST(SUM(abs(d)) AS BIGINT) AS total_abs_delta FROM n GROUP BY 1""", ["raw_findings"])
def g25c(spark, sf):
    return compare.two_corpus_category_delta(
        fx.raw_findings(spark, sf), "phase", "before", "after", "cwe", "model", fx.MODELS)
