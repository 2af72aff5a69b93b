"""Binary classification metrics and triage policies over scored rows."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import md5_draw, md5_hex
from .keys import key_join
from .ranks import draw_positions, placed, present, ranked
from .staging import stage

# The review policies.
RECALL_TARGETS = {"recall_90": 0.90, "recall_95": 0.95}
TOP_FRACTIONS = {"top_20": 0.20, "top_50": 0.50}


def confusion_metrics(preds: DataFrame, by: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """tn, fp, fn, tp and the threshold metrics; undefined ratios are zero."""
    return _threshold_ratios(preds.groupBy(*by).agg(*_confusion(y_true, y_pred)))


def _confusion(y_true: str, y_pred: str) -> list[Column]:
    y, p = F.col(y_true) == 1, F.col(y_pred) == 1
    return [F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
            F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp")]


def _threshold_ratios(g: DataFrame) -> DataFrame:

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    balanced = F.when(sens.isNotNull() & spec.isNotNull(), (sens + spec) / 2).otherwise(F.coalesce(sens, spec))
    return g.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "balanced_accuracy": balanced,
        "precision_1": ratio(tp, tp + fp), "recall_1": ratio(tp, tp + fn), "f1_1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def _curve(preds: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    """Distinct scores with positives at, below and in total."""
    return ranked(preds.withColumn("_y", F.col(y).cast("long")), by, score, sums=["_y"])


def roc_auc(preds: DataFrame, by: Sequence[str], y: str = "y_true", score: str = "y_score") -> DataFrame:
    """Tie-aware area under the ROC curve by rank sums; null for a single class."""
    return curve_metrics(preds, by, y, score).select(*by, "roc_auc")


def average_precision(preds: DataFrame, by: Sequence[str], y: str = "y_true", score: str = "y_score") -> DataFrame:
    """Step-wise average precision over distinct scores from high to low."""
    return curve_metrics(preds, by, y, score).select(*by, "pr_auc")


def curve_metrics(preds: DataFrame, by: Sequence[str], y: str = "y_true", score: str = "y_score") -> DataFrame:
    """ROC-AUC and average precision from one ranked table."""
    return _areas(_curve(preds, by, y, score), list(by))


def _areas(t: DataFrame, by: Sequence[str]) -> DataFrame:
    at_least = F.col("_y_total") - F.col("_y_below")
    step = F.col("_y") * at_least / (F.col("total") - F.col("below"))
    g = t.groupBy(*by).agg(
        F.max("total").alias("n"), F.max("_y_total").cast("double").alias("_p"),
        F.sum(F.col("avg_rank") * F.col("_y")).alias("_r"), F.sum(step).alias("_s"),
    )
    neg = F.col("n") - F.col("_p")
    auc = F.when((F.col("_p") > 0) & (neg > 0),
                 (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * neg))
    ap = F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).otherwise(0.0)
    return g.select(*by, "n", auc.alias("roc_auc"), ap.alias("pr_auc"))


def binary_metrics(preds: DataFrame, by: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred",
                   y_score: str = "y_score") -> DataFrame:
    """Threshold and curve metrics per run.

    One table of the distinct scores serves both, so that ``preds`` is read once
    and need not be written.
    """
    by = list(by)
    cells = stage(preds.groupBy(*by, y_score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y_true).cast("long")).alias("_y"), *_confusion(y_true, y_pred)))
    c = _threshold_ratios(cells.groupBy(*by).agg(*[F.sum(k).alias(k) for k in ("tn", "fp", "fn", "tp")]))
    curve = _areas(placed(present(cells, y_score).select(*by, y_score, "n", "_y"), by, y_score, ["_y"]), by)
    return c.join(curve.drop("n"), by)


def threshold_for_recall(df: DataFrame, by: Sequence[str], y: str, score: str, targets: Mapping[str, float]) -> DataFrame:
    """Largest threshold whose recall reaches each target, one column per target.

    Without any positive no threshold is feasible; the value just under the
    lowest score then selects everything.
    """
    by = list(by)
    t = _curve(df, by, y, score)
    recall = F.try_divide(F.col("_y_total") - F.col("_y_below"), F.col("_y_total"))
    return t.groupBy(*by).agg(*[
        F.coalesce(F.max(F.when(recall >= r - 1e-15, F.col(score))), F.min(score) - 1e-12).alias(name)
        for name, r in targets.items()
    ])


def _policy_ratios(g: DataFrame) -> DataFrame:
    """Coverage, recall, miss rate, precision and lift from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    g = g.withColumns({"n_test": tp + fp + fn + tn, "n_selected": tp + fp, "positives": tp + fn})
    coverage, precision = F.try_divide("n_selected", "n_test"), F.try_divide("tp", "n_selected")
    base = F.try_divide("positives", "n_test")
    return g.withColumns({
        "coverage": coverage, "workload_reduction": 1.0 - coverage,
        "finding_recall": F.try_divide("tp", "positives"), "miss_rate": F.try_divide("fn", "positives"),
        "precision_selected": precision, "baseline_prevalence": base,
        "lift": F.when(base > 0, F.try_divide(precision, base)),
    })


def policy_metrics(test: DataFrame, by: Sequence[str], y: str, score: str, tie: Sequence[str],
                   thresholds: DataFrame, fixed: float = 0.5) -> DataFrame:
    """Every review policy on the scored test rows of every run.

    ``thresholds`` holds one column per recall policy, fitted on training rows.
    All policies are sums over one table of distinct scores. A top fraction
    ends inside one score at most; only the rows of that score are ordered.
    """
    by = list(by)
    table = stage(_curve(test, by, y, score))
    names = [c for c in thresholds.columns if c not in by]
    above = F.col("total") - F.col("below") - F.col("n")
    quota = {n: F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(float(f)))) for n, f in TOP_FRACTIONS.items()}
    flags = {"always": F.lit(True), f"fixed_{int(fixed * 100)}": F.col(score) >= fixed,
             **{n: F.coalesce(F.col(score) >= F.col(n), F.lit(False)) for n in names},
             **{n: above + F.col("n") <= k for n, k in quota.items()}}
    cut = {n: (above < k) & (above + F.col("n") > k) for n, k in quota.items()}
    sums = key_join(table, thresholds, by, "left").groupBy(*by).agg(
        F.max("total").alias("_n"), F.max("_y_total").alias("_p"),
        *[F.sum(F.when(f, F.col("n")).otherwise(0)).alias(f"_s_{n}") for n, f in flags.items()],
        *[F.sum(F.when(f, F.col("_y")).otherwise(0)).alias(f"_t_{n}") for n, f in flags.items()],
    )
    cells = F.array(*[F.struct(F.lit(n).alias("policy"), F.col(f"_s_{n}").alias("_sel"), F.col(f"_t_{n}").alias("tp")) for n in flags])
    whole = sums.select(*by, "_n", "_p", F.explode(cells).alias("_c")).select(*by, "_n", "_p", "_c.*")
    ends = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("policy"), (quota[n] - above).cast("long").alias("_need")))
                                     for n, c in cut.items()]))
    split = table.select(*by, score, F.explode(ends).alias("_c")).select(*by, score, "_c.*")
    rows = key_join(test.select(*by, score, F.col(y).alias("_y"), md5_draw(*tie).alias("_d"), md5_hex(*tie).alias("_h")),
                    split, [*by, score])
    taken = draw_positions(rows, [*by, "policy", "_need"], F.col("_d"), keep=F.col("_need"), tie=["_h"])
    extra = taken.groupBy(*by, "policy").agg(F.count(F.lit(1)).alias("_more"), F.count_if(F.col("_y") == 1).alias("_hit"))
    g = key_join(whole, extra, [*by, "policy"], "left").select(
        *by, "policy", "_n", "_p", (F.col("_sel") + F.coalesce("_more", F.lit(0))).alias("_sel"),
        (F.col("tp") + F.coalesce("_hit", F.lit(0))).alias("tp"))
    return _policy_ratios(g.select(
        *by, "policy", "tp", (F.col("_sel") - F.col("tp")).alias("fp"), (F.col("_p") - F.col("tp")).alias("fn"),
        (F.col("_n") - F.col("_p") - F.col("_sel") + F.col("tp")).alias("tn")))


POLICY_METRICS = ["coverage", "workload_reduction", "finding_recall", "miss_rate", "precision_selected", "lift"]


def policy_summary(runs: DataFrame, policy: str, run: Sequence[str], metrics: Sequence[str] = POLICY_METRICS,
                   replicates: int = 20_000, seed: int = 2026) -> DataFrame:
    """Mean, deviation and bootstrap interval of every policy metric over runs."""
    from .descriptives import long
    from .replicates import bootstrap_mean_ci

    rows = long(runs, [policy, *run], metrics)
    base = rows.groupBy(policy, "metric").agg(
        F.count("value").alias("n_runs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    ci = bootstrap_mean_ci(rows, [policy, "metric"], "value", [*run, policy, "metric"], replicates, seed)
    return base.join(ci.drop("replicates"), [policy, "metric"], "left")
