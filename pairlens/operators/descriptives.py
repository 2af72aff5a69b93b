"""Descriptive tables: metrics per group, runs, latencies, attempts, histograms."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import quantiles, quantiles_of, ranked
from .staging import stage

Q5 = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}


def long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "metric",
         value: str = "value") -> DataFrame:
    """Numeric columns as (name, value) rows."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), name, value
    )


def quality_audit(df: DataFrame, group: str, case: str, flags: Sequence[str]) -> DataFrame:
    """Rows, unique cases, and mean and sum of validity flags per group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(case).alias("n_cases"),
        *[F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in flags],
        *[F.sum(F.col(c).cast("double")).alias(f"{c}_sum") for c in flags],
    )


def group_descriptives(df: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """Mean, median and sum of each metric per group (long form)."""
    by = [group, "metric"]
    table = ranked(long(df, [group], metrics), by, "value")
    base = table.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("sum")
    ).withColumn("mean", F.col("sum") / F.col("n"))
    return base.join(quantiles_of(table, by, "value", {"median": 0.5}).drop("count"), by)


def paired_long(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per key and (before, after) pair with both values and the delta."""
    cells = F.array(*[
        F.struct(F.lit(b).alias("before_metric"), F.lit(a).alias("after_metric"),
                 F.col(b).cast("double").alias("before"), F.col(a).cast("double").alias("after"))
        for b, a in pairs
    ])
    rows = df.select(*keys, F.explode(cells).alias("_p")).select(*keys, "_p.*")
    return rows.where(F.col("before").isNotNull() & F.col("after").isNotNull()).withColumn(
        "delta", F.col("after") - F.col("before")
    )


def before_after(df: DataFrame, group: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Means, deltas, improved/worsened/unchanged counts and the signed-rank test."""
    from .stats import wilcoxon

    by = [group, "before_metric", "after_metric"]
    rows = stage(paired_long(df, [group], pairs))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.avg("before").alias("before_mean"), F.avg("after").alias("after_mean"),
        F.avg("delta").alias("mean_delta"),
        F.count_if(F.col("delta") < 0).alias("improved_cases"),
        F.count_if(F.col("delta") > 0).alias("worsened_cases"),
        F.count_if(F.col("delta") == 0).alias("unchanged_cases"),
    )
    mid = quantiles(rows, by, "delta", {"median_delta": 0.5}).drop("count")
    test = wilcoxon(rows, by, "delta").select(*by, "statistic", "p_value")
    return base.join(mid, by, "left").join(test, by, "left")


def run_summary(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum over runs (long form)."""
    rows = long(runs, keys, metrics)
    return rows.groupBy(*keys, "metric").agg(
        F.count("value").alias("n_runs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def sign_consistency(coefs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, deviation, mean size and sign counts of coefficients over runs."""
    v = F.col(value)
    g = coefs.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.avg(F.abs(v)).alias("abs_mean"), F.stddev_samp(F.abs(v)).alias("abs_std"),
        F.count_if(v > 0).alias("positive_runs"), F.count_if(v < 0).alias("negative_runs"),
        F.count_if(v == 0).alias("zero_runs"),
    )
    total = F.col("positive_runs") + F.col("negative_runs") + F.col("zero_runs")
    return g.withColumn("sign_consistency", F.greatest("positive_runs", "negative_runs") / total)


def importance_summary(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, deviation, range and sign counts of importances or losses."""
    v = F.col(value)
    return runs.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_if(v > 0).alias("positive_runs"), F.count_if(v < 0).alias("negative_runs"),
        F.count_if(v == 0).alias("zero_runs"),
    )


def _scopes(df: DataFrame, group: str) -> DataFrame:
    """Every row under OVERALL and under its group."""
    return df.withColumn(
        "scope", F.explode(F.array(F.lit("OVERALL"), F.concat(F.lit("MODEL:"), F.col(group))))
    )


def latency_summary(raw: DataFrame, unit: Sequence[str], group: str, value: str) -> DataFrame:
    """Median of the repeats per unit, then its distribution overall and per group."""
    # The repeats of one unit are few by design, so that the built-in percentile is bounded.
    known = raw.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    per_unit = known.groupBy(*unit).agg(F.percentile(value, F.lit(0.5)).alias("_ms"))
    scoped = _scopes(per_unit, group)
    table = ranked(scoped, ["scope"], "_ms")
    q = quantiles_of(table, ["scope"], "_ms", Q5)
    base = table.groupBy("scope").agg(
        F.sum("n").alias("n"), (F.sum(F.col("_ms") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("_ms").alias("min"), F.max("_ms").alias("max"),
    )
    return base.join(q.drop("count"), "scope").withColumn("iqr", F.col("q3") - F.col("q1"))


def ratio_summary(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Quantiles of per-row ratios where the denominator is positive."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("ratio"),
                 F.when(F.col(d) > 0, F.col(n).cast("double") / F.col(d)).alias("value"))
        for name, (n, d) in ratios.items()
    ])
    rows = df.select(F.explode(cells).alias("_r")).select("_r.*")
    return quantiles(rows, ["ratio"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumnRenamed(
        "count", "n")


def failure_summary(attempts: DataFrame, group: str, stage: str, done: Sequence[str]) -> DataFrame:
    """Failures per (group, stage); null keys keep their own row."""
    failed = attempts.where(F.coalesce(~F.col(stage).isin(list(done)), F.lit(True)))
    return failed.groupBy(group, stage).agg(F.count(F.lit(1)).alias("n_failures"))


def success_summary(attempts: DataFrame, group: str, stage: str, done: Sequence[str]) -> DataFrame:
    """Attempts, successes and success rate per group."""
    ok = F.coalesce(F.col(stage).isin(list(done)), F.lit(False))
    g = attempts.groupBy(group).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("successful"))
    return g.withColumn("success_rate", F.col("successful") / F.col("attempts"))


def missing_inputs(df: DataFrame, inputs: Mapping[str, str], out: str = "error") -> DataFrame:
    """Names of the empty inputs of an attempt, '|'-joined."""
    parts = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"MISSING_{name}")) for name, c in inputs.items()]
    return df.withColumn(out, F.concat_ws("|", *parts))


def composition(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per stratum, null keys included."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def prevalence_audit(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Non-zero rows and share, mean, median, maximum and distinct values per feature."""
    filled = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    table = ranked(long(filled, [], features, "feature"), ["feature"], "value")
    base = table.groupBy("feature").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value") != 0, F.col("n")).otherwise(0)).alias("nonzero_rows"),
        F.sum(F.col("value") * F.col("n")).alias("_s"), F.max("value").alias("max"),
        F.count(F.lit(1)).alias("distinct_values"),
    )
    mid = quantiles_of(table, ["feature"], "value", {"median": 0.5}).drop("count")
    return base.join(mid, "feature").withColumns({
        "fraction_nonzero": F.col("nonzero_rows") / F.col("n_rows"), "mean": F.col("_s") / F.col("n_rows"),
    }).drop("_s")


def class_histogram(df: DataFrame, features: Sequence[str], target: str, bins: int = 29) -> DataFrame:
    """Per-class bin counts on a range clipped at the 99th (and 1st) percentile."""
    rows = long(df, [target], features, "feature").where("value IS NOT NULL")
    table = ranked(rows, ["feature"], "value")
    q = quantiles_of(table, ["feature"], "value", {"p1": 0.01, "p99": 0.99}).drop("count")
    ends = table.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    edge = q.join(ends, "feature")
    lower = F.when(F.col("lo") < 0, F.col("p1")).otherwise(F.greatest(F.lit(0.0), F.col("lo")))
    flat = F.col("p99") <= lower
    edge = edge.select("feature", F.when(flat, F.col("lo")).otherwise(lower).alias("lower"),
                       F.when(flat, F.col("hi")).otherwise(F.col("p99")).alias("upper"))
    # Distinct values per class first: the join then carries counts, not rows.
    counts = rows.groupBy("feature", target, "value").agg(F.count(F.lit(1)).alias("_c"))
    width = (F.col("upper") - F.col("lower")) / bins
    place = F.when(width > 0, F.floor((F.col("value") - F.col("lower")) / width)).otherwise(0)
    inside = (F.col("value") >= F.col("lower")) & (F.col("value") <= F.col("upper"))
    return (
        counts.join(edge, "feature").where(inside)
        .groupBy("feature", target, F.least(F.lit(bins - 1), place).cast("int").alias("bin"),
                 "lower", "upper")
        .agg(F.sum("_c").alias("n"))
    )


def score_histogram(df: DataFrame, by: Sequence[str], score: str, bins: int = 15) -> DataFrame:
    """Counts in equal bins of [0, 1]; the last bin is closed."""
    place = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int")
    return df.where((F.col(score) >= 0) & (F.col(score) <= 1)).groupBy(*by, place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def attempt_funnel(meta: DataFrame, group: str, attempts: str = "attempts") -> DataFrame:
    """Attempted, valid, reused and failed-by-stage counts per group.

    ``attempts`` is an array of (stage, success, reused); the case is valid
    when an apply attempt succeeded, else its last attempt names the stage.
    """
    a = F.col(attempts)
    n = F.size(F.coalesce(a, F.array()))
    ok = F.filter(F.transform(a, lambda x, i: F.struct((i + 1).alias("i"), x["stage"].alias("s"),
                                                       x["success"].alias("ok"))), lambda x: (x["s"] == "apply") & x["ok"])
    first_ok = F.get(ok, F.lit(0))["i"]
    last = F.when(n > 0, F.element_at(a, -1)["stage"])
    reused = F.coalesce(F.exists(a, lambda x: x["reused"]), F.lit(False))
    case = meta.select(group, n.alias("n"), first_ok.alias("first_ok"), last.alias("last"), reused.alias("reused"))
    valid = F.col("first_ok").isNotNull()
    return case.groupBy(group).agg(
        F.count_if(F.col("n") > 0).alias("attempted"), F.count_if(valid).alias("valid"),
        F.count_if(F.col("reused")).alias("generation_reused"),
        F.count_if(~valid & (F.col("last") == "generation")).alias("generation_failed"),
        F.count_if(~valid & (F.col("last") == "apply")).alias("apply_failed"),
        F.sum("n").cast("long").alias("total_attempts"), F.avg(F.col("first_ok").cast("double")).alias("mean_first_success"),
    )


def quartile_contrast(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Risk at or below the first and at or above the third quartile per feature."""
    filled = df.select(
        F.col(target).cast("long").alias("_y"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
    )
    table = ranked(long(filled, ["_y"], features, "feature"), ["feature"], "value", sums=["_y"])
    q = quantiles_of(table, ["feature"], "value", {"q1": 0.25, "q3": 0.75}).drop("count")
    j = table.select("feature", "value", "n", "_y").join(q, "feature")
    low, high = F.col("value") <= F.col("q1"), F.col("value") >= F.col("q3")

    def total(c: str, mask: Column) -> Column:
        return F.sum(F.when(mask, F.col(c)).otherwise(0))

    g = j.groupBy("feature", "q1", "q3").agg(
        F.count(F.lit(1)).alias("_distinct"),
        total("n", low).alias("low_n"), total("n", high).alias("high_n"),
        total("_y", low).alias("_ly"), total("_y", high).alias("_hy"),
    ).where("_distinct >= 4 AND low_n > 0 AND high_n > 0")
    lo, hi = F.col("_ly") / F.col("low_n"), F.col("_hy") / F.col("high_n")
    return g.select(
        "feature", "q1", "q3", "low_n", "high_n", lo.alias("risk_bottom_quartile"), hi.alias("risk_top_quartile"),
        (hi - lo).alias("risk_difference"), F.when(lo > 0, hi / lo).alias("risk_ratio"),
    )
