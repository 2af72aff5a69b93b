"""Balanced logistic regression and forests on Spark ML, and their evaluation."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bijection import permuted
from ..functions.draws import md5_draw
from ..functions.ratios import interactions, one_hot
from .exchange import exchanged_auc
from .forest import grow_forests, scored_by
from .keys import key_join
from .newton import Fitted, SplitTable
from .ranks import draw_positions, quantiles
from .splits import group_folds, group_splits, run_folds
from .staging import scratch, stage
from .triage import binary_metrics, curve_metrics


@dataclass
class LinearModel:
    """A fitted logistic regression in terms of the raw columns."""

    features: list[str]
    medians: dict[str, float]
    means: list[float]
    scales: list[float]
    coefficients: list[float]
    intercept: float
    extra: dict = field(default_factory=dict)

    def filled(self, name: str) -> Column:
        return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None)), F.lit(self.medians.get(name, 0.0)), F.lit(0.0))

    def margin(self) -> Column:
        """Linear predictor as one arithmetic expression (no vectors, no Python)."""
        shift, total = self.intercept, F.lit(0.0)
        for f, m, s, b in zip(self.features, self.means, self.scales, self.coefficients):
            shift -= b * m / s
            total = total + F.lit(b / s) * self.filled(f)
        return F.lit(shift) + total

    def score(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin()))

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.score()
        return df.withColumn("y_score", s).withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))


@dataclass
class ForestModel:
    """A fitted random forest with the medians of its training rows."""

    features: list[str]
    medians: dict[str, float]
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        fill = {f"_f_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)),
                                      F.lit(self.medians.get(c, 0.0)), F.lit(0.0)) for c in self.features}
        v = VectorAssembler(inputCols=list(fill), outputCol="_x").transform(df.withColumns(fill))
        p = self.model.transform(v).withColumn("y_score", vector_to_array("probability")[1])
        return p.select(*keep, "y_score", (F.col("y_score") >= 0.5).cast("int").alias("y_pred"))


def _class_counts(train: DataFrame, label: str) -> dict[int, int]:
    return {int(r[0]): int(r[1]) for r in train.groupBy(F.col(label).cast("int")).agg(F.count(F.lit(1))).collect()}


def _medians(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact training medians of the columns that have nulls at all."""
    from .descriptives import long

    gaps = train.agg(*[F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).alias(f) for f in features]).first()
    holes = [f for f in features if gaps[f]]
    if not holes:
        return {}
    q = quantiles(long(train, [], holes), ["metric"], "value", {"m": 0.5})
    return {r["metric"]: float(r["m"]) for r in q.select("metric", "m").collect()}


def _weighted(train: DataFrame, label: str, counts: Mapping[int, int]) -> DataFrame:
    n = sum(counts.values())
    w = F.when(F.col(label) == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    return train.withColumn("_w", w)


def _linear(table: SplitTable, fitted: Fitted) -> LinearModel:
    names = [table.features[k] for k in fitted.columns]
    return LinearModel(names, dict(zip(names, map(float, fitted.fill))), fitted.mean.tolist(), fitted.scale.tolist(),
                       fitted.beta[1:].tolist(), float(fitted.beta[0]))


def balanced_lr(train: DataFrame, features: Sequence[str], label: str, c: float = 1.0) -> LinearModel | None:
    """L2 logistic regression with balanced class weights; None for a single class.

    The optimum of sum(w * loss) + |b|^2 / (2C) on population-scaled columns, by Newton steps.
    """
    table = SplitTable.whole(train, features, label)
    if not table.usable(score=False):
        return None
    return _linear(table, table.fit({"": list(features)}, [0], c)[0, ""])


def balanced_rf(train: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 15,
                min_leaf: int = 1, seed: int = 42) -> ForestModel | None:
    """Random forest with balanced class weights; None for a single class."""
    features = list(features)
    counts = _class_counts(train, label)
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return None
    medians = _medians(train, features)
    fill = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(medians.get(f, 0.0)), F.lit(0.0)).alias(f"_f_{f}")
            for f in features]
    w = _weighted(train.select(F.col(label).cast("double").alias("_y"), *fill), "_y", counts)
    v = VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="_x").transform(w)
    rf = RandomForestClassifier(
        featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed)
    return ForestModel(features, medians, rf.fit(v.select("_x", "_y", "_w")))


Fitter = Callable[[DataFrame, Sequence[str], str], "LinearModel | ForestModel | None"]
LR: dict[str, Fitter] = {"logistic_regression": balanced_lr}
LR_RF: dict[str, Fitter] = {"logistic_regression": balanced_lr, "random_forest": balanced_rf}


class _Table:
    """Rows of one schema written bit by bit to a staged table."""

    def __init__(self, df: DataFrame):
        self.path = scratch(df.sparkSession)
        self.parts: list[DataFrame] = []

    def add(self, df: DataFrame) -> None:
        self.parts.append(df)
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.parts[0].sparkSession.read.schema(self.parts[0].schema).parquet(self.path)


def predictions(df: DataFrame, sets: Mapping[str, Sequence[str]], models: Mapping[str, Fitter], splits: DataFrame,
                group: str, label: str, keep: Sequence[str] = (), staged: bool = True) -> tuple[DataFrame, list]:
    """Test predictions of every run x feature set x classifier, and the fitted models.

    Without ``staged`` they are not written and come without ``group`` and ``keep``,
    for what reads them once and only combines them.

    Logistic regressions of all runs and sets are fitted together, and so are
    forests. For other classifiers the driver loops over fits; each fit and each
    transform is distributed. Runs whose training or test rows have a single
    class are left out. Trees stay in a table and are not among the models.
    """
    keep, splits = list(keep), stage(splits)
    runs = [r[0] for r in splits.select("run").distinct().orderBy("run").collect()]
    number = F.array_position(F.array(*[F.lit(r) for r in runs]), F.col("run")).cast("int") - 1
    roles = splits.select(number.alias("no"), group, (1 - F.col("is_test")).alias("is_train"), F.col("is_test").alias("is_score"))
    names = list(dict.fromkeys(f for fs in sets.values() for f in fs))
    table = SplitTable(df, names, label, group, roles, len(runs), [c for c in keep if c != group])
    usable = table.usable(score=True)
    if not usable:
        raise ValueError("no split has both classes on both sides")
    kept = [group, *[c for c in keep if c != group]] if staged else []
    columns = ["run", "feature_set", "algorithm", *kept, "y_true", "y_pred", "y_score"]
    done = stage if staged else (lambda made: made)
    run_of = F.element_at(F.array(*[F.lit(r) for r in runs]), F.col("no") + 1)
    out, fits = None, []
    for algorithm, fit in models.items():
        if fit is balanced_lr:
            fitted = table.fit(sets, usable)
            fits += [(runs[s], name, algorithm, _linear(table, f)) for (s, name), f in fitted.items()]
            got = done(table.scored(fitted, kept).select(run_of.alias("run"), F.lit(algorithm).alias("algorithm"), "*").select(columns))
        elif fit is balanced_rf:
            forests = grow_forests(table, sets, usable)
            got = done(scored_by(table, forests, sets).select(run_of.alias("run"), F.lit(algorithm).alias("algorithm"), "*").select(columns))
        else:
            got, more = _one_by_one(table, sets, algorithm, fit, [(s, runs[s]) for s in usable], columns)
            fits += more
        out = got if out is None else out.unionByName(got)
    return out, fits


def _one_by_one(table: SplitTable, sets: Mapping[str, Sequence[str]], algorithm: str, fit: Fitter, runs: Sequence[tuple],
                columns: Sequence[str]) -> tuple[DataFrame, list]:
    values = [F.col("_x")[k].alias(f) for k, f in enumerate(table.features)]
    rows = table.rows.select(*table.keep, F.col("_y").alias("y_true"), "_train", "_score", *values)
    out, fits = _Table(table.rows), []
    for s, run in runs:
        train = stage(rows.where(F.array_contains("_train", s)))
        for name, features in sets.items():
            model = fit(train, features, "y_true")
            fits.append((run, name, algorithm, model))
            scored = model.transform(rows.where(F.array_contains("_score", s)))
            out.add(scored.withColumns({"run": F.lit(run), "feature_set": F.lit(name), "algorithm": F.lit(algorithm),
                                        "y_true": F.col("y_true").cast("int")}).select(*columns))
    return out.read(), fits


RUN_KEYS = ["run", "feature_set", "algorithm"]


def evaluate_sets(df: DataFrame, sets: Mapping[str, Sequence[str]], models: Mapping[str, Fitter], splits: DataFrame,
                  group: str, label: str) -> DataFrame:
    """Metrics per run x feature set x classifier."""
    preds, _ = predictions(df, sets, models, splits, group, label, staged=False)
    return binary_metrics(preds, RUN_KEYS)


def leave_group_out(df: DataFrame, groups: Mapping[str, Sequence[str]], models: Mapping[str, Fitter], splits: DataFrame,
                    group: str, label: str) -> DataFrame:
    """AUC lost when one feature group is removed, on the same split."""
    full = [f for fs in groups.values() for f in fs]
    sets = {"full": full, **{f"without_{g}": [f for f in full if f not in set(fs)] for g, fs in groups.items()}}
    # Read twice below, and few rows.
    m = stage(evaluate_sets(df, sets, models, splits, group, label).select(*RUN_KEYS, "roc_auc"))
    whole = m.where("feature_set = 'full'").select("run", "algorithm", F.col("roc_auc").alias("auc_full"))
    part = m.where("feature_set <> 'full'").join(whole, ["run", "algorithm"])
    sizes = F.create_map(*[x for g, fs in groups.items() for x in (F.lit(g), F.lit(len(fs)))])
    name = F.regexp_replace("feature_set", "^without_", "")
    return part.select(
        "run", "algorithm", name.alias("group_removed"), sizes[name].alias("n_removed"), "auc_full",
        F.col("roc_auc").alias("auc_without_group"), (F.col("auc_full") - F.col("roc_auc")).alias("auc_loss_when_removed"))


def _shuffled(base: DataFrame, by: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """Every row of ``base`` (by, _row from 1, _n, ...) beside the row that each repeat's shuffle puts in its place.

    The shuffle is a keyed bijection of row numbers: the row that comes computes
    where it goes, so that only the repeats of whole rows travel. Columns of the
    coming row have the prefix ``o_``.
    """
    by = list(by)
    named = F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    sent = base.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    sent = sent.withColumn("_to", permuted(F.col("_row") - 1, F.col("_n"), named) + 1)
    coming = [c for c in base.columns if c not in (*by, "_row", "_n")]
    sent = sent.select(*by, "repeat", F.col("_to").alias("_row"), *[F.col(c).alias(f"o_{c}") for c in coming])
    return key_join(sent, base, [*by, "_row"])


def _numbered(rows: DataFrame, by: Sequence[str], ids: Sequence[str], seed: int) -> DataFrame:
    """Rows with a number ``_row`` inside their group and the group's size ``_n``, staged."""
    placed = draw_positions(rows, by, md5_draw(F.lit(seed), *ids), out="_row", tie=ids)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return stage(key_join(placed, sizes, by))


def linear_drops(rows: DataFrame, by: Sequence[str], features: Sequence[str], ids: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """Drop in AUC per group, feature and repeat for linear scores.

    ``rows`` has y_true, the margin ``_m`` and the parts ``_c`` that the features
    add to it. A shuffled feature exchanges one part of the margin; all features
    of a repeat share its shuffle, and the exchanged margins are formed after it.
    """
    by = list(by)
    base = _numbered(rows, by, ids, seed).drop(*[c for c in ids if c not in by])
    auc = exchanged_auc(base, _shuffled(base, by, repeats, seed), by)
    whole = curve_metrics(base.withColumn("y_score", F.col("_m")), by).select(*by, F.col("roc_auc").alias("_whole"))
    feature = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_f") + 1)
    return key_join(auc, whole, by).select(
        *by, feature.alias("feature"), "repeat", (F.col("_whole") - F.col("roc_auc")).alias("auc_drop"))


def permutation_importance(model, test: DataFrame, label: str, ids: Sequence[str], repeats: int = 5,
                           seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Drop in test AUC when one feature is shuffled inside its group, per feature and repeat.

    Linear models exchange parts of the margin; other models score rows with
    one value exchanged.
    """
    by, ids, fs = list(by), list(ids), model.features
    y = F.col(label).cast("int").alias("y_true")
    if isinstance(model, LinearModel):
        parts = F.array(*[F.lit(b) * ((model.filled(f) - m) / s) for f, m, s, b in zip(fs, model.means, model.scales, model.coefficients)])
        rows = test.select(*dict.fromkeys([*by, *ids]), y, parts.alias("_c"))
        rows = rows.withColumn("_m", F.lit(model.intercept) + F.aggregate("_c", F.lit(0.0), lambda s, c: s + c))
        return linear_drops(rows, by, fs, ids, repeats, seed)
    base = _numbered(test.select(*dict.fromkeys([*by, *ids]), y, *[F.col(f).cast("double").alias(f) for f in fs]), by, ids, seed)
    pairs = _shuffled(base, by, repeats, seed).withColumn("feature", F.explode(F.array(*[F.lit(f) for f in fs])))
    moved = pairs.select(*by, "feature", "repeat", "y_true", *[
        F.when(F.col("feature") == f, F.col(f"o_{f}")).otherwise(F.col(f)).alias(f) for f in fs])
    auc = curve_metrics(model.transform(moved), [*by, "feature", "repeat"]).select(*by, "feature", "repeat", "roc_auc")
    whole = curve_metrics(model.transform(base), by).select(*by, F.col("roc_auc").alias("_whole"))
    return key_join(auc, whole, by).select(*by, "feature", "repeat", (F.col("_whole") - F.col("roc_auc")).alias("auc_drop"))


def importance_runs(df: DataFrame, features: Sequence[str], splits: DataFrame, group: str, label: str, ids: Sequence[str],
                    repeats: int = 10, seed: int = 42) -> DataFrame:
    """Permutation importance of every feature on the test rows of every run, from logistic regressions fitted together."""
    splits = stage(splits)
    runs = [r[0] for r in splits.select("run").distinct().orderBy("run").collect()]
    number = F.array_position(F.array(*[F.lit(r) for r in runs]), F.col("run")).cast("int") - 1
    roles = splits.select(number.alias("no"), group, (1 - F.col("is_test")).alias("is_train"), F.col("is_test").alias("is_score"))
    table = SplitTable(df, features, label, group, roles, len(runs), ids)
    usable = table.usable(score=True)
    fitted = table.fit({"": list(features)}, usable)
    parts = stage(table.margin_parts({s: f for (s, _), f in fitted.items()}))
    drops = linear_drops(parts, ["no"], features, ids, repeats, seed)
    run_of = F.element_at(F.array(*[F.lit(r) for r in runs]), F.col("no") + 1)
    return drops.groupBy("no", "feature").agg(
        F.avg("auc_drop").alias("permutation_importance"), F.stddev_pop("auc_drop").alias("permutation_repeat_std")).select(
        run_of.alias("run"), "feature", "permutation_importance", "permutation_repeat_std")


def importance_of(drops: DataFrame) -> DataFrame:
    """Mean and population deviation of the drops over the repeats."""
    return drops.groupBy("feature").agg(
        F.avg("auc_drop").alias("permutation_importance"), F.stddev_pop("auc_drop").alias("permutation_repeat_std"))


def coefficients(spark, fits: Sequence[tuple]) -> DataFrame:
    """Coefficients of every linear fit, scaled and in raw units."""
    rows = [
        (run, s, f, float(b), float(b / sc))
        for run, s, _, m in fits if isinstance(m, LinearModel)
        for f, b, sc in zip(m.features, m.coefficients, m.scales)
    ]
    out = spark.createDataFrame(rows, "run int, feature_set string, feature string, coefficient double, raw_coefficient double")
    return out.withColumns({
        "abs_coefficient": F.abs("coefficient"),
        "direction": F.when(F.col("coefficient") > 0, "positive").when(F.col("coefficient") < 0, "negative").otherwise("zero"),
    })


def impurity_importance(spark, fits: Sequence[tuple]) -> DataFrame:
    """Impurity importances of every forest fit."""
    rows = [
        (run, s, f, float(v)) for run, s, _, m in fits if isinstance(m, ForestModel)
        for f, v in zip(m.features, m.model.featureImportances.toArray())
    ]
    return spark.createDataFrame(rows, "run int, feature_set string, feature string, importance double")


def interaction_test(df: DataFrame, features: Sequence[str], column: str, values: Sequence[str], splits: DataFrame,
                     group: str, label: str, replicates: int = 10_000) -> DataFrame:
    """Additive against interaction model over the same runs (AUC deltas and tests)."""
    from .stats import paired_delta

    made = interactions(one_hot(df, column, values, drop_first=True), features, column, values, values[0])
    dummies = [f"{column}_{v}" for v in values[1:]]
    cross = [f"{column}_{v}__x__{f}" for v in values[1:] for f in features]
    sets = {"additive": [*features, *dummies], "interaction": [*features, *dummies, *cross]}
    m = evaluate_sets(made, sets, LR, splits, group, label)
    return paired_delta(m, ["run"], "feature_set", "interaction", "additive", ["roc_auc", "pr_auc"], replicates)


def auc_per_group(preds: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """ROC-AUC and average precision of predictions within each group."""
    return curve_metrics(preds, [*keys, column])


def oof_scores(train: DataFrame, features: Sequence[str], label: str, group: str, k: int = 5, seed: int = 42,
               keep: Sequence[str] = ()) -> DataFrame:
    """Out-of-fold scores of the training rows under grouped folds; all folds are fitted together."""
    folds = group_folds(train, group, label, k, seed).select(group, "fold")
    no = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("no")
    roles = folds.select(group, "fold", no).withColumns(
        {"is_train": (F.col("no") != F.col("fold")).cast("int"), "is_score": (F.col("no") == F.col("fold")).cast("int")})
    table = SplitTable(train, features, label, group, roles, k, keep)
    usable = table.usable(score=False)
    if len(usable) < k:
        raise ValueError(f"fold {min(set(range(k)) - set(usable))} leaves a single class for training")
    scored = table.scored(table.fit({"": list(features)}, usable))
    return scored.select(group, F.col("no").alias("fold"), *[c for c in keep if c != group], "y_true", "y_score")


def triage_runs(df: DataFrame, features: Sequence[str], label: str, group: str, ids: Sequence[str], runs: int = 30,
                seed: int = 42, folds: int = 5) -> DataFrame:
    """Every review policy per run; recall thresholds come from inner folds of the training rows.

    The runs and the folds inside them are splits of one table and are fitted
    together: number run * (folds + 1) is the run, the next ones are its folds.
    Runs with a single class on either side or in the training rows of a fold
    are left out.
    """
    from .triage import RECALL_TARGETS, policy_metrics, threshold_for_recall

    splits = stage(group_splits(df, group, runs, 0.2, seed))
    first = (F.col("run") - 1) * (folds + 1)
    outer = splits.select(first.alias("no"), group, (1 - F.col("is_test")).alias("is_train"), F.col("is_test").alias("is_score"))
    inner = run_folds(df, splits.where("is_test = 0"), group, label, folds).select(
        group, "fold", "run", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("k")).select(
        (first + 1 + F.col("k")).alias("no"), group, (F.col("k") != F.col("fold")).cast("int").alias("is_train"),
        (F.col("k") == F.col("fold")).cast("int").alias("is_score"))
    table = SplitTable(df, features, label, group, outer.unionByName(inner), runs * (folds + 1), ids)
    trained, scored = set(table.usable(score=False)), set(table.usable(score=True))
    usable = [r * (folds + 1) for r in range(runs)]
    usable = [s for s in usable if s in scored and all(s + 1 + k in trained for k in range(folds))]
    if not usable:
        raise ValueError("no run has both classes everywhere")
    fitted = table.fit({"": list(features)}, [s + k for s in usable for k in range(folds + 1)])
    rows = stage(table.scored(fitted).select(
        (F.floor(F.col("no") / (folds + 1)) + 1).cast("int").alias("run"), (F.col("no") % (folds + 1)).alias("_k"), *ids, "y_true", "y_score"))
    limits = threshold_for_recall(rows.where("_k > 0"), ["run"], "y_true", "y_score", RECALL_TARGETS)
    return policy_metrics(rows.where("_k = 0").drop("_k"), ["run"], "y_true", "y_score", ids, limits)


def linear_attribution(model: LinearModel, df: DataFrame, ids: Sequence[str], rows: int | None = None, seed: int = 42) -> DataFrame:
    """Attribution coefficient * (x - mean) per row and feature, in scaled units.

    ``rows`` keeps a drawn sample for the beeswarm table.
    """
    ids = list(ids)
    if rows is not None:
        df = draw_positions(df, [], md5_draw(F.lit(seed), *ids), keep=rows, out="_p", tie=ids)
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), model.filled(f).alias("value"),
                 (F.lit(b) * ((model.filled(f) - m) / s)).alias("attribution"))
        for f, m, s, b in zip(model.features, model.means, model.scales, model.coefficients)
    ])
    return df.select(*ids, F.explode(cells).alias("_c")).select(*ids, "_c.*")


def patch_features(diffs: DataFrame, features: DataFrame, key: str, patch: str) -> DataFrame:
    """Diff text and cached case features to the model's input columns."""
    from ..functions.diffs import diff_metrics
    from ..functions.ratios import derived_ratios, size_class

    d = diff_metrics(diffs, patch, "union").drop(patch).join(features, key)
    return derived_ratios(d, "plus1").withColumn("prompt_size_category", size_class("prompt_chars"))


def batch_score(model: LinearModel, diffs: DataFrame, features: DataFrame, key: str, patch: str) -> DataFrame:
    """Score every changed unit from its diff text and cached features."""
    scored = model.transform(patch_features(diffs, features, key, patch))
    return scored.select(key, "y_score", "y_pred")
