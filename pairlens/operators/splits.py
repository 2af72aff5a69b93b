"""Grouped splits and folds, and preprocessing fitted on training rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import md5_draw
from .keys import key_join
from .ranks import draw_positions, positions
from .stats import median_fill


def group_splits(df: DataFrame, group: str, runs: int = 30, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """(run, seed, group, is_test): ceil(fraction * groups) whole groups are tested per run."""
    groups = df.select(group).distinct()
    n = groups.agg(F.count(F.lit(1))).scalar()
    tries = groups.select(
        group, F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")
    ).withColumn("seed", (F.col("run") + (seed - 1)).cast("int"))
    placed = draw_positions(tries, ["run"], md5_draw("seed", group), out="_p", tie=[group])
    return placed.select(
        "run", "seed", group, (F.col("_p") <= F.ceil(F.lit(float(fraction)) * n)).cast("int").alias("is_test")
    )


def leaked_groups(splits: DataFrame, group: str) -> DataFrame:
    """Groups found on both sides of a run (empty for a sound split)."""
    return splits.groupBy("run", group).agg(
        F.count_distinct("is_test").alias("_k")).where("_k > 1").drop("_k")


def _dealt(groups: DataFrame, by: Sequence[str], group: str, k: int, seed: Column) -> DataFrame:
    """``groups`` with their fold: dealt in snake order from the most ``positives`` down."""
    g = groups.withColumn("_tag", F.concat_ws("|", seed.cast("string"), F.col(group).cast("string")))
    placed = positions(g, by, "positives", ["_tag"], descending=True, out="_p")
    p = F.col("_p") - 1
    block, j = F.floor(p / k), p % k
    return placed.withColumn("fold", F.when(block % 2 == 0, j).otherwise(k - 1 - j).cast("int")).drop("_tag", "_p")


def _positives(df: DataFrame, group: str, y: str) -> DataFrame:
    return df.groupBy(group).agg(F.sum(F.col(y).cast("long")).alias("positives"))


def group_folds(df: DataFrame, group: str, y: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold of each group: dealt in snake order from the most positives down."""
    return _dealt(_positives(df, group, y), [], group, k, F.lit(seed)).select(group, "positives", "fold")


def run_folds(df: DataFrame, runs: DataFrame, group: str, y: str, k: int = 5) -> DataFrame:
    """(run, group, fold): ``group_folds`` of the groups of every run with the run's seed, from one count per group."""
    listed = key_join(runs.select("run", "seed", group), _positives(df, group, y), [group])
    return _dealt(listed, ["run"], group, k, F.col("seed")).select("run", group, "fold")


def train_median_impute(df: DataFrame, columns: Sequence[str], train: Column | None = None) -> DataFrame:
    """Nulls filled with medians of the training rows, then zero."""
    return median_fill(df, columns, train)


def scale(df: DataFrame, columns: Sequence[str], train: Column | None = None, kind: str = "standard") -> DataFrame:
    """Standard (population deviation) or min-max scaling fitted on training rows."""
    rows = df if train is None else df.where(train)
    c = {x: F.col(x).cast("double") for x in columns}
    if kind == "standard":
        fit = rows.agg(F.struct(*[F.avg(v).alias(f"a_{x}") for x, v in c.items()],
                                *[F.stddev_pop(v).alias(f"b_{x}") for x, v in c.items()])).scalar()
        spread = {x: F.when(fit[f"b_{x}"] > 0, fit[f"b_{x}"]).otherwise(1.0) for x in columns}
    else:
        fit = rows.agg(F.struct(*[F.min(v).alias(f"a_{x}") for x, v in c.items()],
                                *[F.max(v).alias(f"b_{x}") for x, v in c.items()])).scalar()
        spread = {x: F.when(fit[f"b_{x}"] > fit[f"a_{x}"], fit[f"b_{x}"] - fit[f"a_{x}"]).otherwise(1.0)
                  for x in columns}
    return df.withColumns({x: (c[x] - fit[f"a_{x}"]) / spread[x] for x in columns})
