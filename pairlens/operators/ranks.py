"""Distributed ranks, quantiles and positions.

A window without partition keys, or over one hot key, sends everything to one
task. Here rows are first combined per distinct value, which removes hot values
and reads the input once. The distinct values are then cut into range buckets
whose bounds are literals in the plan, so every recomputation after a lost
executor cuts the same way. Ranks are local to (key, bucket) and shifted by the
bucket's prefix count.
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.draws import md5_hex
from .keys import key_join
from .staging import stage


def bucket_count(df: DataFrame) -> int:
    """Range buckets of an input: as many as shuffles have partitions, which a cluster sets by its size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def value_bounds(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Approximate equi-depth cut points of ``value`` from one sketch (few numbers come back)."""
    buckets = buckets or bucket_count(df)
    if buckets == 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.select(F.col(value).cast("double").alias("v")).approxQuantile(
        "v", probs, 1.0 / (4 * buckets)
    )
    return sorted(set(cuts))


def bucketed(df: DataFrame, value: str, bounds: Sequence[float], out: str = "_b") -> DataFrame:
    """``df`` with the index of the range bucket of ``value``: the number of bounds that are not above it.

    Every row searches the bounds by halves, since there are as many of them as
    shuffles have partitions. Nulls are in the first bucket, NaN in the last.
    """
    cuts = sorted({float(b) + 0.0 for b in bounds if math.isfinite(b)})
    if not cuts:
        return df.withColumn(out, F.lit(0))
    # -0.0 equals 0.0 in every comparison here, but not in the search.
    rows = df.withColumn("_at_bound", F.col(value).cast("double") + F.lit(0.0))
    placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_at_bound", outputCol=out, handleInvalid="keep").transform(rows)
    place = F.least(F.coalesce(F.col(out).cast("int"), F.lit(0)), F.lit(len(cuts)))
    return placed.withColumn(out, place).drop("_at_bound")


def ranked(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    sums: Sequence[str] = (),
    weight: str | None = None,
    bounds: Sequence[float] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """One row per distinct (by, value) with its place in the ascending order.

    Adds ``n`` rows at the value, ``below`` rows strictly under it, ``total``
    rows of the group, ``avg_rank`` for ties, and for every column in ``sums``
    its sum at the value, below it (``<c>_below``) and in total (``<c>_total``).
    Null and NaN values are left out; null keys are groups like others.
    """
    by = list(by)
    unit = F.col(weight) if weight else F.lit(1)
    g = stage(present(df, value).groupBy(*by, value).agg(
        F.sum(unit).cast("long").alias("n"), *[F.sum(s).alias(s) for s in sums]
    ))
    return placed(g, by, value, sums, bounds, buckets)


def present(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is neither null nor NaN."""
    rows = df.where(F.col(value).isNotNull())
    return rows.where(~F.isnan(value)) if df.schema[value].dataType.typeName() in ("double", "float") else rows


def placed(
    g: DataFrame,
    by: Sequence[str],
    value: str,
    sums: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``ranked`` of a staged table that has one row per (by, value) with ``n`` and ``sums``, and no missing values."""
    by = list(by)
    if bounds is None:
        bounds = value_bounds(g, value, buckets)
    g = bucketed(g, value, bounds)
    counted = ["n", *sums]
    inside = W.partitionBy(*by, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = [F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in counted]
    head = by or [F.lit(0)]
    prior = W.partitionBy(*head).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*head)
    offsets = g.groupBy(*by, "_b").agg(*[F.sum(c).alias(c) for c in counted]).select(
        *by,
        "_b",
        *[F.coalesce(F.sum(c).over(prior), F.lit(0)).alias(f"_off_{c}") for c in counted],
        *[F.sum(c).over(whole).alias(f"_all_{c}") for c in counted],
    )
    out = key_join(g.select("*", *local), offsets, [*by, "_b"])
    return out.select(
        *by,
        value,
        "_b",
        "n",
        (F.col("_in_n") + F.col("_off_n")).cast("long").alias("below"),
        F.col("_all_n").cast("long").alias("total"),
        (F.col("_in_n") + F.col("_off_n") + (F.col("n") + 1) / 2.0).alias("avg_rank"),
        *[F.col(s) for s in sums],
        *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"{s}_below") for s in sums],
        *[F.col(f"_all_{s}").alias(f"{s}_total") for s in sums],
    )


def avg_rank(df: DataFrame, by: Sequence[str], value: str, out: str = "rank", **kw) -> DataFrame:
    """Every row with the average rank of its value inside its group."""
    ranks = ranked(df, by, value, **kw).select(*by, value, F.col("avg_rank").alias(out))
    return key_join(df, ranks, [*by, value], "left")


def quantiles_of(table: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated exact quantiles from a ``ranked`` table."""
    v, below, n = F.col(value).cast("double"), F.col("below"), F.col("n")
    aggs = [F.max("total").alias("count")]
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("total") - 1)
        for tag, pos in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (below <= pos) & (pos < below + n)
            aggs.append(F.max(F.when(hit, v)).alias(f"_{name}_{tag}"))
    out = table.groupBy(*by).agg(*aggs)
    cols = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("count") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return out.select(*by, "count", *cols)


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], **kw) -> DataFrame:
    """Exact quantiles per group at any size; columns are named by ``probs``."""
    return quantiles_of(ranked(df, by, value, **kw), by, value, probs)


def positions(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    tie: Sequence[str],
    descending: bool = False,
    out: str = "position",
    **kw,
) -> DataFrame:
    """1-based place of every row inside its group, ordered by (value, md5 of tie).

    Ties are spread over the 256 md5 prefixes, so neither a hot group nor a hot
    value ends in one task.
    """
    by = list(by)
    rows = df.withColumn("_h", md5_hex(*tie)).withColumn("_hp", F.substring("_h", 1, 2))
    cells = stage(rows.groupBy(*by, value, "_hp").agg(F.count(F.lit(1)).alias("_c")))
    table = ranked(cells, by, value, weight="_c", **kw)
    first = F.col("total") - F.col("below") - F.col("n") if descending else F.col("below")
    table = table.select(*by, value, first.alias("_first"))
    prior = W.partitionBy(*by, value).orderBy("_hp").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(
        *by, value, "_hp", F.coalesce(F.sum("_c").over(prior), F.lit(0)).alias("_tie")
    )
    cells = key_join(cells, table, [*by, value])
    local = W.partitionBy(*by, value, "_hp").orderBy("_h", *tie)
    return (
        key_join(rows, cells, [*by, value, "_hp"])
        .withColumn(
            out,
            (F.col("_first") + F.col("_tie") + F.row_number().over(local)).cast("long"),
        )
        .drop("_h", "_hp", "_first", "_tie")
    )


def draw_positions(
    df: DataFrame,
    by: Sequence[str],
    draw: Column,
    keep: int | Column | None = None,
    out: str = "position",
    tie: Sequence[str] = (),
) -> DataFrame:
    """1-based place of every row in the order of a uniform 32-bit draw.

    The draw is uniform, so its high bits are equi-depth buckets without any
    sampling. With ``keep`` only buckets that can hold the first ``keep`` rows
    are sorted at all.
    """
    by = list(by)
    rows = df.withColumn("_d", draw).withColumn("_b", F.shiftright("_d", 20).cast("int"))
    head = by or [F.lit(0)]
    prior = W.partitionBy(*head).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    cells = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c")).select(
        *by, "_b", F.coalesce(F.sum("_c").over(prior), F.lit(0)).alias("_off")
    )
    if keep is not None:
        keep_col = keep if isinstance(keep, Column) else F.lit(keep)
        cells = cells.where(F.col("_off") < keep_col)
    local = W.partitionBy(*by, "_b").orderBy("_d", *tie)
    placed = key_join(rows, cells, [*by, "_b"]).withColumn(
        out, (F.col("_off") + F.row_number().over(local)).cast("long")
    )
    if keep is not None:
        placed = placed.where(F.col(out) <= keep_col)
    return placed.drop("_d", "_b", "_off")
