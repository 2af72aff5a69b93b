"""Input contracts: required columns, unique keys, constant groups, disjoint sets."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


class ContractError(ValueError):
    """An input does not have the shape an operator needs."""


def violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") != 1)


def require(
    df: DataFrame,
    columns: Sequence[str] = (),
    unique: Sequence[str] = (),
    rows: int | None = None,
    forbidden: Sequence[str] = (),
) -> DataFrame:
    """The input itself, or ContractError naming what is wrong."""
    have = set(df.columns)
    missing = [c for c in columns if c not in have]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    illegal = sorted(have & set(forbidden))
    if illegal:
        raise ContractError(f"forbidden columns: {illegal}")
    if unique:
        bad = violations(df, unique).take(5)
        if bad:
            raise ContractError(f"keys {list(unique)} are not unique, e.g. {bad}")
    if rows is not None:
        seen = df.count()
        if seen != rows:
            raise ContractError(f"expected {rows} rows, found {seen}")
    return df


def inconsistent(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per column the number of keys whose value is not constant."""
    g = df.groupBy(key).agg(
        *[(~F.min(c).eqNullSafe(F.max(c))).cast("int").alias(c) for c in columns],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad")) for c in columns])
    return (
        g.select(F.explode(pairs).alias("p"))
        .groupBy(F.col("p.column").alias("column"))
        .agg(F.sum("p.bad").cast("long").alias("inconsistent_keys"))
    )


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that leak from one side to the other."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
