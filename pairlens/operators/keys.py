"""Joins that keep null keys: two nulls are one group, as in a grouping."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on equal or both-null ``keys``, which come out once.

    Spark splits a hot key of such a join as it does for plain equality. For
    inner and left joins; without keys, ``right`` must be a single row.
    """
    keys = list(keys)
    if not keys:
        return left.join(F.broadcast(right), how=how)
    names = {k: f"_k{i}_{k}" for i, k in enumerate(keys)}
    side = right.withColumnsRenamed(names)
    on = None
    for k, name in names.items():
        same = left[k].eqNullSafe(side[name])
        on = same if on is None else on & same
    return left.join(side, on, how).drop(*names.values())
