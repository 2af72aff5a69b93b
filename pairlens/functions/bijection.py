"""A keyed permutation of row numbers as a column expression.

Shuffling rows then means computing an index instead of sorting draws. A number
below n is written with two digits of a mixed radix, a * b >= n with a and b
near the root of n. Feistel rounds add a hash of one digit to the other, which
can be undone, so the rounds permute the a * b numbers. A number that lands at
n or above is sent on until it is below (cycle walking); fewer than one in b
numbers need that.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .draws import md5_draw

ROUNDS = 4
#: Steps of the walk. A walk has a * b - n < a steps at most, and one in b numbers goes on after each.
WALK = 24


def _radix(n: Column) -> tuple[Column, Column]:
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double")))).cast("long")
    return a, F.greatest(F.lit(1), F.ceil(n / a)).cast("long")


def _rounds(x: Column, key: Column, a: Column, b: Column) -> Column:
    def one(s: Column, k: Column) -> Column:
        left = F.struct(F.pmod(s["l"] + md5_draw(key, k, s["r"]), a).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + md5_draw(key, k, s["l"]), b).alias("r"))
        return F.when(k % 2 == 0, left).otherwise(right)

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one, lambda s: s["l"] * b + s["r"])


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Where the permutation of 0 .. n-1 named by ``key`` (a string) sends ``x``."""
    a, b = _radix(n)
    steps = F.slice(F.sequence(F.lit(0), F.lit(WALK)), F.lit(1), F.least(a * b - n, F.lit(WALK)).cast("int"))
    first = _rounds(x.cast("long"), key, a, b)
    return F.aggregate(steps, first, lambda y, _: F.when(y < n, y).otherwise(_rounds(y, key, a, b)))
