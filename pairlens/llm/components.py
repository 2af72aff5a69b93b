"""Connected components over links between integers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _is_stars(e: DataFrame) -> bool:
    """Each a has one b, and no b is an a."""
    many = e.groupBy("a").count().where("count > 1").select("a")
    chained = e.select(F.col("b").alias("a")).distinct().join(e.select("a"), "a", "left_semi")
    return many.unionAll(chained).isEmpty()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every linked node but the roots.

    Alternating large and small stars; every round is written to the shared
    folder, so that lineage stays short and a lost executor costs one round.
    Stars shrink logarithmically; minima are combined before the shuffle.
    """
    e = links.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct()
    e = stage(e)
    while not _is_stars(e):
        e = stage(_small_star(_large_star(e)))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
