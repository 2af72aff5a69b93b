"""Enrichment, reconciliation and lookup joins."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..sources.contracts import ContractError, violations


def enrich_by_case(facts: DataFrame, features: DataFrame, key: str = "case", check: bool = True) -> DataFrame:
    """Many-to-one enrichment; ``features`` must have one row per key."""
    if check and violations(features, [key]).take(1):
        raise ContractError(f"{key} is not unique among the features")
    return facts.join(features, key, "left")


def reconcile(frozen: DataFrame, recomputed: DataFrame, keys: Sequence[str], features: Sequence[str],
              tolerance: float = 1e-9) -> DataFrame:
    """Per feature the number and rate of rows where both tables agree."""
    keys = list(keys)
    a = frozen.select(*keys, *[F.col(f).cast("double").alias(f"a_{f}") for f in features])
    b = recomputed.select(*keys, *[F.col(f).cast("double").alias(f"b_{f}") for f in features])
    j = a.join(b, keys)
    sums = j.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) <= tolerance).alias(f"m_{f}") for f in features
    ])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("n").alias("n"),
                              F.col(f"m_{f}").alias("n_exact_match")) for f in features])
    out = sums.select(F.explode(rows).alias("_r")).select("_r.*")
    return out.withColumn("exact_match_rate", F.try_divide("n_exact_match", "n"))


def first_available(keys: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: Sequence[str],
                    text: str = "text") -> DataFrame:
    """Text of each key from the first source that has one, and that source's name."""
    key = list(key)
    union = None
    for rank, (name, df) in enumerate(sources):
        part = df.where(F.coalesce(text, F.lit("")) != "").select(
            *key, F.lit(rank).alias("_rank"), F.lit(name).alias("text_source"), F.col(text).alias("text")
        )
        union = part if union is None else union.unionByName(part)
    best = union.groupBy(*key).agg(F.min(F.struct("_rank", "text_source", "text")).alias("_b"))
    out = keys.select(*key).distinct().join(best, key, "left")
    return out.select(*key, F.coalesce("_b.text_source", F.lit("")).alias("text_source"),
                      F.coalesce("_b.text", F.lit("")).alias("text"))


def backfill(df: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fill missing columns or null values from a lookup by row id."""
    have = set(df.columns)
    side = lookup.select(key, *[F.col(c).alias(f"_l_{c}") for c in columns])
    out = df.join(side, key, "left").withColumns({
        c: F.coalesce(F.col(c), F.col(f"_l_{c}")) if c in have else F.col(f"_l_{c}") for c in columns
    })
    return out.drop(*[f"_l_{c}" for c in columns])


def pending_work(inputs: DataFrame, log: DataFrame, key: Sequence[str], text: str, version: str) -> DataFrame:
    """Inputs to run again: no success, another version, or other content.

    ``log`` has success, protocol_version, recorded_sha256 and recorded_chars;
    the recorded length decides when no hash was recorded.
    """
    key = list(key)
    now = inputs.withColumn("_sha", F.sha2(F.col(text), 256)).withColumn("_len", F.length(text))
    j = now.join(log, key, "left")
    same = F.when(
        F.coalesce("recorded_sha256", F.lit("")) != "", F.col("recorded_sha256") == F.col("_sha")
    ).otherwise(F.col("recorded_chars").eqNullSafe(F.col("_len")))
    done = (
        F.coalesce(F.col("success"), F.lit(False)) & F.col("protocol_version").eqNullSafe(F.lit(version))
        & F.coalesce(same, F.lit(False))
    )
    reason = (
        F.when(F.col("success").isNull(), "never_run").when(~F.col("success"), "failed")
        .when(~F.col("protocol_version").eqNullSafe(F.lit(version)), "other_version").otherwise("content_changed")
    )
    return j.where(~done).select(*key, reason.alias("reason"))


def flatten_phases(before: DataFrame, after: DataFrame) -> DataFrame:
    """BEFORE and AFTER in one table with a phase; absent columns become null."""
    return before.withColumn("phase", F.lit("before")).unionByName(
        after.withColumn("phase", F.lit("after")), allowMissingColumns=True
    )


def missing_keys(wanted: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested keys that are not available."""
    return wanted.select(*keys).distinct().join(available.select(*keys).distinct(), list(keys), "left_anti")
