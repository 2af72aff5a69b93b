"""De-duplication, seeded samples, permutations and interval merging."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.draws import md5_draw
from .keys import key_join
from .ranks import bucketed, draw_positions, positions, value_bounds
from .staging import stage

# Order of context states, best first.
CONTEXT_QUALITY = {
    "BEFORE_AFTER_DIFF_MAPPED": 5, "BEFORE_AFTER_DIFF": 4, "BEFORE_AFTER_MAPPED": 3,
    "BEFORE_AFTER": 2, "AFTER_DIFF": 1,
}


def context_quality(status) -> Column:
    c = F.col(status) if isinstance(status, str) else status
    out = F.lit(0)
    for name, rank in CONTEXT_QUALITY.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key under a total order.

    A minimum over structs is combined before the shuffle, so a hot key costs
    one row per task and not a sort of its group.
    """
    rest = [c for c in df.columns if c not in set(keys)]
    rank = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def sample_per_group(df: DataFrame, group: Sequence[str], n: int, seed, key: Sequence[str]) -> DataFrame:
    """Up to ``n`` rows per group, chosen by a seeded draw of the row key."""
    return draw_positions(df, group, md5_draw(F.lit(seed), *key), keep=n, out="draw_place", tie=key)


def round_robin_sample(df: DataFrame, stratum: str, n: int, seed, key: Sequence[str]) -> DataFrame:
    """Visit the strata in turn, one drawn item each, until ``n`` items are taken."""
    drawn = draw_positions(df, [stratum], md5_draw(F.lit(seed), *key), keep=n, out="round", tie=key)
    return drawn.orderBy("round", stratum).limit(n)


def shuffle_ids(df: DataFrame, seed, key: Sequence[str], prefix: str = "RV", out: str = "review_id") -> DataFrame:
    """Seeded permutation; every row gets its running id."""
    placed = draw_positions(df, [], md5_draw(F.lit(seed), *key), out="_p", tie=key)
    number = F.col("_p").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return placed.withColumn(out, F.concat(F.lit(prefix), padded)).drop("_p")


def blind(df: DataFrame, key: str, shown: Sequence[str], raters: Sequence[str] = ("reviewer_1", "reviewer_2")):
    """The blinded table with empty rating columns, and the key table."""
    ratings = [f"{r}_{f}" for r in raters
               for f in ("validity", "patch_attribution", "confidence_1_to_5", "notes")]
    ratings += ["adjudicated_validity", "adjudicated_patch_attribution", "adjudication_notes"]
    review = df.select(key, *shown, *[F.lit("").alias(c) for c in ratings])
    return review, df.select(key, *[c for c in df.columns if c != key])


def review_sample(findings: DataFrame, size: int, seed, key: Sequence[str],
                  equivalence: str = "equivalence_key", status: str = "context_status") -> DataFrame:
    """All new findings, filled up to ``size`` with stratified distinct controls."""
    findings = stage(findings)
    new = findings.where(F.col("is_new_finding") == 1)
    controls = dedupe(
        findings.where(F.col("is_new_finding") != 1), [equivalence],
        [-context_quality(status), md5_draw(F.lit(seed), *key), *[F.col(k) for k in key]],
    )
    stratum = F.concat_ws(" | ", "test_id", F.upper("severity"))
    room = max(0, size - new.count())
    taken = round_robin_sample(controls.withColumn("_stratum", stratum), "_stratum", room, seed, key)
    return new.withColumn("sample_group", F.lit("ALL_NEW_FINDINGS")).unionByName(
        taken.drop("round", "_stratum").withColumn("sample_group", F.lit("STRATIFIED_DEDUP_CONTROL"))
    )


def top_fraction(df: DataFrame, by: Sequence[str], score: str, fraction: float, tie: Sequence[str]) -> DataFrame:
    """The max(1, ceil(n * fraction)) best scores of every run.

    Rows are not ranked: counts per range of scores tell in which range the cut
    of each group lies. All above it are taken, and only the rows of the range
    that holds the cut are put in order.
    """
    by = list(by)
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    rows = bucketed(rows, score, value_bounds(rows, score))
    head = W.partitionBy(*(by or [F.lit(0)]))
    cells = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c")).select(
        *by, "_b", "_c", F.sum("_c").over(head).alias("_n"),
        F.coalesce(F.sum("_c").over(head.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    need = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(float(fraction)))) - F.col("_above")
    cut = cells.withColumn("_need", need).where((F.col("_need") > 0) & (F.col("_need") <= F.col("_c")))
    tagged = key_join(rows, stage(cut.select(*by, F.col("_b").alias("_cut"), "_need")), by)
    edge = positions(tagged.where("_b = _cut"), by, score, tie, descending=True, out="_p").where("_p <= _need").drop("_p")
    return tagged.where("_b > _cut").unionByName(edge).drop("_b", "_cut", "_need")


def rankings(long: DataFrame, metric: str, member: str, value: str) -> DataFrame:
    """Members per metric from high to low, with sequential ranks (one row per member)."""
    order = W.partitionBy(metric).orderBy(F.desc(value), member)
    return long.select(metric, member, value).withColumn("rank_desc", F.row_number().over(order))


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or adjacent inclusive integer intervals.

    Runs over range buckets of the start, with the reach and the number of
    islands of earlier buckets added, so one hot key is not sorted in one task.
    """
    keys = list(keys)
    # One row per start: a start that many rows share costs one.
    rows = stage(df.groupBy(*keys, start).agg(F.max(end).alias(end), F.count(F.lit(1)).alias("_n")))
    rows = bucketed(rows, start, value_bounds(rows, start))
    prior = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    reach = rows.groupBy(*keys, "_b").agg(F.max(end).alias("_m")).select(
        *keys, "_b", F.max("_m").over(prior).alias("_reach")
    )
    local = W.partitionBy(*keys, "_b").orderBy(start)
    seen = F.greatest(F.max(end).over(local.rowsBetween(W.unboundedPreceding, -1)), F.col("_reach"))
    rows = key_join(rows, reach, [*keys, "_b"]).withColumn("_seen", seen)
    rows = rows.withColumn("_new", (F.col("_seen").isNull() | (F.col(start) > F.col("_seen") + 1)).cast("int"))
    base = rows.groupBy(*keys, "_b").agg(F.sum("_new").alias("_k")).select(
        *keys, "_b", F.coalesce(F.sum("_k").over(prior), F.lit(0)).alias("_base")
    )
    running = F.sum("_new").over(local.rowsBetween(W.unboundedPreceding, 0))
    return key_join(rows, base, [*keys, "_b"]).withColumn("island", F.col("_base") + running).groupBy(
        *keys, "island"
    ).agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("merged"))
