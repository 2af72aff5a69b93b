"""Sharding by proportional stratified interleaving.

Rows are ranked in seeded random order within their source; the fractional rank
``(rank + 1/2) / rows of the source`` orders all rows, so that every stretch of
the order holds each source in proportion. Equal cuts of it are the shards.
Neither rank needs a source or the table in one task: rows are dealt into
buckets by their draw (or fraction), ranked inside a bucket, and shifted by the
rows of the buckets before.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import stage
from .common import GROUP_ROWS

SHARDS = 16


def offsets(counts: DataFrame, keys: list[str], bucket: str, span: int = 1024) -> DataFrame:
    """``counts`` (keys, bucket, n) with ``before`` and ``total``: the rows of the buckets before and of all, within ``keys``.

    Two levels: windows see ``span`` buckets, or the sums of ``span`` buckets.
    """
    block = (F.col(bucket) / span).cast("long")
    inner = Window.partitionBy(*keys, "block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = counts.withColumn("block", block)
    sums = at.groupBy(*keys, "block").agg(F.sum("n").alias("m")).withColumns({
        "base": F.coalesce(F.sum("m").over(outer), F.lit(0)), "total": F.sum("m").over(Window.partitionBy(*keys))})
    return (at.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0)))
            .join(sums.select(*keys, "block", "base", "total"), [*keys, "block"])
            .select(*keys, bucket, (F.col("base") + F.col("within")).alias("before"), "total"))


def placed(rows: DataFrame, keys: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """``rows`` with their position in ``keys``, by ``bucket`` and then ``order``, and the ``total`` of their keys.

    Rows meet these numbers by key and bucket, so that a hot key stays dealt out.
    """
    before = offsets(rows.groupBy(*keys, bucket).agg(F.count("*").alias("n")), keys, bucket)
    inside = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1
    return (rows.withColumn("inside", inside).join(before, [*keys, bucket])
            .withColumn(out, (F.col("inside") + F.col("before")).cast("long")).drop("inside", "before"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 7, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, source, shard and slot of every row of ``docs`` (doc_id, text, source).

    Counts of shards differ by one at most, and so do, per source, those of
    shards and their proportional share, up to rounding. A null text counts one
    byte; a null source is a source of its own; repeated rows are placed apart;
    no rows fill no shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(docs.select(
        "doc_id", F.struct("source").alias("s"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(F.lit(seed), "doc_id", text).alias("draw")))
    n = rows.count()
    # A draw is uniform over 64 bits: its top bits make buckets of about group_rows rows.
    bits = max(0, min(30, (max(n, 1) // group_rows).bit_length()))
    first = F.shiftrightunsigned("draw", 64 - bits) if bits else F.lit(0).cast("long")
    ranked = placed(rows.withColumn("bucket", first), ["s"], "bucket", [F.col("draw"), F.col("doc_id"), F.col("crc")], "rank")
    parts = max(1, n // group_rows)
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("total"))
    mixed = (stage(ranked.drop("bucket")).withColumn("fraction", fraction).drop("total")
             .withColumn("part", F.least(F.floor(F.col("fraction") * parts), F.lit(parts - 1)).cast("long")).withColumn("all", F.lit(0)))
    order = [F.col("fraction"), F.col("s"), F.col("draw"), F.col("doc_id"), F.col("crc")]
    at = placed(mixed, ["all"], "part", order, "at")
    shard = F.expr(f"int(at * {shards} div {max(n, 1)})")
    start = F.expr(f"(bigint(shard) * {max(n, 1)} + {shards - 1}) div {shards}")
    return at.withColumn("shard", shard).withColumn("slot", F.col("at") - start).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.col("s.source").alias("source"), "shard", "slot")
