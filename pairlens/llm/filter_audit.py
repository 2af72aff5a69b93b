"""What every order of a set of filters keeps, removes and loses, from one id table per filter."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..operators.staging import scratch, stage

SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["k1", "k2"]
COUNTS = ["removed", "good", "toxic"]


@dataclass
class Failing:
    """``rows``: k1, k2, part, good, toxic, n (how many documents agree in these).
    ``ids``: k1, k2, number; stored as one table (folder) per filter."""

    rows: DataFrame
    ids: DataFrame


def _text_filters(words: Column, text: Column) -> dict[str, Column]:
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {"A": n < 50, "B": 100 * distinct < 65 * n, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def failing_ids(docs: DataFrame, labels: DataFrame) -> Failing:
    """The id tables of the five text filters A to E and the rows they speak of.

    A: under 50 words; B: distinct words below 65 %; C: capitals above 5 % of the
    code points; D: holds any of ``#$%&*|``; E: equal to the text of a smaller
    doc_id. Null texts and sources are empty. A null doc_id is smaller and larger
    than none, so E spares it. An id stands for (doc_id, text); documents that
    agree in both are counted, not stored twice. A document is good (toxic) if
    any of its labels has quality (toxic) 1. Texts are read once; what is stored
    and joined afterwards is as narrow as ids.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["source"], F.lit("")).alias("part"), text.alias("text"),
                       F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"))
    tests = _text_filters(F.col("words"), F.col("text"))
    judged = stage(base.select(
        "doc_id", "part", F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("text", F.col("doc_id").isNull()).alias("k2"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in enumerate(tests.values())]), lambda k: k.isNotNull()).alias("failed")))

    firsts = stage(judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                   .where("first < last").select("digest", "first"))
    copies = judged.join(firsts, "digest").where("doc_id > first").select(*KEY, F.lit(len(tests)).alias("number"))
    ids = judged.select(*KEY, F.explode("failed").alias("number")).unionAll(copies).distinct()
    path = scratch(docs.sparkSession)
    ids.write.partitionBy("number").parquet(path)
    ids = docs.sparkSession.read.schema(ids.schema).parquet(path)

    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    counted = judged.groupBy(*KEY, "part", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.join(marks, "doc_id", "left").select(
        *KEY, "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    return Failing(stage(rows), ids)


def _counted(members: DataFrame, mask: Column) -> DataFrame:
    """Documents, good and toxic ones per part, filter and set of filters before it."""
    return members.groupBy("part", "filter", mask.alias("mask")).agg(
        F.sum("n").alias("removed"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def prefix_losses(failing: Failing, n_filters: int) -> tuple[DataFrame, DataFrame]:
    """(removed, redundant): part, filter, mask and counts, for every filter and set ``mask`` of filters before it.

    Which rows a filter removes depends on the set of filters before it, not on
    their order. A filter's failing ids start with an empty set; sets grow by one
    later filter at a time. The left-anti join with that filter's ids leaves what
    is still removed here, the left-semi join gives what has become redundant.
    All sets of one size go through one join. Zeros are left out.
    """
    members = stage(failing.rows.join(failing.ids, KEY).select(
        F.col("number").alias("filter"), F.lit(0).alias("mask"), F.lit(-1).alias("number"), *KEY, "part", "good", "toxic", "n"))
    removed, redundant = [_counted(members, F.col("mask"))], []
    later = F.array(*[F.lit(k) for k in range(n_filters)])
    wider = F.col("mask").bitwiseOR(F.expr("shiftleft(1, number)"))
    for _ in range(n_filters - 1):
        grown = members.withColumn("next", F.explode(F.filter(later, lambda k: (k > F.col("number")) & (k != F.col("filter")))))
        grown = stage(grown.drop("number").withColumnRenamed("next", "number"))
        on = [*KEY, "number"]
        redundant.append(_counted(grown.join(failing.ids, on, "left_semi"), wider))
        members = stage(grown.join(failing.ids, on, "left_anti").withColumn("mask", wider))
        removed.append(_counted(members, F.col("mask")))
    gone = removed[0]
    for r in removed[1:]:
        gone = gone.unionAll(r)
    twice = redundant[0]
    for r in redundant[1:]:
        twice = twice.unionAll(r)
    return gone, twice


def audit_orders(failing: Failing, letters: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    part, filter_order, step (from 1) and counts of documents of the part: kept
    after the step, removed by it, redundant (failing its filter, removed before),
    unique_fails (failing its filter only), good_lost, toxic_lost, and shapley:
    removals by its filter summed over all orders. No documents give no rows.
    """
    n = len(letters)
    removed, redundant = prefix_losses(failing, n)
    key = (F.col("filter") * F.lit(1 << n) + F.col("mask")).alias("at")
    cells = removed.select("part", key, *COUNTS, F.lit(0).cast("long").alias("twice")).unionAll(
        redundant.select("part", key, *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.col("removed").alias("twice")))
    cells = cells.groupBy("part", "at").agg(*[F.sum(c).alias(c) for c in [*COUNTS, "twice"]])
    table = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct(*COUNTS, "twice")))).alias("cells"))
    totals = failing.rows.groupBy("part").agg(F.sum("n").alias("total"))
    per_part = totals.join(table, "part", "left")

    # A filter's removals do not depend on the order of those before it, so all is looked up by sets.
    numbered = F.create_map(*[x for k, c in enumerate(letters) for x in (F.lit(c), F.lit(k))])
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = per_part.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))

    def set_of(length: Column) -> Column:
        taken = F.slice(F.split("filter_order", ""), F.lit(1), length)
        return F.aggregate(taken, F.lit(0), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), numbered[c])))

    def cell(at: Column, field: str) -> Column:
        return F.coalesce(F.try_element_at("cells", at)[field], F.lit(0).cast("long"))

    base = F.col("filter") * F.lit(1 << n)
    full = (1 << n) - 1
    # Sets grow by their later filters: those of a set begin with its lowest members.
    chain = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), k) - 1))
    chain = F.filter(F.array_distinct(chain), lambda m: m != 0)
    found = steps.withColumn("filter", numbered[F.substring("filter_order", F.col("step"), F.lit(1))]).withColumn("mask", set_of(F.col("step") - 1))
    found = found.select(
        "part", "filter_order", "step", "filter", "total", cell(base + F.col("mask"), "removed").alias("removed"),
        F.aggregate(chain, F.lit(0).cast("long"), lambda s, m: s + cell(base + m, "twice")).alias("redundant"),
        cell(base + (F.lit(full) - F.call_function("shiftleft", F.lit(1), F.col("filter"))), "removed").alias("unique_fails"),
        cell(base + F.col("mask"), "good").alias("good_lost"), cell(base + F.col("mask"), "toxic").alias("toxic_lost"))
    so_far = W.partitionBy("part", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return found.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", F.sum("removed").over(W.partitionBy("part", "filter")).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five text filters over all documents."""
    return audit_orders(failing_ids(docs, labels), "ABCDE")
