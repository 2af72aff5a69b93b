"""AUC of linear scores in which one part at a time is exchanged.

Rows times features are too many to travel as rows. Tasks pack the exchanged
scores of a block of rows into one list per group and range of scores, the
lists of a range meet in one task and are ranked there as arrays, and the rank
sums are shifted by the counts of the ranges below.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Scores of one repeat that a range holds on average, all groups together, and rows that the cuts are read from.
RANGE_SCORES, CUT_ROWS = 1 << 21, 20_000


def _lists(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _cuts(base: DataFrame, rows: int, features: int) -> list[float]:
    """Bounds of ranges of about equal numbers of exchanged scores.

    They come from drawn rows that exchange their parts with the next one. They
    decide how the work is dealt, not what comes out.
    """
    ranges = -(-rows * features // RANGE_SCORES)
    if ranges < 2:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _lists(b.column(1), b.num_rows)
            s = b.column(0).to_numpy()[:, None] - c + np.roll(c, 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(s.ravel())], names=["s"])

    some = base.select("_m", "_c").sample(min(1.0, max(CUT_ROWS, 50 * ranges) / rows), 1)
    s = some.mapInArrow(run, "s double").where("NOT isnan(s)")
    return sorted(set(s.approxQuantile("s", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))


def exchanged_auc(base: DataFrame, pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _f, repeat, roc_auc) of the scores ``_m`` with the part _f of ``_c`` exchanged for that of ``o__c``.

    ``pairs`` has by, repeat, y_true, ``_m``, ``_c`` and ``o__c``; ``base`` is a
    staged table of its rows before they are repeated. NaN scores are left out,
    the area of a single class is null.
    """
    by = list(by)
    keys = [*by, "repeat"]
    ship(base.sparkSession)
    sizes = base.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("_c")).alias("features")).first()
    cuts = np.array(_cuts(base, sizes["rows"], sizes["features"] or 0), float)
    kept = [pairs.schema[c] for c in keys]
    packed = T.StructType([*kept, T.StructField("_b", T.IntegerType()), T.StructField("f", T.ArrayType(T.ShortType())),
                           T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("y", T.ArrayType(T.ByteType()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            mine = _lists(b.column("_c"), n)
            s = b.column("_m").to_numpy(zero_copy_only=False)[:, None] - mine + _lists(b.column("o__c"), n)
            p = s.shape[1]
            y = b.column("y_true").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int8)
            group = b.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            cell = group[:, None] * (len(cuts) + 1) + np.searchsorted(cuts, s)
            cell, flat = cell.ravel(), s.ravel()
            order = np.argsort(cell, kind="stable")
            order = order[~np.isnan(flat[order])]
            if not len(order):
                continue
            cell = cell[order]
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            offsets = pa.array(np.r_[starts, len(cell)].astype(np.int32))
            heads = b.take(pa.array(order[starts] // p))
            yield pa.RecordBatch.from_arrays(
                [*[heads.column(c) for c in keys], pa.array((cell[starts] % (len(cuts) + 1)).astype(np.int32)),
                 pa.ListArray.from_arrays(offsets, pa.array((order % p).astype(np.int16))),
                 pa.ListArray.from_arrays(offsets, pa.array(flat[order])), pa.ListArray.from_arrays(offsets, pa.array(y[order // p]))],
                names=packed.names)

    ranked = T.StructType([*kept, T.StructField("_b", T.IntegerType()), T.StructField("_f", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("p", T.LongType()), T.StructField("r", T.DoubleType())])

    def rank(key: tuple, table: pa.Table) -> pa.Table:
        f, s, y = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(x).chunks]) for x in ("f", "s", "y"))
        order = np.lexsort((s, f))
        f, s, y = f[order], s[order], y[order]
        first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
        size = np.diff(np.r_[first, len(f)])
        ties = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (s[1:] != s[:-1])])
        many = np.diff(np.r_[ties, len(f)])
        # Average rank of every tie inside its feature, and the positives of the tie.
        place = ties - np.repeat(first, size)[ties] + (many + 1) / 2
        hits = np.add.reduceat(y.astype(np.int64), ties)
        at = np.flatnonzero(np.r_[True, f[ties][1:] != f[ties][:-1]])
        out = [pa.array([k.as_py()] * len(first), t.type) for k, t in zip(key, [table.schema.field(c) for c in [*keys, "_b"]])]
        return pa.Table.from_arrays(
            [*out, pa.array(f[first].astype(np.int32)), pa.array(size.astype(np.int64)), pa.array(np.add.reduceat(hits, at)),
             pa.array(np.add.reduceat(place * hits, at))], names=ranked.names)

    lists = pairs.select(*keys, "y_true", "_m", "_c", "o__c").mapInArrow(pack, packed)
    parts = lists.groupBy(*keys, "_b").applyInArrow(rank, ranked)
    below = W.partitionBy(*keys, "_f").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_o", F.coalesce(F.sum("n").over(below), F.lit(0)))
    g = parts.groupBy(*by, "_f", "repeat").agg(
        F.sum("n").alias("n"), F.sum("p").cast("double").alias("p"), F.sum(F.col("r") + F.col("_o") * F.col("p")).alias("r"))
    neg = F.col("n") - F.col("p")
    auc = F.when((F.col("p") > 0) & (neg > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg))
    return g.select(*by, "_f", "repeat", auc.alias("roc_auc"))
