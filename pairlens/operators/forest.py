"""Random forests of many splits and feature sets, grown together.

Every task gets the training sample of one split and grows some of its trees
for all feature sets; trees are rows of a table, and the rows to be scored meet
the trees of their split in blocks. The driver sees neither rows nor trees.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .newton import SplitTable
from .staging import stage

#: Training rows of a split that its trees are grown from at most: trees of more rows draw from these.
SAMPLE_ROWS = 20_000
#: Trees that a task grows, and rows that are scored in one task.
CHUNK, SCORED = 25, 65_536


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. ``value`` is the weighted share of class 1, ``gain`` the impurity a split removes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.value[at]
            k = at[inner]
            at[inner] = np.where(x[inner, f[inner]] <= self.threshold[k], self.left[k], self.right[k])


def _best_split(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, int, float] | None:
    """(gain, column, threshold) of the split with the least weighted Gini impurity, None if no column varies."""
    order = np.argsort(x, axis=0, kind="stable")
    v = np.take_along_axis(x, order, 0)
    ws, ps = np.cumsum(w[order], 0), np.cumsum((w * y)[order], 0)
    total, pos = ws[-1, 0], ps[-1, 0]
    wl, pl = ws[:-1], ps[:-1]
    wr, pr = total - wl, pos - pl
    with np.errstate(divide="ignore", invalid="ignore"):
        left = pl * (wl - pl) / wl
        right = pr * (wr - pr) / wr
    loss = np.where(v[1:] > v[:-1], left + right, np.inf)
    k = int(np.argmin(loss))
    row, col = divmod(k, x.shape[1])
    if not np.isfinite(loss[row, col]):
        return None
    threshold = (v[row, col] + v[row + 1, col]) / 2
    if threshold >= v[row + 1, col]:
        threshold = v[row, col]
    return 2 * float(pos * (total - pos) / total - loss[row, col]), col, float(threshold)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, random: np.random.Generator, depth: int, tried: int) -> Tree:
    """A classification tree; every split looks at ``tried`` columns drawn anew, and at more while none of them varies."""
    nodes: list[list] = []
    todo = [(np.flatnonzero(w > 0), 0, -1, False)]
    while todo:
        rows, level, parent, is_right = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 if is_right else 2] = me
        ws, ys = w[rows], y[rows]
        total, pos = ws.sum(), (ws * ys).sum()
        nodes.append([-1, 0.0, -1, -1, pos / total, 0.0])
        if level >= depth or len(rows) < 2 or ys.min() == ys.max():
            continue
        columns, found = random.permutation(x.shape[1]), None
        for at in range(0, len(columns), tried):
            some = columns[at:at + tried]
            found = _best_split(x[np.ix_(rows, some)], ys, ws)
            if found:
                break
        if not found:
            continue
        gain, col, threshold = found
        f = int(some[col])
        nodes[me][0], nodes[me][1], nodes[me][5] = f, threshold, gain
        low = x[rows, f] <= threshold
        todo += [(rows[~low], level + 1, me, True), (rows[low], level + 1, me, False)]
    a = list(zip(*nodes))
    return Tree(np.array(a[0], np.int32), np.array(a[1]), np.array(a[2], np.int32), np.array(a[3], np.int32), np.array(a[4]), np.array(a[5]))


def _pack(trees: Sequence[Tree]) -> bytes:
    out = BytesIO()
    starts = np.cumsum([0, *(len(t.feature) for t in trees)])
    np.savez(out, starts=starts, **{c: np.concatenate([getattr(t, c) for t in trees]) for c in Tree.__dataclass_fields__})
    return out.getvalue()


def _unpack(blob: bytes) -> list[Tree]:
    got = np.load(BytesIO(blob))
    whole = {c: got[c] for c in Tree.__dataclass_fields__}
    return [Tree(**{c: v[a:b] for c, v in whole.items()}) for a, b in zip(got["starts"], got["starts"][1:])]


def _matrix(column: pa.ChunkedArray, p: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def _order(table: SplitTable):
    """An order of rows that does not depend on how they are stored."""
    return [F.xxhash64(*table.keep, "_y", "_x"), *table.keep]


def grow_forests(table: SplitTable, sets: Mapping[str, Sequence[str]], splits: Sequence[int], trees: int = 100, depth: int = 15,
                 seed: int = 42, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(no, feature_set, chunk, trees, importance): balanced forests of every split and feature set, staged.

    A tree draws as many rows with replacement as the split's training sample
    has; classes weigh n / (2 * n of the class). ``importance`` sums the impurity
    that each feature removes, per tree as a share.
    """
    at = {f: k for k, f in enumerate(table.features)}
    columns = {name: [at[f] for f in fs] for name, fs in sets.items()}
    p, fill, counts = len(table.features), table.fill, table.train_counts
    rows = table.rows.select(*table.keep, "_y", "_x", F.explode("_train").alias("no")).where(F.col("no").isin([int(s) for s in splits]))
    placed = rows.withColumn("_at", F.row_number().over(W.partitionBy("no").orderBy(*_order(table)))).where(F.col("_at") <= sample_rows)
    chunks = F.explode(F.sequence(F.lit(0), F.lit(-(-trees // CHUNK) - 1))).alias("chunk")
    dealt = placed.select("no", "_at", "_y", "_x", chunks)

    def run(some: pa.Table) -> pa.Table:
        some = some.sort_by("_at")
        no, chunk = some.column("no")[0].as_py(), some.column("chunk")[0].as_py()
        x, y = _matrix(some.column("_x"), p), some.column("_y").to_numpy()
        x = np.where(np.isnan(x), fill[no], x)
        weight = np.where(y == 1, sum(counts[no]) / (2.0 * counts[no][1]), sum(counts[no]) / (2.0 * counts[no][0]))
        names, blobs, shares = [], [], []
        for name, cols in columns.items():
            random = np.random.default_rng([seed + no, chunk, len(cols)])
            own = np.ascontiguousarray(x[:, cols])
            made, share = [], np.zeros(len(cols))
            for _ in range(min(CHUNK, trees - chunk * CHUNK)):
                drawn = np.bincount(random.integers(0, len(y), len(y)), minlength=len(y))
                tree = grow(own, y, weight * drawn, random, depth, max(1, int(np.sqrt(len(cols)))))
                gains = np.bincount(np.maximum(tree.feature, 0), np.where(tree.feature >= 0, tree.gain, 0), len(cols))
                share += gains / (gains.sum() or 1.0)
                made.append(tree)
            names.append(name)
            blobs.append(_pack(made))
            shares.append(share.tolist())
        k = len(names)
        return pa.table({"no": pa.array([no] * k, pa.int32()), "feature_set": names, "chunk": pa.array([chunk] * k, pa.int32()),
                         "trees": pa.array(blobs, pa.binary()), "importance": pa.array(shares, pa.list_(pa.float64()))})

    ship(table.rows.sparkSession)
    return stage(dealt.groupBy("no", "chunk").applyInArrow(run, "no int, feature_set string, chunk int, trees binary, importance array<double>"))


def scored_by(table: SplitTable, forests: DataFrame, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """no, feature_set, the kept columns, y_true, y_score, y_pred, as ``SplitTable.scored``: the mean of the trees' shares."""
    at = {f: k for k, f in enumerate(table.features)}
    columns = {name: [at[f] for f in fs] for name, fs in sets.items()}
    p, fill = len(table.features), table.fill
    kept = [table.rows.schema[c] for c in table.keep]
    schema = T.StructType([
        T.StructField("no", T.IntegerType()), T.StructField("feature_set", T.StringType()), *kept,
        T.StructField("y_true", T.IntegerType()), T.StructField("y_score", T.DoubleType()), T.StructField("y_pred", T.IntegerType())])
    names = [f.name for f in kept]
    grown = forests.select("no").distinct()
    rows = table.rows.select(*table.keep, "_y", "_x", F.explode("_score").alias("no")).join(grown, "no", "left_semi")
    sizes = stage(rows.groupBy("no").agg(F.ceil(F.count(F.lit(1)) / SCORED).cast("int").alias("blocks")))
    dealt = rows.join(sizes, "no").withColumn("block", F.pmod(F.xxhash64("_x"), F.col("blocks")).cast("int")).drop("blocks")
    copies = forests.join(sizes, "no").select(
        "no", "feature_set", "chunk", "trees", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def run(some: pa.Table, wood: pa.Table) -> pa.Table:
        out = []
        if some.num_rows:
            no = some.column("no")[0].as_py()
            x, y = _matrix(some.column("_x"), p), some.column("_y").to_numpy()
            x = np.where(np.isnan(x), fill[no], x)
            for name, cols in columns.items():
                mine = [b.as_py() for b, s in zip(wood.column("trees"), wood.column("feature_set")) if s.as_py() == name]
                forest = [t for blob in mine for t in _unpack(blob)]
                own = np.ascontiguousarray(x[:, cols])
                z = sum((t.score(own) for t in forest), np.zeros(len(x))) / len(forest)
                out.append(pa.table([pa.array(np.full(len(x), no, np.int32)), pa.array([name] * len(x)), *[some.column(c) for c in names],
                                     pa.array(y.astype(np.int32)), pa.array(z), pa.array((z >= 0.5).astype(np.int32))], names=schema.names))
        if out:
            return pa.concat_tables(out)
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(schema).empty_table()

    return dealt.groupBy("no", "block").cogroup(copies.groupBy("no", "block")).applyInArrow(run, schema)


def forest_importance(forests: DataFrame, sets: Mapping[str, Sequence[str]], trees: int) -> DataFrame:
    """no, feature_set, feature, importance: the mean share of removed impurity over the trees."""
    named = F.create_map(*[x for n, fs in sets.items() for x in (F.lit(n), F.array(*[F.lit(f) for f in fs]))])
    cells = forests.select("no", "feature_set", F.posexplode("importance").alias("at", "v"))
    g = cells.groupBy("no", "feature_set", "at").agg((F.sum("v") / trees).alias("importance"))
    return g.select("no", "feature_set", F.element_at(named[F.col("feature_set")], F.col("at") + 1).alias("feature"), "importance")
