"""Nearest neighbours by inner product over learned partitions of a neighbour graph."""
from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..operators.staging import stage
from ..shipping import ship
from .common import arrow
from .vectors import finite, matrix, width

#: Neighbours of a query.
NEIGHBOURS = 20
#: Distinct vectors a partition is meant to hold; one above twice as many is split again.
PART_ROWS = 2048
#: Partitions that one split makes at most.
FAN = 32
#: Vectors of a partition that its split is learned from (its neighbour graph, classifiers and coverage).
SAMPLE = 4096
#: Part of the neighbours of held-out queries that the probed partitions of a split must hold.
RECALL = 0.95
#: Vectors and queries that meet in one task; rows a model is applied to in one task.
CANDIDATES, QUERIES, ROUTED = 8192, 4096, 65_536
#: Queries whose scores are held at once.
QUERIES_AT_ONCE = 256
HIDDEN, EPOCHS, BATCH = 96, 24, 256


# The neighbour graph of a sample and its balanced partition.

def _neighbours(q: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    """For every row of ``q`` the ``k`` other rows of ``p`` (same order) with the largest inner products."""
    out = np.empty((len(q), k), np.int64)
    for at in range(0, len(q), 512):
        s = q[at:at + 512] @ p.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at:at + 512] = np.argpartition(s, -k, axis=1)[:, -k:]
    return out


def _halves(a: np.ndarray, b: np.ndarray, n: int, left: int, random: np.random.Generator) -> np.ndarray:
    """True for the ``left`` nodes of one side of the graph with edges a-b, few edges cut.

    The order of a Fiedler-like vector (power iteration without its constant
    part) gives the first cut; then pairs are swapped while that cuts fewer.
    """
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
    root = np.sqrt(degree)
    flat, v = root / np.linalg.norm(root), random.standard_normal(n)
    for _ in range(40):
        u = v / root
        v = (v + (np.bincount(a, u[b], n) + np.bincount(b, u[a], n) + u) / root) / 2
        v -= flat * (flat @ v)
        v /= np.linalg.norm(v) or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(v / root, kind="stable")[:left]] = True
    cut = int((side[a] != side[b]).sum())
    for _ in range(12):
        across = side[a] != side[b]
        gain = np.bincount(a, np.where(across, 1, -1), n) + np.bincount(b, np.where(across, 1, -1), n)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
        m = min(len(one), len(two), max(1, n // 20))
        m = int((gain[one[:m]] + gain[two[:m]] > 0).sum())
        if not m:
            break
        moved = side.copy()
        moved[one[:m]], moved[two[:m]] = False, True
        now = int((moved[a] != moved[b]).sum())
        if now >= cut:
            break
        side, cut = moved, now
    return side


def balanced_parts(near: np.ndarray, parts: int, random: np.random.Generator) -> np.ndarray:
    """Part of every node of the neighbour graph by recursive bisection; sizes differ by rounding only."""
    n, k = near.shape
    a, b = np.repeat(np.arange(n), k), near.ravel()
    out = np.zeros(n, np.int64)

    def split(nodes: np.ndarray, first: int, count: int) -> None:
        if count == 1 or len(nodes) < 2:
            out[nodes] = first
            return
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        inner = (place[a] >= 0) & (place[b] >= 0)
        low = count // 2
        side = _halves(place[a[inner]], place[b[inner]], len(nodes), len(nodes) * low // count, random)
        split(nodes[side], first, low)
        split(nodes[~side], first + low, count - low)

    split(np.arange(n), 0, parts)
    return out


# The small classifier: a softmax over a linear and a hidden layer.

Weights = list[np.ndarray]


def _scores(w: Weights, x: np.ndarray) -> np.ndarray:
    z = np.maximum(x @ w[0] + w[1], 0) @ w[2] + x @ w[3] + w[4]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(x: np.ndarray, target: np.ndarray, random: np.random.Generator) -> Weights:
    """Cross entropy against ``target`` distributions by Adam."""
    d, m = x.shape[1], target.shape[1]
    w = [random.standard_normal((d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN), np.zeros((HIDDEN, m)), np.zeros((d, m)), np.zeros(m)]
    mean, square, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(x))
        for at in range(0, len(x), BATCH):
            some = order[at:at + BATCH]
            xs = x[some]
            h = xs @ w[0] + w[1]
            r = np.maximum(h, 0)
            z = r @ w[2] + xs @ w[3] + w[4]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - target[some]) / len(some)
            back = (g @ w[2].T) * (h > 0)
            grads = [xs.T @ back, back.sum(0), r.T @ g, xs.T @ g, g.sum(0)]
            step += 1
            rate = 0.01 * (1 - epoch / EPOCHS)
            for k, grad in enumerate(grads):
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.99 * square[k] + 0.01 * grad * grad
                w[k] = w[k] - rate * (mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8) + 1e-4 * w[k])
    return w


def directions(v: np.ndarray) -> np.ndarray:
    """Queries for a classifier: their length does not matter; one more entry is zero."""
    return np.hstack([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))]) * np.sqrt(v.shape[1])


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Rows for a classifier, one entry longer, so that the nearest by angle are the largest inner products."""
    u = v / longest
    rest = np.sqrt(np.maximum(0.0, 1 - np.square(u).sum(1, keepdims=True)))
    return np.hstack([u, rest]) * np.sqrt(v.shape[1])


def learn_split(v: np.ndarray, parts: int, longest: float, seed: int = 11) -> bytes:
    """A split learned from a sample: classifier of rows, classifier of queries, coverage.

    Rows go to their most probable partition, as learned from the balanced
    partition of the graph. Queries learn how their neighbours are spread over
    the partitions that rows are then given, and probe partitions by falling
    probability until these add up to ``coverage``: the least at which the
    probed partitions hold ``RECALL`` of the neighbours of held-out queries.
    """
    random = np.random.default_rng(seed)
    q, p = directions(v), lifted(v, longest)
    near = _neighbours(q, p, min(NEIGHBOURS, len(v) - 1))
    own = balanced_parts(near, parts, random)
    spread = np.zeros((len(v), parts))
    for k in range(near.shape[1]):
        spread[np.arange(len(v)), own[near[:, k]]] += 0.5 / near.shape[1]
    spread[np.arange(len(v)), own] += 0.5
    rows = train(p, spread, random)
    given = _scores(rows, p).argmax(1)
    held = np.zeros((len(v), parts))
    for k in range(near.shape[1]):
        held[np.arange(len(v)), given[near[:, k]]] += 1 / near.shape[1]
    out = random.permutation(len(v)) < len(v) // 5
    queries = train(q[~out], held[~out], random)
    chance = _scores(queries, q[out])
    order = np.argsort(-chance, axis=1)
    sums = np.cumsum(np.take_along_axis(chance, order, 1), 1) - np.take_along_axis(chance, order, 1)
    caught = np.take_along_axis(held[out], order, 1)
    coverage = 1.0
    for c in np.arange(0.5, 1.0, 0.01):
        if (caught * (sums < c)).sum(1).mean() >= RECALL:
            coverage = float(c)
            break
    blob = BytesIO()
    np.savez(blob, coverage=coverage, longest=longest, **{f"r{k}": w for k, w in enumerate(rows)}, **{f"q{k}": w for k, w in enumerate(queries)})
    return blob.getvalue()


class Split:
    """A learned split, read back."""

    def __init__(self, blob: bytes):
        got = np.load(BytesIO(blob))
        self.coverage, self.longest = float(got["coverage"]), float(got["longest"])
        self.rows, self.queries = ([got[f"{s}{k}"] for k in range(5)] for s in "rq")

    def place(self, v: np.ndarray) -> np.ndarray:
        return _scores(self.rows, lifted(v, self.longest)).argmax(1)

    def probes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, part, probability) of the partitions to look at."""
        chance = _scores(self.queries, directions(v))
        order = np.argsort(-chance, axis=1, kind="stable")
        ranked = np.take_along_axis(chance, order, 1)
        row, rank = np.nonzero((np.cumsum(ranked, 1) - ranked < self.coverage) | (self.coverage >= 1))
        return row, order[row, rank], ranked[row, rank]


# The tables.

def _together(left: DataFrame, right: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    ship(left.sparkSession)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _apply(rows: DataFrame, models: DataFrame, d: int, probe: bool) -> DataFrame:
    """Rows of split partitions with their new ones; a model meets blocks of some ten thousand rows of its partition.

    ``p`` is the probability that a query's neighbour is there, multiplied over the levels.
    """
    sizes = rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ROUTED).cast("int").alias("blocks"))
    blocks = stage(models.join(sizes, "part").select("part", "blocks", "blob"))
    dealt = rows.join(blocks.select("part", "blocks"), "part").withColumn("block", F.pmod("c2", F.col("blocks").cast("long")))
    copies = blocks.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), "blob")

    def run(some: pa.Table, model: pa.Table) -> pa.Table:
        split = Split(model.column("blob")[0].as_py())
        v = matrix(some.column("v"), d)
        row, part, chance = split.probes(v) if probe else (np.arange(len(v)), split.place(v), np.ones(len(v)))
        some = some.take(pa.array(row))
        base = some.column("part").to_numpy() * FAN
        return pa.table({"part": base + part, "was": some.column("part"), "p": some.column("p").to_numpy() * chance,
                         "c1": some.column("c1"), "c2": some.column("c2"), "v": some.column("v")})

    return _together(dealt.select("part", "block", "p", "c1", "c2", "v"), copies, ["part", "block"], run,
                     f"part long, was long, p double, c1 long, c2 long, v {rows.schema['v'].dataType.simpleString()}")


def partition(rows: DataFrame, queries: DataFrame, d: int, longest: float, part_rows: int = PART_ROWS,
              sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(rows, queries) with their partitions: every row in one, every query in those it probes, with probability p.

    Both have c1, c2, v. All start in one partition. Every round splits all
    partitions above twice ``part_rows`` at once, each in a task that learns
    from a bounded sample of it; a partition that a split leaves almost whole
    stays as it is (the search takes partitions of any size).
    """
    done_rows, done_queries = [], []
    columns = ["p", "c1", "c2", "v"]
    rows = stage(rows.select(F.lit(0).cast("long").alias("part"), F.lit(1.0).alias("p"), "c1", "c2", "v"))
    queries = stage(queries.select(F.lit(0).cast("long").alias("part"), F.lit(1.0).alias("p"), "c1", "c2", "v"))
    level = 0
    while True:
        sizes = stage(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
        large = sizes.where(F.col("n") > 2 * part_rows)
        named = F.concat_ws("/", F.lit(level), F.col("part").cast("string")).alias("part")
        if large.isEmpty():
            done_rows.append(rows.select(named, *columns))
            done_queries.append(queries.select(named, *columns))
            break
        ends = sizes.where(F.col("n") <= 2 * part_rows).select("part")
        done_rows.append(rows.join(ends, "part", "left_semi").select(named, *columns))
        done_queries.append(queries.join(ends, "part", "left_semi").select(named, *columns))
        first = W.partitionBy("part").orderBy("c2", "c1")
        chosen = rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= sample)
        chosen = chosen.join(large, "part").select("part", "n", "v")

        def learn(some: pa.Table) -> pa.Table:
            n = some.column("n")[0].as_py()
            blob = learn_split(matrix(some.column("v"), d), min(FAN, -(-n // part_rows)), longest)
            return pa.table({"part": some.column("part").slice(0, 1), "blob": pa.array([blob], pa.binary())})

        ship(rows.sparkSession)
        models = stage(chosen.groupBy("part").applyInArrow(learn, "part long, blob binary"))
        moved = stage(_apply(rows, models, d, False))
        probed = stage(_apply(queries, models, d, True))
        whole = moved.groupBy("part", "was").agg(F.count(F.lit(1)).alias("m")).join(large.withColumnRenamed("part", "was"), "was")
        whole = stage(whole.where("m > 0.9 * n").select("part"))
        level += 1
        stuck = F.concat_ws("/", F.lit(-level), F.col("part").cast("string")).alias("part")
        done_rows.append(moved.join(whole, "part", "left_semi").select(stuck, *columns))
        done_queries.append(probed.join(whole, "part", "left_semi").select(stuck, *columns))
        rows = moved.join(whole, "part", "left_anti").select("part", *columns)
        queries = probed.join(whole, "part", "left_anti").select("part", *columns)
        rows, queries = stage(rows), stage(queries)
    out, asked = done_rows[0], done_queries[0]
    for r, q in zip(done_rows[1:], done_queries[1:]):
        out, asked = out.unionAll(r), asked.unionAll(q)
    return stage(out), stage(asked)


def _best(scores: np.ndarray, k: int, least: np.ndarray) -> Iterator[np.ndarray]:
    """Per row of scores the columns of the ``k`` largest that reach ``least``, and all that tie with the last within rounding."""
    low = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    low = np.maximum(low, least)
    with np.errstate(invalid="ignore"):
        low = np.where(np.isfinite(low), low - 1e-9 * np.maximum(1.0, np.abs(low)), low)
    for s, bound in zip(scores, low):
        yield np.flatnonzero(s >= bound)


HIT = "c1 long, c2 long, score double, vec_id long, same boolean"


def _search(rows: DataFrame, queries: DataFrame, members: DataFrame, d: int, k: int) -> DataFrame:
    """Rows of ``HIT``: per query and block of its partitions the ``k`` + 1 best that reach the query's ``least`` score."""
    per = rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).alias("row_blocks")).join(
        queries.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("query_blocks")), "part")
    per = stage(per)
    zero = F.lit(0).cast("long")
    left = rows.join(per, "part").join(members, ["c1", "c2"]).select(
        "part", F.pmod("c1", "row_blocks").alias("rb"), F.explode(F.sequence(zero, F.col("query_blocks") - 1)).alias("qb"), "c1", "c2", "ids", "v")
    right = queries.join(per, "part").select(
        "part", F.explode(F.sequence(zero, F.col("row_blocks") - 1)).alias("rb"), F.pmod("c1", "query_blocks").alias("qb"), "c1", "c2", "least", "v")

    def run(some: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("c1", "c2", "score", "vec_id", "same")}
        if some.num_rows and asked.num_rows:
            v, q, least = matrix(some.column("v"), d), matrix(asked.column("v"), d), asked.column("least").to_numpy()
            ids = some.column("ids").to_pylist()
            at, to = (np.stack([t.column("c1").to_numpy(), t.column("c2").to_numpy()], 1) for t in (some, asked))
            for start in range(0, len(q), QUERIES_AT_ONCE):
                part = q[start:start + QUERIES_AT_ONCE]
                for r, cols in enumerate(_best(part @ v.T, k + 1, least[start:start + QUERIES_AT_ONCE]), start):
                    # Summed row by row, so that equal vectors score alike wherever they are met.
                    exact = (v[cols] * q[r]).sum(1)
                    hits = [(-s, i is None, i or 0, c) for s, c in zip(exact.tolist(), cols.tolist()) if s >= least[r] for i in ids[c]]
                    for s, none, i, c in sorted(hits)[:k + 1]:
                        out["c1"].append(to[r, 0])
                        out["c2"].append(to[r, 1])
                        out["score"].append(-s)
                        out["vec_id"].append(None if none else i)
                        out["same"].append(bool((at[c] == to[r]).all()))
        return pa.table({"c1": pa.array(out["c1"], pa.int64()), "c2": pa.array(out["c2"], pa.int64()), "score": pa.array(out["score"], pa.float64()),
                         "vec_id": pa.array(out["vec_id"], pa.int64()), "same": pa.array(out["same"], pa.bool_())})

    return _together(left, right, ["part", "rb", "qb"], run, HIT)


def rerank(rows: DataFrame, queries: DataFrame, members: DataFrame, d: int, k: int) -> DataFrame:
    """(c1, c2, found): per distinct query the ``k`` + 1 best (score, vec_id, same) in its partitions, best first.

    A query first looks into its most probable partition, then into the next
    3, 12, 48 ... and from the second round on only gets back what reaches its
    ``k`` + 1st best score so far, so that what a query gathers hardly grows
    with the number of its partitions. Partitions of any size are searched in
    blocks of bounded numbers of rows and queries. ``members`` has per distinct
    vector its ``k`` + 1 smallest ids.
    """
    best = W.partitionBy("c1", "c2").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    order = W.partitionBy("c1", "c2").orderBy(F.desc("p"), "part")
    asked = stage(queries.withColumn("rank", F.row_number().over(order)))
    last = asked.agg(F.max("rank")).first()[0] or 0
    hits, done = None, 0
    while done < last:
        now = asked.where((F.col("rank") > done) & (F.col("rank") <= max(1, 4 * done)))
        if hits is None:
            now = now.withColumn("least", F.lit(float("-inf")))
        else:
            least = hits.where(F.col("at") == k + 1).select("c1", "c2", F.col("score").alias("least"))
            now = now.join(least, ["c1", "c2"], "left").na.fill(float("-inf"), ["least"])
        found = _search(rows, stage(now), members, d, k)
        found = found if hits is None else found.unionByName(hits.drop("at"))
        hits = stage(found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1))
        done = max(1, 4 * done)
    if hits is None:
        hits = rows.sparkSession.createDataFrame([], f"{HIT}, at int")
    return hits.groupBy("c1", "c2").agg(F.array_sort(F.collect_list(F.struct("at", "score", "vec_id", "same"))).alias("found"))


def nearest(df: DataFrame, asks: Column, col: str = "embedding", key: str = "vec_id", k: int = NEIGHBOURS,
            part_rows: int = PART_ROWS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of every row that ``asks`` is true for.

    Nearness is the inner product in doubles, ties go to the smaller key (null
    last). Vectors that are null, all zero, or hold null, NaN or infinite
    entries take no part; shorter vectors are as if they ended in zeros. Rows
    that agree in key and vector are one row; rows that share a key only are
    separate queries under one query_id. A row is no candidate of itself, its
    copies are. Equal vectors are indexed once with their ``k`` + 1 smallest
    keys, which is all a result can show. No rows, no result.
    """
    whole = df.select(F.col(key).alias("vec_id"), F.col(col).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")).where(
        finite("v") & F.exists("v", lambda c: c != 0))
    d = width(whole, "v")
    # Floats stay floats where the table has them; sums are in doubles.
    kind = "float" if df.schema[col].dataType.elementType.typeName() == "float" else "double"
    zero = F.lit(0.0).cast(kind)
    filled = F.concat(F.transform("v", lambda c: c.cast(kind) + zero), F.array_repeat(zero, F.lit(d) - F.size("v")))
    whole = whole.select("vec_id", "asks", filled.alias("v"))
    hashed = whole.select("vec_id", "asks", F.xxhash64("v").alias("c1"), F.xxhash64(F.lit("2"), "v").alias("c2"), "v")
    rows = stage(hashed.groupBy("vec_id", "c1", "c2").agg(F.max("asks").alias("asks"), F.first("v").alias("v")))
    order = W.partitionBy("c1", "c2").orderBy(F.asc_nulls_last("vec_id"))
    kept = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    classes = stage(kept.groupBy("c1", "c2").agg(
        F.collect_list("vec_id").alias("ids"), F.max(F.col("vec_id").isNull()).alias("none"), F.first("v").alias("v")))
    asking = rows.where("asks")
    longest = classes.agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))).alias("m")).first()["m"]
    asked = classes.join(asking.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi")
    parts, probes = partition(classes, asked, d, float(longest or 1.0) or 1.0, part_rows, sample)
    members = classes.select("c1", "c2", F.when(F.col("none"), F.concat("ids", F.array(F.lit(None).cast("long")))).otherwise(F.col("ids")).alias("ids"))
    found = stage(rerank(parts, probes, members, d, k))
    other = F.filter("found", lambda f: ~(f["same"] & f["vec_id"].eqNullSafe(F.col("vec_id"))))
    listed = asking.select("vec_id", "c1", "c2").join(found, ["c1", "c2"]).select(
        F.col("vec_id").alias("query_id"), F.posexplode(F.slice(other, 1, k)).alias("p", "f"))
    return listed.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
