"""Penalised logistic regressions of many splits and feature sets, fitted together.

All fits share one staged table whose rows are packed blocks of rows, so that a
pass hands arrays to numpy instead of taking every row apart. A pass gives, for
every fit that has not converged, the loss, gradient and information matrix at
its coefficients: tasks fold blocks with matrix products, Spark adds the partial
sums, and the driver solves one small system per fit.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .ranks import quantiles
from .staging import stage

#: Rows a task of the staged table holds at least, rows of a packed block at most, and bytes of its features.
TASK_ROWS, BLOCK, BLOCK_BYTES = 4096, 8192, 1 << 18
#: Bytes of the packed blocks that go to Python at once, and of a row group of them.
BATCH_BYTES, ROW_GROUP = 4 << 20, 16 << 20
#: Splits whose flags share one long.
FLAGS = 62
#: Newton steps at most, and the largest change of a coefficient at which a fit is done.
STEPS, TOLERANCE = 200, 1e-9


@dataclass
class Fitted:
    """Coefficients of scaled features of one split and feature set; ``fill`` replaces missing values."""

    columns: list[int]
    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    steps: int

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x[:, self.columns]
        return (np.where(np.isnan(x), self.fill, x) - self.mean) / self.scale


class SplitTable:
    """Rows with their features and the splits that train on them and score them.

    ``splits`` has one row per (split, group): ``no`` (from 0), the group,
    ``is_train``, ``is_score``. Groups are looked up once; a row then carries
    the flags of its splits as bits, so rows are not multiplied by splits.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, group: str, splits: DataFrame, n_splits: int,
                 keep: Sequence[str] = ()):
        self.features, self.n_splits = list(features), n_splits
        self.keep = [c for c in dict.fromkeys([group, *keep])]
        no = F.col("no").cast("int")

        def bits(flag: str, word: int):
            mine = (F.col(flag) == 1) & (F.floor(no / FLAGS) == word)
            return F.coalesce(F.bit_or(F.when(mine, F.call_function("shiftleft", F.lit(1).cast("long"), no % FLAGS))), F.lit(0).cast("long"))

        member = splits.groupBy(F.col(group).alias("_g")).agg(
            *[bits(f"is_{role}", w).alias(f"_{role}_{w}") for role in ("train", "score") for w in range(self._words)])
        self._make(df.join(member, df[group].eqNullSafe(member["_g"])), label)

    @classmethod
    def whole(cls, df: DataFrame, features: Sequence[str], label: str) -> "SplitTable":
        """One split that trains on all rows and scores none."""
        self = cls.__new__(cls)
        self.features, self.n_splits, self.keep = list(features), 1, []
        self._make(df.withColumns({"_train_0": F.lit(1).cast("long"), "_score_0": F.lit(0).cast("long")}), label)
        return self

    @property
    def _words(self) -> int:
        return max(1, -(-self.n_splits // FLAGS))

    def _make(self, tagged: DataFrame, label: str) -> None:
        """The packed table: rows of a block as one row of arrays' bytes, the kept columns as an Arrow stream."""
        flags = [f"_{role}_{w}" for role in ("train", "score") for w in range(self._words)]
        x = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))).alias(f"_x{k}") for k, f in enumerate(self.features)]
        y = F.col(label).cast("double").alias("_y")
        source = tagged.select(*self.keep, y, *x, *flags).where("_y IS NOT NULL")
        self.kinds = [source.schema[c] for c in self.keep]
        self.spark = source.sparkSession
        ship(self.spark)
        # Blocks are bounded by rows before they are packed and by bytes after it.
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        run = _packer(len(self.keep), len(self.features), self._words)
        packed = stage(source.mapInArrow(run, "n int, x binary, y binary, train binary, score binary, kept binary"), ROW_GROUP)
        rows = packed.agg(F.sum("n")).first()[0] or 0
        tasks = max(1, -(-rows // TASK_ROWS))
        # Only a table of many small parts is written again.
        self.packed = stage(packed.coalesce(tasks), ROW_GROUP) if tasks < packed.rdd.getNumPartitions() else packed
        self._count()
        self._scale()

    @cached_property
    def rows(self) -> DataFrame:
        """The rows one by one: the kept columns, ``_y``, ``_x`` and the lists ``_train`` and ``_score`` of split numbers, staged."""
        p, n = len(self.features), self.n_splits
        schema = T.StructType([*self.kinds, T.StructField("_y", T.DoubleType()), T.StructField("_x", T.ArrayType(T.DoubleType())),
                               T.StructField("_train", T.ArrayType(T.IntegerType())), T.StructField("_score", T.ArrayType(T.IntegerType()))])

        def lists(flags: np.ndarray) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(flags.sum(1))].astype(np.int32)), pa.array(np.nonzero(flags)[1].astype(np.int32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, y, train, score, kept in blocks(batches, p, n, 2):
                xs = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * p), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(y), xs, lists(train), lists(score)], names=schema.names)

        return stage(self._packed("train", "score", "kept").mapInArrow(run, schema))

    def _packed(self, *more: str) -> DataFrame:
        ship(self.spark)
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return self.packed.select("n", "x", "y", *more)

    # Passes.

    def sums(self, part: Callable[..., Iterator[tuple[int, np.ndarray]]], scored: bool = False) -> dict[int, np.ndarray]:
        """Sums over all rows of the vectors that ``part`` gives per key for a block (x, y, train, and score if asked for)."""
        p, n = len(self.features), self.n_splits
        flags = ["train", "score"] if scored else ["train"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for x, y, *of in blocks(batches, p, n, len(flags)):
                for key, v in part(x, y, *of):
                    total[key] = total[key] + v if key in total else v
            for key, v in total.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["key", "v"])

        made = self._packed(*flags).mapInArrow(run, "key int, v array<double>")
        cells = made.select("key", F.posexplode("v").alias("at", "v")).groupBy("key", "at").agg(F.sum("v").alias("v")).toArrow()
        key, at, v = (cells.column(c).to_numpy() for c in ("key", "at", "v"))
        out = {}
        for k in np.unique(key):
            mine = key == k
            out[int(k)] = np.zeros(int(at[mine].max()) + 1)
            out[int(k)][at[mine]] = v[mine]
        return out

    def _count(self) -> None:
        """Rows of both classes per split, and which features have gaps."""
        n, p = self.n_splits, len(self.features)

        def part(x: np.ndarray, y: np.ndarray, train: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            yield 0, np.concatenate([np.isnan(x).sum(0).astype(float), np.nansum(x, 0), (~np.isnan(x)).sum(0)])
            classes = np.array([y == 0, y == 1], float)
            yield 1, np.concatenate([(classes @ train).ravel(), (classes @ score).ravel()])

        got = self.sums(part, scored=True)
        counts = got.get(1, np.zeros(4 * n)).astype(int).reshape(2, 2, n)
        self.train_counts, self.score_counts = (
            {s: (int(c[0, s]), int(c[1, s])) for s in range(n) if c[:, s].any()} for c in counts)
        flat = got.get(0, np.zeros(3 * p))
        holes = np.flatnonzero(flat[:p])
        self.whole_rows = not len(holes)
        self.centre = flat[p:2 * p] / np.maximum(flat[2 * p:], 1)
        self.fill = np.zeros((n, p))
        if len(holes):
            cells = F.array(*[F.struct(F.lit(int(k)).alias("at"), F.nanvl(F.col("_x")[int(k)], F.lit(None)).alias("value")) for k in holes])
            long = self.rows.select("_train", cells.alias("c")).select(F.explode("_train").alias("no"), "c")
            long = long.select("no", F.explode("c").alias("c")).select("no", "c.*")
            for r in quantiles(long, ["no", "at"], "value", {"m": 0.5}).collect():
                self.fill[r["no"], r["at"]] = r["m"]

    def _scale(self) -> None:
        n, p, centre, fill = self.n_splits, len(self.features), self.centre, self.fill

        def part(x: np.ndarray, y: np.ndarray, train: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            if not np.isnan(x).any():
                d, t = x - centre, train.T.astype(float)
                yield from enumerate(np.hstack([t @ d, t @ np.square(d), t.sum(1)[:, None]]))
                return
            for s in range(n):
                some = x[train[:, s]]
                some = np.where(np.isnan(some), fill[s], some) - centre
                yield s, np.concatenate([some.sum(0), np.square(some).sum(0), [len(some)]])

        self.mean, self.spread = np.zeros((n, p)), np.ones((n, p))
        for s, v in self.sums(part).items():
            m = v[-1] or 1.0
            mean = v[:p] / m
            var = np.maximum(v[p:2 * p] / m - mean * mean, 0.0)
            # What rounding leaves of a constant column is not a spread.
            var[var <= 1e-13 * (np.square(mean) + v[p:2 * p] / m)] = 0.0
            self.mean[s], self.spread[s] = mean + centre, np.where(var > 0, np.sqrt(var), 1.0)

    def _common(self) -> np.ndarray | None:
        """One unit per feature in which every split's columns are well scaled; None when there are gaps or no such unit."""
        unit = np.median(self.spread, 0)
        near = (self.spread <= 100 * unit) & (unit <= 100 * self.spread) & (np.abs(self.mean - self.centre) <= 100 * self.spread)
        return unit if self.whole_rows and near.all() else None

    def usable(self, score: bool) -> list[int]:
        """Splits with both classes among their training rows, and among the scored ones if asked for."""
        both = lambda counts, s: min(counts.get(s, (0, 0))) > 0
        return [s for s in range(self.n_splits) if both(self.train_counts, s) and (not score or both(self.score_counts, s))]

    def fit(self, sets: Mapping[str, Sequence[str]], splits: Sequence[int], c: float = 1.0) -> dict[tuple[int, str], Fitted]:
        """Balanced L2 logistic regressions of every split and feature set.

        The optimum of sum(w * loss) + |b|^2 / (2C) with w = n / (2 * n of the
        class) on columns scaled over the split's training rows; the intercept
        is free. A step that does not lower the loss is halved.
        """
        at = {f: k for k, f in enumerate(self.features)}
        fits: dict[int, tuple[int, str, Fitted]] = {}
        for s in splits:
            for name, fs in sets.items():
                cols = [at[f] for f in fs]
                fits[len(fits)] = (s, name, Fitted(cols, self.fill[s, cols], self.mean[s, cols], self.spread[s, cols], np.zeros(len(cols) + 1), 0))
        weight = {s: [sum(self.train_counts[s]) / (2.0 * k) for k in self.train_counts[s]] for s in splits}
        base = {k: (np.inf, f[2].beta, None) for k, f in fits.items()}
        active = dict(fits)
        unit = self._common()
        for step in range(STEPS):
            if not active:
                break
            now = {k: (s, f) for k, (s, _, f) in active.items()}
            if unit is None:
                sums = self.sums(_newton_part(now, weight))
            else:
                maps = {k: _to_scaled(f, self.centre, unit) for k, (_, f) in now.items()}
                shared = self.sums(_shared_part(now, weight, self.centre, unit, maps))
                sums = {k: _in_scaled(v, maps[k]) for k, v in shared.items()}
            for k, (s, _, fitted) in list(active.items()):
                m = len(fitted.beta)
                v, b = sums[k], fitted.beta
                loss = v[0] + (b[1:] @ b[1:]) / (2 * c)
                was, origin, move = base[k]
                if move is not None and loss > was + 1e-12 * (1 + abs(was)) and np.abs(move).max() > TOLERANCE:
                    move = move / 2
                    base[k], fitted.beta = (was, origin, move), origin + move
                    continue
                grad, info = v[1:m + 1].copy(), np.zeros((m, m))
                info[np.triu_indices(m)] = v[m + 1:]
                info = np.triu(info) + np.triu(info, 1).T
                grad[1:] += b[1:] / c
                info[np.arange(1, m), np.arange(1, m)] += 1 / c
                move = -np.linalg.lstsq(info, grad, rcond=None)[0]
                base[k], fitted.beta, fitted.steps = (loss, b, move), b + move, step + 1
                if np.abs(move).max() < TOLERANCE:
                    del active[k]
        if active:
            raise RuntimeError(f"{len(active)} fits did not converge in {STEPS} steps")
        return {(s, name): f for s, name, f in fits.values()}

    def scored(self, fits: Mapping[tuple[int, str], Fitted], keep: Sequence[str] | None = None) -> DataFrame:
        """no, feature_set, the kept columns (or ``keep`` of them), y_true, y_score, y_pred: every scored row of every split by its fits."""
        p, n, taken = len(self.features), self.n_splits, self._taken(keep)
        schema = T.StructType([
            T.StructField("no", T.IntegerType()), T.StructField("feature_set", T.StringType()), *[self.kinds[k] for k in taken],
            T.StructField("y_true", T.IntegerType()), T.StructField("y_score", T.DoubleType()), T.StructField("y_pred", T.IntegerType())])
        by_split: dict[int, list[tuple[str, Fitted]]] = {}
        for (s, name), f in fits.items():
            by_split.setdefault(s, []).append((name, f))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, y, score, *kept in blocks(batches, p, n, 1):
                for s, models in by_split.items():
                    mine = np.flatnonzero(score[:, s])
                    if not len(mine):
                        continue
                    some, of = x[mine], [kept[0][k].take(pa.array(mine)) for k in taken]
                    no, true = pa.array(np.full(len(mine), s, np.int32)), pa.array(y[mine].astype(np.int32))
                    for name, f in models:
                        z = 1 / (1 + np.exp(-np.clip(f.beta[0] + f.scaled(some) @ f.beta[1:], -700, 700)))
                        yield pa.RecordBatch.from_arrays(
                            [no, pa.repeat(name, len(mine)), *of, true, pa.array(z), pa.array((z >= 0.5).astype(np.int32))], names=schema.names)

        return self._packed("score", *["kept"] * bool(taken)).mapInArrow(run, schema)

    def _taken(self, keep: Sequence[str] | None) -> list[int]:
        return [k for k, c in enumerate(self.keep) if keep is None or c in keep]

    def margin_parts(self, fits: Mapping[int, Fitted]) -> DataFrame:
        """no, the kept columns, y_true, the margin ``_m`` and what each feature adds to it, ``_c``, of every scored row."""
        p, n = len(self.features), self.n_splits
        schema = T.StructType([T.StructField("no", T.IntegerType()), *self.kinds, T.StructField("y_true", T.IntegerType()),
                               T.StructField("_m", T.DoubleType()), T.StructField("_c", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, y, score, kept in blocks(batches, p, n, 1):
                for s, f in fits.items():
                    mine = np.flatnonzero(score[:, s])
                    if not len(mine):
                        continue
                    parts = f.scaled(x[mine]) * f.beta[1:]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * parts.shape[1]), pa.array(parts.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), s, np.int32)), *[c.take(pa.array(mine)) for c in kept],
                         pa.array(y[mine].astype(np.int32)), pa.array(f.beta[0] + parts.sum(1)), lists], names=schema.names)

        return self._packed("score", "kept").mapInArrow(run, schema)


def _packer(kept: int, p: int, words: int):
    """Rows of ``kept`` columns, a label, ``p`` features and ``words`` longs of flags per role, as packed blocks."""
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(p, 1))))

    def together(columns: Sequence[pa.Array]) -> bytes:
        return b"".join(c.to_numpy(zero_copy_only=False).tobytes() for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                y, x, flags = b.columns[kept], b.columns[kept + 1:kept + 1 + p], b.columns[kept + 1 + p:]
                held = b""
                if kept:
                    sink = pa.BufferOutputStream()
                    own = pa.RecordBatch.from_arrays(b.columns[:kept], names=[str(k) for k in range(kept)])
                    with pa.ipc.new_stream(sink, own.schema) as out:
                        out.write_batch(own)
                    held = sink.getvalue().to_pybytes()
                cells = [together(x), together([y]), together(flags[:words]), together(flags[words:]), held]
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]],
                                                 names=["n", "x", "y", "train", "score", "kept"])

    return run


def blocks(batches: Iterator[pa.RecordBatch], p: int, n: int, lists: int) -> Iterator[tuple]:
    """(x, y, a table of flags per role, and the kept columns if they are read) of every packed block."""
    split = np.arange(n)

    def flags(cell: pa.Scalar, rows: int) -> np.ndarray:
        words = np.frombuffer(cell.as_buffer(), np.int64).reshape(-1, rows)
        return (words[split // FLAGS] >> (split % FLAGS)[:, None] & 1).astype(bool).T

    for b in batches:
        for rows, x, y, *more in zip(*b.columns):
            rows = rows.as_py()
            out = [np.frombuffer(x.as_buffer(), float).reshape(p, rows).T, np.frombuffer(y.as_buffer(), float)]
            out += [flags(c, rows) for c in more[:lists]]
            for cell in more[lists:]:
                held = cell.as_buffer()
                out.append(pa.ipc.open_stream(held).read_next_batch().columns if held.size else [])
            yield tuple(out)


def _newton_part(fits: Mapping[int, tuple[int, Fitted]], weight: Mapping[int, Sequence[float]]):
    """Loss, gradient and upper information matrix of the fits on a block of rows."""

    def part(x: np.ndarray, y: np.ndarray, train: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for k, (s, f) in fits.items():
            mine = train[:, s]
            z = np.hstack([np.ones((int(mine.sum()), 1)), f.scaled(x[mine])])
            t = y[mine]
            w = np.where(t == 1, weight[s][1], weight[s][0])
            margin = z @ f.beta
            mu = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            loss = (w * (np.logaddexp(0, margin) - t * margin)).sum()
            info = (z.T * (w * mu * (1 - mu))) @ z
            yield k, np.concatenate([[loss], z.T @ (w * (mu - t)), info[np.triu_indices(len(f.beta))]])

    return part


def _to_scaled(f: Fitted, centre: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Matrix from the columns (1, (x - centre) / unit) of all features to the scaled columns of a fit."""
    out = np.zeros((len(centre) + 1, len(f.columns) + 1))
    out[0, 0] = 1
    out[0, 1:] = (centre[f.columns] - f.mean) / f.scale
    out[1 + np.array(f.columns, int), np.arange(1, len(f.columns) + 1)] = unit[f.columns] / f.scale
    return out


def _in_scaled(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper information matrix over the common columns as those of a fit's own columns."""
    q, m = to.shape
    info = np.zeros((q, q))
    info[np.triu_indices(q)] = v[q + 1:]
    info = to.T @ (np.triu(info) + np.triu(info, 1).T) @ to
    return np.concatenate([v[:1], to.T @ v[1:q + 1], info[np.triu_indices(m)]])


#: Products of two columns at most that are formed once for all fits.
PRODUCTS = 128


def _shared_part(fits: Mapping[int, tuple[int, Fitted]], weight: Mapping[int, Sequence[float]], centre: np.ndarray, unit: np.ndarray,
                 maps: Mapping[int, np.ndarray]):
    """``_newton_part`` of all fits at once on columns without gaps: a block is scaled once, rows outside a split weigh nothing."""
    keys = list(fits)
    splits = [fits[k][0] for k in keys]
    beta = np.column_stack([maps[k] @ fits[k][1].beta for k in keys])
    zero, one = (np.array([weight[s][c] for s in splits]) for c in (0, 1))
    a, b = np.triu_indices(len(centre) + 1)

    def part(x: np.ndarray, y: np.ndarray, train: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        g = np.hstack([np.ones((len(x), 1)), (x - centre) / unit])
        margin, t = g @ beta, y[:, None]
        w = np.where(t == 1, one, zero) * train[:, splits]
        e = np.exp(-np.abs(margin))
        mu = np.where(margin >= 0, 1, e) / (1 + e)
        loss = (w * (np.log1p(e) + np.maximum(margin, 0) - t * margin)).sum(0)
        grad, curve = (w * (mu - t)).T @ g, w * mu * (1 - mu)
        if len(a) <= PRODUCTS:
            info = curve.T @ (g[:, a] * g[:, b])
        else:
            info = np.array([((g.T * c) @ g)[a, b] for c in curve.T])
        yield from zip(keys, np.hstack([loss[:, None], grad, info]))

    return part
