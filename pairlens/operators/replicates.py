"""Resampling: bootstrap intervals, sign flips and permutation tests.

Rows are never multiplied by replicates. Each task folds its rows into one sum
per (group, replicate) with numpy and only those sums are shuffled. Margins that
all rows share are split along a binary tree over cells of rows; a draw at a
node depends on the node only, so that a task which walks to its own cell agrees
with all others without seeing them.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.draws import PRIME, md5_draw, replicate_constants
from ..functions.hypergeometric import hypergeometric
from ..shipping import ship
from .keys import key_join
from .ranks import positions
from .staging import stage

# Groups held in a task before its partial sums are handed on.
FLUSH_GROUPS = 256
#: Rows that a cell of a group is meant to hold, signs held at once, and draws made at once (they stay in the cache).
CELL_ROWS, DRAWS, PICKS = 4096, 2_000_000, 1 << 16


def sign_sums(df: DataFrame, by: Sequence[str], value: str, ids: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Per (group, replicate): the sum of values times a fair +1/-1.

    Signs are functions of the row ids, the seed and the replicate only.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("_v"), (md5_draw(*ids) % PRIME).alias("_x"),
        (md5_draw(*ids, word=1) % PRIME).alias("_y")
    )
    fields = [rows.schema[c] for c in by]
    schema = StructType([*fields, StructField("rep", LongType()), StructField("_wv", DoubleType())])

    def fold(batches):
        import numpy as np
        import pandas as pd

        a, c, b = replicate_constants(seed, replicates)
        acc: dict[tuple, np.ndarray] = {}

        def emit():
            parts = []
            for key, wv in acc.items():
                part = pd.DataFrame({"rep": np.arange(1, replicates + 1), "_wv": wv})
                for c_, k in zip(by, key):
                    part[c_] = k
                parts.append(part[[*by, "rep", "_wv"]])
            acc.clear()
            return pd.concat(parts, ignore_index=True)

        for pdf in batches:
            groups = pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]
            for key, g in groups:
                key = key if isinstance(key, tuple) else (key,)
                if key not in acc:
                    if len(acc) >= FLUSH_GROUPS:
                        yield emit()
                    acc[key] = np.zeros(replicates)
                x, y = g["_x"].to_numpy(np.int64), g["_y"].to_numpy(np.int64)
                v = g["_v"].to_numpy(np.float64)
                # A block of rows times all replicates stays below a few MB.
                step = max(1, DRAWS // replicates)
                for i in range(0, len(x), step):
                    u = (a[None, :] * x[i:i + step, None] + c[None, :] * y[i:i + step, None] + b[None, :]) % PRIME
                    acc[key] += v[i:i + step] @ np.where(u < PRIME // 2, 1.0, -1.0)
        if acc:
            yield emit()

    part = rows.mapInPandas(fold, schema)
    return part.groupBy(*by, "rep").agg(F.sum("_wv").alias("wv"))


def tree_paths(cells: DataFrame, by: Sequence[str], levels: str, cell: str, size: str) -> DataFrame:
    """``cells`` with the steps from the root of their group's tree to them, as ``path``.

    Cells are numbered by ``levels`` bits, the first of which parts the root. A
    step has its depth and node, the rows below the node and below its left
    half, and which half is taken. One aggregate gives all nodes.
    """
    by = list(by)
    up = F.expr(f"CAST({levels} - d AS INT)")
    steps = cells.where(F.col(levels) > 0).select(*by, cell, size, F.explode(F.sequence(F.lit(0), F.col(levels) - 1)).alias("d"), levels)
    steps = steps.select(*by, cell, size, "d", F.call_function("shiftright", F.col(cell), up).alias("node"),
                         F.call_function("shiftright", F.col(cell), up - 1).bitwiseAND(F.lit(1)).cast("int").alias("half"))
    nodes = steps.groupBy(*by, "d", "node").agg(
        F.sum(size).alias("total"), F.sum(F.when(F.col("half") == 0, F.col(size)).otherwise(0)).alias("left"))
    path = key_join(steps, nodes, [*by, "d", "node"]).groupBy(*by, cell).agg(
        F.array_sort(F.collect_list(F.struct("d", "node", "total", "left", "half"))).alias("path"))
    return key_join(cells, path, [*by, cell], "left").withColumn("path", F.coalesce("path", F.array().cast(path.schema["path"].dataType)))


def levels_of(n: Column, each: Column | int) -> Column:
    """Halvings after which ``n`` rows are about ``each`` per cell."""
    return F.greatest(F.lit(0), F.ceil(F.log2(n / each))).cast("int")


def _key(by: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]) if by else F.lit("")


def _node_rng(seed: int, key: str, *node: int):
    import hashlib

    import numpy as np

    word = int.from_bytes(hashlib.md5(f"{seed}|{key}".encode()).digest()[:8], "big")
    return np.random.default_rng([seed, word, *map(int, node)])


def multinomial_sums(df: DataFrame, by: Sequence[str], value: str, ids: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Per (group, replicate): the number of draws, which is the group's size, and the sum of the values drawn.

    A replicate draws as many rows with replacement as the group has. Draws are
    split binomially along a tree over cells of rows (by a hash of their ids);
    inside a cell every draw picks a row.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("_v"), md5_draw(*ids).alias("_x"), md5_draw(*ids, word=1).alias("_y"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    tagged = key_join(rows, sizes.select(*by, levels_of(F.col("_n"), CELL_ROWS).alias("_levels")), by)
    tagged = stage(tagged.withColumn("_cell", F.expr("shiftright(_x, 32 - _levels)")))
    cells = tagged.groupBy(*by, "_levels", "_cell").agg(F.count(F.lit(1)).alias("_c"))
    paths = stage(tree_paths(cells, by, "_levels", "_cell", "_c").withColumn("_key", _key(by)).select(*by, "_cell", "_key", "path"))
    schema = StructType([*[rows.schema[c] for c in by], StructField("rep", LongType()), StructField("_w", LongType()), StructField("_wv", DoubleType())])

    def run(some, way):
        import numpy as np
        import pyarrow as pa

        from pairlens.functions.draws import picks, replicate_seeds

        order = [("_x", "ascending"), ("_y", "ascending"), ("_v", "ascending")]
        v = some.sort_by(order).column("_v").to_numpy()
        key, cell, path = (way.column(c)[0].as_py() for c in ("_key", "_cell", "path"))
        here = np.full(replicates, path[0]["total"] if path else len(v), np.int64)
        for at in path:
            left = _node_rng(seed, key, at["d"], at["node"]).binomial(here, at["left"] / at["total"])
            here = here - left if at["half"] else left
        seeds = replicate_seeds(f"{seed}|{key}|{cell}", np.arange(replicates))
        sums, step = np.zeros(replicates), max(1, PICKS // max(1, int(here.max(initial=1))))
        for a in range(0, replicates, step):
            k = here[a:a + step]
            which = np.repeat(np.arange(len(k)), k)
            j = np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
            sums[a:a + step] = np.bincount(which, v[picks(seeds[a:a + step][which], j, len(v))], len(k))
        first = pa.array(np.zeros(replicates, np.int64))
        return pa.table([*[way.column(c).take(first) for c in by], pa.array(np.arange(1, replicates + 1)), pa.array(here), pa.array(sums)],
                        names=[*by, "rep", "_w", "_wv"])

    ship(df.sparkSession)
    part = tagged.select(*by, "_cell", "_v", "_x", "_y").groupBy(*by, "_cell").cogroup(paths.groupBy(*by, "_cell")).applyInArrow(run, schema)
    return part.groupBy(*by, "rep").agg(F.sum("_w").alias("w"), F.sum("_wv").alias("wv"))


def _interval(reps: DataFrame, by: Sequence[str], value: str, alpha: float) -> DataFrame:
    # Replicates per group are a fixed number, so the built-in exact percentile is bounded.
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return reps.groupBy(*by).agg(q.alias("_q"), F.count(value).alias("replicates")).select(
        *by, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"), "replicates"
    )


def bootstrap_mean_ci(df: DataFrame, by: Sequence[str], value: str, ids: Sequence[str],
                      replicates: int = 10_000, seed: int = 2026, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean of every group, rows drawn with replacement."""
    means = multinomial_sums(df, by, value, ids, replicates, seed).withColumn("_m", F.col("wv") / F.col("w"))
    return _interval(means, by, "_m", alpha)


def bootstrap_median_ci(df: DataFrame, by: Sequence[str], value: str, ids: Sequence[str],
                        replicates: int = 10_000, seed: int = 2026, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the median of every group, rows drawn with replacement.

    The median of a replicate is the value at one or two ranks. Draws are split
    binomially along a tree over ranges of ranks; only the half that holds the
    middle draw is followed, down to a cell whose draws are made one by one.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), *[c for c in ids if c not in by])
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", _key(by))
    fields = [sizes.schema[c] for c in by]
    schema = StructType([*fields, StructField("rep", LongType()), StructField("_k", LongType())])

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                n, key = one.column("_n")[0].as_py(), one.column("_key")[0].as_py()
                middle = [(n - 1) // 2] if n % 2 else [n // 2 - 1, n // 2]
                ranks = order_statistics(seed, key, n, middle, replicates)
                first = pa.array(np.zeros(ranks.size, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*[one.column(c).take(first) for c in by], pa.array(np.repeat(np.arange(1, replicates + 1), len(middle))), pa.array(ranks.ravel() + 1)],
                    names=[*by, "rep", "_k"])

    ship(df.sparkSession)
    chosen = sizes.mapInArrow(draw, schema)
    placed = positions(rows, by, "_v", ids, out="_k").select(*by, "_k", "_v")
    medians = key_join(chosen, placed, [*by, "_k"]).groupBy(*by, "rep").agg(F.avg("_v").alias("_m"))
    return _interval(medians, by, "_m", alpha)


def order_statistics(seed: int, key: str, n: int, places: Sequence[int], replicates: int):
    """Ranks (from 0) among n rows at the given places of every replicate's sorted draws: (replicates, places)."""
    import numpy as np

    from ..functions.draws import picks, replicate_seeds

    out = np.zeros((replicates, len(places)), np.int64)
    todo = [(0, n, np.arange(replicates), np.full(replicates, n, np.int64), np.tile(np.array(places, np.int64), (replicates, 1)))]
    while todo:
        lo, hi, reps, here, pos = todo.pop()
        if hi - lo > CELL_ROWS:
            mid = (lo + hi) // 2
            left = _node_rng(seed, key, lo, hi).binomial(here, (mid - lo) / (hi - lo))
            for a, b, k, p in ((lo, mid, left, np.where(pos < left[:, None], pos, -1)),
                               (mid, hi, here - left, np.where((pos >= left[:, None]) & (pos >= 0), pos - left[:, None], -1))):
                used = (p >= 0).any(1)
                if used.any():
                    todo.append((a, b, reps[used], k[used], p[used]))
            continue
        step = max(1, PICKS // max(1, int(here.max())))
        for a in range(0, len(reps), step):
            k, p, r = here[a:a + step], pos[a:a + step], reps[a:a + step]
            which = np.repeat(np.arange(len(k)), k)
            starts = np.cumsum(k) - k
            j = np.arange(len(which)) - np.repeat(starts, k)
            drawn = lo + picks(replicate_seeds(f"{seed}|{key}|{lo}", r)[which], j, hi - lo)
            drawn = drawn[np.lexsort((drawn, which))]
            for c in range(p.shape[1]):
                asked = p[:, c] >= 0
                out[r[asked], c] = drawn[(starts + p[:, c])[asked]]
    return out


def bootstrap_ci(df: DataFrame, by: Sequence[str], value: str, ids: Sequence[str], stat: str = "mean", **kw) -> DataFrame:
    """Percentile bootstrap interval of the mean or the median."""
    return (bootstrap_mean_ci if stat == "mean" else bootstrap_median_ci)(df, by, value, ids, **kw)


#: How label counts are drawn.
METHOD = "hypergeometric"


def sign_flip_test(df: DataFrame, by: Sequence[str], value: str, ids: Sequence[str],
                   replicates: int = 1000, seed: int = 7) -> DataFrame:
    """Two-sided paired permutation test on the absolute mean difference."""
    by = list(by)
    seen = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.sum(F.col(value).cast("double"))).alias("_obs")
    )
    flips = sign_sums(df, by, value, ids, replicates, seed)
    # A relative margin keeps equal sums equal in spite of rounding.
    if by:
        j = flips.join(seen, by)
        g = j.groupBy(*by, "n", "_obs")
    else:
        one = seen.select(F.struct("n", "_obs").alias("s")).select("s").scalar()
        j = flips.withColumns({"n": one["n"], "_obs": one["_obs"]})
        g = j.groupBy("n", "_obs")
    out = g.agg(F.count_if(F.abs("wv") >= F.col("_obs") * (1 - 1e-12)).alias("n_extreme"))
    return out.select(
        *by, "n", (F.col("_obs") / F.col("n")).alias("abs_mean"), "n_extreme",
        ((F.col("n_extreme") + 1) / F.lit(replicates + 1.0)).alias("p_value"),
    )


def _split(rng, counts, sizes, replicates):
    """Random allocation of cells (``counts``) to groups (``sizes``), margins fixed.

    ``counts`` is (cells,) or (replicates, cells); returns an array of shape
    (groups, replicates, cells).
    """
    import numpy as np

    left = np.array(np.broadcast_to(np.asarray(counts, np.int64), (replicates, np.shape(counts)[-1])))
    sizes = [np.broadcast_to(np.asarray(s, np.int64), (replicates,)) for s in sizes]
    out = []
    for size in sizes[:-1]:
        need = size.copy()
        rest = left.sum(axis=1)
        took = np.zeros_like(left)
        for c in range(left.shape[1]):
            rest = rest - left[:, c]
            took[:, c] = hypergeometric(rng, left[:, c], rest, need)
            need = need - took[:, c]
        left = left - took
        out.append(took)
    out.append(left)
    return np.stack(out)


def _descend(seed: int, path: Sequence[dict], sizes: Sequence[int], replicates: int):
    """How many labels of every group reach the cell at the end of ``path``: (groups, replicates)."""
    import numpy as np

    here = np.array([np.full(replicates, s, np.int64) for s in sizes])
    for at in path:
        rng = np.random.default_rng([seed, 0, at["d"], at["node"]])
        need, rest = np.full(replicates, at["left"], np.int64), here.sum(axis=0)
        left = np.zeros_like(here)
        for g in range(len(here)):
            rest = rest - here[g]
            left[g] = hypergeometric(rng, here[g], rest, need)
            need = need - left[g]
        here = here - left if at["half"] else left
    return here


def permutation_counts(cells: DataFrame, value: str, count: str, groups: dict[str, int], replicates: int,
                       seed: int, reduce, schema: str, shard_cells: int | None = None) -> DataFrame:
    """Label permutations of a value table, in shards.

    ``cells`` has one row per distinct value and its multiplicity. Values are
    hashed to the leaves of a tree; each task first draws how many labels of
    every group reach its leaf, then allocates its own cells. The nodes of the
    tree are a table that is joined with the leaves; the driver sees none of it.
    ``reduce(values, counts, allocation)`` turns the allocation (groups,
    replicates, cells) into rows to be summed by replicate.
    """
    if shard_cells is None:
        # A task holds groups x replicates x cells integers.
        shard_cells = max(64, 20_000_000 // (replicates * max(1, len(groups))))
    cells = stage(cells)
    levels = max(0, (-(-cells.count() // shard_cells) - 1).bit_length())
    sharded = cells.withColumn("_shard", F.pmod(F.xxhash64(value), F.lit(1 << levels)))
    sizes = sharded.groupBy("_shard").agg(F.sum(count).cast("long").alias("_size")).withColumn("_levels", F.lit(levels))
    paths = stage(tree_paths(sizes, [], "_levels", "_shard", "_size").select("_shard", "path"))
    group_sizes = list(groups.values())

    def run(pdf, way):
        import numpy as np

        own = _descend(seed, [step if isinstance(step, dict) else step.asDict() for step in way["path"].iloc[0]], group_sizes, replicates)
        pdf = pdf.sort_values(value, kind="stable")
        counts = pdf[count].to_numpy(np.int64)
        alloc = _split(np.random.default_rng([seed, 1, int(pdf["_shard"].iloc[0])]), counts, list(own), replicates)
        return reduce(pdf[value].to_numpy(), counts, alloc)

    ship(cells.sparkSession)
    return sharded.groupBy("_shard").cogroup(paths.groupBy("_shard")).applyInPandas(run, schema)


def permutation_chi_square(df: DataFrame, group: str, category: str, replicates: int = 500, seed: int = 123) -> DataFrame:
    """Chi-square with a permutation p-value; cost depends on the margins only."""
    from .compare import chi_square

    table = stage(df.groupBy(group, category).agg(F.count(F.lit(1)).alias("_n")))
    margin = table.groupBy(category).agg(F.sum("_n").alias("_n"))
    # One row per group label: the labels of the comparison, a short list.
    sizes = {r[0]: int(r[1]) for r in table.groupBy(group).agg(F.sum("_n")).orderBy(group).collect()}
    n = sum(sizes.values())

    def reduce(values, counts, alloc):
        import numpy as np
        import pandas as pd

        r = np.array(list(sizes.values()), dtype=float)
        part = (alloc.astype(float) ** 2 / (r[:, None, None] * counts[None, None, :])).sum(axis=(0, 2))
        return pd.DataFrame({"rep": np.arange(1, replicates + 1), "s": part})

    reps = permutation_counts(margin, category, "_n", sizes, replicates, seed, reduce, "rep long, s double")
    observed = chi_square(table, group, category, weight="_n")
    sim = reps.groupBy("rep").agg(F.sum("s").alias("s")).withColumn("stat", F.lit(float(n)) * (F.col("s") - 1))
    seen = observed.select("chi2").scalar()
    hits = sim.agg(F.count_if(F.col("stat") >= seen * (1 - 1e-9) - 1e-9)).scalar()
    return observed.withColumns({
        "iterations": F.lit(replicates), "p_perm": (hits + 1) / F.lit(replicates + 1.0), "method": F.lit(METHOD),
    })


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F statistic from one pass of sums; infinite without inner variance."""
    v = F.col(value).cast("double")
    g = df.where(v.isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"))
    t = g.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("s")).alias("within"), F.sum(F.col("n") * F.col("m")).alias("sx"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sxx"),
    )
    between = F.greatest(F.lit(0.0), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    dfw, dfb = F.col("n") - F.col("k"), F.greatest(F.col("k") - 1, F.lit(1))
    f = (
        F.when(dfw <= 0, F.lit(0.0)).when(F.col("within") <= 0, F.lit(float("inf")))
        .otherwise((between / dfb) / (F.col("within") / dfw))
    )
    return t.select(F.col("k").alias("n_groups"), "n", f.alias("f_stat"))


def permutation_anova(df: DataFrame, group: str, value: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """One-way F with the label-permutation p-value.

    Values are counted first; a replicate needs only the group sums of its
    random allocation, since the total sum of squares does not change.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    table = stage(rows.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n")))
    sizes = {r[0]: int(r[1]) for r in table.groupBy("_g").agg(F.sum("_n")).orderBy("_g").collect()}
    k, n = len(sizes), sum(sizes.values())
    observed = anova(df, group, value)
    if n - k <= 0:
        return observed.withColumns({"iterations": F.lit(0), "p_perm": F.lit(1.0), "method": F.lit(METHOD)})
    total = rows.agg(F.avg("_v").alias("m"), F.var_pop("_v").alias("v")).first()
    centre, tss = float(total["m"]), float(total["v"]) * n
    cells = table.groupBy("_v").agg(F.sum("_n").alias("_n"))
    names = [f"s{i}" for i in range(k)]

    def reduce(values, counts, alloc):
        import numpy as np
        import pandas as pd

        sums = alloc @ (values.astype(float) - centre)
        out = pd.DataFrame({"rep": np.arange(1, replicates + 1)})
        for i, c in enumerate(names):
            out[c] = sums[i]
        return out

    schema = "rep long, " + ", ".join(f"{c} double" for c in names)
    reps = permutation_counts(cells, "_v", "_n", sizes, replicates, seed, reduce, schema)
    sums = reps.groupBy("rep").agg(*[F.sum(c).alias(c) for c in names])
    between = F.lit(0.0)
    for c, size in zip(names, sizes.values()):
        between = between + F.col(c) * F.col(c) / float(size)
    within = F.greatest(F.lit(0.0), F.lit(tss) - between)
    f = F.when(within <= tss * 1e-14, F.lit(float("inf"))).otherwise(
        (between / max(k - 1, 1)) / (within / (n - k)))
    seen = observed.select("f_stat").scalar()
    hits = sums.select(f.alias("f")).agg(F.count_if(F.col("f") >= seen * (1 - 1e-9))).scalar()
    return observed.withColumns({
        "iterations": F.lit(replicates), "p_perm": (hits + 1) / F.lit(replicates + 1.0), "method": F.lit(METHOD),
    })
