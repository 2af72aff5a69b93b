"""Comparing groups by category: crosstabs, overlap, profiles, distances."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scores import severity_score
from .ranks import quantiles


def pairs_of(members: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(members, 2))


def wide(df: DataFrame, unit: Sequence[str], group: str, value: str, members: Sequence[str],
         prefix: str = "m_", complete: bool = True) -> DataFrame:
    """One row per unit with a column per member (one shuffle, combined map-side)."""
    w = df.groupBy(*unit).agg(*[
        F.max(F.when(F.col(group) == m, F.col(value))).alias(f"{prefix}{i}") for i, m in enumerate(members)
    ])
    if complete:
        for i in range(len(members)):
            w = w.where(F.col(f"{prefix}{i}").isNotNull())
    return w


def pairwise(df: DataFrame, unit: Sequence[str], group: str, value: str, members: Sequence[str]) -> DataFrame:
    """Values of every unordered member pair on the units that both have.

    The pairs come from the fixed member list inside each unit's row; rows are
    never joined to each other.
    """
    w = wide(df, unit, group, value, members, complete=False)
    cells = [
        F.struct(F.lit(members[i]).alias("group_a"), F.lit(members[j]).alias("group_b"),
                 F.col(f"m_{i}").alias("value_a"), F.col(f"m_{j}").alias("value_b"))
        for i, j in combinations(range(len(members)), 2)
    ]
    out = w.select(*unit, F.explode(F.array(*cells)).alias("_p")).select(*unit, "_p.*")
    return out.where(F.col("value_a").isNotNull() & F.col("value_b").isNotNull())


def crosstab(df: DataFrame, category: str, group: str, members: Sequence[str]) -> DataFrame:
    """Counts per category and member, with their spread and total."""
    ct = df.groupBy(category).agg(*[F.count_if(F.col(group) == m).alias(m) for m in members])
    cols = [F.col(m) for m in members]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    spread = F.greatest(*cols) - F.least(*cols) if len(cols) > 1 else F.lit(0)
    return ct.withColumns({"spread": spread.cast("long"), "total": total}).where(F.col("total") > 0)


def _extreme(members: Sequence[str], largest: bool) -> Column:
    """Name of the first member that holds the largest (smallest) count."""
    best = F.greatest(*[F.col(m) for m in members]) if largest else F.least(*[F.col(m) for m in members])
    out = F.lit(members[-1])
    for m in reversed(members[:-1]):
        out = F.when(F.col(m) == best, F.lit(m)).otherwise(out)
    return out


def category_shares(ct: DataFrame, members: Sequence[str]) -> DataFrame:
    """Share of each member in a category, and who holds maximum and minimum."""
    total = F.greatest(F.col("total"), F.lit(1))
    return ct.withColumns({
        **{f"{m}_share": F.col(m) / total for m in members},
        "max_member": _extreme(members, True), "min_member": _extreme(members, False),
    })


def pairwise_category_diff(ct: DataFrame, category: str, members: Sequence[str], n: int = 5) -> DataFrame:
    """Per member pair the ``n`` categories that differ most, with their totals."""
    totals = ct.agg(F.struct(*[F.sum(m).alias(m) for m in members])).scalar()
    cells = [
        F.struct(F.lit(a).alias("group_a"), F.lit(b).alias("group_b"), F.col(a).alias("count_a"),
                 F.col(b).alias("count_b")) for a, b in pairs_of(members)
    ]
    d = ct.select(category, F.explode(F.array(*cells)).alias("_p")).select(category, "_p.*")
    gap = F.abs(F.col("count_a") - F.col("count_b"))
    d = d.withColumns({
        "difference": gap,
        "pct_difference": gap / F.greatest("count_a", "count_b", F.lit(1)) * 100.0,
    })
    # The crosstab has one row per category, so this window ranks a short list.
    order = W.partitionBy("group_a", "group_b").orderBy(F.desc("difference"), category)
    d = d.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).withColumn("_t", totals)

    def total(side):
        out = F.lit(None).cast("long")
        for m in members:
            out = F.when(F.col(side) == m, F.col("_t")[m]).otherwise(out)
        return out

    a, b = total("group_a"), total("group_b")
    return d.withColumns({
        "total_difference": a - b,
        "pct_total_difference": F.abs(a - b) / F.greatest(a, b, F.lit(1)) * 100.0,
    }).drop("_t")


def top_categories(ct: DataFrame, category: str, by: str = "total", n: int = 25) -> DataFrame:
    """The ``n`` leading categories by total or spread (a report of fixed length)."""
    return ct.orderBy(F.desc(by), category).limit(n)


def _key_flags(df: DataFrame, group: str, key: Sequence[str], members: Sequence[str]) -> DataFrame:
    return df.where(F.col(group).isin(list(members))).groupBy(*key).agg(*[
        F.max((F.col(group) == m).cast("long")).alias(f"f_{i}") for i, m in enumerate(members)
    ])


def overlap(df: DataFrame, group: str, key: Sequence[str], members: Sequence[str]) -> DataFrame:
    """Keys per member in total, only there, and common to all members."""
    k = len(members)
    flags = [F.col(f"f_{i}") for i in range(k)]
    held = flags[0]
    for f in flags[1:]:
        held = held + f
    sums = _key_flags(df, group, key, members).agg(
        *[F.sum(flags[i]).alias(f"t_{i}") for i in range(k)],
        *[F.sum(F.when(held == 1, flags[i]).otherwise(0)).alias(f"u_{i}") for i in range(k)],
        F.sum((held == k).cast("long")).alias("common_all"),
    )
    rows = F.array(*[
        F.struct(F.lit(m).alias("member"), F.coalesce(f"t_{i}", F.lit(0)).alias("total"),
                 F.coalesce(f"u_{i}", F.lit(0)).alias("unique_keys"),
                 F.coalesce("common_all", F.lit(0)).alias("common_all"))
        for i, m in enumerate(members)
    ])
    out = sums.select(F.explode(rows).alias("_r")).select("_r.*")
    return out.withColumn("unique_share", F.col("unique_keys") / F.greatest("total", F.lit(1)))


def jaccard(df: DataFrame, group: str, key: Sequence[str], members: Sequence[str]) -> DataFrame:
    """Pairwise |A and B| / |A or B|; the first closest and farthest pair are marked."""
    k = len(members)
    idx = list(combinations(range(k), 2))
    sums = _key_flags(df, group, key, members).agg(
        *[F.sum(F.col(f"f_{i}") * F.col(f"f_{j}")).alias(f"i_{i}_{j}") for i, j in idx],
        *[F.sum(F.greatest(f"f_{i}", f"f_{j}")).alias(f"u_{i}_{j}") for i, j in idx],
    )
    rows = F.array(*[
        F.struct(
            F.lit(members[i]).alias("group_a"), F.lit(members[j]).alias("group_b"),
            F.coalesce(f"i_{i}_{j}", F.lit(0)).alias("both"),
            F.coalesce(f"u_{i}_{j}", F.lit(0)).alias("either"),
            F.coalesce(F.try_divide(f"i_{i}_{j}", f"u_{i}_{j}"), F.lit(0.0)).alias("jaccard"),
        ) for i, j in idx
    ])
    vals = F.transform("_rows", lambda r: r["jaccard"])
    out = sums.select(rows.alias("_rows")).select(
        F.posexplode("_rows").alias("_i", "_r"),
        F.array_position(vals, F.array_max(vals)).alias("_hi"),
        F.array_position(vals, F.array_min(vals)).alias("_lo"),
    )
    return out.select(
        "_r.*",
        (F.col("_i") + 1 == F.col("_hi")).cast("int").alias("is_closest"),
        (F.col("_i") + 1 == F.col("_lo")).cast("int").alias("is_farthest"),
    )


# Items whose pairs one row expands to.
PAIR_BLOCK = 256


def cooccurrence(df: DataFrame, basket: Sequence[str], item: str, by: Sequence[str] = ()) -> DataFrame:
    """Baskets that hold both items, per unordered item pair.

    Equal item sets are counted first, so pairs are formed once per distinct
    set. A set is cut into blocks of first items, dealt out before their pairs
    are formed; pairs are summed before they are shuffled.
    """
    by = list(by)
    key = [*by, *basket]
    d = df.where(F.col(item).isNotNull()).select(*key, item).distinct()
    sets = d.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    sets = sets.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_c"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_s"), F.lit(1)), F.lit(PAIR_BLOCK))
    blocks = sets.select(*by, "_c", "_s", F.explode(starts).alias("_at"))
    firsts = blocks.select(
        *by, "_c", "_s", "_at", F.posexplode(F.slice("_s", F.col("_at"), F.lit(PAIR_BLOCK))).alias("_i", "item_a"))
    pairs = firsts.select(
        *by, "_c", "item_a",
        F.explode(F.slice("_s", F.col("_at") + F.col("_i") + 1, F.size("_s"))).alias("item_b"),
    )
    return pairs.groupBy(*by, "item_a", "item_b").agg(F.sum("_c").alias("n_baskets"))


def graph_density(df: DataFrame, basket: Sequence[str], item: str, by: Sequence[str]) -> DataFrame:
    """Edges, nodes, density 2E/(N(N-1)) and mean pair count of the item graph."""
    by = list(by)
    edges = cooccurrence(df, basket, item, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("edges"), F.avg("n_baskets").alias("cooc_avg")
    )
    nodes = df.groupBy(*by).agg(F.count_distinct(item).alias("nodes"))
    out = nodes.join(edges, by, "left").na.fill(0, ["edges"]).na.fill(0.0, ["cooc_avg"])
    full = F.col("nodes") * (F.col("nodes") - 1)
    return out.withColumn("density", F.when(F.col("nodes") > 1, 2.0 * F.col("edges") / full).otherwise(0.0))


def entropy(df: DataFrame, group: Sequence[str], category: str) -> DataFrame:
    """Shannon entropy (bits) of the category within each group."""
    group = list(group)
    n = df.groupBy(*group, category).agg(F.count(F.lit(1)).alias("_n"))
    # sum(-p log p) = log N - sum(n log n) / N, so one pass over the counts is enough.
    g = n.groupBy(*group).agg(F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.log2("_n")).alias("_s"))
    return g.select(*group, F.greatest(F.lit(0.0), F.log2("_t") - F.col("_s") / F.col("_t")).alias("entropy"))


# Hub categories and the published top list.
HUB_CWES = ["CWE-703", "CWE-327"]
TOP_CWES = [
    "CWE-20", "CWE-78", "CWE-79", "CWE-89", "CWE-200", "CWE-287", "CWE-295", "CWE-319", "CWE-326",
    "CWE-327", "CWE-502", "CWE-614",
]


def profile_vector(findings: DataFrame, group: Sequence[str], basket: Sequence[str]) -> DataFrame:
    """Risk profile of a group: volume, severity mix, categories, confidence, graph."""
    group = list(group)
    sev = F.upper("severity")
    base = findings.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.count_distinct("cwe").alias("n_cwe_unique"),
        F.avg((sev == "HIGH").cast("double")).alias("p_high"),
        F.avg((sev == "MEDIUM").cast("double")).alias("p_medium"),
        F.max(F.col("cwe").isin(HUB_CWES).cast("int")).alias("hub_presence"),
        F.avg(severity_score("confidence", 1).cast("double")).alias("avg_confidence"),
        F.avg(F.col("cwe").isin(TOP_CWES).cast("double")).alias("top_list_ratio"),
    )
    bits = entropy(findings, group, "cwe").withColumnRenamed("entropy", "entropy_cwe")
    graph = graph_density(findings, basket, "cwe", group).select(
        *group, "cooc_avg", F.col("density").alias("cluster_density")
    )
    return base.join(bits, group, "left").join(graph, group, "left")


def risk_label(profile: DataFrame) -> DataFrame:
    """Composite score and whether it reaches the median score."""
    c = F.col
    score = (
        c("n_findings") * (1 + c("p_high") + 0.5 * c("p_medium")) * (1 + c("top_list_ratio"))
        * (1 + 0.3 * c("hub_presence")) * (1 + 0.1 * c("entropy_cwe"))
        * (1 + 0.05 * c("cluster_density")) * (1 + 0.05 * c("cooc_avg"))
        * (1 + 0.05 * (c("avg_confidence") / 3.0))
    )
    scored = profile.withColumn("risk_score", score)
    middle = quantiles(scored, [], "risk_score", {"m": 0.5}).select("m").scalar()
    return scored.withColumn("risk_label", (F.col("risk_score") >= middle).cast("int"))


def hellinger(df: DataFrame, group: str, a: str, b: str, category: str, by: Sequence[str] = ()) -> DataFrame:
    """Hellinger distance of the category distributions of two groups."""
    by = list(by)
    n = df.where(F.col(group).isin(a, b)).groupBy(*by, category).agg(
        F.count_if(F.col(group) == a).alias("_na"), F.count_if(F.col(group) == b).alias("_nb")
    )
    # sum (sqrt p - sqrt q)^2 = [A present] + [B present] - 2 sum sqrt(p q): one pass over the counts.
    root = F.sqrt(F.col("_na").cast("double")) * F.sqrt(F.col("_nb").cast("double"))
    g = n.groupBy(*by).agg(F.sum("_na").alias("ta"), F.sum("_nb").alias("tb"), F.sum(root).alias("_s"))
    ta, tb = F.col("ta").cast("double"), F.col("tb").cast("double")
    cross = F.when((ta > 0) & (tb > 0), F.col("_s") / F.sqrt(ta * tb)).otherwise(0.0)
    square = (ta > 0).cast("double") + (tb > 0).cast("double") - 2.0 * cross
    return g.select(*by, "ta", "tb", (F.sqrt(F.greatest(F.lit(0.0), square)) / F.sqrt(F.lit(2.0))).alias("hellinger"))


def chi_square(df: DataFrame, row: str, column: str, by: Sequence[str] = (),
               weight: str | None = None) -> DataFrame:
    """Chi-square of independence and Cramer's V, empty cells included.

    sum (o-e)^2/e over all cells equals N (sum o^2/(r c) - 1), so only the
    occupied cells and the margins are needed.
    """
    by = list(by)
    unit = F.col(weight) if weight else F.lit(1)
    cells = df.groupBy(*by, row, column).agg(F.sum(unit).cast("long").alias("_o"))
    rows = cells.groupBy(*by, row).agg(F.sum("_o").alias("_r"))
    cols = cells.groupBy(*by, column).agg(F.sum("_o").alias("_c"))
    o = F.col("_o").cast("double")
    part = cells.join(rows, [*by, row]).join(cols, [*by, column])
    g = part.groupBy(*by).agg(
        F.sum("_o").alias("n"),
        F.sum(o * o / (F.col("_r").cast("double") * F.col("_c"))).alias("_s"),
        F.count_distinct(row).alias("n_rows"), F.count_distinct(column).alias("n_cols"),
    )
    chi = F.greatest(F.lit(0.0), F.col("n") * (F.col("_s") - 1.0))
    k = F.least("n_rows", "n_cols")
    out = g.withColumn("chi2", chi)
    return out.withColumns({
        "df": (F.col("n_rows") - 1) * (F.col("n_cols") - 1),
        "cramers_v": F.when(k > 1, F.sqrt(F.col("chi2") / (F.col("n") * (k - 1)))).otherwise(0.0),
    }).drop("_s")


def two_corpus_shift(df: DataFrame, corpus: str, a: str, b: str, category: str, group: str) -> DataFrame:
    """Per group: total before and after, change, and Hellinger distance of categories."""
    n = df.groupBy(group).agg(
        F.count_if(F.col(corpus) == a).alias("before_total"),
        F.count_if(F.col(corpus) == b).alias("after_total"),
    ).where((F.col("before_total") > 0) & (F.col("after_total") > 0))
    h = hellinger(df, corpus, a, b, category, [group]).select(group, "hellinger")
    delta = F.col("after_total") - F.col("before_total")
    return n.join(h, group).withColumns({
        "delta": delta, "pct_change": delta / F.greatest("before_total", F.lit(1)) * 100.0,
    })


def two_corpus_category_delta(
    df: DataFrame, corpus: str, a: str, b: str, category: str, group: str, members: Sequence[str]
) -> DataFrame:
    """Per category the after-minus-before count of every member and their absolute sum."""
    sign = F.when(F.col(corpus) == b, 1).when(F.col(corpus) == a, -1).otherwise(0)
    out = df.groupBy(category).agg(*[
        F.sum(F.when(F.col(group) == m, sign).otherwise(0)).cast("long").alias(f"{m}_delta") for m in members
    ])
    total = F.lit(0)
    for m in members:
        total = total + F.abs(F.col(f"{m}_delta"))
    return out.withColumn("total_abs_delta", total.cast("long"))


def rate_per_changed_lines(findings: DataFrame, diffs: DataFrame, group: str, key: Sequence[str]) -> DataFrame:
    """Changed lines, touched files and findings per thousand changed lines.

    ``diffs`` carries patch_added, patch_removed and an array ``files``.
    """
    size = diffs.groupBy(group).agg(
        F.sum("patch_added").alias("lines_added"), F.sum("patch_removed").alias("lines_removed")
    )
    files = diffs.select(group, F.explode("files").alias("_f")).distinct().groupBy(group).agg(
        F.count(F.lit(1)).alias("files_touched")
    )
    found = findings.select(group, *key).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n_findings"))
    out = size.join(files, group, "left").join(found, group, "left").na.fill(0, ["files_touched", "n_findings"])
    changed = F.col("lines_added") + F.col("lines_removed")
    return out.withColumns({
        "lines_changed": changed,
        "findings_per_1k_changed": F.col("n_findings") / (F.greatest(changed, F.lit(1)) / 1000.0),
    })
