"""From nested reports to flat findings, novelty, and case x model summaries."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scores import severity_score
from .keys import key_join
from .ranks import positions
from .staging import stage

UNIT = ["case", "model"]

#: Findings are the largest tables that are staged; this codec takes two thirds of the default one's disk.
CODEC = "zstd"


def restrict_to_touched(findings: DataFrame, touched: DataFrame, unit: Sequence[str] = tuple(UNIT)) -> DataFrame:
    """Findings whose path is touched in the same case and model."""
    return findings.join(
        touched.select(*unit, "relative_filename").distinct(), [*unit, "relative_filename"], "left_semi"
    )


def touched_paths(runs: DataFrame, listed: str, parsed: str, unit: Sequence[str] = tuple(UNIT)) -> DataFrame:
    """One row per touched path; the listed files win over the parsed ones."""
    files = F.when(F.size(F.coalesce(listed, F.array())) > 0, F.col(listed)).otherwise(F.col(parsed))
    return runs.select(*unit, F.explode(files).alias("relative_filename")).distinct()


def multiset_diff(
    before: DataFrame,
    after: DataFrame,
    keys: Sequence[str] = ("case", "model", "finding_fingerprint"),
    line: str = "line_number",
    tie: Sequence[str] = ("row_key",),
) -> DataFrame:
    """AFTER rows with existed_before / is_new_finding under the multiset rule.

    The k-th occurrence of a key, ordered by line (null first) and then row
    hash, is new when k exceeds the number of BEFORE rows with that key. The
    counts of both sides decide most keys at once: all rows of a key are new if
    there are none before, and none is if there are as many. Only rows of the
    keys between are put in order, over ranges of lines and md5 prefixes, so
    that no key is one task. Null keys are keys like others.

    The counts that travel to the rows are those of keys on both sides; a row
    that meets none has no equal before.
    """
    keys = list(keys)
    sides = after.select(*keys, F.lit(0).alias("_nb"), F.lit(1).alias("_na")).unionAll(
        before.select(*keys, F.lit(1), F.lit(0)))
    counts = sides.groupBy(*keys).agg(F.sum("_nb").alias("_nb"), F.sum("_na").alias("_na")).where("_na > 0 AND _nb > 0")
    rows = stage(key_join(after, counts, keys, "left").na.fill(0, ["_nb"]), codec=CODEC)
    mixed = (F.col("_nb") > 0) & (F.col("_nb") < F.col("_na"))
    sure = rows.where(~mixed).withColumn("_new", F.col("_nb") == 0)
    at = F.coalesce(F.col(line).cast("double"), F.lit(float("-inf")))
    placed = positions(rows.where(mixed).withColumn("_at", at), keys, "_at", tie, out="_k")
    both = sure.unionByName(placed.withColumn("_new", F.col("_k") > F.col("_nb")).drop("_at", "_k"))
    return both.withColumns({
        "is_new_finding": F.col("_new").cast("int"),
        "existed_before": (~F.col("_new")).cast("int"),
    }).drop("_nb", "_na", "_new")


def matched_counts(before: DataFrame, after: DataFrame,
                   keys: Sequence[str] = ("case", "model", "finding_fingerprint")) -> DataFrame:
    """Per key: BEFORE and AFTER multiplicity, matched, new and resolved."""
    keys = list(keys)
    both = before.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    g = both.groupBy(*keys).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
    m = F.least("n_before", "n_after")
    return g.withColumns({"matched": m, "new": F.col("n_after") - m, "resolved": F.col("n_before") - m})


def file_risk_flags(diffed: DataFrame, keys: Sequence[str] = (*UNIT, "relative_filename")) -> DataFrame:
    """Whether the file of each finding has any HIGH finding, after and new."""
    diffed = stage(diffed)
    keys = list(keys)
    high = F.upper("severity") == "HIGH"
    per_file = diffed.groupBy(*keys).agg(
        F.max(high.cast("int")).alias("is_risky_after"),
        F.max((high & (F.col("is_new_finding") == 1)).cast("int")).alias("is_risky_new"),
    )
    return key_join(diffed, per_file, keys)


def case_model_summary(before: DataFrame, diffed: DataFrame, units: DataFrame | None = None,
                       unit: Sequence[str] = tuple(UNIT)) -> DataFrame:
    """Before/after/new/resolved counts, HIGH counts, risk sums and deltas.

    ``units`` lists the valid case x model pairs, so that pairs without any
    finding keep a row of zeros.
    """
    high = (F.upper("severity") == "HIGH").cast("int")
    score = severity_score("severity")

    def phase(df, is_after):
        zero = F.lit(0)
        fresh = F.col("is_new_finding") if is_after else zero
        b, a = (zero, F.lit(1)) if is_after else (F.lit(1), zero)
        return df.select(
            *unit, b.alias("b"), a.alias("a"), fresh.alias("w"),
            (b * high).alias("hb"), (a * high).alias("ha"), (fresh * high).alias("hw"),
            (b * score).alias("rb"), (a * score).alias("ra"), (fresh * score).alias("rw"),
        )

    both = phase(before, False).unionByName(phase(diffed, True))
    if units is not None:
        names = both.columns[len(unit):]
        both = both.unionByName(
            units.select(*unit).distinct().select(*unit, *[F.lit(0).alias(n) for n in names])
        )
    g = both.groupBy(*unit).agg(*[
        F.sum(short).cast("long").alias(name) for short, name in (
            ("b", "findings_before"), ("a", "findings_after"), ("w", "findings_new"),
            ("hb", "high_before"), ("ha", "high_after"), ("hw", "high_new"),
            ("rb", "risk_before"), ("ra", "risk_after"), ("rw", "risk_introduced"),
        )
    ])
    matched = F.col("findings_after") - F.col("findings_new")
    return g.withColumns({
        "findings_resolved_est": F.greatest(F.lit(0), F.col("findings_before") - matched).cast("long"),
        "delta_high": F.col("high_after") - F.col("high_before"),
        "delta_risk": F.col("risk_after") - F.col("risk_before"),
        "has_finding_after": (F.col("findings_after") > 0).cast("int"),
        "has_high_after": (F.col("high_after") > 0).cast("int"),
        "has_new_finding": (F.col("findings_new") > 0).cast("int"),
        "has_new_high": (F.col("high_new") > 0).cast("int"),
    })


def common_cohort(df: DataFrame, entity: str, member: str, required: Sequence[str]) -> DataFrame:
    """Rows of the entities that are present for every required member."""
    kept = df.where(F.col(member).isin(list(required)))
    full = kept.groupBy(entity).agg(F.count_distinct(member).alias("_k"))
    full = full.where(F.col("_k") == len(set(required))).select(entity)
    return kept.join(full, entity, "left_semi")


def category_prevalence(df: DataFrame, category: str = "cwe", severity: str = "severity", rows: DataFrame | None = None) -> DataFrame:
    """Category share over all rows, severity score, and their product.

    ``rows`` has the categories of the same rows, if there is a smaller table of
    them; what makes ``df`` then does not run for the shares.
    """
    counts = (df if rows is None else rows).groupBy(category).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    share = counts.select(
        F.col(category).alias("_cat"), (F.col("_n") / total).alias("category_prevalence")
    )
    out = df.join(share, F.col(category).eqNullSafe(F.col("_cat")), "left").drop("_cat")
    return out.withColumns({
        "category_severity_score": severity_score(severity),
        "category_weighted_severity": F.col("category_prevalence") * severity_score(severity),
    })


def valid_counts(summary: DataFrame, members: Sequence[str]) -> DataFrame:
    """Distinct valid cases per model, the minimum, and the common cohort size."""
    kept = summary.where(F.col("model").isin(list(members))).select("case", "model").distinct()
    per = kept.groupBy("model").agg(F.count(F.lit(1)).alias("valid_cases"))
    common = kept.groupBy("case").agg(F.count(F.lit(1)).alias("_k")).agg(
        F.count_if(F.col("_k") == len(set(members))).alias("common_cases")
    )
    return per.select(
        "*",
        per.agg(F.min("valid_cases")).scalar().alias("minimum_valid"),
        common.scalar().alias("common_cases"),
    )


def status_grid(cases: DataFrame, members: Sequence[str], runs: DataFrame) -> DataFrame:
    """Complete case x expected-model grid; pairs without a run have null state."""
    grid = cases.select("case").distinct().select(
        "case", F.explode(F.array(*[F.lit(m) for m in members])).alias("model")
    )
    return grid.join(runs, UNIT, "left")


def plan_missing_pairs(
    cases: DataFrame, valid: DataFrame, attempted: DataFrame, members: Sequence[str],
    target: int, batch: int,
) -> DataFrame:
    """Next cases to run: fewest missing models first, attempted pairs deferred.

    Takes min(batch, target - size of the common cohort) cases.
    """
    grid = status_grid(cases, members, valid.select(*UNIT).distinct().withColumn("_ok", F.lit(1)))
    tried = attempted.select(*UNIT).distinct().withColumn("_tried", F.lit(1))
    g = grid.join(tried, UNIT, "left").groupBy("case").agg(
        F.count_if(F.col("_ok").isNull()).alias("n_missing"),
        F.count_if(F.col("_ok").isNull() & F.col("_tried").isNotNull()).alias("_deferred"),
        F.array_sort(F.collect_list(F.when(F.col("_ok").isNull(), F.col("model")))).alias("missing"),
    )
    common = g.agg(F.count_if(F.col("n_missing") == 0)).scalar()
    todo = g.where((F.col("n_missing") > 0) & (F.col("_deferred") == 0)).select(
        "case", "n_missing", F.concat_ws(",", "missing").alias("missing_models")
    )
    # A batch is a short work list: the sort keeps only its top rows per task.
    first = todo.orderBy("n_missing", "case").limit(batch)
    place = F.row_number().over(W.orderBy("n_missing", "case"))
    return first.withColumn("place", place).where(
        F.col("place") <= F.greatest(F.lit(0), F.lit(target) - common)
    )
