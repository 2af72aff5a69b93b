"""Derived features, size classes, targets and design columns."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

BASE = [
    "patch_lines", "patch_added", "patch_removed", "patch_files_touched", "patch_hunks",
    "patch_churn", "patch_net", "prompt_chars", "prompt_lines", "prompt_tokens",
]
# Inclusive upper ends of the size classes of variant ``plus1``.
SIZE_CUTS = (500, 1000, 2000)


def derived_ratios(df: DataFrame, variant: str = "plus1") -> DataFrame:
    """Ratios of patch and prompt sizes.

    ``plus1`` divides by x+1 and takes tokens per character; ``max1`` divides by
    max(x, 1) and takes characters per token.
    """
    c = {k: F.col(k).cast("double") for k in BASE}

    def per(x: Column) -> Column:
        return x + 1.0 if variant == "plus1" else F.greatest(x, F.lit(1.0))

    token = (
        c["prompt_tokens"] / per(c["prompt_chars"]) if variant == "plus1"
        else c["prompt_chars"] / per(c["prompt_tokens"])
    )
    return df.withColumns({
        "patch_density": c["patch_churn"] / per(c["patch_lines"]),
        "add_remove_ratio": c["patch_added"] / per(c["patch_removed"]),
        "net_per_line": c["patch_net"] / per(c["patch_lines"]),
        "hunks_per_file": c["patch_hunks"] / per(c["patch_files_touched"]),
        "patch_complexity": c["patch_hunks"] * c["patch_files_touched"],
        "change_intensity": c["patch_churn"] / per(c["patch_files_touched"]),
        "prompt_density": c["prompt_chars"] / per(c["prompt_lines"]),
        "prompt_token_density": token,
    })


def size_class(value, cuts: Sequence[float] = SIZE_CUTS) -> Column:
    """Right-closed bucket number of a value."""
    v = F.col(value) if isinstance(value, str) else value
    out = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        out = F.when(v <= cut, F.lit(i)).otherwise(out)
    return F.when(v.isNotNull(), out).cast("int")


def size_class_by_quantile(
    df: DataFrame, value: str, probs: Sequence[float] = (0.33, 0.66), out: str = "size_class"
) -> DataFrame:
    """Bucket by the data's own quantiles (default: terciles)."""
    from ..operators.ranks import quantiles

    names = {f"_q{i}": p for i, p in enumerate(probs)}
    cuts = quantiles(df, [], value, names).select(F.struct(*names)).scalar()
    above = F.lit(0)
    for q in names:
        above = above + (cuts[q] < F.col(value)).cast("int")
    return df.withColumn(out, above)


def number(c) -> Column:
    """Tolerant number: anything unreadable counts as zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nanvl(c.cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0))


def derive_targets(df: DataFrame) -> DataFrame:
    """0/1 targets and deltas of a case x model summary, with coercion."""

    def positive(c):
        return (number(c) > 0).cast("int")

    return df.withColumns({
        "has_finding_after": positive("findings_after"),
        "has_high_after": positive("high_after"),
        "has_new_finding": positive("findings_new"),
        "has_new_high": positive("high_new"),
        "risk_increased": positive("delta_risk"),
        "risk_introduced": positive("risk_introduced" if "risk_introduced" in df.columns else "delta_risk"),
        "delta_findings": (number("findings_after") - number("findings_before")),
    })


def one_hot(df: DataFrame, column: str, values: Sequence[str], drop_first: bool = False) -> DataFrame:
    """Explicit 0/1 columns for a fixed value list."""
    keep = list(values)[1:] if drop_first else list(values)
    return df.withColumns({
        f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in keep
    })


def interactions(
    df: DataFrame, features: Sequence[str], column: str, values: Sequence[str], reference: str
) -> DataFrame:
    """Feature columns multiplied by the indicator of each non-reference group."""
    made: Mapping[str, Column] = {
        f"{column}_{v}__x__{f}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0))
        * F.col(f).cast("double")
        for v in values if v != reference for f in features
    }
    return df.withColumns(made)
