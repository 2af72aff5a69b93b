"""Unified-diff features as row-local column expressions (no explode)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .draws import col
from .paths import norm_path
from .text import lines

# Fixed value: the format of a git file header.
GIT_HEADER = r"(?md)^diff --git a/(.+?) b/(.+?)$"


def _count(ls: Column, keep) -> Column:
    return F.size(F.filter(ls, keep)).cast("long")


def _starts(x: Column, prefix: str) -> Column:
    return F.startswith(x, F.lit(prefix))


def touched_files(text, variant: str = "ordered") -> Column:
    """Distinct target paths of a diff.

    ``ordered``: targets of the git headers, else of the ``+++`` lines.
    ``union``: both kinds together, order not significant.
    """
    t = F.coalesce(col(text), F.lit(""))
    ls = lines(t)
    if variant == "union":
        git = F.transform(
            F.filter(ls, lambda x: x.rlike(r"^diff --git \s*\S+\s+\S")),
            lambda x: F.regexp_replace(F.split(x, r"\s+")[3], "^b/", ""),
        )
        plus = F.transform(
            F.filter(ls, lambda x: _starts(x, "+++ b/")), lambda x: F.btrim(F.substring(x, 7, 1 << 30))
        )
        return F.array_distinct(F.concat(git, plus))
    git = F.transform(F.regexp_extract_all(t, F.lit(GIT_HEADER), F.lit(2)), lambda x: norm_path(x))
    plus = F.transform(
        F.filter(ls, lambda x: _starts(x, "+++ ")),
        lambda x: norm_path(F.substring_index(F.btrim(F.substring(x, 5, 1 << 30)), "\t", 1)),
    )
    git = F.filter(F.array_distinct(git), lambda p: p != "")
    plus = F.filter(F.array_distinct(plus), lambda p: (p != "") & (p != "dev/null"))
    return F.when(F.size(git) > 0, git).otherwise(plus)


def diff_metrics(df: DataFrame, text: str, variant: str = "ordered", prefix: str = "patch_") -> DataFrame:
    """Lines, added, removed, files, hunks, churn and net of a unified diff."""
    ls = F.col("_ls")
    out = df.withColumn("_ls", lines(text)).withColumns({
        f"{prefix}lines": F.size(ls).cast("long"),
        f"{prefix}added": _count(ls, lambda x: _starts(x, "+") & ~_starts(x, "+++")),
        f"{prefix}removed": _count(ls, lambda x: _starts(x, "-") & ~_starts(x, "---")),
        f"{prefix}hunks": _count(ls, lambda x: _starts(x, "@@")),
        f"{prefix}files_touched": F.size(touched_files(text, variant)).cast("long"),
    }).drop("_ls")
    return out.withColumns({
        f"{prefix}churn": F.col(f"{prefix}added") + F.col(f"{prefix}removed"),
        f"{prefix}net": F.col(f"{prefix}added") - F.col(f"{prefix}removed"),
    })
