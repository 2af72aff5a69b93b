"""Finding identity, severity and execution state as column expressions."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from . import lexicons as lx
from .draws import col
from .text import norm_text, strip_short

# The characters that end a line, and the blanks that do not.
BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
INLINE = r"[\t\x1f\p{Zs}]"

# Ordinal scores of severity and confidence labels.
LEVELS: Mapping[str, int] = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}


def severity_score(level, default: int = 0) -> Column:
    """LOW/MEDIUM/HIGH in any case to 1/2/3, anything else to ``default``."""
    up = F.upper(col(level))
    out = F.lit(default)
    for name, score in LEVELS.items():
        out = F.when(up == name, F.lit(score)).otherwise(out)
    return out


def cwe_label(cwe_id) -> Column:
    """'CWE-<id>', or 'CWE-Unknown' when the report has no id."""
    return F.concat(F.lit("CWE-"), F.coalesce(col(cwe_id).cast("string"), F.lit("Unknown")))


def fingerprint(path, test_id, cwe, details) -> Column:
    """Line-free identity of a finding; nulls count as empty."""
    parts = [F.coalesce(col(c), F.lit("")) for c in (path, test_id, cwe)]
    return F.concat_ws("|", *parts, norm_text(details))


def line_key(path, line, test_id) -> Column:
    """The older identity that includes the line number."""
    return F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("None"))
                              for c in (path, line, test_id)])


def pointed_line(context) -> Column:
    """Code of the first line marked '>>', without marker and line number."""
    t = F.coalesce(col(context), F.lit(""))
    # The line is found in the text as it is; texts without the mark are not searched.
    first = F.regexp_extract(t, rf"(?:^|{BREAK})({INLINE}*>>[^{BREAK[1:-1]}]*)", 1)
    code = F.regexp_replace(first, rf"^{lx.SPACE}*>>{lx.SPACE}*\p{{Nd}}+{lx.SPACE}*:{lx.SPACE}*", "")
    code = F.regexp_replace(code, rf"^{lx.SPACE}*\p{{Nd}}+{lx.SPACE}*:{lx.SPACE}*", "")
    code = F.regexp_replace(strip_short(code), f"{lx.SPACE}+", " ")
    return F.when(F.contains(t, F.lit(">>")), code).otherwise(F.lit(""))


def equivalence_key(case, path, test_id, cwe, details, line, context) -> Column:
    """16 hex digits that agree for the same finding seen in several models."""
    code = F.coalesce(F.nullif(pointed_line(context), F.lit("")),
                      F.concat(F.lit("LINE:"), F.coalesce(col(line).cast("string"), F.lit(""))))
    parts = [F.lower(strip_short(F.coalesce(c.cast("string"), F.lit(""))))
             for c in (*map(col, (case, path, test_id, cwe, details)), code)]
    return F.substring(F.sha2(F.concat_ws("||", *parts), 256), 1, 16)


def apply_flags(df: DataFrame, strategy: str, strict: str, fuzzy: str) -> DataFrame:
    """Strict/fuzzy application flags, from the booleans or the strategy name."""
    s, f = F.coalesce(F.col(strict), F.lit(False)), F.coalesce(F.col(fuzzy), F.lit(False))
    name = F.coalesce(F.col(strategy), F.lit(""))
    unknown = ~s & ~f
    return df.withColumns({
        "strict_apply": F.when(unknown, F.startswith(name, F.lit("git apply"))).otherwise(s).cast("int"),
        "fuzzy_apply": F.when(unknown, F.startswith(name, F.lit("patch "))).otherwise(f).cast("int"),
    })


def execution_status(df: DataFrame, meta: str = "meta", generation: str = "generation",
                     generation_text: str = "generation_text") -> DataFrame:
    """State of an attempted run: the first rule that holds decides.

    ``meta`` holds patch_apply_success and experiment_valid, ``generation``
    holds success, apply_success and error; either struct may be null.
    """

    def truth(c):
        return F.coalesce(c, F.lit(False))

    g, m = F.col(generation), F.col(meta)
    valid = truth(m["patch_apply_success"]) & truth(m["experiment_valid"])
    generated = truth(g["success"])
    applied = valid | truth(g["apply_success"]) | truth(m["patch_apply_success"])
    said = F.coalesce(F.col(generation_text), F.lit(""))
    no_credit, limited = F.contains(said, F.lit("status: 402")), F.contains(said, F.lit("status: 429"))
    status = (
        F.when(valid, "pipeline_valid")
        .when(no_credit, "insufficient_credit")
        .when(limited, "rate_limited")
        .when(g.isNull() & m.isNull(), "not_attempted")
        .when(generated & ~applied, "apply_failed")
        .when(F.coalesce(g["error"], F.lit("")) != "", "generation_failed")
        .otherwise("pipeline_incomplete")
    )
    return df.withColumns({
        "status": status,
        "pipeline_valid": valid.cast("int"),
        "generation_success": generated.cast("int"),
        "apply_success": applied.cast("int"),
        "artifact_http_429": limited.cast("int"),
        "artifact_http_402": no_credit.cast("int"),
    })
