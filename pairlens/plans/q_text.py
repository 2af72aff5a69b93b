"""Queries for scalar and text functions (B)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import diffs, lexicons as lx, paths, ratios, scores, text as tx
from . import fixtures as fx
from .registry import query


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _n(pattern: str, over: str = "lo", group: int = 0) -> str:
    return f"CAST(len(regexp_extract_all({over}, {_q(pattern)}, {group})) AS BIGINT)"


def _sum(patterns) -> str:
    return "(" + " + ".join(_n(p) for p in patterns) + ")"


# --- B1-B4 -------------------------------------------------------------------

@query("b1_norm_path", f"""
SELECT "case", relative_filename AS path, COUNT(*) AS n FROM raw_findings GROUP BY 1, 2""", ["raw_findings"])
def b1(spark, sf):
    r = fx.reports(spark, sf).withColumn("path", paths.norm_path("filename", "case"))
    return r.groupBy("case", "path").agg(F.count(F.lit(1)).alias("n"))


@query("b2_norm_text", """
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS x
  FROM (SELECT doc_id, text || ' at 0xDEADbeef  now ' AS text FROM documents))
SELECT doc_id, md5(regexp_replace(x, '\\b0x[0-9a-f]+\\b', '<hex>', 'g')) AS digest FROM t""")
def b2(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr("doc_id", "concat(text, ' at 0xDEADbeef  now ') AS text")
    return d.select("doc_id", F.md5(tx.norm_text("text")).alias("digest"))


@query("b3_fingerprint", """
SELECT finding_fingerprint, COUNT(*) AS n FROM raw_findings GROUP BY 1""", ["raw_findings"])
def b3(spark, sf):
    return fx.parsed_findings(spark, sf).groupBy("finding_fingerprint").agg(F.count(F.lit(1)).alias("n"))


@query("b4_severity_score", """
SELECT severity, confidence, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS s,
  CASE upper(confidence) WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS c, COUNT(*) AS n
FROM raw_findings GROUP BY 1, 2, 3, 4""", ["raw_findings"])
def b4(spark, sf):
    r = fx.raw_findings(spark, sf)
    return r.groupBy(
        "severity", "confidence", scores.severity_score("severity").alias("s"),
        scores.severity_score("confidence").alias("c"),
    ).agg(F.count(F.lit(1)).alias("n"))


# --- B5, B6: diffs -------------------------------------------------------------

_METRICS = """
SELECT "case", CAST(len(ls) AS BIGINT) AS patch_lines,
  CAST(len(list_filter(ls, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS BIGINT) AS patch_added,
  CAST(len(list_filter(ls, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS BIGINT) AS patch_removed,
  CAST(len(list_filter(ls, lambda x: starts_with(x, '@@'))) AS BIGINT) AS patch_hunks,
  {files} AS patch_files_touched,
  CAST(len(list_filter(ls, lambda x: (starts_with(x, '+') AND NOT starts_with(x, '+++')) OR
    (starts_with(x, '-') AND NOT starts_with(x, '---')))) AS BIGINT) AS patch_churn,
  CAST(len(list_filter(ls, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) -
    len(list_filter(ls, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS BIGINT) AS patch_net
FROM (SELECT "case", patch, CASE WHEN list_extract(l, -1) = '' THEN l[:-2] ELSE l END AS ls
  FROM (SELECT "case", patch, string_split(patch, E'\\n') AS l FROM diffs))"""


@query("b5_diff_metrics", _METRICS.format(
    files="CAST(CASE WHEN starts_with(patch, '--- ') THEN 1 ELSE 2 END AS BIGINT)"), ["diffs"])
def b5(spark, sf):
    return diffs.diff_metrics(fx.diffs(spark, sf), "patch").select(
        "case", *[f"patch_{m}" for m in ("lines", "added", "removed", "hunks", "files_touched", "churn", "net")]
    )


@query("b6_touched_files", """
SELECT "case", CASE WHEN starts_with(patch, '--- ') THEN file ELSE file || '|lib/util.py' END AS ordered,
  CAST(CASE WHEN starts_with(patch, '--- ') THEN 1 ELSE 2 END AS BIGINT) AS n_union FROM diffs""", ["diffs"])
def b6(spark, sf):
    d = fx.diffs(spark, sf)
    return d.select(
        "case",
        F.concat_ws("|", diffs.touched_files("patch")).alias("ordered"),
        F.size(diffs.touched_files("patch", "union")).cast("long").alias("n_union"),
    )


# --- B7-B13: text features -------------------------------------------------------

@query("b7_text_size", """
SELECT "case", CAST(length(text) AS BIGINT) AS prompt_chars,
  CAST(len(string_split(text, E'\\n')) - CASE WHEN ends_with(text, E'\\n') OR text = '' THEN 1 ELSE 0 END AS BIGINT)
  AS prompt_lines, CAST(CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS prompt_tokens
FROM problem""", ["problem"])
def b7(spark, sf):
    return tx.text_size(fx.problem(spark, sf), "text").select(
        "case", "prompt_chars", "prompt_lines", "prompt_tokens"
    )


@query("b8_has_any", "SELECT \"case\", CAST(" + " OR ".join(
    f"contains(lower(text), {_q(t)})" for t in [*lx.GUIDELINE_TERMS, "validate user"]
) + " AS INTEGER) AS has_terms FROM problem", ["problem"])
def b8(spark, sf):
    terms = [*lx.GUIDELINE_TERMS, "validate user"]
    return fx.problem(spark, sf).select("case", tx.has_any("text", terms).alias("has_terms"))


_BULLETS = (
    "CAST(len(list_filter(string_split(t, E'\\n'), lambda x: regexp_matches(x, "
    "'^\\s*(?:[-*+]|\\d+[.)])\\s+'))) AS BIGINT)"
)
_NLINES = "(len(string_split(text, E'\\n')) - CASE WHEN ends_with(text, E'\\n') OR text = '' THEN 1 ELSE 0 END)"
_IDENT = r"\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_.]*\b"
_NUM = r"\b\d+(?:\.\d+)?\b"
_WORDS = _n(r"[\p{L}\p{N}_]+", "text")


@query("b9_density_features", f"""
, c AS (SELECT "case", CAST(length(text) AS BIGINT) AS ps_chars, CAST({_NLINES} AS BIGINT) AS ps_lines,
  {_WORDS} AS ps_words, {_n(chr(92) + "?", "t")} AS ps_questions, {_n(_NUM, "t")} AS ps_numeric_literal_count,
  {_n(_IDENT, "t")} AS ps_identifier_count, {_BULLETS} AS ps_bullet_count,
  {_sum(lx.CONSTRAINTS)} AS ps_constraint_count, {_sum(lx.MODALS)} AS ps_modal_count FROM plain)
SELECT *, ROUND(ps_chars / greatest(ps_lines, 1), 8) AS ps_chars_per_line,
  ROUND(ps_words / greatest(ps_lines, 1), 8) AS ps_words_per_line,
  ROUND(ps_identifier_count / greatest(ps_words, 1), 8) AS ps_identifier_density,
  ROUND(ps_numeric_literal_count / greatest(ps_words, 1), 8) AS ps_numeric_density FROM c""", ["plain"])
def b9(spark, sf):
    d = tx.density_features(fx.problem(spark, sf), "text").drop("doc_id", "source", "lang", "text")
    return d.withColumns({
        c: F.round(c, 8) for c in (
            "ps_chars_per_line", "ps_words_per_line", "ps_identifier_density", "ps_numeric_density")
    })


_PATH = rf"(?:^|[^\w./-])((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.(?:{lx.FILE_ENDINGS}))"
_PATHS = f"regexp_extract_all(t, {_q(_PATH)}, 1)"
_TEST = r"\btest(?:s|ing)?\b|pytest|unittest|fail_to_pass|pass_to_pass"
_TRACE = r"""\btraceback\b|file\s+["'][^"']+["'],\s+line\s+\d+"""
_EVIDENCE = {
    "file_path_count": f"CAST(len({_PATHS}) AS BIGINT)",
    "unique_file_path_count": f"CAST(len(list_distinct({_PATHS})) AS BIGINT)",
    "test_reference_count": _n(_TEST),
    "traceback_count": _n(_TRACE),
    "url_count": _n(r"https?://[^\s)\]>]+"),
}


@query("b10_evidence_features", 'SELECT "case", ' + ", ".join(
    f"{e} AS ps_{k}" for k, e in _EVIDENCE.items()
) + f", CAST({_n('```')} // 2 AS BIGINT) AS ps_code_fence_count FROM plain", ["plain"])
def b10(spark, sf):
    return tx.evidence_features(fx.problem(spark, sf), "text").drop("doc_id", "source", "lang", "text")


def _domain_sql() -> str:
    d = lx.STATEMENT_DOMAINS
    counts = ", ".join(f"{_sum(ps)} AS ps_domain_{k}_count" for k, ps in d.items())
    flags = ", ".join(f"CAST(ps_domain_{k}_count > 0 AS INTEGER) AS ps_domain_{k}" for k in d)
    implicit = " + ".join(f"CAST(ps_domain_{k}_count > 0 AS INTEGER)" for k in d if k != "explicit_security")
    return (
        f', c AS (SELECT "case", {counts} FROM plain) SELECT *, {flags}, CAST({implicit} AS INTEGER) '
        "AS ps_security_relevant_domain_count, ps_domain_explicit_security_count AS ps_explicit_security_term_count FROM c"
    )


@query("b11_lexicon_features", _domain_sql(), ["plain"])
def b11(spark, sf):
    return tx.lexicon_features(fx.problem(spark, sf), "text").drop("doc_id", "source", "lang", "text")


def _envelope_sql() -> str:
    d = lx.ENVELOPE_DOMAINS
    imperative = rf"(?im)^\s*(?:[-*]\s*)?(?:{'|'.join(lx.IMPERATIVES)})\b"
    section = r"(?im)^\s*\[(?:RULES|OBJECTIVE|REQUIREMENTS?)\]\s*$"

    def said(*terms):
        return "CAST(" + " OR ".join(f"contains(lower(text), {_q(t)})" for t in terms) + " AS INTEGER)"

    cols = {
        "bullet_count": _BULLETS,
        "question_count": _n(r"\?", "t"),
        "code_block_count": f"CAST({_n('```')} // 2 AS BIGINT)",
        **{k: v for k, v in _EVIDENCE.items()},
        "constraint_count": _sum(lx.ENVELOPE_CONSTRAINTS),
        "negation_constraint_count": _sum(lx.NEGATIONS),
        "modal_count": _sum(lx.MODALS),
        "imperative_count": _n(imperative, "t"),
        "identifier_count": _n(_IDENT, "t"),
        "numeric_literal_count": _n(_NUM, "t"),
        "has_explicit_security_guidance": said("[security-guidelines]", "security guidelines", "secure coding"),
        "has_test_objective": said("[objective]", "tests pass", "make these tests pass"),
        "has_relevant_files_section": said("[relevant files]"),
        "has_repository_context": said("[repository]", "commit_base:", "repo:"),
        **{f"mentions_{k}": f"CAST({_sum(ps)} > 0 AS INTEGER)" for k, ps in d.items()},
        "requirement_count": f"({_BULLETS} + {_sum(lx.MODALS)} + {_n(section, 't')})",
        "security_term_count": "(" + " + ".join(_sum(d[k]) for k in lx.ENVELOPE_SECURITY_TERMS) + ")",
        "domain_count": "CAST(" + " + ".join(f"CAST({_sum(ps)} > 0 AS INTEGER)" for ps in d.values()) + " AS INTEGER)",
    }
    return 'SELECT "case", ' + ", ".join(f"{e} AS sem_{k}" for k, e in cols.items()) + " FROM plain"


@query("b12_envelope_features", _envelope_sql(), ["plain"])
def b12(spark, sf):
    return tx.envelope_features(fx.problem(spark, sf), "text").drop("doc_id", "source", "lang", "text")


def _audit_sql() -> str:
    # Matches are found on the placeholder text; the planted terms are ASCII, so spelling is kept.
    d = lx.STATEMENT_DOMAINS
    lists = ", ".join(
        "list_concat(" + ", ".join(f"regexp_extract_all(t, {_q('(?i)' + p)})" for p in ps) + f") AS l_{k}"
        for k, ps in d.items()
    )
    firsts = ", ".join(
        f"list_filter(l_{k}, lambda x, i: list_position(list_transform(l_{k}, lambda y: lower(y)), lower(x)) = i) AS u_{k}"
        for k in d
    )
    out = ", ".join(
        f"CAST(len(u_{k}) AS INTEGER) AS audit_{k}_count, array_to_string(u_{k}, ' | ') AS audit_{k}_terms" for k in d
    )
    implicit = " + ".join(f"len(u_{k})" for k in d if k != "explicit_security")
    return (
        f', l AS (SELECT "case", length(text) AS n, {lists} FROM plain), u AS (SELECT "case", n, {firsts} FROM l) '
        f'SELECT "case", CAST(n AS BIGINT) AS prompt_chars_for_audit, {out}, '
        "CAST(len(u_explicit_security) > 0 AS INTEGER) AS audit_has_explicit_security_terms, "
        f"CAST({implicit} > 0 AS INTEGER) AS audit_has_security_relevant_task_terms FROM u"
    )


@query("b13_lexical_audit", _audit_sql(), ["plain"])
def b13(spark, sf):
    return tx.lexical_audit(fx.problem(spark, sf), "text").drop("doc_id", "source", "lang", "text")


# --- B14-B16: derived features ------------------------------------------------------

_SIZES = """SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
  CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS patch_added,
  CAST(l_linenumber AS BIGINT) AS patch_removed, CAST(l_quantity AS BIGINT) + l_linenumber AS patch_churn,
  CAST(l_quantity AS BIGINT) - l_linenumber AS patch_net, CAST(l_quantity AS BIGINT) + 2 * l_linenumber AS patch_lines,
  CAST(l_tax * 100 AS BIGINT) AS patch_hunks, CAST(l_discount * 100 AS BIGINT) AS patch_files_touched,
  l_partkey AS prompt_chars, l_partkey // 4 AS prompt_tokens, l_suppkey AS prompt_lines FROM lineitem"""


def _ratio_sql(variant: str) -> str:
    def per(c):
        return f"({c} + 1.0)" if variant == "plus1" else f"CAST(greatest({c}, 1) AS DOUBLE)"

    token = f"prompt_tokens / {per('prompt_chars')}" if variant == "plus1" else f"prompt_chars / {per('prompt_tokens')}"
    cols = {
        "patch_density": f"patch_churn / {per('patch_lines')}",
        "add_remove_ratio": f"patch_added / {per('patch_removed')}",
        "net_per_line": f"patch_net / {per('patch_lines')}",
        "hunks_per_file": f"patch_hunks / {per('patch_files_touched')}",
        "patch_complexity": "CAST(patch_hunks * patch_files_touched AS DOUBLE)",
        "change_intensity": f"patch_churn / {per('patch_files_touched')}",
        "prompt_density": f"prompt_chars / {per('prompt_lines')}",
        "prompt_token_density": token,
    }
    body = ", ".join(f"ROUND(CAST({e} AS DOUBLE), 8) AS {k}" for k, e in cols.items())
    return f"SELECT k, ln, pk, sk, cents, {body} FROM ({_SIZES})"


_RATIOS = ["patch_density", "add_remove_ratio", "net_per_line", "hunks_per_file", "patch_complexity",
           "change_intensity", "prompt_density", "prompt_token_density"]


def _sizes(spark, sf):
    import re

    cols = re.sub(r"\s+", " ", _SIZES)[len("SELECT "):-len(" FROM lineitem")]
    exprs = re.split(r", (?=l_|CAST)", cols.replace("l_partkey // 4", "l_partkey div 4"))
    return fx.table(spark, sf, "lineitem").selectExpr(*exprs)


def _ratios(variant):
    def run(spark, sf):
        d = ratios.derived_ratios(_sizes(spark, sf), variant)
        return d.select("k", "ln", "pk", "sk", "cents", *[F.round(c, 8).alias(c) for c in _RATIOS])
    return run


query("b14_derived_ratios_plus1", _ratio_sql("plus1"))(_ratios("plus1"))
query("b14_derived_ratios_max1", _ratio_sql("max1"))(_ratios("max1"))


@query("b15_size_class_cuts", """
SELECT CASE WHEN n_chars <= 500 THEN 0 WHEN n_chars <= 1000 THEN 1 WHEN n_chars <= 2000 THEN 2 ELSE 3 END AS size_class,
  COUNT(*) AS n, CAST(MAX(n_chars) AS BIGINT) AS top FROM documents GROUP BY 1""")
def b15(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.groupBy(ratios.size_class("n_chars").alias("size_class")).agg(
        F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("top")
    )


@query("b15_size_class_terciles", """
WITH q AS (SELECT quantile_cont(n_chars, 0.33) AS a, quantile_cont(n_chars, 0.66) AS b FROM documents)
SELECT doc_id, CASE WHEN n_chars <= a THEN 0 WHEN n_chars <= b THEN 1 ELSE 2 END AS size_class FROM documents, q""")
def b15t(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    return ratios.size_class_by_quantile(d, "n_chars").select("doc_id", "size_class")


@query("b16_derive_targets", """
SELECT "case", model, has_finding_after, has_high_after, has_new_finding, has_new_high,
  CAST(delta_risk > 0 AS INTEGER) AS risk_increased, CAST(risk_introduced > 0 AS INTEGER) AS risk_introduced,
  CAST(findings_after - findings_before AS DOUBLE) AS delta_findings FROM summary""", ["summary"])
def b16(spark, sf):
    t = ratios.derive_targets(fx.summary(spark, sf))
    return t.select("case", "model", "has_finding_after", "has_high_after", "has_new_finding", "has_new_high",
                    "risk_increased", "risk_introduced", "delta_findings")


# --- B17-B19 --------------------------------------------------------------------------

@query("b17_extract_diff", """
WITH a AS (SELECT doc_id, lang, replace(text, '```', '') AS body FROM documents)
SELECT doc_id, md5(CASE lang
  WHEN 'en' THEN rtrim(E'diff --git a/x b/x\\n+' || body, E' \\n\\t') || E'\\n'
  WHEN 'fr' THEN rtrim(E'--- a/x\\n+++ b/x\\n' || body, E' \\n\\t') || E'\\n'
  ELSE '' END) AS digest FROM a""")
def b17(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr(
        "doc_id",
        "CASE lang WHEN 'en' THEN concat('Here it is:\\r\\n```diff\\ndiff --git a/x b/x\\n+', text, '\\n```\\n') "
        "WHEN 'fr' THEN concat('voila\\n--- a/x\\n+++ b/x\\n', text) ELSE text END AS answer",
    )
    return d.select("doc_id", F.md5(tx.extract_diff("answer")).alias("digest"))


@query("b18_compact_text", """
WITH a AS (SELECT doc_id, lang, trim(split_part(text, E'\\n', 1)) AS title, text FROM documents),
b AS (SELECT *, CASE WHEN lang = 'en' THEN title || E'\\n' || text || E'\\n\\n\\n\\nend' ELSE text END AS t FROM a),
c AS (SELECT *, greatest(length(title), length(t) // 3) AS lo FROM b),
d AS (SELECT *, CASE WHEN title = '' THEN 0 ELSE instr(substr(t, lo + 1), title) END AS hit FROM c),
e AS (SELECT *, CASE WHEN hit > 0 AND lo + hit > 1 THEN substr(t, 1, lo + hit - 1) ELSE t END AS u FROM d),
f AS (SELECT *, CASE WHEN title <> '' AND starts_with(u, title) THEN ltrim(substr(u, length(title) + 1), E' \\n\\t')
  ELSE u END AS v FROM e),
g AS (SELECT doc_id, trim(regexp_replace(v, '\\n{3,}', E'\\n\\n', 'g'), E' \\n\\t') AS w FROM f)
SELECT doc_id, md5(CASE WHEN length(w) <= 2000 THEN w ELSE rtrim(substr(w, 1, 2000 - 45), E' \\n\\t') ||
  E'\\n\\n[issue truncated for shared context budget]' END) AS digest FROM g""")
def b18(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr(
        "doc_id", "trim(split_part(text, '\\n', 1)) AS title",
        "CASE WHEN lang = 'en' THEN concat(trim(split_part(text, '\\n', 1)), '\\n', '<!-- a\\nnote -->', text, "
        "'\\n\\n\\n\\nend') ELSE text END AS t",
    )
    return d.select("doc_id", F.md5(tx.compact_text("t", "title", 2000)).alias("digest"))


# --- B21-B28 ---------------------------------------------------------------------------

@query("b21_equivalence_key", """
SELECT row_key, substr(sha256(lower("case") || '||' || relative_filename || '||' || lower(test_id) || '||' ||
  lower(cwe) || '||' || 'use of 0x' || 'af' || '||' || CASE WHEN severity = 'HIGH' THEN 'x = call(' || lower(model) || ')'
  ELSE 'line:' || line_number END), 1, 16) AS equivalence_key FROM raw_findings""", ["raw_findings"])
def b21(spark, sf):
    r = fx.raw_findings(spark, sf).withColumn("details", F.lit(" Use of 0xAF ")).withColumn(
        "context",
        F.when(F.col("severity") == "HIGH",
               F.concat(F.lit("     1: import os\n>>     2:  x  =  call("), "model", F.lit(")\n       3: y")))
        .otherwise(F.lit("     1: a\n     2: b")),
    )
    key = scores.equivalence_key("case", "relative_filename", "test_id", "cwe", "details", "line_number", "context")
    return r.select("row_key", key.alias("equivalence_key"))


@query("b23_apply_flags", """
SELECT event_id, CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'signup' THEN 0
  WHEN event_type = 'view' THEN 1 ELSE 0 END AS strict_apply,
  CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN 1 ELSE 0 END
  AS fuzzy_apply FROM events""")
def b23(spark, sf):
    e = fx.table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'view' THEN 'git apply --3way' WHEN 'error' THEN 'patch -p1' "
        "WHEN 'purchase' THEN NULL ELSE 'patch x' END AS strategy",
        "CASE WHEN event_type = 'purchase' THEN NULL ELSE event_type = 'click' END AS strict",
        "event_type = 'signup' AS fuzzy",
    )
    return scores.apply_flags(e, "strategy", "strict", "fuzzy").select("event_id", "strict_apply", "fuzzy_apply")


@query("b24_execution_status", """
WITH e AS (SELECT event_id, CASE WHEN value < 10 THEN 1 WHEN value < 20 THEN 2 WHEN value < 30 THEN 3
  WHEN value < 40 THEN 4 WHEN value < 55 THEN 5 WHEN value < 70 THEN 6 ELSE 7 END AS k FROM events)
SELECT event_id, CASE k WHEN 1 THEN 'pipeline_valid' WHEN 2 THEN 'insufficient_credit' WHEN 3 THEN 'rate_limited'
  WHEN 4 THEN 'not_attempted' WHEN 5 THEN 'apply_failed' WHEN 6 THEN 'generation_failed'
  ELSE 'pipeline_incomplete' END AS status, CAST(k = 1 AS INTEGER) AS pipeline_valid,
  CAST(k IN (1, 5) AS INTEGER) AS generation_success, CAST(k = 1 AS INTEGER) AS apply_success,
  CAST(k = 3 AS INTEGER) AS artifact_http_429, CAST(k = 2 AS INTEGER) AS artifact_http_402 FROM e""")
def b24(spark, sf):
    e = fx.table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN value < 10 THEN 1 WHEN value < 20 THEN 2 WHEN value < 30 THEN 3 WHEN value < 40 THEN 4 "
        "WHEN value < 55 THEN 5 WHEN value < 70 THEN 6 ELSE 7 END AS k",
    ).selectExpr(
        "event_id",
        "CASE WHEN k IN (1, 7) THEN named_struct('patch_apply_success', k = 1, 'experiment_valid', k = 1) END AS meta",
        "CASE WHEN k <> 4 THEN named_struct('success', k IN (1, 5), 'apply_success', false, 'error', "
        "CASE WHEN k = 6 THEN 'boom' ELSE '' END) END AS generation",
        "CASE k WHEN 2 THEN 'x status: 402 y' WHEN 3 THEN 'status: 429' ELSE '' END AS generation_text",
    )
    return scores.execution_status(e).drop("meta", "generation", "generation_text")


@query("b25_one_hot", """
SELECT event_id, CAST(event_type = 'error' AS DOUBLE) AS event_type_error,
  CAST(event_type = 'purchase' AS DOUBLE) AS event_type_purchase, CAST(event_type = 'signup' AS DOUBLE)
  AS event_type_signup, CAST(event_type = 'view' AS DOUBLE) AS event_type_view FROM events""")
def b25(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", "event_type")
    return ratios.one_hot(e, "event_type", fx.EVENT_TYPES, drop_first=True).drop("event_type")


@query("b26_interactions", """
SELECT event_id, CAST(event_type = 'error' AS DOUBLE) * value AS error_x, CAST(event_type = 'view' AS DOUBLE) * value
  AS view_x FROM events""")
def b26(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", "event_type", "value")
    i = ratios.interactions(e, ["value"], "event_type", ["click", "error", "view"], "click")
    return i.select("event_id", F.col("event_type_error__x__value").alias("error_x"),
                    F.col("event_type_view__x__value").alias("view_x"))


@query("b27_repo_slug", """
SELECT s_suppkey, CASE WHEN s_nationkey < 8 THEN 'own/repo' || s_suppkey WHEN s_nationkey < 16 THEN
  'alt/x' || s_suppkey ELSE '' END AS slug, CASE WHEN s_nationkey < 8 THEN 'repo' || s_suppkey ELSE 'bad' END AS short,
  'own__r' || s_suppkey AS url_slug FROM supplier""")
def b27(spark, sf):
    s = fx.table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "CASE WHEN s_nationkey < 8 THEN concat(' own/repo', s_suppkey, '/ ') ELSE 'not a slug/bad' END AS a",
        "CASE WHEN s_nationkey < 16 THEN concat('alt/x', s_suppkey) END AS b",
        "concat('https://host.example/own/r', s_suppkey, '.git/') AS url",
    )
    return s.select("s_suppkey", paths.repo_slug("a", "b").alias("slug"), paths.repo_short_name("a").alias("short"),
                    paths.repo_url_slug("url").alias("url_slug"))


@query("b28_parse_labels", """
SELECT event_id, CASE WHEN ok THEN 'UNCERTAIN' END AS validity, CASE WHEN ok THEN 'PRE_EXISTING' END AS patch_attribution,
  CASE WHEN ok THEN k END AS confidence FROM (SELECT event_id, CAST(floor(value / 20) AS INTEGER) AS k,
  event_type <> 'error' AND CAST(floor(value / 20) AS INTEGER) BETWEEN 1 AND 5 AS ok FROM events)""")
def b28(spark, sf):
    e = fx.table(spark, sf, "events").selectExpr(
        "event_id",
        "concat(CASE WHEN event_type = 'click' THEN 'Sure: ' ELSE '' END, '{\"validity\": \"', "
        "CASE WHEN event_type = 'error' THEN 'MAYBE' ELSE 'UNCERTAIN' END, '\", \"patch_attribution\": \"PRE_EXISTING\", "
        "\"confidence\": ', CAST(floor(value / 20) AS INT), ', \"reasoning\": \"r\"}', "
        "CASE WHEN event_type = 'click' THEN ' done' ELSE '' END) AS answer",
    )
    return tx.parse_labels(e, "answer").select("event_id", "validity", "patch_attribution", "confidence")
