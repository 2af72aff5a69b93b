"""Views over the given tables that have the shape the operators expect.

Every view is a projection (or grouping) of whole tables. Single-table views
are written once as SQL expressions that Spark and DuckDB both read; ``SQL``
holds their DuckDB form for the oracle.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

MODELS = ["A", "N", "R"]

# Category ids given to l_partkey % 20.
CWE_IDS = [20, 78, 79, 89, 200, 287, 295, 319, 326, 327, 502, 614, 703, 22, 94, 330, 377, 400, 611, 798]


def _pick(expr: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {expr} {arms} ELSE {values[-1]} END"


_SEV = "CASE WHEN l_quantity <= 25 THEN 'LOW' WHEN l_quantity <= 42 THEN 'MEDIUM' ELSE 'HIGH' END"
_CONF = "CASE WHEN l_discount < 0.03 THEN 'LOW' WHEN l_discount < 0.07 THEN 'medium' ELSE 'HIGH' END"
_CASE = "'case-' || CAST(l_suppkey AS STRING)"
_FILE = "'src/mod_' || CAST(l_partkey % 50 AS STRING) || '.py'"
_CENTS = "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"

FINDING = {
    "phase": "CASE WHEN l_linestatus = 'O' THEN 'before' ELSE 'after' END",
    "model": "l_returnflag",
    "case": _CASE,
    "repo": "'owner-' || CAST(l_suppkey % 7 AS STRING) || '/proj-' || CAST(l_suppkey AS STRING)",
    "filename": (
        "CASE WHEN l_linestatus = 'O' THEN '/tmp/swe_before_x/repo/' "
        "ELSE '/data//repos_patched/' || " + _CASE + " || '/' END || " + _FILE
    ),
    "line_number": "CAST(l_orderkey AS INT)",
    "test_id": "'B' || CAST(100 + l_linenumber AS STRING)",
    "test_name": "'rule_' || CAST(l_linenumber AS STRING)",
    "cwe_id": _pick("CAST(l_partkey % 20 AS INT)", CWE_IDS),
    "severity": _SEV,
    "confidence": _CONF,
    "details": "'  Use  of 0x' || CAST(l_linenumber AS STRING) || 'AF  In Call '",
    "row_key": (
        "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || "
        "CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || "
        f"CAST({_CENTS} AS STRING) || '-' || CAST(CAST(l_shipdate AS DATE) AS STRING)"
    ),
    "changed": "CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END",
}

# Clean columns for the oracle side, where the raw path needs no normalising.
FINDING_CLEAN = {
    **{k: v for k, v in FINDING.items() if k not in ("filename", "details", "cwe_id")},
    "relative_filename": _FILE,
    "cwe": f"'CWE-' || CAST({FINDING['cwe_id']} AS STRING)",
    "finding_fingerprint": (
        f"{_FILE} || '|B' || CAST(100 + l_linenumber AS STRING) || '|CWE-' || "
        f"CAST({FINDING['cwe_id']} AS STRING) || '|use of <hex> in call'"
    ),
}

SUFFIX = [
    "'\\n- You must validate user input before the sql query; see src/app/views.py and docs/a.md\\n'",
    "'\\n1. The login API should not leak the password token. http://example.com/a?b=1\\n```\\nx = 1.5\\n```\\n'",
    "'\\nFix the race condition: os.system(cmd) is unsafe (CWE-78). Run tests/test_x.py with pytest\\n'",
    "'\\nTraceback (most recent call last):\\n  File \"lib/core/io.py\", line 42\\nraise Exception\\n'",
    "'\\n* do not break json.loads; exec( and eval( are required to be removed, 12 and 3.25\\n'",
    "'\\n[OBJECTIVE]\\n  - Ensure vulnerable SQLi paths are escaped. Never use pickle or YAML.\\n'",
    "''",
]
_TEXT = "text || " + "CASE CAST(doc_id % 7 AS INT) " + " ".join(
    f"WHEN {i} THEN {s}" for i, s in enumerate(SUFFIX[:-1])
) + f" ELSE {SUFFIX[-1]} END"
PROBLEM = {"case": "'doc-' || CAST(doc_id AS STRING)", "doc_id": "doc_id", "source": "source",
           "lang": "lang", "text": _TEXT}


def _select(cols: dict[str, str]) -> str:
    return ", ".join(f'{expr} AS "{name}"' for name, expr in cols.items())


def _duck(text: str) -> str:
    # DuckDB reads backslash escapes only in E'' strings; ours start with one.
    return text.replace("'\\n", "E'\\n")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str, cols: dict[str, str]) -> DataFrame:
    return table(spark, sf, name).selectExpr(*[f"{e} AS `{n}`" for n, e in cols.items()])


def h32(expr: str, word: int = 0) -> str:
    """DuckDB form of a 32-bit md5 draw of a string expression."""
    return f"CAST('0x' || substr(md5({expr}), {1 + 8 * word}, 8) AS BIGINT)"


RATINGS = {
    "review_id_v2": "'RV' || CAST(l.doc_id AS STRING)",
    "sample_group_v2": "d.source",
    "validity_r1": (
        "CASE WHEN d.lang = 'de' THEN '' WHEN l.quality = 1 THEN ' valid_security_finding' "
        "ELSE 'LIKELY_FALSE_POSITIVE' END"
    ),
    "validity_r2": (
        "CASE WHEN d.n_chars < 300 THEN 'UNCERTAIN' WHEN l.quality = 1 AND l.toxic = 0 THEN "
        "'VALID_SECURITY_FINDING' ELSE 'LIKELY_FALSE_POSITIVE' END"
    ),
    "attribution_r1": (
        "CASE WHEN l.toxic = 1 THEN 'PRE_EXISTING' ELSE 'INTRODUCED_OR_AFFECTED_BY_PATCH' END"
    ),
    "attribution_r2": (
        "CASE WHEN d.n_chars > 4000 THEN 'UNCERTAIN' WHEN l.toxic = 1 THEN 'PRE_EXISTING' "
        "ELSE 'INTRODUCED_OR_AFFECTED_BY_PATCH' END"
    ),
    "adjudicated_validity": "CASE WHEN d.lang = 'es' THEN 'valid_security_finding' ELSE '' END",
    "adjudicated_patch_attribution": "CASE WHEN d.lang = 'es' THEN 'PRE_EXISTING' ELSE '' END",
}

# Oracle views: name -> (needed views, DuckDB SELECT).
SQL: dict[str, tuple[list[str], str]] = {
    "raw_findings": ([], f"SELECT {_select({**FINDING_CLEAN})} FROM lineitem"),
    "pairs": ([], (
        f"SELECT {_CASE} AS \"case\", l_returnflag AS model FROM lineitem GROUP BY 1, 2 "
        "HAVING SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) * 10 < 52 * COUNT(*)"
    )),
    "touched": (["raw_findings"], (
        'SELECT DISTINCT "case", model, relative_filename FROM raw_findings WHERE changed = 1'
    )),
    "valid_findings": (["raw_findings", "pairs"], (
        'SELECT r.* FROM raw_findings r JOIN pairs p ON r."case" = p."case" AND r.model = p.model'
    )),
    "findings": (["valid_findings", "touched"], (
        'SELECT r.* FROM valid_findings r JOIN touched t '
        'ON r."case" = t."case" AND r.model = t.model AND r.relative_filename = t.relative_filename'
    )),
    "diffed": (["findings"], (
        'WITH b AS (SELECT "case", model, finding_fingerprint, COUNT(*) AS nb FROM findings '
        "WHERE phase = 'before' GROUP BY 1, 2, 3), "
        'a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "case", model, finding_fingerprint '
        "ORDER BY line_number, md5(row_key)) AS k FROM findings WHERE phase = 'after') "
        "SELECT a.* EXCLUDE (k), CAST(a.k > COALESCE(b.nb, 0) AS INTEGER) AS is_new_finding, "
        "CAST(a.k <= COALESCE(b.nb, 0) AS INTEGER) AS existed_before "
        'FROM a LEFT JOIN b ON a."case" = b."case" AND a.model = b.model '
        "AND a.finding_fingerprint = b.finding_fingerprint"
    )),
    "summary": (["findings", "diffed", "pairs"], (
        "WITH s AS (SELECT \"case\", model, 1 AS b, 0 AS a, 0 AS w, severity FROM findings WHERE phase = 'before' "
        "UNION ALL SELECT \"case\", model, 0, 1, is_new_finding, severity FROM diffed "
        "UNION ALL SELECT \"case\", model, 0, 0, 0, '' FROM pairs), "
        "t AS (SELECT *, CAST(severity = 'HIGH' AS INTEGER) AS h, CASE severity WHEN 'LOW' THEN 1 "
        "WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 0 END AS r FROM s), "
        "g AS (SELECT \"case\", model, CAST(SUM(b) AS BIGINT) AS findings_before, "
        "CAST(SUM(a) AS BIGINT) AS findings_after, CAST(SUM(w) AS BIGINT) AS findings_new, "
        "CAST(SUM(b*h) AS BIGINT) AS high_before, CAST(SUM(a*h) AS BIGINT) AS high_after, "
        "CAST(SUM(w*h) AS BIGINT) AS high_new, CAST(SUM(b*r) AS BIGINT) AS risk_before, "
        "CAST(SUM(a*r) AS BIGINT) AS risk_after, CAST(SUM(w*r) AS BIGINT) AS risk_introduced "
        "FROM t GROUP BY 1, 2) "
        "SELECT *, CAST(GREATEST(0, findings_before - (findings_after - findings_new)) AS BIGINT) "
        "AS findings_resolved_est, high_after - high_before AS delta_high, "
        "risk_after - risk_before AS delta_risk, CAST(findings_after > 0 AS INTEGER) AS has_finding_after, "
        "CAST(high_after > 0 AS INTEGER) AS has_high_after, CAST(findings_new > 0 AS INTEGER) AS has_new_finding, "
        "CAST(high_new > 0 AS INTEGER) AS has_new_high FROM g"
    )),
    "cohort": (["summary"], (
        'SELECT * FROM summary WHERE "case" IN (SELECT "case" FROM summary GROUP BY 1 '
        "HAVING COUNT(DISTINCT model) = 3)"
    )),
    "problem": ([], f"SELECT {_duck(_select(PROBLEM))} FROM documents"),
    # Accented letters as '_' so that ASCII word edges equal Unicode ones here.
    "plain": (["problem"], (
        'SELECT "case", doc_id, source, lang, text, '
        "regexp_replace(text, '[À-ÖØ-öø-ÿŒœŠšŽžß]', '_', 'g') AS t, "
        "regexp_replace(lower(text), '[À-ÖØ-öø-ÿŒœŠšŽžß]', '_', 'g') AS lo FROM problem"
    )),
    # Unified diffs: the document's lines with md5-chosen prefixes under one or two hunks.
    "diff_lines": ([], (
        "WITH l AS (SELECT doc_id, source, lang, UNNEST(string_split(text, E'\\n')) AS x, "
        "generate_subscripts(string_split(text, E'\\n'), 1) AS i, "
        "len(string_split(text, E'\\n')) AS n FROM documents) "
        "SELECT doc_id, source, lang, x, i, n, CASE WHEN n >= 4 AND i > n // 2 THEN 2 ELSE 1 END AS hunk, "
        "CASE WHEN substr(md5(doc_id || '-' || i), 1, 1) < '8' THEN ' ' "
        "WHEN substr(md5(doc_id || '-' || i), 1, 1) < 'c' THEN '+' ELSE '-' END AS p FROM l"
    )),
    "hunks": (["diff_lines"], (
        "SELECT doc_id, source, lang, hunk, COUNT(*) FILTER (WHERE p IN (' ', '-')) AS oc, "
        "COUNT(*) FILTER (WHERE p IN (' ', '+')) AS nc, 10 * hunk + CASE WHEN hunk = 2 THEN n ELSE 0 END AS os, "
        "12 * hunk + CASE WHEN hunk = 2 THEN n ELSE 0 END AS ns, string_agg(p || x, E'\\n' ORDER BY i) AS body "
        "FROM diff_lines GROUP BY 1, 2, 3, 4, n"
    )),
    "diffs": (["hunks"], (
        "SELECT 'doc-' || doc_id AS \"case\", source, 'src/m' || doc_id || '.py' AS file, "
        "CASE WHEN lang = 'de' THEN E'--- a/src/m' || doc_id || E'.py\\t2024\\n+++ b/src/m' || doc_id || E'.py\\t2024\\n' "
        "ELSE 'diff --git a/src/m' || doc_id || '.py b/src/m' || doc_id || E'.py\\n' END || "
        "string_agg('@@ -' || os || ',' || (oc + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) || ' +' || ns || ',' || nc || E' @@ f\\n' || body, "
        "E'\\n' ORDER BY hunk) || CASE WHEN lang = 'de' THEN '' ELSE E'\\ndiff --git a/lib/util.py b/lib/util.py' END || E'\\n' AS patch "
        "FROM hunks GROUP BY doc_id, source, lang"
    )),
    # Paired binary and numeric outcomes: unit = user, group = event type.
    "outcomes": ([], (
        "SELECT user_id, event_type, MAX(CAST(value > 100 AS INTEGER)) AS y, "
        "CAST(ROUND(SUM(value) * 100) AS BIGINT) / 100.0 AS total, COUNT(*) AS n "
        "FROM events GROUP BY 1, 2"
    )),
    "scored": ([], (
        "SELECT l.doc_id, d.source, l.quality AS y, l.toxic, "
        "CAST(d.n_chars AS DOUBLE) AS n_chars, "
        "CAST(d.n_chars % 997 AS DOUBLE) / 997.0 AS score "
        "FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
    )),
    "ratings": ([], (
        f"SELECT {_select(RATINGS)} FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
    )),
}


def oracle(needs: list[str], body: str) -> str:
    """``body`` under the CTEs of the views it needs, dependencies first.

    A body that starts with a comma adds further CTEs of its own.
    """
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in SQL[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    ctes = ", ".join(f"{n} AS ({SQL[n][1]})" for n in order)
    if not ctes:
        body = re.sub(r"^\s*,", "WITH", body)
    return f"WITH {ctes} {body}" if ctes else body


# --- Spark side: the same views built with the library's own operators ------

def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Raw findings with unnormalised paths and texts."""
    from ..functions.scores import cwe_label

    raw = view(spark, sf, "lineitem", FINDING)
    return raw.withColumn("cwe", cwe_label("cwe_id")).drop("cwe_id")


def raw_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Flat findings as a normalised table would hold them."""
    return view(spark, sf, "lineitem", FINDING_CLEAN)


def parsed_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows, normalised from the raw report columns."""
    from ..functions.paths import norm_path
    from ..functions.scores import fingerprint

    r = reports(spark, sf).withColumn("relative_filename", norm_path("filename", "case"))
    return r.withColumn(
        "finding_fingerprint", fingerprint("relative_filename", "test_id", "cwe", "details")
    ).drop("filename", "details")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "lineitem", {
        "case": _CASE, "model": "l_returnflag", "d": "CAST(ROUND(l_discount * 100) AS BIGINT)"
    })
    g = v.groupBy("case", "model").agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("d") * 10 < F.col("n") * 52).select("case", "model")


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings in touched files of the valid pairs."""
    from ..operators.findings import restrict_to_touched

    raw = raw_findings(spark, sf)
    touched = raw.where("changed = 1").select("case", "model", "relative_filename").distinct()
    # The few touched paths meet the pairs, so that the findings travel once for both.
    return restrict_to_touched(raw, touched.join(pairs(spark, sf), ["case", "model"], "left_semi"))


def diffed(spark: SparkSession, sf: str, keep: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """BEFORE findings and the AFTER findings with novelty flags.

    The flat findings are a table of their own (Parquet between stages), since
    several branches read them. With ``keep`` it has these columns and what the
    diff needs: what follows a written table cannot prune what was written.
    """
    from ..operators.findings import CODEC, multiset_diff
    from ..operators.staging import stage

    f = findings(spark, sf)
    if keep is not None:
        f = f.select(*dict.fromkeys(["phase", "case", "model", "finding_fingerprint", "line_number", "row_key", *keep]))
    f = stage(f, codec=CODEC)
    before = f.where("phase = 'before'")
    return before, multiset_diff(before, f.where("phase = 'after'"))


def summary(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.findings import case_model_summary

    before, after = diffed(spark, sf, ["severity"])
    return case_model_summary(before, after, pairs(spark, sf))


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.findings import common_cohort
    from ..operators.staging import stage

    return common_cohort(stage(summary(spark, sf)), "case", "model", MODELS)


def problem(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "documents", PROBLEM)


def _hunk_header(h: int, count_shift) -> F.Column:
    """'@@' line of hunk ``h`` whose prefixed lines are in column _h<h>."""
    n, body = F.size("_x"), F.col(f"_h{h}")

    def num(kinds):
        return F.size(F.filter(body, lambda x: F.substring(x, 1, 1).isin(kinds)))

    shift = n if h == 2 else F.lit(0)
    return F.concat(
        F.lit("@@ -"), F.lit(10 * h) + shift, F.lit(","), num([" ", "-"]) + count_shift, F.lit(" +"),
        F.lit(12 * h) + shift, F.lit(","), num([" ", "+"]), F.lit(" @@ f\n"), F.array_join(body, "\n"),
    )


def documents(spark: SparkSession, sf: str, wanted: DataFrame | None = None) -> DataFrame:
    """The documents, or those whose doc_id is in ``wanted``."""
    d = table(spark, sf, "documents")
    return d if wanted is None else d.join(wanted.select("doc_id"), "doc_id", "left_semi")


def diffs(spark: SparkSession, sf: str, wanted: DataFrame | None = None) -> DataFrame:
    """One unified diff per document, built inside the row."""
    d = documents(spark, sf, wanted).withColumn("_x", F.split("text", "\n"))

    def prefixed(x, i):
        digit = F.substring(F.md5(F.concat("doc_id", F.lit("-"), i + 1)), 1, 1)
        return F.concat(F.when(digit < "8", " ").when(digit < "c", "+").otherwise("-"), x)

    d = d.withColumn("_p", F.transform("_x", prefixed))
    half = F.when(F.size("_x") >= 4, F.floor(F.size("_x") / 2)).otherwise(F.size("_x")).cast("int")
    d = d.withColumns({
        "_h1": F.slice("_p", F.lit(1), half),
        "_h2": F.when(F.size("_x") >= 4, F.slice("_p", half + 1, F.size("_x"))),
    })
    name = F.concat(F.lit("src/m"), "doc_id", F.lit(".py"))
    wrong = F.when(F.col("lang") == "fr", 1).otherwise(0)
    plain = F.concat(F.lit("--- a/"), name, F.lit("\t2024\n+++ b/"), name, F.lit("\t2024\n"))
    git = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n"))
    de = F.col("lang") == "de"
    second = F.when(F.col("_h2").isNotNull(), F.concat(F.lit("\n"), _hunk_header(2, wrong))).otherwise("")
    patch = F.concat(
        F.when(de, plain).otherwise(git), _hunk_header(1, wrong), second,
        F.when(de, F.lit("")).otherwise(F.lit("\ndiff --git a/lib/util.py b/lib/util.py")), F.lit("\n"),
    )
    return d.select(F.concat(F.lit("doc-"), "doc_id").alias("case"), "source", name.alias("file"),
                    patch.alias("patch"))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(
        F.max((F.col("value") > 100).cast("int")).alias("y"),
        (F.round(F.sum("value") * 100).cast("long") / 100.0).alias("total"),
        F.count(F.lit(1)).alias("n"),
    )


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).selectExpr(
        "doc_id", "source", "quality AS y", "toxic", "CAST(n_chars AS DOUBLE) AS n_chars",
        "CAST(n_chars % 997 AS DOUBLE) / 997.0 AS score",
    )


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").alias("d")
    l = table(spark, sf, "labels").alias("l")
    return l.join(d, F.expr("l.doc_id = d.doc_id")).selectExpr(
        *[f"{e} AS `{n}`" for n, e in RATINGS.items()]
    )
