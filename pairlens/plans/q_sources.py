"""Queries for sources, contracts and case preparation (A)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.staging import scratch
from ..sources import cases, contracts, readers, runs
from . import fixtures as fx
from .registry import query

# A report per line item: one or two findings under ``results`` or ``issues``.
_ITEM = (
    "named_struct('filename', concat('./src/m', l_partkey % 50, '.py'), 'line_number', CAST(l_orderkey AS INT), "
    "'test_id', concat('B', 100 + l_linenumber), 'test_name', 'r', 'issue_severity', 'low', "
    "'issue_confidence', 'HIGH', 'issue_text', 'text', 'issue_cwe', "
    "named_struct('id', CASE WHEN l_tax > 0.01 THEN CAST(l_partkey % 20 AS INT) END))"
)


@query("a1_read_findings", """
WITH r AS (SELECT *, l_linestatus = 'O' AS first_key FROM lineitem),
f AS (SELECT l_returnflag AS model, l_suppkey, 'B' || (100 + l_linenumber) AS test_id,
  CASE WHEN l_tax > 0.01 THEN 'CWE-' || (l_partkey % 20) ELSE 'CWE-Unknown' END AS cwe,
  UNNEST(CASE WHEN l_quantity > 25 THEN [0, 1] ELSE [0] END) AS position FROM r)
SELECT model, CAST(l_suppkey AS BIGINT) AS suppkey, test_id, cwe, 'LOW' AS severity,
  COUNT(*) AS n_findings, CAST(SUM(position) AS BIGINT) AS second_items FROM f GROUP BY 1, 2, 3, 4""")
def a1(spark, sf):
    items = f"CASE WHEN l_quantity > 25 THEN array({_ITEM}, {_ITEM}) ELSE array({_ITEM}) END"
    text = fx.table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS model", "l_suppkey AS suppkey",
        f"CASE WHEN l_linestatus = 'O' THEN to_json(named_struct('results', {items})) "
        f"ELSE to_json(named_struct('results', array(), 'issues', {items})) END AS report",
    )
    nested = text.select("model", "suppkey", F.from_json("report", readers.REPORT_SCHEMA).alias("r"))
    flat = readers.flatten_report(nested.select("model", "suppkey", "r.results", "r.issues"))
    return flat.groupBy("model", "suppkey", "test_id", "cwe", "severity").agg(
        F.count(F.lit(1)).alias("n_findings"), F.sum("position").alias("second_items")
    )


# Run folders made of line items: reports of both phases, metadata (broken for every eleventh supplier, without a file list for
# odd ones), patches (that name other files where the list counts) and prompts.
_DIRS = {"run_a": "A", "run_n": "N", "run_r": "R"}
_FINDING_ITEM = (
    "named_struct('filename', filename, 'line_number', line_number, 'test_id', test_id, 'test_name', test_name, "
    "'issue_severity', severity, 'issue_confidence', confidence, 'issue_text', details, 'issue_cwe', named_struct('id', cwe_id))"
)


def run_files(spark, sf):
    """(source_dir, folder, name, value): the text of every file of every run."""
    # The line items of a run meet as they are; their texts are made where they have met.
    met = fx.table(spark, sf, "lineitem").repartition("l_suppkey", "l_returnflag")
    rows = met.selectExpr(*[f"{e} AS `{n}`" for n, e in {
        **{k: fx.FINDING[k] for k in ("phase", "model", "case", "filename", "line_number", "test_id", "test_name", "cwe_id", "severity",
                                      "confidence", "details", "row_key", "changed")},
        "supplier": "l_suppkey", "file": fx._FILE, "cents": "CAST(ROUND(l_discount * 100) AS BIGINT)"}.items()])
    # The digest as bytes has the order of its hexadecimal digits.
    entry = F.struct("line_number", F.unhex(F.md5("row_key")).alias("h"), F.expr(_FINDING_ITEM).alias("item"))
    units = rows.groupBy("supplier", "model", "case").agg(
        F.sum("cents").alias("d"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(F.col("changed") == 1, F.col("file")))).alias("files"),
        *[F.sort_array(F.collect_list(F.when(F.col("phase") == p, entry))).alias(p) for p in ("before", "after")])

    def report(phase):
        # Reports exist for both phases of every run, also without findings.
        items = F.col(phase)["item"]
        issues = F.to_json(F.struct(F.array().alias("results"), items.alias("issues")))
        found = F.when(F.col("supplier") % 3 == 0, issues).otherwise(F.to_json(F.struct(items.alias("results"))))
        return F.when(F.size(phase) > 0, found).otherwise("{}")

    even = F.col("supplier") % 2 == 0
    valid = (F.col("d") * 10 < F.col("n") * 52).cast("string")
    listed = F.to_json(F.struct(F.lit(True).alias("patch_apply_success"), F.when(even, F.col("files")).alias("actual_changed_files"),
                                F.concat(F.lit("own/"), "case").alias("repo"),
                                F.when(F.col("supplier") % 5 == 0, "patch -p1").otherwise("git apply -v").alias("apply_strategy")))
    meta = F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(', "experiment_valid": '), valid,
                    F.when(F.col("supplier") % 11 == 0, F.lit("")).otherwise(F.lit("}")))
    named = F.when(even & (F.size("files") > 0), F.array(F.lit("other.py"))).otherwise(F.col("files"))
    # Every file ends with a line break.
    patch = F.array_join(F.transform(named, lambda f: F.concat(
        F.lit("diff --git a/"), f, F.lit(" b/"), f, F.lit("\n@@ -1 +1,2 @@\n-x\n+y\n+z"))), "\n")
    prompt = F.concat(F.lit("Fix it.\n"), F.when(F.col("supplier") % 4 == 0, F.lit("OWASP\n")).otherwise(F.lit("")), F.col("case"))
    generation = F.concat(F.lit('{"success": true, "end_to_end_attempt_count": '), F.col("n").cast("string"), F.lit("}"))
    case = F.col("case")
    files = F.array(*[F.struct(F.lit(folder).alias("folder"), name.alias("name"), value.alias("value")) for folder, name, value in (
        *[("reports", F.concat(case, F.lit(f"_bandit_{p}.json")), report(p)) for p in ("before", "after")],
        ("metadata", F.concat(case, F.lit(".json")), meta), ("generation_metadata", F.concat(case, F.lit(".json")), generation),
        ("patches", F.when(F.col("supplier") % 7 == 0, F.concat(F.lit("0-"), case, F.lit("-v.patch"))).otherwise(F.concat(case, F.lit(".patch"))), patch),
        ("patches", F.concat(case, F.lit(".prompt.txt")), prompt))])
    made = units.withColumns({"j": listed, "source_dir": F.concat(F.lit("run_"), F.lower("model"))})
    return made.select("source_dir", F.inline(files))


def made_tables(spark, sf):
    """The finding tables of the run folders, written in the canonical order and read back."""
    root, out = scratch(spark), scratch(spark)
    files = run_files(spark, sf).select(F.concat_ws("/", "source_dir", "folder", "name").alias("path"), F.concat("value", F.lit("\n")).alias("content"))
    readers.write_pack(files, root)
    paths = runs.write_tables(runs.finding_tables(spark, root, _DIRS, fx.MODELS), out)
    return {name: spark.read.parquet(path) for name, path in paths.items()}


_RUN_TABLES = f"""
, u AS (SELECT {fx._CASE} AS "case", l_returnflag AS model, l_suppkey AS supplier, COUNT(*) AS n,
  COUNT(DISTINCT CASE WHEN {fx.FINDING['changed']} = 1 THEN {fx._FILE} END) AS files FROM lineitem GROUP BY 1, 2, 3),
w AS (SELECT u.* FROM u JOIN pairs p ON u."case" = p."case" AND u.model = p.model WHERE supplier % 11 <> 0),
k AS (SELECT *, CASE WHEN supplier % 2 = 0 AND files > 0 THEN 1 ELSE files END AS named FROM w)"""


@query("a1_finding_tables", _RUN_TABLES + """,
t AS (SELECT d.*, k.supplier, k.named FROM diffed d JOIN k ON d."case" = k."case" AND d.model = k.model),
f AS (SELECT *, MAX(CAST(severity = 'HIGH' AS INTEGER)) OVER q AS is_risky_after,
  MAX(CASE WHEN severity = 'HIGH' THEN is_new_finding ELSE 0 END) OVER q AS is_risky_new, COUNT(*) OVER (PARTITION BY cwe) AS same, COUNT(*) OVER () AS n_all
  FROM t WINDOW q AS (PARTITION BY "case", model, relative_filename))
SELECT model, 'run_' || lower(model) AS source_dir, 'own/' || "case" AS repo, "case", "case" || '_bandit_after.json' AS report_file,
  line_number, test_id, test_name, cwe, severity, upper(confidence) AS confidence, relative_filename, finding_fingerprint,
  relative_filename || '|' || line_number || '|' || test_id AS finding_line_key, is_new_finding, existed_before, is_risky_after, is_risky_new,
  5 * named AS patch_lines, 2 * named AS patch_added, named AS patch_files_touched, named AS patch_hunks,
  9 + 6 * CAST(supplier % 4 = 0 AS BIGINT) + length("case") AS prompt_chars, CAST(supplier % 4 = 0 AS INTEGER) AS prompt_has_security_guidelines,
  CAST(supplier % 5 = 0 AS INTEGER) AS fuzzy_patch_apply, ROUND(same / n_all, 8) AS category_prevalence
FROM f""", ["diffed"])
def a1_tables(spark, sf):
    got = made_tables(spark, sf)["findings"]
    return got.select(
        "model", "source_dir", "repo", "case", "report_file", "line_number", "test_id", "test_name", "cwe", "severity", "confidence",
        "relative_filename", "finding_fingerprint", "finding_line_key", "is_new_finding", "existed_before", "is_risky_after", "is_risky_new",
        "patch_lines", "patch_added", "patch_files_touched", "patch_hunks", "prompt_chars", "prompt_has_security_guidelines",
        "fuzzy_patch_apply", F.round("category_prevalence", 8).alias("category_prevalence"))


@query("a1_run_summary", _RUN_TABLES + """,
s AS (SELECT s.*, k.named, k.files AS files_touched FROM summary s JOIN k ON s."case" = k."case" AND s.model = k.model)
SELECT "case", model, findings_before, findings_after, findings_new, findings_resolved_est, high_before, high_after, high_new, delta_high,
  risk_before, risk_after, delta_risk, risk_introduced, files_touched, 3 * named AS patch_churn
FROM s WHERE "case" IN (SELECT "case" FROM s GROUP BY 1 HAVING COUNT(DISTINCT model) = 3)""", ["summary"])
def a1_summary(spark, sf):
    return made_tables(spark, sf)["common_summary"].select(
        "case", "model", "findings_before", "findings_after", "findings_new", "findings_resolved_est", "high_before", "high_after", "high_new",
        "delta_high", "risk_before", "risk_after", "delta_risk", "risk_introduced", "files_touched", "patch_churn")


@query("a1_run_status", f"""
, u AS (SELECT {fx._CASE} AS "case", l_returnflag AS model, l_suppkey AS supplier, COUNT(*) AS n FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT DISTINCT "case" FROM u), g AS (SELECT c."case", m.model FROM c, (VALUES ('A'), ('N'), ('R')) m(model)),
j AS (SELECT g.*, u.n, u.supplier, p."case" IS NOT NULL AND supplier % 11 <> 0 AS valid FROM g LEFT JOIN u ON g."case" = u."case" AND g.model = u.model
  LEFT JOIN pairs p ON g."case" = p."case" AND g.model = p.model)
SELECT model, 'run_' || lower(model) AS source_dir, "case", CASE WHEN valid THEN 'pipeline_valid' WHEN n IS NULL THEN 'not_attempted'
  WHEN supplier % 11 = 0 THEN 'apply_failed' ELSE 'pipeline_incomplete' END AS status, CAST(valid AS INTEGER) AS pipeline_valid,
  CAST(n IS NOT NULL AS INTEGER) AS generation_success, CAST(n IS NOT NULL AND supplier % 11 <> 0 AS INTEGER) AS apply_success,
  0 AS artifact_http_429, 0 AS artifact_http_402, CAST(n AS INTEGER) AS end_to_end_attempt_count FROM j""", ["pairs"])
def a1_status(spark, sf):
    return made_tables(spark, sf)["status"]


@query("a2_read_run_metadata", """
SELECT event_id, CAST(event_type <> 'error' AS INTEGER) AS metadata_ok,
  CASE WHEN event_type <> 'error' THEN CAST(value > 50 AS INTEGER) END AS patch_ok,
  CASE WHEN event_type <> 'error' THEN CASE WHEN event_type = 'view' THEN 'git apply' ELSE 'patch -p1' END END
  AS apply_strategy, CASE WHEN event_type <> 'error' THEN 1 END AS n_files FROM events""")
def a2(spark, sf):
    e = fx.table(spark, sf, "events").selectExpr(
        "event_id",
        "concat('{\"patch_apply_success\": ', CAST(value > 50 AS STRING), ', \"actual_changed_files\": [\"', "
        "event_type, '.py\"], \"apply_strategy\": \"', CASE WHEN event_type = 'view' THEN 'git apply' "
        "ELSE 'patch -p1' END, CASE WHEN event_type = 'error' THEN '' ELSE '\"}' END) AS body",
    )
    m = readers.parse_run_metadata(e, "body")
    return m.select(
        "event_id", "metadata_ok", F.col("patch_apply_success").cast("int").alias("patch_ok"),
        "apply_strategy",
        F.when(F.col("metadata_ok") == 1, F.size("actual_changed_files")).alias("n_files"),
    )


@query("a3_read_text_artifacts", """
WITH f AS (SELECT (CASE WHEN lang = 'en' THEN '' ELSE 'run_' END) || 'doc-' || doc_id || '.patch' AS name,
  text FROM documents),
c AS (SELECT 'doc-' || doc_id AS "case" FROM documents),
m AS (SELECT c."case", MIN(f.name) AS name FROM c JOIN f ON contains(f.name, c."case") GROUP BY 1),
p AS (SELECT m."case", COALESCE(e.name, m.name) AS name FROM m LEFT JOIN f e ON e.name = m."case" || '.patch')
SELECT p."case", p.name, md5(f.text) AS digest FROM p JOIN f ON p.name = f.name""")
def a3(spark, sf):
    d = fx.table(spark, sf, "documents")
    files = d.selectExpr(
        "concat(CASE WHEN lang = 'en' THEN '' ELSE 'run_' END, 'doc-', doc_id, '.patch') AS name", "text"
    )
    keys = d.selectExpr("concat('doc-', doc_id) AS case")
    return readers.pick_artifact(files, keys, ".patch").select("case", "name", F.md5("text").alias("digest"))


@query("a4_map_source_dir", """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'm1' WHEN '2-HIGH' THEN 'm2' ELSE 'm5' END AS model,
  COUNT(*) AS n_runs FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1""")
def a4(spark, sf):
    o = fx.table(spark, sf, "orders")
    m = readers.map_source_dir(o, {"1-URGENT": "m1", "2-HIGH": "m2", "5-LOW": "m5"}, "o_orderpriority")
    return m.groupBy("model").agg(F.count(F.lit(1)).alias("n_runs"))


@query("a5_require", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) <> 1""")
def a5(spark, sf):
    rows = contracts.require(
        fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], forbidden=["y_true"],
        unique=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])
    return contracts.violations(rows, ["l_orderkey", "l_linenumber"])


@query("a5_constant_per_key", """
SELECT 'o_orderstatus' AS "column", COUNT(*) FILTER (WHERE a > 1) AS inconsistent_keys FROM
  (SELECT o_custkey, COUNT(DISTINCT o_orderstatus) AS a FROM orders GROUP BY 1)
UNION ALL SELECT 'o_orderpriority', COUNT(*) FILTER (WHERE a > 1) FROM
  (SELECT o_custkey, COUNT(DISTINCT o_orderpriority) AS a FROM orders GROUP BY 1)""")
def a5b(spark, sf):
    return contracts.inconsistent(
        fx.table(spark, sf, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"]
    )


@query("a6_write_ordered", """
SELECT CAST(NULL AS VARCHAR) AS model, p_brand AS repo, p_partkey, p_name, p_size FROM part""")
def a6(spark, sf):
    p = fx.table(spark, sf, "part").selectExpr("p_partkey", "p_name", "p_brand AS repo", "p_size")
    path = scratch(spark)
    readers.write_ordered(p, path, ["model", "repo"])
    return spark.read.parquet(path)


@query("a7_prepare_cases", """
WITH r AS (SELECT *, CASE WHEN lang = 'de' THEN '  ' ELSE 'inst-' || doc_id END AS instance_id,
  CASE WHEN source = 'src3' THEN '' ELSE 'own/' || source || '/' END AS repo FROM documents),
s AS (SELECT *, trim(text, E' \\n\\t') AS st FROM r),
t AS (SELECT *, split_part(st, E'\\n', 1) AS first FROM s)
SELECT CASE WHEN trim(instance_id) = '' THEN 'instance_id' WHEN repo = '' THEN 'repo'
    WHEN st = '' THEN 'problem_statement' END AS reject_reason,
  trim(instance_id) AS case_id, repo AS repo_full_name,
  CASE WHEN repo = '' THEN '' ELSE source END AS repo_short_name,
  md5(source) AS base_commit,
  CASE WHEN length(first) > 120 THEN substr(first, 1, 120) || '…' ELSE first END AS issue_title,
  md5(st) AS statement_digest,
  CASE WHEN lang = 'fr' THEN 'src/b.py' ELSE E'src/a.py\\nsrc/b.py' END AS short_file_list,
  CASE WHEN lang = 'en' THEN E't1\\nt2' ELSE 'plain::test' END AS test_query,
  CAST(CASE WHEN lang = 'fr' THEN 1 ELSE 2 END AS BIGINT) AS gold_files_count
FROM t""")
def a7(spark, sf):
    rows = fx.table(spark, sf, "documents").selectExpr(
        "CASE WHEN lang = 'de' THEN '  ' ELSE concat('inst-', doc_id) END AS instance_id",
        "CASE WHEN source = 'src3' THEN '' ELSE concat('own/', source, '/') END AS repo",
        "md5(source) AS base_commit",
        "text AS problem_statement",
        "CASE WHEN lang = 'fr' THEN '--- a/src/b.py\\n+++ b/src/b.py\\t2024-01-01\\n@@ -1 +1 @@' ELSE "
        "'diff --git a/src/a.py b/src/a.py\\n+x\\ndiff --git a/src/b.py b/src/b.py\\n-y\\n"
        "diff --git a/src/a.py b/src/a.py\\n' END AS patch",
        "CASE WHEN lang = 'en' THEN '[\"t1\", \"t2\"]' ELSE '' END AS FAIL_TO_PASS",
        "'plain::test' AS PASS_TO_PASS",
    )
    return cases.prepare_cases(rows).withColumn("statement_digest", F.md5("problem_statement")).drop(
        "problem_statement"
    )


_RULE_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in cases.RULE_CWE.items())
_TEXT_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in cases.CWE_TEXT.items())


@query("a8_rule_dimension", f"""
, rules(k, v) AS (VALUES {_RULE_ROWS}), texts(k, v) AS (VALUES {_TEXT_ROWS}),
j AS (SELECT f.test_id, COALESCE(r.v, f.cwe) AS rule_cwe FROM raw_findings f LEFT JOIN rules r ON f.test_id = r.k)
SELECT j.test_id, j.rule_cwe, t.v AS cwe_description, COUNT(*) AS n FROM j LEFT JOIN texts t ON j.rule_cwe = t.k
GROUP BY 1, 2, 3""", ["raw_findings"])
def a8(spark, sf):
    d = cases.rule_dimension(fx.raw_findings(spark, sf))
    return d.groupBy("test_id", "rule_cwe", "cwe_description").agg(F.count(F.lit(1)).alias("n"))


@query("a9_json_first", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'own/' || user_id WHEN 'view' THEN CAST(user_id AS VARCHAR)
  WHEN 'error' THEN 'True' WHEN 'signup' THEN 'deep"q' ELSE '' END AS repo_found FROM events""")
def a9(spark, sf):
    e = fx.table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'click' THEN concat('{\"a\": {\"Repo\": \"  \"}, \"repo_name\": \" own/', user_id, ' \"}') "
        "WHEN 'view' THEN concat('{\"repo\": {\"repo\": ', user_id, '}, \"repo_name\": \"late\"}') "
        "WHEN 'error' THEN '{\"x\": [{\"repo\": true}]}' "
        "WHEN 'signup' THEN '{\"note\": \"\\\\\"repo\\\\\": \\\\\"no\\\\\"\", \"x\": {\"y\": {\"repo\": \"deep\\\\\"q\"}}}' "
        "ELSE '{\"other\": 1}' END AS body",
    )
    return readers.json_first(e, "body", ["repo", "repo_name"], "repo_found").select("event_id", "repo_found")
