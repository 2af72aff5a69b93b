"""Queries for joins, novelty, cohorts and line-level work (B19-B22, C)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import diffs as df_
from ..operators import compare, findings as fo, joins, linemap, retrieval, review
from ..sources import contracts
from . import fixtures as fx
from .registry import query

_AFTER = "phase = 'after'"


@query("c1_restrict_to_touched", """
SELECT "case", model, phase, relative_filename, COUNT(*) AS n FROM findings GROUP BY 1, 2, 3, 4""", ["findings"])
def c1(spark, sf):
    return fx.findings(spark, sf).groupBy("case", "model", "phase", "relative_filename").agg(
        F.count(F.lit(1)).alias("n"))


@query("c2_multiset_diff", """
SELECT "case", model, row_key, finding_fingerprint, is_new_finding, existed_before FROM diffed""", ["diffed"])
def c2(spark, sf):
    _, after = fx.diffed(spark, sf, [])
    return after.select("case", "model", "row_key", "finding_fingerprint", "is_new_finding", "existed_before")


@query("c2_null_model", """
, f AS (SELECT "case", CASE WHEN model <> 'N' THEN model END AS model, finding_fingerprint, line_number, row_key, phase FROM findings),
b AS (SELECT "case", model, finding_fingerprint, COUNT(*) AS n FROM f WHERE phase = 'before' GROUP BY 1, 2, 3),
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "case", model, finding_fingerprint ORDER BY line_number NULLS FIRST, md5(row_key), row_key) AS k
  FROM f WHERE phase = 'after')
SELECT a."case", a.model, row_key, CAST(k > coalesce(n, 0) AS INTEGER) AS is_new_finding FROM a LEFT JOIN b
  ON a."case" = b."case" AND a.model IS NOT DISTINCT FROM b.model AND a.finding_fingerprint = b.finding_fingerprint""", ["findings"])
def c2n(spark, sf):
    f = fx.findings(spark, sf).withColumn("model", F.expr("CASE WHEN model <> 'N' THEN model END"))
    out = fo.multiset_diff(f.where("phase = 'before'"), f.where(_AFTER))
    return out.select("case", "model", "row_key", "is_new_finding")


@query("c2_matched_counts", """
, g AS (SELECT "case", model, finding_fingerprint, COUNT(*) FILTER (WHERE phase = 'before') AS n_before,
  COUNT(*) FILTER (WHERE phase = 'after') AS n_after FROM findings GROUP BY 1, 2, 3)
SELECT *, least(n_before, n_after) AS matched, n_after - least(n_before, n_after) AS new,
  n_before - least(n_before, n_after) AS resolved FROM g""", ["findings"])
def c2m(spark, sf):
    f = fx.findings(spark, sf)
    return fo.matched_counts(f.where("phase = 'before'"), f.where(_AFTER))


@query("c3_enrich_by_case", """
SELECT f.row_key, CAST(s.s_nationkey AS INTEGER) AS s_nationkey, ROUND(s.s_acctbal, 2) AS s_acctbal
FROM raw_findings f LEFT JOIN supplier s ON f."case" = 'case-' || s.s_suppkey""", ["raw_findings"])
def c3(spark, sf):
    s = fx.table(spark, sf, "supplier").selectExpr(
        "concat('case-', s_suppkey) AS case", "s_nationkey", "ROUND(s_acctbal, 2) AS s_acctbal")
    f = fx.raw_findings(spark, sf).select("case", "row_key")
    return joins.enrich_by_case(f, s).select("row_key", "s_nationkey", "s_acctbal")


@query("c3_case_constancy", """
SELECT 'repo' AS "column", COUNT(*) FILTER (WHERE a > 1) AS inconsistent_keys FROM
  (SELECT "case", COUNT(DISTINCT repo) AS a FROM raw_findings GROUP BY 1)
UNION ALL SELECT 'severity', COUNT(*) FILTER (WHERE a > 1) FROM
  (SELECT "case", COUNT(DISTINCT severity) AS a FROM raw_findings GROUP BY 1)""", ["raw_findings"])
def c3c(spark, sf):
    return contracts.inconsistent(fx.raw_findings(spark, sf), "case", ["repo", "severity"])


@query("c4_status_grid", """
, cases AS (SELECT DISTINCT "case" FROM raw_findings), m(model) AS (VALUES ('A'), ('N'), ('R'), ('Z'))
SELECT c."case", m.model, CASE WHEN p.model IS NULL THEN 'not_attempted' ELSE 'pipeline_valid' END AS status
FROM cases c CROSS JOIN m LEFT JOIN pairs p ON p."case" = c."case" AND p.model = m.model""", ["raw_findings", "pairs"])
def c4(spark, sf):
    runs = fx.pairs(spark, sf).withColumn("status", F.lit("pipeline_valid"))
    grid = fo.status_grid(fx.raw_findings(spark, sf), [*fx.MODELS, "Z"], runs)
    return grid.withColumn("status", F.coalesce("status", F.lit("not_attempted")))


@query("c5_common_cohort", 'SELECT * FROM cohort', ["cohort"])
def c5(spark, sf):
    return fx.cohort(spark, sf)


@query("c6_plan_missing_pairs", """
, cases AS (SELECT DISTINCT "case" FROM raw_findings), m(model) AS (VALUES ('A'), ('N'), ('R')),
tried AS (SELECT "case", model FROM raw_findings GROUP BY 1, 2 HAVING SUM(changed) * 10 > 61 * COUNT(*)),
g AS (SELECT c."case", m.model, p.model IS NULL AS miss, p.model IS NULL AND t.model IS NOT NULL AS def
  FROM cases c CROSS JOIN m LEFT JOIN pairs p ON p."case" = c."case" AND p.model = m.model
  LEFT JOIN tried t ON t."case" = c."case" AND t.model = m.model),
k AS (SELECT "case", COUNT(*) FILTER (WHERE miss) AS n_missing, COUNT(*) FILTER (WHERE def) AS d,
  string_agg(model, ',' ORDER BY model) FILTER (WHERE miss) AS missing_models FROM g GROUP BY 1),
c AS (SELECT COUNT(*) AS common FROM k WHERE n_missing = 0),
o AS (SELECT "case", n_missing, missing_models, CAST(ROW_NUMBER() OVER (ORDER BY n_missing, "case") AS INTEGER) AS place
  FROM k WHERE n_missing > 0 AND d = 0)
SELECT o.* FROM o, c WHERE place <= least(20, greatest(0, 1000000 - common))""", ["raw_findings", "pairs"])
def c6(spark, sf):
    raw = fx.raw_findings(spark, sf)
    tried = raw.groupBy("case", "model").agg(F.sum("changed").alias("c"), F.count(F.lit(1)).alias("n")).where(
        "c * 10 > 61 * n")
    return fo.plan_missing_pairs(raw, fx.pairs(spark, sf), tried, fx.MODELS, 1000000, 20)


# --- C7, C8, B22, D23: lines ------------------------------------------------------

_MAP = """
, body AS (SELECT doc_id, hunk, i, p, os, ns, oc, nc, n,
  COUNT(*) FILTER (WHERE p IN (' ', '-')) OVER w AS o_before, COUNT(*) FILTER (WHERE p IN (' ', '+')) OVER w AS n_before
  FROM (SELECT l.doc_id, l.hunk, l.i, CASE WHEN l.p = '+' AND starts_with(l.x, '++') THEN '' WHEN l.p = '-' AND
    starts_with(l.x, '--') THEN '' ELSE l.p END AS p, l.n, h.os, h.ns, h.oc + CASE WHEN h.lang = 'fr' THEN 1 ELSE 0 END AS oc, h.nc
    FROM diff_lines l JOIN hunks h ON l.doc_id = h.doc_id AND l.hunk = h.hunk)
  WINDOW w AS (PARTITION BY doc_id, hunk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT DISTINCT doc_id, CAST(i + 8 AS INTEGER) AS pt FROM diff_lines),
hit AS (SELECT doc_id, pt, arg_min(old, hunk) AS old, arg_min(p, hunk) AS p, MIN(hunk) AS hunk FROM (
  SELECT f.doc_id, f.pt, b.hunk, b.os + b.o_before AS old, b.p FROM f JOIN body b
  ON f.doc_id = b.doc_id AND b.p IN (' ', '+') AND b.ns + b.n_before = f.pt) GROUP BY 1, 2),
nxt AS (SELECT f.doc_id, f.pt, MIN(h.hunk) FILTER (WHERE h.ns > f.pt) AS later, MAX(h.hunk) AS last
  FROM f JOIN hunks h ON f.doc_id = h.doc_id GROUP BY 1, 2),
prev AS (SELECT n.*, CASE WHEN later IS NULL THEN last ELSE later - 1 END AS before FROM nxt n),
j AS (SELECT p.doc_id, p.pt, p.later, hit.old, hit.p, hit.hunk,
  COALESCE(b.os + b.oc + CASE WHEN b.lang = 'fr' THEN 1 ELSE 0 END - b.ns - b.nc, 0) AS off
  FROM prev p LEFT JOIN hit ON hit.doc_id = p.doc_id AND hit.pt = p.pt
  LEFT JOIN hunks b ON b.doc_id = p.doc_id AND b.hunk = p.before)
SELECT 'doc-' || doc_id AS "case", pt AS line_number, CAST(CASE
  WHEN hunk IS NOT NULL AND (later IS NULL OR hunk < later) THEN CASE WHEN p = ' ' THEN old ELSE greatest(1, old) END
  ELSE pt + off END AS INTEGER) AS mapped_before_line,
 CASE WHEN hunk IS NOT NULL AND (later IS NULL OR hunk < later) THEN CASE WHEN p = ' ' THEN 'CONTEXT_LINE_IN_HUNK'
  ELSE 'ADDED_IN_PATCH' END ELSE 'UNCHANGED_OUTSIDE_DIFF' END AS line_mapping_relation FROM j"""


@query("c7_map_lines", _MAP, ["diff_lines", "hunks"])
def c7(spark, sf):
    d = fx.diffs(spark, sf)
    found = fx.table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("case"),
        F.explode(F.sequence(F.lit(9), F.size(F.split("text", "\n")) + 8)).alias("line_number"),
    )
    return linemap.map_lines(found, d, ["case"], "line_number", "patch")


def _spot(floor: str) -> str:
    """The first form of comparing (list of lines, block) with a start at or after ``floor``, nearest to the declared one."""
    forms = []
    for k in range(3):
        starts = f"list_filter(range({floor}, len(l{k}) - len(b{k}) + 1), lambda i: l{k}[i + 1 : i + len(b{k})] = b{k})"
        forms.append(f"list_min(list_transform({starts}, lambda i: abs(i - os + 1) * 10000000 + i)) % 10000000")
    return f"coalesce({', '.join(forms)})"


@query("c8_relocate_hunks", """
, o AS (SELECT doc_id, hunk, list(x ORDER BY i) FILTER (WHERE p <> '+') AS b0 FROM diff_lines GROUP BY 1, 2),
d AS (SELECT doc_id, string_split(text, E'\\n') AS l0 FROM documents),
f AS (SELECT o.doc_id, o.hunk, h.os, b0, list_transform(b0, lambda x: regexp_replace(x, '\\s+$', '')) AS b1,
  list_transform(b0, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS b2, l0,
  list_transform(l0, lambda x: regexp_replace(x, '\\s+$', '')) AS l1, list_transform(l0, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS l2
  FROM o JOIN d ON o.doc_id = d.doc_id JOIN hunks h ON o.doc_id = h.doc_id AND o.hunk = h.hunk),
one AS (SELECT doc_id, hunk, os, """ + _spot("0") + """ AS found FROM f WHERE hunk = 1),
two AS (SELECT doc_id, hunk, os, """ + _spot("coalesce(found + 1, 0)") + """ AS found FROM
  (SELECT f.*, one.found FROM f JOIN one ON f.doc_id = one.doc_id WHERE f.hunk = 2)),
u AS (SELECT * FROM one UNION ALL SELECT * FROM two)
SELECT 'doc-' || doc_id AS "case", 'src/m' || doc_id || '.py' AS path, CAST(os AS INTEGER) AS declared_start, CAST(found + 1 AS INTEGER) AS found_start,
  CASE WHEN found IS NULL THEN 'not_found' WHEN found + 1 = os THEN 'already_correct' ELSE 'relocated' END AS relocation FROM u""", ["hunks"])
def c8(spark, sf):
    """Hunks of every document's diff are looked for in the document itself."""
    d = fx.diffs(spark, sf)
    files = fx.table(spark, sf, "documents").select(
        F.concat(F.lit("src/m"), "doc_id", F.lit(".py")).alias("path"), "text")
    return linemap.relocate_hunks(d, files, ["case"], "patch", "path", "text").select("case", "path", "declared_start", "found_start", "relocation")


@query("c8_relocate_blocks", """
, doc AS (SELECT doc_id, string_split(text, E'\\n') AS ls FROM documents),
b AS (SELECT doc_id, ls, len(ls) // 2 AS mid, CAST(least(3, len(ls) - len(ls) // 2) AS BIGINT) AS n FROM doc),
c AS (SELECT doc_id, mid, UNNEST(list_filter(range(0, len(ls) - n + 1),
  lambda i: ls[i + 1 : i + n] = ls[mid + 1 : mid + n])) AS i FROM b)
SELECT 'doc-' || doc_id AS "case", CAST(arg_min(i, abs(i) * 1000000 + i) + 1 AS INTEGER) AS found_start,
  CASE WHEN arg_min(i, abs(i) * 1000000 + i) = 0 THEN 'already_correct' ELSE 'relocated' END AS relocation
FROM c GROUP BY doc_id""", ["problem"])
def c8b(spark, sf):
    """One hunk per document: three lines from its middle, declared at line 1."""
    doc = fx.table(spark, sf, "documents").withColumn("_ls", F.split("text", "\n"))
    at = F.floor(F.size("_ls") / 2).cast("int")
    block = F.slice("_ls", at + 1, F.least(F.lit(3), F.size("_ls") - at))
    head = F.concat(F.lit("--- a/doc-"), "doc_id", F.lit("\n+++ b/doc-"), "doc_id", F.lit("\n@@ -1,3 +1,3 @@\n"))
    patch = F.concat(head, F.array_join(F.transform(block, lambda x: F.concat(F.lit(" "), x)), "\n"))
    d = doc.select(F.concat(F.lit("doc-"), "doc_id").alias("case"), patch.alias("patch"))
    files = doc.select(F.concat(F.lit("doc-"), "doc_id").alias("path"), "text")
    out = linemap.relocate_hunks(d, files, ["case"], "patch", "path", "text")
    return out.select("case", "found_start", "relocation")


@query("b22_context_window", """
, d AS (SELECT doc_id, string_split(text, E'\\n') AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) > 0 AND l[-1] = '' THEN l[:-2] ELSE l END AS ls FROM d),
w AS (SELECT doc_id, UNNEST([1, CAST(len(ls) // 2 + 1 AS INTEGER), CAST(len(ls) + 5 AS INTEGER)]) AS n, ls FROM s),
a AS (SELECT DISTINCT doc_id, n, ls, least(len(ls), n) AS pt FROM w)
SELECT doc_id, n, md5(CASE WHEN len(ls) = 0 THEN '' ELSE array_to_string(list_transform(range(greatest(1, pt - 8),
  least(len(ls), pt + 8) + 1),
  lambda i: CASE WHEN i = pt THEN '>>' ELSE '  ' END || ' ' || lpad(CAST(i AS VARCHAR), 5, ' ') || ': ' || ls[i]), E'\\n') END) AS digest FROM a
""")
def b22(spark, sf):
    doc = fx.table(spark, sf, "documents").select("doc_id", "text")
    n = F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n"))
    n = F.when(F.col("text") == "", 0).otherwise(n)
    want = doc.select("doc_id", F.explode(F.array_distinct(F.array(
        F.lit(1), (F.floor(n / 2) + 1).cast("int"), (n + 5).cast("int")))).alias("n"))
    c = linemap.context_window(want, doc, ["doc_id"], "n", "text")
    return c.select("doc_id", "n", F.md5("code_context").alias("digest"))


@query("d23_hunk_audit", """
, l AS (SELECT d.*, CASE WHEN (p || x LIKE '--- %' OR p || x LIKE '+++ %') THEN 1 ELSE 0 END AS odd FROM diff_lines d),
h AS (SELECT doc_id, hunk, lang, COUNT(*) FILTER (WHERE p = ' ') AS c, string_agg(x, E'\\n' ORDER BY i) FILTER (WHERE p = '-') AS mi,
  string_agg(x, E'\\n' ORDER BY i) FILTER (WHERE p = '+') AS pl, COUNT(*) FILTER (WHERE p = '-') AS nm,
  COUNT(*) FILTER (WHERE p = '+') AS np, SUM(odd) AS odd FROM l GROUP BY 1, 2, 3),
k AS (SELECT *, nm + np > 0 AND NOT (nm = np AND mi = pl) AS kept FROM h),
f AS (SELECT doc_id, lang, COUNT(*) FILTER (WHERE kept) AS k, COUNT(*) FILTER (WHERE NOT kept) AS n FROM k GROUP BY 1, 2)
SELECT 'doc-' || doc_id AS "case", CAST(k > 0 AS BIGINT) AS files_kept, CAST(k = 0 AS BIGINT) AS files_without_useful_hunk,
  k AS hunks_kept, n AS hunks_dropped_noop, CAST(0 AS BIGINT) AS hunks_dropped_empty,
  CAST(CASE WHEN lang = 'fr' THEN k ELSE 0 END AS BIGINT) AS hunks_recounted FROM f""", ["diff_lines"])
def d23(spark, sf):
    return linemap.hunk_audit(fx.diffs(spark, sf), ["case"], "patch")


# --- B19, B20, C9: retrieval -------------------------------------------------------

_CITE = (
    "concat(text, CASE lang WHEN 'en' THEN '\\nFile \"lib/a.py\", line 12, in f\\n  File \"/abs/b.py\", line 3\\n"
    "see (src/x.py) and ../up.py' WHEN 'fr' THEN concat('\\nlook at `pkg/m', doc_id, '.py:10` or pkg/only.py ') "
    "WHEN 'de' THEN '\\nFile \"lib/a.py\", line 12\\nFile \"lib/a.py\", line 40\\n' ELSE '' END)"
)


def _cited(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr(
        "doc_id", "lang", f"{_CITE} AS text",
        "CASE WHEN lang = 'de' THEN 'tests/t.py::test_one' ELSE '' END AS tests",
        "CASE WHEN lang = 'en' THEN 'src/x.py\\nsetup.py' ELSE 'core/z.py' END AS listed",
    )
    return retrieval.referenced_locations(d, "text", "tests")


@query("b19_referenced_locations", """
SELECT doc_id, path, line FROM documents, (VALUES ('en', 'lib/a.py', 12), ('en', 'src/x.py', NULL),
  ('fr', 'M', NULL), ('fr', 'pkg/only.py', NULL), ('de', 'lib/a.py', 12), ('de', 'lib/a.py', 40),
  ('de', 'tests/t.py', NULL)) AS v(lg, path, line) WHERE lang = lg AND path <> 'M'
UNION ALL SELECT doc_id, 'pkg/m' || doc_id || '.py', NULL FROM documents WHERE lang = 'fr'""")
def b19(spark, sf):
    return retrieval.location_rows(_cited(spark, sf), ["doc_id"])


@query("b20_relevant_paths", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'src/x.py|lib/a.py|setup.py' WHEN 'fr' THEN
  'core/z.py|pkg/m' || doc_id || '.py|pkg/only.py' WHEN 'de' THEN 'lib/a.py|core/z.py|tests/t.py' ELSE 'core/z.py' END AS paths
FROM documents""")
def b20(spark, sf):
    r = retrieval.relevant_paths(_cited(spark, sf), "listed")
    return r.select("doc_id", F.array_join("relevant_paths", "|").alias("paths"))


_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


@query("c9_issue_terms", f"""
WITH w AS (SELECT DISTINCT doc_id, lower(UNNEST(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]{{3,}}'))) AS term FROM documents),
s AS (SELECT DISTINCT doc_id, lower(UNNEST(regexp_extract_all(text,
  '(?:^|[^\\p{{L}}\\p{{N}}_])in\\s+([A-Za-z_][\\p{{L}}\\p{{N}}_]*)', 1))) AS term FROM documents),
a AS (SELECT doc_id, term, MAX(wt) AS wt FROM (SELECT doc_id, term, 1 AS wt FROM w WHERE term NOT IN ({_STOP})
  UNION ALL SELECT doc_id, term, 10 FROM s) GROUP BY 1, 2),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY wt DESC, length(term) DESC, term) AS k FROM a)
SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS n_terms, CAST(SUM(wt) AS BIGINT) AS weight FROM r WHERE k <= 100 GROUP BY 1""")
def c9t(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr("doc_id", "'' AS title", "text", "'' AS tests")
    t = retrieval.issue_terms(d, "title", "text", "tests")
    return t.where(F.size("terms") > 0).select(
        "doc_id", F.size("terms").cast("long").alias("n_terms"),
        F.aggregate("terms", F.lit(0).cast("long"), lambda s, x: s + x["weight"]).alias("weight"))


def _retrieval_input(spark, sf):
    doc = fx.table(spark, sf, "documents")
    # Terms of a document: the words of its label's language source name and fixed prose words.
    terms = doc.select("doc_id", F.expr(
        "array(named_struct('term', 'tion', 'weight', 1), named_struct('term', lang, 'weight', 8), "
        "named_struct('term', 'the', 'weight', 10))").alias("terms"))
    files = doc.select("doc_id", F.concat(F.lit("def the_first():\n"), "text").alias("text"))
    return files, terms


@query("c9_line_scores", """
WITH l AS (SELECT doc_id, lang, UNNEST(string_split(E'def the_first():\\n' || text, E'\\n')) AS x,
  generate_subscripts(string_split(E'def the_first():\\n' || text, E'\\n'), 1) - 1 AS i FROM documents),
s AS (SELECT doc_id, i, CASE WHEN contains(lower(x), 'tion') THEN 1 ELSE 0 END +
  CASE WHEN contains(lower(x), lang) THEN 8 ELSE 0 END + CASE WHEN contains(lower(x), 'the') THEN 10 ELSE 0 END +
  CASE WHEN starts_with(ltrim(lower(x)), 'def the') OR starts_with(ltrim(lower(x)), 'class the') THEN 20 ELSE 0 END +
  CASE WHEN starts_with(ltrim(lower(x)), 'def tion') OR starts_with(ltrim(lower(x)), 'def ' || lang) THEN 20 ELSE 0 END AS score FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS "index", CAST(score AS INTEGER) AS score FROM s WHERE score > 0""")
def c9s(spark, sf):
    files, terms = _retrieval_input(spark, sf)
    d = retrieval.line_scores(files, terms, ["doc_id"], "text")
    return d.select("doc_id", F.explode("scored").alias("_s")).select("doc_id", "_s.index", "_s.score")


# The fold over the lines of a file by falling score, one line a step: a line inside a window changes nothing, one whose
# window touches an earlier one widens the first such, another opens a window until there are three.
@query("c9_rank_lines", """
WITH RECURSIVE d AS (SELECT doc_id, lang, string_split(E'def the_first():\\n' || text, E'\\n') AS l FROM documents),
n AS (SELECT doc_id, lang, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM d),
x AS (SELECT doc_id, lang, len(l) - 1 AS last, UNNEST(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM n),
s AS (SELECT doc_id, last, i, CASE WHEN contains(lower(x), 'tion') THEN 1 ELSE 0 END +
  CASE WHEN contains(lower(x), lang) THEN 8 ELSE 0 END + CASE WHEN contains(lower(x), 'the') THEN 10 ELSE 0 END +
  CASE WHEN starts_with(ltrim(lower(x)), 'def the') OR starts_with(ltrim(lower(x)), 'class the') THEN 20 ELSE 0 END +
  CASE WHEN starts_with(ltrim(lower(x)), 'def tion') OR starts_with(ltrim(lower(x)), 'def ' || lang) THEN 20 ELSE 0 END AS score FROM x),
o AS (SELECT doc_id, i, greatest(0, i - 12) AS a, least(last, i + 12) AS z, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS k FROM s WHERE score > 0),
w(doc_id, k, ws) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) FROM n
  UNION ALL SELECT w.doc_id, o.k, CASE WHEN len(list_filter(ws, lambda v: v.s <= i AND i <= v.e)) > 0 THEN ws
    WHEN len(list_filter(ws, lambda v: a <= v.e + 1 AND z >= v.s - 1)) > 0 THEN list_transform(ws, lambda v, j: CASE
      WHEN j = list_position(list_transform(ws, lambda u: a <= u.e + 1 AND z >= u.s - 1), true)
      THEN CAST({'s': least(a, v.s), 'e': greatest(z, v.e)} AS STRUCT(s BIGINT, e BIGINT)) ELSE v END)
    ELSE list_append(ws, CAST({'s': a, 'e': z} AS STRUCT(s BIGINT, e BIGINT))) END
  FROM w JOIN o ON w.doc_id = o.doc_id AND o.k = w.k + 1 WHERE len(ws) < 3),
f AS (SELECT doc_id, arg_max(ws, k) AS ws FROM w GROUP BY doc_id)
SELECT doc_id, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS place, CAST(UNNEST(ws).s AS INTEGER) AS start, CAST(UNNEST(ws).e AS INTEGER) AS "end" FROM f""")
def c9(spark, sf):
    files, terms = _retrieval_input(spark, sf)
    return retrieval.rank_lines(files, terms, ["doc_id"], "text")


# --- C10 - C15 ------------------------------------------------------------------------

@query("c10_pairwise", """
SELECT a.user_id, a.event_type AS group_a, b.event_type AS group_b, ROUND(a.total, 2) AS value_a, ROUND(b.total, 2) AS value_b
FROM outcomes a JOIN outcomes b ON a.user_id = b.user_id AND a.event_type < b.event_type""", ["outcomes"])
def c10(spark, sf):
    p = compare.pairwise(fx.outcomes(spark, sf), ["user_id"], "event_type", "total", fx.EVENT_TYPES)
    return p.withColumns({"value_a": F.round("value_a", 2), "value_b": F.round("value_b", 2)})


def adjudicated(spark, sf):
    r = fx.ratings(spark, sf)
    key = r.select("review_id_v2", "sample_group_v2")

    def rater(tag):
        return r.select("review_id_v2", F.col(f"validity_{tag}").alias("validity"),
                        F.col(f"attribution_{tag}").alias("patch_attribution"))

    adj = r.select("review_id_v2", "adjudicated_validity", "adjudicated_patch_attribution")
    return review.adjudicate(key, rater("r1"), rater("r2"), adj)


fx.SQL["adjudicated"] = (["ratings"], """
SELECT review_id_v2, sample_group_v2, v1 AS validity_r1, v2 AS validity_r2, a1 AS attribution_r1, a2 AS attribution_r2,
  CAST((v1 <> '' AND v2 <> '' AND v1 <> v2) OR (a1 <> '' AND a2 <> '' AND a1 <> a2) AS INTEGER) AS disagree,
  CASE WHEN av <> '' THEN av WHEN v1 = v2 THEN v1 ELSE '' END AS final_validity,
  CASE WHEN aa <> '' THEN aa WHEN a1 = a2 THEN a1 ELSE '' END AS final_patch_attribution
FROM (SELECT *, upper(trim(validity_r1)) AS v1, upper(trim(validity_r2)) AS v2, upper(trim(attribution_r1)) AS a1,
  upper(trim(attribution_r2)) AS a2, upper(trim(adjudicated_validity)) AS av,
  upper(trim(adjudicated_patch_attribution)) AS aa FROM ratings)""")


query("c11_adjudicate", "SELECT * FROM adjudicated", ["adjudicated"])(adjudicated)


@query("c12_reconcile", """
, m AS (SELECT "case", CAST(len(regexp_extract_all(patch, '(?m)^\\+')) - len(regexp_extract_all(patch, '(?m)^\\+\\+\\+')) AS DOUBLE) AS added,
  CAST(len(regexp_extract_all(patch, '(?m)^diff --git')) AS DOUBLE) AS files_a,
  CAST(CASE WHEN starts_with(patch, '--- ') THEN 1 ELSE 2 END AS DOUBLE) AS files_b FROM diffs)
SELECT 'patch_added' AS feature, COUNT(*) AS n, COUNT(*) AS n_exact_match, 1.0::DOUBLE AS exact_match_rate FROM m
UNION ALL SELECT 'patch_files_touched', COUNT(*), COUNT(*) FILTER (WHERE files_a = files_b),
  ROUND(COUNT(*) FILTER (WHERE files_a = files_b) / COUNT(*), 8) FROM m""", ["diffs"])
def c12(spark, sf):
    d = fx.diffs(spark, sf)
    a = df_.diff_metrics(d, "patch").select("case", "patch_added", "patch_files_touched")
    b = a.select("case", "patch_added").join(
        d.select("case", F.regexp_count("patch", F.lit("(?m)^diff --git")).alias("patch_files_touched")), "case")
    out = joins.reconcile(a, b, ["case"], ["patch_added", "patch_files_touched"])
    return out.withColumn("exact_match_rate", F.round("exact_match_rate", 8))


@query("c13_first_available", """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'own' WHEN lang = 'fr' THEN 'any' WHEN length(text) > 2000 THEN 'case_json' ELSE '' END
  AS text_source, md5(CASE WHEN lang = 'en' THEN text WHEN lang = 'fr' THEN 'any ' || text WHEN length(text) > 2000 THEN 'json ' || text
  ELSE '' END) AS digest FROM documents""")
def c13(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "lang", "text")
    own = d.selectExpr("doc_id", "CASE WHEN lang = 'en' THEN text END AS text")
    anyd = d.where("lang IN ('en', 'fr')").selectExpr("doc_id", "concat('any ', text) AS text")
    js = d.where("length(text) > 2000").selectExpr("doc_id", "concat('json ', text) AS text")
    out = joins.first_available(d, [("own", own), ("any", anyd), ("case_json", js)], ["doc_id"])
    return out.select("doc_id", "text_source", F.md5("text").alias("digest"))


@query("c14_backfill", """
SELECT o.o_orderkey, CASE WHEN o.o_orderstatus = 'F' THEN c.c_mktsegment ELSE o.o_orderpriority END AS segment,
  c.c_name AS c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def c14(spark, sf):
    o = fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey AS id", "CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS segment")
    c = fx.table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS segment", "c_name")
    return joins.backfill(o, c, "id", ["segment", "c_name"]).drop("id")


@query("c15_pending_work", """
SELECT doc_id, CASE WHEN lang = 'de' THEN 'never_run' WHEN lang = 'es' THEN 'failed' WHEN source IN ('src1', 'src2')
  THEN 'other_version' ELSE 'content_changed' END AS reason FROM documents
WHERE NOT (lang IN ('en', 'fr') AND source NOT IN ('src1', 'src2') AND (lang = 'fr' OR n_chars = length(text)
  AND source <> 'src3'))""")
def c15(spark, sf):
    d = fx.table(spark, sf, "documents")
    log = d.where("lang <> 'de'").selectExpr(
        "doc_id", "lang <> 'es' AS success",
        "CASE WHEN source IN ('src1', 'src2') THEN 'v1' ELSE 'v2' END AS protocol_version",
        "CASE WHEN lang = 'fr' THEN sha2(text, 256) ELSE '' END AS recorded_sha256",
        "CASE WHEN source = 'src3' THEN -1 ELSE n_chars END AS recorded_chars",
    )
    return joins.pending_work(d.select("doc_id", "text"), log, ["doc_id"], "text", "v2")
