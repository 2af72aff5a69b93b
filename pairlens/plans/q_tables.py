"""Queries for aggregations, windows, samples and set operations (D, E, F)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, findings as fo, joins, sampling
from . import fixtures as fx
from .registry import query


@query("d1_case_model_summary", "SELECT * FROM summary", ["summary"])
def d1(spark, sf):
    return fx.summary(spark, sf)


_FLAGGED = ["relative_filename", "severity"]
_FLAG_COLUMNS = ["row_key", "case", "model", *_FLAGGED, "is_new_finding"]


@query("d2_file_risk_flags", """
SELECT row_key, MAX(CAST(severity = 'HIGH' AS INTEGER)) OVER w AS is_risky_after,
  MAX(CAST(severity = 'HIGH' AND is_new_finding = 1 AS INTEGER)) OVER w AS is_risky_new
FROM diffed WINDOW w AS (PARTITION BY "case", model, relative_filename)""", ["diffed"])
def d2(spark, sf):
    _, after = fx.diffed(spark, sf, _FLAGGED)
    return fo.file_risk_flags(after.select(_FLAG_COLUMNS)).select("row_key", "is_risky_after", "is_risky_new")


@query("d2_null_path", """
, d AS (SELECT row_key, "case", model, severity, is_new_finding, CASE WHEN model <> 'N' THEN relative_filename END AS path FROM diffed)
SELECT row_key, MAX(CAST(severity = 'HIGH' AS INTEGER)) OVER w AS is_risky_after,
  MAX(CAST(severity = 'HIGH' AND is_new_finding = 1 AS INTEGER)) OVER w AS is_risky_new
FROM d WINDOW w AS (PARTITION BY "case", model, path)""", ["diffed"])
def d2n(spark, sf):
    _, after = fx.diffed(spark, sf, _FLAGGED)
    after = after.withColumn("relative_filename", F.expr("CASE WHEN model <> 'N' THEN relative_filename END"))
    return fo.file_risk_flags(after.select(_FLAG_COLUMNS)).select("row_key", "is_risky_after", "is_risky_new")


@query("d3_category_prevalence", """
, t AS (SELECT *, COUNT(*) OVER (PARTITION BY cwe) / COUNT(*) OVER () AS p, CASE severity WHEN 'LOW' THEN 1
  WHEN 'MEDIUM' THEN 2 ELSE 3 END AS s FROM raw_findings)
SELECT row_key, ROUND(p, 9) AS category_prevalence, s AS category_severity_score, ROUND(p * s, 9) AS category_weighted_severity
FROM t""", ["raw_findings"])
def d3(spark, sf):
    p = fo.category_prevalence(fx.raw_findings(spark, sf).select("row_key", "cwe", "severity"))
    return p.select("row_key", F.round("category_prevalence", 9).alias("category_prevalence"),
                    "category_severity_score",
                    F.round("category_weighted_severity", 9).alias("category_weighted_severity"))


@query("d4_valid_counts", """
, k AS (SELECT model, COUNT(DISTINCT "case") AS valid_cases FROM pairs GROUP BY 1),
c AS (SELECT COUNT(*) AS n FROM (SELECT "case" FROM pairs GROUP BY 1 HAVING COUNT(DISTINCT model) = 3))
SELECT model, valid_cases, (SELECT MIN(valid_cases) FROM k) AS minimum_valid, (SELECT n FROM c) AS common_cases FROM k""", ["pairs"])
def d4(spark, sf):
    return fo.valid_counts(fx.pairs(spark, sf), fx.MODELS)


@query("d8_crosstab", """
SELECT cwe, COUNT(*) FILTER (WHERE model = 'A') AS "A", COUNT(*) FILTER (WHERE model = 'N') AS "N",
  COUNT(*) FILTER (WHERE model = 'R') AS "R", COUNT(*) AS total, greatest(COUNT(*) FILTER (WHERE model = 'A'),
  COUNT(*) FILTER (WHERE model = 'N'), COUNT(*) FILTER (WHERE model = 'R')) - least(COUNT(*) FILTER (WHERE model = 'A'),
  COUNT(*) FILTER (WHERE model = 'N'), COUNT(*) FILTER (WHERE model = 'R')) AS spread
FROM raw_findings GROUP BY 1""", ["raw_findings"])
def d8(spark, sf):
    return compare.crosstab(fx.raw_findings(spark, sf), "cwe", "model", fx.MODELS)


fx.SQL["ct"] = (["raw_findings"], """
SELECT cwe, COUNT(*) FILTER (WHERE model = 'A') AS a, COUNT(*) FILTER (WHERE model = 'N') AS n,
  COUNT(*) FILTER (WHERE model = 'R') AS r, COUNT(*) AS total FROM raw_findings GROUP BY 1""")


@query("d9_rate_per_changed_lines", """
, f AS (SELECT source AS model, COUNT(*) AS docs FROM documents GROUP BY 1),
k AS (SELECT source, COUNT(*) FILTER (WHERE p = '+' AND NOT starts_with(x, '++')) AS lines_added,
  COUNT(*) FILTER (WHERE p = '-' AND NOT starts_with(x, '--')) AS lines_removed FROM diff_lines GROUP BY 1),
s AS (SELECT source, COUNT(*) + CAST(MAX(CASE WHEN lang = 'de' THEN 0 ELSE 1 END) AS BIGINT) AS files_touched FROM documents GROUP BY 1),
n AS (SELECT 'src' || (l_partkey % 20) AS source, COUNT(DISTINCT (l_suppkey, l_orderkey, l_linenumber)) AS n_findings FROM lineitem GROUP BY 1)
SELECT k.source, k.lines_added, k.lines_removed, s.files_touched, COALESCE(n.n_findings, 0) AS n_findings,
  k.lines_added + k.lines_removed AS lines_changed,
  ROUND(COALESCE(n.n_findings, 0) / (greatest(k.lines_added + k.lines_removed, 1) / 1000.0), 6) AS findings_per_1k_changed
FROM k JOIN s ON k.source = s.source LEFT JOIN n ON n.source = k.source""", ["diff_lines"])
def d9(spark, sf):
    from ..functions import diffs as df_

    d = fx.diffs(spark, sf).withColumn("files", df_.touched_files("patch"))
    d = df_.diff_metrics(d, "patch").select("source", "files", "patch_added", "patch_removed")
    found = fx.table(spark, sf, "lineitem").selectExpr(
        "concat('src', l_partkey % 20) AS source", "l_suppkey", "l_orderkey", "l_linenumber")
    out = compare.rate_per_changed_lines(found, d, "source", ["l_suppkey", "l_orderkey", "l_linenumber"])
    return out.withColumn("findings_per_1k_changed", F.round("findings_per_1k_changed", 6))


fx.SQL["profile"] = (["raw_findings"], """
SELECT b.*, e.entropy_cwe, COALESCE(c.cooc_avg, 0) AS cooc_avg, CASE WHEN b.n_cwe_unique > 1
  THEN 2.0 * COALESCE(c.edges, 0) / (b.n_cwe_unique * (b.n_cwe_unique - 1)) ELSE 0 END AS cluster_density
FROM (SELECT "case", COUNT(*) AS n_findings, COUNT(DISTINCT cwe) AS n_cwe_unique,
    AVG(CAST(severity = 'HIGH' AS DOUBLE)) AS p_high, AVG(CAST(severity = 'MEDIUM' AS DOUBLE)) AS p_medium,
    MAX(CAST(cwe IN ('CWE-703', 'CWE-327') AS INTEGER)) AS hub_presence,
    AVG(CASE upper(confidence) WHEN 'LOW' THEN 1.0 WHEN 'MEDIUM' THEN 2.0 ELSE 3.0 END) AS avg_confidence,
    AVG(CAST(cwe IN ('CWE-20', 'CWE-78', 'CWE-79', 'CWE-89', 'CWE-200', 'CWE-287', 'CWE-295', 'CWE-319', 'CWE-326',
      'CWE-327', 'CWE-502', 'CWE-614') AS DOUBLE)) AS top_list_ratio FROM raw_findings GROUP BY 1) b
JOIN (SELECT "case", -SUM(p * log2(p)) AS entropy_cwe FROM (SELECT "case", cwe, COUNT(*) / SUM(COUNT(*)) OVER
    (PARTITION BY "case") AS p FROM raw_findings GROUP BY 1, 2) GROUP BY 1) e ON b."case" = e."case"
LEFT JOIN (SELECT "case", COUNT(*) AS edges, AVG(n) AS cooc_avg FROM (SELECT a."case", a.cwe AS x, b.cwe AS y, COUNT(*) AS n
    FROM (SELECT DISTINCT "case", relative_filename, cwe FROM raw_findings) a JOIN
    (SELECT DISTINCT "case", relative_filename, cwe FROM raw_findings) b ON a."case" = b."case" AND
    a.relative_filename = b.relative_filename AND a.cwe < b.cwe GROUP BY 1, 2, 3) GROUP BY 1) c ON b."case" = c."case" """)
_PROFILE = ["p_high", "p_medium", "avg_confidence", "top_list_ratio", "entropy_cwe", "cooc_avg", "cluster_density"]


def _profile(spark, sf):
    return compare.profile_vector(fx.raw_findings(spark, sf), ["case"], ["relative_filename"])


@query("d10_profile_vector", "SELECT \"case\", n_findings, n_cwe_unique, hub_presence, " + ", ".join(
    f"ROUND(CAST({c} AS DOUBLE), 8) AS {c}" for c in _PROFILE) + " FROM profile", ["profile"])
def d10(spark, sf):
    return _profile(spark, sf).select("case", "n_findings", "n_cwe_unique", "hub_presence",
                                      *[F.round(c, 8).alias(c) for c in _PROFILE])


@query("d11_entropy", """
SELECT source, ROUND(-SUM(p * log2(p)), 8) + 0.0 AS entropy FROM (SELECT source, lang, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY source) AS p
FROM documents GROUP BY 1, 2) GROUP BY 1""")
def d11(spark, sf):
    e = compare.entropy(fx.table(spark, sf, "documents"), ["source"], "lang")
    return e.select("source", F.round("entropy", 8).alias("entropy"))


@query("d12_risk_label", """
, s AS (SELECT "case", n_findings * (1 + p_high + 0.5 * p_medium) * (1 + top_list_ratio) * (1 + 0.3 * hub_presence) *
  (1 + 0.1 * entropy_cwe) * (1 + 0.05 * cluster_density) * (1 + 0.05 * cooc_avg) * (1 + 0.05 * (avg_confidence / 3.0)) AS r FROM profile)
SELECT "case", ROUND(CAST(r AS DOUBLE), 4) AS risk_score, CAST(r >= (SELECT quantile_cont(r, 0.5) FROM s) AS INTEGER) AS risk_label FROM s""",
       ["profile"])
def d12(spark, sf):
    r = compare.risk_label(_profile(spark, sf))
    return r.select("case", F.round("risk_score", 4).alias("risk_score"), "risk_label")


@query("d26_category_shares", """
SELECT cwe, ROUND(a / greatest(total, 1), 8) AS a_share, ROUND(n / greatest(total, 1), 8) AS n_share,
  ROUND(r / greatest(total, 1), 8) AS r_share, CASE greatest(a, n, r) WHEN a THEN 'A' WHEN n THEN 'N' ELSE 'R' END AS max_member,
  CASE least(a, n, r) WHEN a THEN 'A' WHEN n THEN 'N' ELSE 'R' END AS min_member FROM ct""", ["ct"])
def d26(spark, sf):
    ct = compare.crosstab(fx.raw_findings(spark, sf), "cwe", "model", fx.MODELS)
    s = compare.category_shares(ct, fx.MODELS)
    return s.select("cwe", *[F.round(f"{m}_share", 8).alias(f"{m.lower()}_share") for m in fx.MODELS],
                    "max_member", "min_member")


@query("d27_pairwise_category_diff", """
, p AS (SELECT cwe, 'A' AS group_a, 'N' AS group_b, a AS count_a, n AS count_b FROM ct UNION ALL
  SELECT cwe, 'A', 'R', a, r FROM ct UNION ALL SELECT cwe, 'N', 'R', n, r FROM ct),
t AS (SELECT group_a, group_b, CAST(SUM(count_a) AS BIGINT) AS ta, CAST(SUM(count_b) AS BIGINT) AS tb FROM p GROUP BY 1, 2),
k AS (SELECT *, abs(count_a - count_b) AS difference, CAST(ROW_NUMBER() OVER (PARTITION BY group_a, group_b
  ORDER BY abs(count_a - count_b) DESC, cwe) AS INTEGER) AS place FROM p)
SELECT cwe, k.group_a, k.group_b, count_a, count_b, difference, ROUND(difference / greatest(count_a, count_b, 1) * 100.0, 6)
  AS pct_difference, place, ta - tb AS total_difference, ROUND(abs(ta - tb) / greatest(ta, tb, 1) * 100.0, 6) AS pct_total_difference
FROM k JOIN t ON k.group_a = t.group_a AND k.group_b = t.group_b WHERE place <= 5""", ["ct"])
def d27(spark, sf):
    ct = compare.crosstab(fx.raw_findings(spark, sf), "cwe", "model", fx.MODELS)
    d = compare.pairwise_category_diff(ct, "cwe", fx.MODELS, 5)
    return d.withColumns({c: F.round(c, 6) for c in ("pct_difference", "pct_total_difference")})


# --- E: windows, samples ----------------------------------------------------------------

@query("e1_dedupe", """
SELECT o_custkey, o_orderkey, ROUND(o_totalprice, 2) AS o_totalprice FROM orders
QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def e1(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    d = sampling.dedupe(o, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])
    return d.withColumn("o_totalprice", F.round("o_totalprice", 2))


_DRAW = fx.h32("'7|' || doc_id")


@query("e3_round_robin_sample", f"""
, s AS (SELECT doc_id, source, ROW_NUMBER() OVER (PARTITION BY source ORDER BY {_DRAW}, doc_id) AS round FROM documents)
SELECT doc_id, source, round FROM s ORDER BY round, source LIMIT 70""")
def e3(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "source")
    return sampling.round_robin_sample(d, "source", 70, 7, ["doc_id"])


@query("e4_sample_per_group", f"""
SELECT doc_id, source, ROW_NUMBER() OVER (PARTITION BY source ORDER BY {_DRAW}, doc_id) AS draw_place FROM documents
QUALIFY draw_place <= 10""")
def e4(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "source")
    return sampling.sample_per_group(d, ["source"], 10, 7, ["doc_id"])


@query("e4_sample_null_group", f"""
, d AS (SELECT doc_id, CASE WHEN lang <> 'en' THEN lang END AS lang FROM documents)
SELECT doc_id, lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY {_DRAW}, doc_id) AS draw_place FROM d QUALIFY draw_place <= 25""")
def e4n(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN lang <> 'en' THEN lang END AS lang")
    return sampling.sample_per_group(d, ["lang"], 25, 7, ["doc_id"])


@query("e5_top_categories", """
SELECT cwe, total FROM ct ORDER BY total DESC, cwe LIMIT 10""", ["ct"])
def e5(spark, sf):
    ct = compare.crosstab(fx.raw_findings(spark, sf), "cwe", "model", fx.MODELS)
    return sampling_top(ct)


def sampling_top(ct):
    return compare.top_categories(ct, "cwe", "total", 10).select("cwe", "total")


@query("e6_top_fraction", """
SELECT l_returnflag, row_key, ROUND(l_extendedprice, 2) AS price FROM (SELECT l_returnflag, l_extendedprice,
  CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_key FROM lineitem)
QUALIFY ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, md5(row_key))
  <= greatest(1, ceil(COUNT(*) OVER (PARTITION BY l_returnflag) * 0.2))""")
def e6(spark, sf):
    l = fx.table(spark, sf, "lineitem").selectExpr(
        "l_returnflag", "l_extendedprice", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key")
    t = sampling.top_fraction(l, ["l_returnflag"], "l_extendedprice", 0.2, ["row_key"])
    return t.select("l_returnflag", "row_key", F.round("l_extendedprice", 2).alias("price"))


@query("e6_top_fraction_null_group", """
, l AS (SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, l_extendedprice,
  CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_key FROM lineitem)
SELECT flag, row_key, ROUND(l_extendedprice, 2) AS price FROM l
QUALIFY ROW_NUMBER() OVER (PARTITION BY flag ORDER BY l_extendedprice DESC, md5(row_key)) <= greatest(1, ceil(COUNT(*) OVER (PARTITION BY flag) * 0.2))""")
def e6n(spark, sf):
    rows = fx.table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag", "l_extendedprice",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key")
    top = sampling.top_fraction(rows, ["flag"], "l_extendedprice", 0.2, ["row_key"])
    return top.select("flag", "row_key", F.round("l_extendedprice", 2).alias("price"))


@query("e9_merge_null_key", """
, w AS (SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, l_orderkey // 50 * 500 AS s,
  l_orderkey // 50 * 500 + CAST(l_quantity AS BIGINT) * 12 AS e FROM lineitem),
m AS (SELECT *, MAX(e) OVER (PARTITION BY flag ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM w),
i AS (SELECT *, SUM(CASE WHEN seen IS NULL OR s > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY flag ORDER BY s, e
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT flag, CAST(island AS BIGINT) AS island, MIN(s) AS s, MAX(e) AS e, COUNT(*) AS merged FROM i GROUP BY 1, 2
""")
def e9n(spark, sf):
    w = fx.table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag", "l_orderkey div 50 * 500 AS s",
        "l_orderkey div 50 * 500 + CAST(l_quantity AS BIGINT) * 12 AS e")
    return sampling.merge_intervals(w, ["flag"], "s", "e")


@query("e9_merge_intervals", """
, w AS (SELECT l_suppkey, l_orderkey * 10 AS s, l_orderkey * 10 + CAST(l_quantity AS BIGINT) * 4 AS e FROM lineitem),
m AS (SELECT *, MAX(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM w),
i AS (SELECT *, SUM(CASE WHEN seen IS NULL OR s > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT l_suppkey, CAST(island AS BIGINT) AS island, MIN(s) AS s, MAX(e) AS e, COUNT(*) AS merged FROM i GROUP BY 1, 2
""")
def e9(spark, sf):
    w = fx.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey", "l_orderkey * 10 AS s", "l_orderkey * 10 + CAST(l_quantity AS BIGINT) * 4 AS e")
    return sampling.merge_intervals(w, ["l_suppkey"], "s", "e")


@query("e10_shuffle_ids", f"""
, p AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY {_DRAW}, doc_id) AS k FROM documents)
SELECT doc_id, 'RV' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS review_id FROM p
""")
def e10(spark, sf):
    return sampling.shuffle_ids(fx.table(spark, sf, "documents").select("doc_id"), 7, ["doc_id"])


@query("e11_blind", """
SELECT "case" || '-' || row_key AS item, relative_filename, test_id, '' AS reviewer_1_validity, '' AS reviewer_2_notes,
  severity, model FROM raw_findings""", ["raw_findings"])
def e11(spark, sf):
    f = fx.raw_findings(spark, sf).withColumn("item", F.concat_ws("-", "case", "row_key"))
    seen, key = sampling.blind(f, "item", ["relative_filename", "test_id"])
    seen = seen.select("item", "relative_filename", "test_id", "reviewer_1_validity", "reviewer_2_notes")
    return seen.join(key.select("item", "severity", "model"), "item")


fx.SQL["review_input"] = (["diffed"], """
SELECT row_key, test_id, severity, is_new_finding, "case" || '|' || relative_filename || '|' || test_id || '|' || cwe AS ek,
  CASE WHEN changed = 1 THEN 'BEFORE_AFTER' WHEN confidence = 'HIGH' THEN 'AFTER_DIFF' ELSE 'AFTER_ONLY' END AS st FROM diffed""")


@query("e12_review_sample", f"""
, c AS (SELECT *, CASE st WHEN 'BEFORE_AFTER' THEN 2 WHEN 'AFTER_DIFF' THEN 1 ELSE 0 END AS q,
  {fx.h32("'9|' || row_key")} AS d FROM review_input WHERE is_new_finding = 0),
e AS (SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY ek ORDER BY q DESC, d, row_key) = 1),
r AS (SELECT *, test_id || ' | ' || severity AS stratum, ROW_NUMBER() OVER (PARTITION BY test_id || ' | ' || severity
  ORDER BY d, row_key) AS round FROM e),
p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY round, stratum) AS place FROM r)
SELECT row_key, 'ALL_NEW_FINDINGS' AS sample_group FROM review_input WHERE is_new_finding = 1
UNION ALL SELECT row_key, 'STRATIFIED_DEDUP_CONTROL' FROM p
WHERE place <= 200000 - (SELECT COUNT(*) FROM review_input WHERE is_new_finding = 1)""", ["review_input"])
def e12(spark, sf):
    _, after = fx.diffed(spark, sf, ["relative_filename", "test_id", "cwe", "severity", "confidence", "changed"])
    f = after.selectExpr(
        "row_key", "test_id", "severity", "is_new_finding",
        "concat_ws('|', case, relative_filename, test_id, cwe) AS equivalence_key",
        "CASE WHEN changed = 1 THEN 'BEFORE_AFTER' WHEN confidence = 'HIGH' THEN 'AFTER_DIFF' ELSE 'AFTER_ONLY' END AS context_status",
    )
    return sampling.review_sample(f, 200000, 9, ["row_key"]).select("row_key", "sample_group")


# --- F: sets --------------------------------------------------------------------------------

_KEY = ["relative_filename", "line_number", "test_id"]
fx.SQL["keysets"] = (["raw_findings"], """
SELECT relative_filename, line_number, test_id, MAX(CAST(model = 'A' AS BIGINT)) AS a, MAX(CAST(model = 'N' AS BIGINT)) AS n,
  MAX(CAST(model = 'R' AS BIGINT)) AS r FROM raw_findings GROUP BY 1, 2, 3""")


@query("f1_overlap", " UNION ALL ".join(
    f"SELECT '{m}' AS member, CAST(SUM({c}) AS BIGINT) AS total, COUNT(*) FILTER (WHERE {c} = 1 AND a + n + r = 1) AS unique_keys, "
    f"COUNT(*) FILTER (WHERE a + n + r = 3) AS common_all, ROUND(COUNT(*) FILTER (WHERE {c} = 1 AND a + n + r = 1) / SUM({c}), 8) "
    "AS unique_share FROM keysets" for m, c in (("A", "a"), ("N", "n"), ("R", "r"))), ["keysets"])
def f1(spark, sf):
    o = compare.overlap(fx.raw_findings(spark, sf), "model", _KEY, fx.MODELS)
    return o.withColumn("unique_share", F.round("unique_share", 8))


@query("f2_jaccard", """
, j AS (SELECT 'A' AS group_a, 'N' AS group_b, CAST(SUM(a * n) AS BIGINT) AS bt, CAST(SUM(greatest(a, n)) AS BIGINT) AS either, 1 AS k FROM keysets
UNION ALL SELECT 'A', 'R', CAST(SUM(a * r) AS BIGINT), CAST(SUM(greatest(a, r)) AS BIGINT), 2 FROM keysets
UNION ALL SELECT 'N', 'R', CAST(SUM(n * r) AS BIGINT), CAST(SUM(greatest(n, r)) AS BIGINT), 3 FROM keysets)
SELECT group_a, group_b, bt AS "both", either, ROUND(bt / either, 9) AS jaccard,
  CAST(k = (SELECT arg_min(k, (-bt / either, k)) FROM j) AS INTEGER) AS is_closest,
  CAST(k = (SELECT arg_min(k, (bt / either, k)) FROM j) AS INTEGER) AS is_farthest FROM j""", ["keysets"])
def f2(spark, sf):
    j = compare.jaccard(fx.raw_findings(spark, sf), "model", _KEY, fx.MODELS)
    return j.withColumn("jaccard", F.round("jaccard", 9))


_BASKET = "SELECT DISTINCT l_orderkey, l_partkey % 20 AS item FROM lineitem"


@query("f3_cooccurrence", f"""
SELECT a.item AS item_a, b.item AS item_b, COUNT(*) AS n_baskets FROM ({_BASKET}) a JOIN ({_BASKET}) b
ON a.l_orderkey = b.l_orderkey AND a.item < b.item GROUP BY 1, 2""")
def f3(spark, sf):
    b = fx.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_partkey % 20 AS item")
    return compare.cooccurrence(b, ["l_orderkey"], "item")


@query("f4_graph_density", """
, d AS (SELECT DISTINCT l_returnflag AS model, l_orderkey, l_partkey % 500 AS item FROM lineitem),
e AS (SELECT a.model, a.item AS x, b.item AS y, COUNT(*) AS n FROM d a JOIN d b ON a.model = b.model AND a.l_orderkey = b.l_orderkey
  AND a.item < b.item GROUP BY 1, 2, 3)
SELECT n.model, n.nodes, e.edges, ROUND(e.cooc_avg, 8) AS cooc_avg, ROUND(2.0 * e.edges / (n.nodes * (n.nodes - 1)), 8) AS density
FROM (SELECT model, COUNT(DISTINCT item) AS nodes FROM d GROUP BY 1) n
JOIN (SELECT model, COUNT(*) AS edges, AVG(n) AS cooc_avg FROM e GROUP BY 1) e ON n.model = e.model
""")
def f4(spark, sf):
    b = fx.table(spark, sf, "lineitem").selectExpr("l_returnflag AS model", "l_orderkey", "l_partkey % 500 AS item")
    g = compare.graph_density(b, ["l_orderkey"], "item", ["model"])
    return g.withColumns({"cooc_avg": F.round("cooc_avg", 8), "density": F.round("density", 8)})


@query("f5_flatten_phases", """
SELECT row_key, 'before' AS phase, CAST(NULL AS INTEGER) AS is_new_finding FROM findings WHERE phase = 'before'
UNION ALL SELECT row_key, 'after', is_new_finding FROM diffed""", ["findings", "diffed"])
def f5(spark, sf):
    before, after = fx.diffed(spark, sf, [])
    return joins.flatten_phases(before.drop("phase"), after.drop("phase")).select(
        "row_key", "phase", "is_new_finding")


@query("f6_missing_keys", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def f6(spark, sf):
    l = fx.table(spark, sf, "lineitem").selectExpr("l_orderkey AS o_orderkey")
    return joins.missing_keys(fx.table(spark, sf, "orders"), l, ["o_orderkey"])
