"""The registered queries of the corpus operators and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode
from .common import read
from ..operators.staging import scratch
from .exact_dedup import exact_duplicates
from .filter_audit import audit_filters
from .learned_partitions import nearest
from .license_scan import NOT_WORD, PHRASES, TEMPLATES, THRESHOLD, need_of, rivals_of, scan_licenses, template_words
from .packing import pack_documents
from .quality_gam import classify_quality
from .quality_rules import quality_rules
from .secret_scan import BASE, RULES, listed, scan_secrets
from .sharding import shard_rows
from .simhash import hex_print, near_duplicates
from .substrings import remove_repeats
from .whitening import whiten_vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """Every line against every template, and every place of every phrase."""

    def listed(values: list[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    sets = [template_words(t.text) for t in TEMPLATES]
    templates = ", ".join(f"({k}, '{t.label}', {listed(w)}, {need_of(len(w), THRESHOLD)})" for k, (t, w) in enumerate(zip(TEMPLATES, sets)))
    rivals = ", ".join(map(str, rivals_of(TEMPLATES, THRESHOLD)))
    phrases = ", ".join(f"('{label}', {listed(p.split())})" for p, label in PHRASES.items())
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_filter(string_split_regex({lower}, '{NOT_WORD}'), lambda w: w <> '')"
    return f"""
WITH t(k, label, words, need) AS (VALUES {templates}), p(label, words) AS (VALUES {phrases}), q(a, b) AS (VALUES {rivals}),
d AS (SELECT doc_id, coalesce(text, '') AS text, {words.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT doc_id, i, list_distinct({words.format("line")}) AS w FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
c AS (SELECT doc_id, i, k, label, len(list_intersect(b.w, t.words)) / len(t.words) AS best, len(t.words) AS size FROM b, t
      WHERE len(list_intersect(b.w, t.words)) >= need),
m AS (SELECT * FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y JOIN q ON q.b = y.k WHERE q.a = x.k AND y.doc_id = x.doc_id AND y.i = x.i
      AND (y.best > x.best OR y.best = x.best AND y.size > x.size))),
f AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS found, max(best) AS best, list(DISTINCT label) AS labels FROM m GROUP BY doc_id),
s AS (SELECT doc_id, label, i - 1 AS i FROM (SELECT doc_id, label, p.words AS pw, d.w AS w, unnest(range(1, len(d.w) + 1)) AS i FROM d, p)
      WHERE w[i:i + len(pw) - 1] = pw),
g AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS labels FROM s GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word,
       coalesce(array_to_string(list_sort(g.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(g.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN g USING (doc_id)
"""


ORACLES["op1_license_scan"] = _license_sql()


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_secrets(read(spark, sf_dir, "documents"), scratch(spark))

    def found(k: int, kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["number"] == k)).cast("long").alias(f"n_{kind}")

    counts = [found(k, r.kind) for k, r in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    return rows.select("doc_id", *counts, F.sha2(listed(base, RULES).cast("binary"), 256).alias("base_sha256"),
                       listed(F.col("spans"), RULES).alias("spans"))


_SPANS = """
  SELECT doc_id, '{kind}' AS kind, {k} AS k, m, len(m) AS size,
         sum(len(gap)) OVER w + coalesce(sum(len(m)) OVER v, 0) AS start
  FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(string_split_regex(t, '{pattern}')) AS gap,
               generate_subscripts(string_split_regex(t, '{pattern}'), 1) AS no FROM d WHERE regexp_matches(t, '{pattern}'))
  WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING),
         v AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""


def _secret_sql() -> str:
    parts = [_SPANS.format(kind=r.kind, k=k, pattern=r.pattern.replace("'", "''")) for k, r in enumerate(RULES)]
    value = RULES[0].pattern.replace("'", "''")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)}),
f AS (SELECT doc_id, k, start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM s
      WHERE m IS NOT NULL AND (k > 0 OR len(regexp_extract(m, '{value}', 2)) >= 6)),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
             coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (k < 3), '') AS base, string_agg(span, ',' ORDER BY start, k) AS spans
      FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLES["op5_secret_scan"] = _secret_sql()


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents")).drop("tkey")


ORACLES["op6_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
r AS (
  SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", hex_print().alias("fingerprint"), "component_id")


@query
def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("removed")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    texts = decode(encode(read(spark, sf_dir, "documents"), path), path)
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op11_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
j AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 50)::INT + 2 * (100 * list_unique(w) < 65 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false))::INT AS fails
  FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
s AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM j GROUP BY part, fails),
l(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT v.c || w.c || x.c || y.c || z.c AS filter_order,
         [(1, v.b, 0), (2, w.b, v.b), (3, x.b, v.b + w.b), (4, y.b, v.b + w.b + x.b), (5, z.b, 31 - z.b)] AS steps
  FROM l v, l w, l x, l y, l z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND v.b | w.b | x.b | y.b | z.b = 31),
k AS (SELECT filter_order, u[1] AS step, u[2] AS b, u[3] AS earlier FROM (SELECT filter_order, unnest(steps) AS u FROM o)),
r AS (
  SELECT part, filter_order, step, b, sum(n) FILTER (fails & (earlier | b) = 0) AS kept,
         sum(n) FILTER (fails & b > 0 AND fails & earlier = 0) AS removed, sum(n) FILTER (fails & b > 0 AND fails & earlier > 0) AS redundant,
         sum(n) FILTER (fails = b) AS unique_fails, sum(good) FILTER (fails & b > 0 AND fails & earlier = 0) AS good_lost,
         sum(toxic) FILTER (fails & b > 0 AND fails & earlier = 0) AS toxic_lost
  FROM s, k GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, b)::BIGINT AS shapley
FROM r
"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_vectors(read(spark, sf_dir, "embeddings"))
