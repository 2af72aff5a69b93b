"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. The ledger holds, per blob,
the rules (with version) it was scanned by and the spans they found. A run scans
only blobs and rules that the ledger lacks, appends what it found, and joins the
findings back to all versions. Everything is DataFrame expressions.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern``, leftmost non-overlapping; matches that fail ``holds`` are dropped.

    Only texts with the literal ``hint`` are searched, where one is given. A new
    ``version`` makes every blob unseen for the rule.
    """

    kind: str
    pattern: str
    version: int = 1
    hint: str | None = None
    least: int = 0
    group: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def holds(self, match: Column) -> Column:
        value = F.regexp_extract(match, self.pattern, self.group) if self.group else match
        return F.length(value) >= self.least


# The base kinds. Runs of hex digits and keys below their least length are left out by the pattern.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=6, group=2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# A private key: the header, and all up to its END line, where no other line of five hyphens comes before. Without END:
# headers of the key and up to 240 lines of base64. The parts are counted so that the JVM's matcher does not recurse deeply.
_PEM_HEAD, _PEM_END = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"-----END [A-Z ]{0,40}PRIVATE KEY-----"
_PEM_GAP = r"""[\x20\x09-\x0D\\"'#>*|+,]+"""
_PEM_FIELDS = r"(?:[\x20\x09-\x0D\\]+[A-Za-z-]{1,40}:\x20?[A-Za-z0-9,.-]+){0,4}"
_PEM_LINES = rf"(?:{_PEM_GAP}[A-Za-z0-9+/=]{{16,}}){{0,60}}" * 4 + r"(?:[\x0A\x0D]+[A-Za-z0-9+/=]{1,15}(?:[\x0A\x0D]|$))?"
_PEM = rf"{_PEM_HEAD}(?:[^-]*(?:-{{1,4}}[^-]+){{0,200}}{_PEM_END}|{_PEM_FIELDS}{_PEM_LINES})"
RULES = BASE + (
    Rule("pem", _PEM, version=2, hint="PRIVATE KEY-----"),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}", hint="AIza"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hint="eyJ"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}", hint="k_live_"),
)
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def running_sums(steps: Column) -> Column:
    """Inclusive running sums of an array of longs, by blocks: linear but for a factor of the block."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def over(s: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: total(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK))))

        def with_sums(at: Column) -> Column:
            base = F.transform(at, lambda _, b: total(F.slice(at, F.lit(1), b)))
            return let(base, lambda bs: F.transform(s, lambda _, i: bs[F.floor(i / _BLOCK).cast("int")] + total(
                F.slice(s, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1))))

        return let(sums, with_sums)

    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(let(steps, over))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """The spans of one rule as structs (start, number, stop); places count code points."""
    kind = "array<struct<start:bigint,number:int,stop:bigint>>"

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
        sizes = F.transform(found, lambda m: F.length(m).cast("long"))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)),
                           F.concat(F.array(F.lit(0).cast("long")), F.slice(sizes, F.lit(1), F.size(found) - 1)), lambda a, b: a + b)
        spans = F.zip_with(running_sums(steps), found, lambda s, m: F.struct(
            s.alias("start"), F.lit(number).alias("number"), (s + F.length(m)).alias("stop"), rule.holds(m).alias("ok")))
        return F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: F.struct(
            x["start"].alias("start"), x["number"].alias("number"), x["stop"].alias("stop")))

    there = text.rlike(rule.pattern)
    if rule.hint:
        there = F.contains(text, F.lit(rule.hint)) & there
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return F.when(there, let(found, placed)).otherwise(F.array()).cast(kind)


LEDGER = "blob string, rules array<string>, spans array<struct<start:bigint,number:int,stop:bigint,rule:string>>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; one that was never written is empty."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def addressed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null is empty) and blob."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("blob"))


def unseen(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob, a row (doc_id) that holds it, and the rules it was not scanned by."""
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    blobs = addressed(docs).groupBy("blob").agg(F.min("doc_id").alias("at"))
    names = F.array(*(F.lit(r.name) for r in rules))
    missing = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "at", missing.alias("missing")).where("size(missing) > 0")


def scan_new(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> None:
    """Scan what the ledger at ``path`` lacks and append it, one row per blob scanned."""
    spark = docs.sparkSession
    todo = unseen(docs, read_ledger(spark, path), rules).withColumnRenamed("blob", "wanted")
    rows = addressed(docs)
    texts = rows.join(todo, rows["doc_id"].eqNullSafe(todo["at"]) & (rows["blob"] == todo["wanted"]))

    def by(k: int, rule: Rule) -> Column:
        spans = F.transform(spans_of(F.col("text"), rule, k), lambda x: F.struct(
            x["start"].alias("start"), x["number"].alias("number"), x["stop"].alias("stop"), F.lit(rule.name).alias("rule")))
        return F.when(F.array_contains("missing", rule.name), spans).otherwise(F.array())

    found = F.concat(*(by(k, r) for k, r in enumerate(rules)))
    scanned = texts.select("blob", F.col("missing").alias("rules"), found.alias("spans"))
    # Repeated rows gave the same findings; the ledger takes them once.
    scanned.dropDuplicates(["blob"]).write.mode("append").parquet(path)


def findings(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, blob and ``spans`` (start, number, stop) of every row of ``docs``, by start and then rule."""
    names = F.array(*(F.lit(r.name) for r in rules))
    order = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))))
    known = read_ledger(docs.sparkSession, path).select("blob", F.filter("spans", lambda s: F.array_contains(names, s["rule"])).alias("spans"))
    # A blob has one row per run that scanned it by further rules.
    per_blob = known.where("size(spans) > 0").groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ranked = F.array_sort(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), order[s["rule"]].alias("number"), s["stop"].alias("stop"))))
    out = addressed(docs).select("doc_id", "blob").join(per_blob.select("blob", ranked.alias("spans")), "blob", "left")
    none = F.array().cast("array<struct<start:bigint,number:int,stop:bigint>>")
    return out.select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column, rules: Sequence[Rule]) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["number"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger up to date and give the findings of every row of ``docs`` (doc_id, text).

    Null texts are empty; repeated rows and copies share one scan; null ids are kept.
    """
    scan_new(docs, path, rules)
    return findings(docs, path, rules)


def merged(spans: Column) -> Column:
    """Spans in order of their start, overlapping ones made one."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        meets = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= s["start"])
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1),
                          F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when(meets, joined).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop")))))

    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,stop:bigint>>"), step)


def redact(docs: DataFrame, path: str, mark: str = "[REDACTED]", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every span that the ledger at ``path`` holds replaced by ``mark``, and ``n_chars`` brought in line.

    All columns stay; no row is added or lost, repeated rows are all kept, and no
    rows stay none. Null texts stay null.
    """
    own, key = free_name(docs, "row__"), "blob__"
    names = F.array(*(F.lit(r.name) for r in rules))
    known = read_ledger(docs.sparkSession, path).select("blob", F.filter("spans", lambda s: F.array_contains(names, s["rule"])).alias("found"))
    spans = known.where("size(found) > 0").groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    spans = spans.select(F.col("blob").alias(key), merged(F.col("found")).alias("cuts__"))
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias(own),
                         F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias(key))
    at = packed.join(spans, key, "left")
    text = F.col(f"{own}.text")

    def cut(cuts: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.substring(
            text, (F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(cuts, F.greatest(i, F.lit(1)))["stop"]) + 1).cast("int"),
            F.when(i == F.size(cuts), F.length(text)).otherwise(
                F.try_element_at(cuts, i + 1)["start"] - F.when(i == 0, F.lit(0)).otherwise(
                    F.try_element_at(cuts, F.greatest(i, F.lit(1)))["stop"])).cast("int")))
        return F.array_join(pieces, mark)

    clean = F.when(F.col("cuts__").isNull(), text).otherwise(cut(F.col("cuts__")))
    fresh = {"text": clean}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("cuts__").isNull(), F.col(f"{own}.n_chars")).otherwise(F.length(clean).cast("long"))
    return at.select(*(fresh.get(c, F.col(f"{own}.`{c}`")).alias(c) for c in docs.columns))
