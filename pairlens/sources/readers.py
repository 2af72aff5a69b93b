"""Readers and writers for reports, run metadata and text artifacts."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.scores import cwe_label

ISSUE = (
    "STRUCT<filename:STRING, line_number:INT, test_id:STRING, test_name:STRING, "
    "issue_severity:STRING, issue_confidence:STRING, issue_text:STRING, issue_cwe:STRUCT<id:INT>>"
)
REPORT_SCHEMA = f"results ARRAY<{ISSUE}>, issues ARRAY<{ISSUE}>"
META_SCHEMA = (
    "patch_apply_success BOOLEAN, experiment_valid BOOLEAN, actual_changed_files ARRAY<STRING>, "
    "apply_strategy STRING, strict_patch_apply BOOLEAN, fuzzy_patch_apply BOOLEAN"
)


def flatten_report(reports: DataFrame, marks: str | None = None) -> DataFrame:
    """One row per finding of a nested report; ``results``, else ``issues``.

    ``marks`` names an array of structs by the positions of the findings: only
    those that have one are kept, and its fields become columns (``by_position``).
    """
    keep = [c for c in reports.columns if c not in ("results", "issues", marks)]
    filled = F.when(F.size(F.coalesce("results", F.array())) > 0, F.col("results")).otherwise(
        F.col("issues")
    )
    if marks is None:
        r = reports.select(*keep, F.posexplode(filled).alias("position", "_r"))
    else:
        # The arrays are paired before they are taken apart: no row holds a whole one.
        pairs = reports.withColumn("_r", filled).select(*keep, F.posexplode(F.arrays_zip("_r", F.col(marks).alias("_m"))).alias("position", "_p"))
        r = pairs.where("_p._m IS NOT NULL").select(*keep, "position", "_p._r", "_p._m.*").drop("place")
        keep += [c for c in r.columns if c not in (*keep, "position", "_r")]
    return r.select(
        *keep,
        F.col("_r.filename").alias("filename"),
        F.col("_r.line_number").alias("line_number"),
        F.col("_r.test_id").alias("test_id"),
        F.col("_r.test_name").alias("test_name"),
        cwe_label("_r.issue_cwe.id").alias("cwe"),
        F.upper(F.coalesce("_r.issue_severity", F.lit(""))).alias("severity"),
        F.upper(F.coalesce("_r.issue_confidence", F.lit(""))).alias("confidence"),
        F.col("_r.issue_text").alias("details"),
        "position",
    )


def by_position(df: DataFrame, by: Sequence[str], position: str, fields: Sequence[str] = (), out: str = "marks") -> DataFrame:
    """One row per ``by`` with an array that holds, at each position, the fields of its row, and null where there is none."""
    listed = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("place"), *fields))).alias("_l"))
    # Every entry after the nulls of the gap before it.
    before = F.concat(F.array(F.lit(-1)), F.transform("_l", lambda x: x["place"]))
    none = F.lit(None).cast(listed.schema["_l"].dataType.elementType)
    filled = F.flatten(F.zip_with("_l", F.slice(before, F.lit(1), F.size("_l")), lambda x, last: F.concat(
        F.array_repeat(none, (x["place"] - last - 1).cast("int")), F.array(x))))
    return listed.select(*by, filled.alias(out))


def path_keys(path: Column, suffix: str) -> dict[str, Column]:
    """Source directory and case of an artifact ``<dir>/<kind>/<case><suffix>``."""
    base = F.substring_index(path, "/", -1)
    return {
        "source_dir": F.element_at(F.split(path, "/"), -3),
        "case": F.substring(base, F.lit(1), F.length(base) - len(suffix)),
    }


def read_findings(spark: SparkSession, path: str, phase: str) -> DataFrame:
    """Scanner reports ``*_<phase>.json`` below ``path`` as flat findings."""
    suffix = f"_{phase}.json"
    raw = (
        spark.read.schema(REPORT_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .json(path)
    )
    # The metadata path is URI-encoded, the path of whole files is not: one key for both.
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    keyed = raw.withColumns(path_keys(plain, suffix))
    return flatten_report(keyed.withColumn("phase", F.lit(phase)))


#: Ending of the name of a pack, and bytes of a row group, the least that a task reads of one.
PACK, PACK_GROUP = ".pack", 8 << 20


def _split_packs(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """What lies directly below ``path``: packs, and files and folders that are none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    below = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    packs = [p.toString() for p in below if p.getName().endswith(PACK)]
    return packs, [p.toString() for p in below if not p.getName().startswith(("_", ".")) and not p.getName().endswith(PACK)]


def write_pack(files: DataFrame, path: str) -> None:
    """(path, content) of many small files as one table below ``path``.

    A file costs about 20 ms to make, name and list, whatever it holds, and
    the driver names them one by one; a pack costs its bytes only.
    """
    files.select("path", F.col("content").cast("binary").alias("content")).write.option("parquet.block.size", PACK_GROUP).option(
        "compression", "zstd").parquet(f"{path}/files{PACK}")


def only_packs(spark: SparkSession, path: str) -> bool:
    """Whether nothing but packs lies directly below ``path``."""
    packs, loose = _split_packs(spark, path)
    return bool(packs) and not loose


def _whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, text) of every matching file, byte for byte; invalid UTF-8 is dropped.

    Files may lie loose below ``path`` or in packs directly below it. The path
    of a packed file is ``path`` and the one it was packed under.
    """
    packs, loose = _split_packs(spark, path)
    raw = None
    if loose or not packs:
        raw = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).load(loose if packs else path).select("path", "content")
        )
    if packs:
        named = F.expr("path RLIKE '[^/]'") if glob == "*" else F.endswith("path", F.lit(glob.removeprefix("*")))
        packed = spark.read.schema("path STRING, content BINARY").parquet(*packs).where(named).select(
            F.concat(F.lit(path.rstrip("/") + "/"), "path").alias("path"), "content")
        raw = packed if raw is None else raw.unionAll(packed)
    text = F.col("content").cast("string")
    clean = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    return raw.select("path", F.when(F.is_valid_utf8(text), text).otherwise(clean).alias("text"))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_dir, folder, name, text) of every file below ``path``, loose or packed, from one listing.

    A name may be a folder of one part file, and folders may be written
    ``column=value``, as a partitioned write leaves them.
    """

    def plain(e: Column) -> Column:
        value = F.regexp_replace(e, "^[^=]+=", "")
        return F.when(e == value, e).otherwise(F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))))

    parts = F.split("path", "/")
    named = F.when(F.contains("path", F.lit("=")), F.transform(parts, plain)).otherwise(parts)
    files = _whole_files(spark, path, "*").withColumn("_e", named)
    last = F.element_at("_e", -1)
    files = files.withColumn("_e", F.when(F.startswith(last, F.lit("part-")), F.slice("_e", F.lit(1), F.size("_e") - 1)).otherwise(F.col("_e")))
    # One row of names per file: conditions on them stay above it, so that a path is taken apart once, not for every use of a name.
    names = F.struct(*[F.try_element_at("_e", F.lit(at)).alias(n) for n, at in (("source_dir", -3), ("folder", -2), ("name", -1))])
    return files.select("text", F.inline(F.array(names))).select("source_dir", "folder", "name", "text")


def parse_reports(files: DataFrame, text: str, marks: str | None = None) -> DataFrame:
    """Findings of report texts, or those with ``marks``; a corrupt report has none."""
    parsed = from_text(files, text, REPORT_SCHEMA)
    report = F.when(F.col("_ok"), F.col("_m"))
    return flatten_report(parsed.withColumns({"results": report["results"], "issues": report["issues"]}).drop("_m", "_ok", text), marks)


def from_text(df: DataFrame, text: str, schema: str) -> DataFrame:
    """JSON text as the struct ``_m``; ``_ok`` is false for null and corrupt text."""
    bad = "_corrupt"
    rec = F.from_json(
        F.col(text), f"{schema}, {bad} STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad},
    )
    out = df.withColumn("_m", rec)
    return out.withColumn("_ok", F.coalesce(F.col("_m").isNotNull() & F.col(f"_m.{bad}").isNull(), F.lit(False)))


def parse_run_metadata(df: DataFrame, text: str, schema: str = META_SCHEMA) -> DataFrame:
    """Metadata JSON text to columns; unreadable text counts as missing."""
    fields = StructType.fromDDL(schema).names
    ok = F.col("_ok")
    return from_text(df, text, schema).select(
        *df.columns,
        ok.cast("int").alias("metadata_ok"),
        *[F.when(ok, F.col(f"_m.{f}")).alias(f) for f in fields],
    )


def read_run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per case; a corrupt file yields a row with metadata_ok = 0."""
    raw = _whole_files(spark, path, "*.json")
    keyed = raw.withColumns(path_keys(F.col("path"), ".json")).drop("path")
    return parse_run_metadata(keyed, "text").drop("text")


def pick_artifacts(files: DataFrame, cases: DataFrame, suffix: str, by: Sequence[str] = ()) -> DataFrame:
    """Artifact of each case: the exact name, else the first name containing it.

    ``files`` has name and text, ``cases`` has case, both have the columns
    ``by`` inside which names are looked up. The exact names are found by an
    equi-join; only cases without one are matched on substrings of the names,
    through the lengths of their ids, so no pair table is built.
    """
    by = list(by)
    names = files.where(F.endswith("name", F.lit(suffix))).select(*by, "name", "text")
    exact = cases.select(*by, "case").join(
        names.withColumn("case", F.substring("name", F.lit(1), F.length("name") - len(suffix))), [*by, "case"], "left")
    found = exact.where(F.col("name").isNotNull())
    rest = exact.where(F.col("name").isNull()).select(*by, "case").withColumn("_len", F.length("case"))
    # Substrings of the stem with the lengths that occur among unmatched cases.
    lengths = rest.agg(F.array_sort(F.collect_set("_len"))).scalar()
    stem = F.length("name") - len(suffix)
    sized = names.select(*by, "name", F.explode(lengths).alias("_n")).where(F.col("_n") <= stem)
    grams = sized.select(
        *by,
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), stem - F.col("_n") + 1),
                    lambda i: F.col("name").substr(i, F.col("_n")),
                )
            )
        ).alias("case"),
        "name",
    )
    first = rest.join(grams, [*by, "case"]).groupBy(*by, "case").agg(F.min("name").alias("name"))
    return found.select(*by, "case", "name", "text").unionByName(
        first.join(names, [*by, "name"]).select(*by, "case", "name", "text")
    )


def pick_artifact(files: DataFrame, cases: DataFrame, suffix: str) -> DataFrame:
    """``pick_artifacts`` for names that are all in one folder."""
    return pick_artifacts(files, cases, suffix)


def read_text_artifacts(spark: SparkSession, path: str, cases: DataFrame, suffix: str) -> DataFrame:
    """Whole-file texts below ``path`` assigned to cases."""
    files = _whole_files(spark, path, f"*{suffix}").select(
        F.substring_index("path", "/", -1).alias("name"), "text"
    )
    return pick_artifact(files, cases, suffix)


def map_source_dir(df: DataFrame, mapping: Mapping[str, str], source: str = "source_dir",
                   out: str = "model") -> DataFrame:
    """Directory name to model; rows of unmapped directories are dropped."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return df.where(F.col(source).isin(list(mapping))).withColumn(out, table[F.col(source)])


def json_first(df: DataFrame, text: str, keys: Sequence[str], out: str = "value") -> DataFrame:
    """First non-empty scalar stored under one of ``keys``, in document order.

    Keys match at any nesting level and in any case. One pass over the text:
    the earliest ``"key": scalar`` wins; a quote inside a string value is
    escaped and so cannot look like a key.
    """
    names = "|".join(keys)
    pattern = (
        rf'(?i)"(?:{names})"\s*:\s*(?:"((?:[^"\\]|\\.)*[^"\\\s](?:[^"\\]|\\.)*)"'
        r"|(-?[0-9][0-9.eE+-]*|true|false))"
    )
    quoted = F.regexp_extract(text, pattern, 1)
    bare = F.regexp_extract(text, pattern, 2)
    decoded = F.from_json(F.concat(F.lit('["'), quoted, F.lit('"]')), "array<string>")[0]
    scalar = F.when(bare == "true", "True").when(bare == "false", "False").otherwise(bare)
    value = F.btrim(F.when(quoted != "", F.coalesce(decoded, quoted)).otherwise(scalar))
    return df.withColumn(out, F.coalesce(value, F.lit("")))


def write_ordered(df: DataFrame, path: str, order: Sequence[str], fmt: str = "parquet",
                  mode: str = "errorifexists") -> DataFrame:
    """Write with the canonical columns first and the extra ones after them.

    Missing canonical columns become nulls; an empty input keeps its schema.
    """
    ordered = order_columns(df, order)
    writer = ordered.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return ordered


def order_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Columns in ``order``, then the rest as they come."""
    have = set(df.columns)
    lead = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in order]
    return df.select(*lead, *[c for c in df.columns if c not in set(order)])
