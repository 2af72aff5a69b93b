"""From the files of many runs to finding tables: one scan, joined by the keys in the paths."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from ..functions.diffs import diff_metrics, touched_files
from ..functions.paths import norm_path
from ..functions.scores import apply_flags, execution_status, fingerprint, line_key, severity_score
from ..functions.text import has_any, text_size
from ..operators.findings import (
    CODEC, case_model_summary, category_prevalence, common_cohort, file_risk_flags, multiset_diff, restrict_to_touched, touched_paths,
)
from ..operators.staging import stage
from . import readers

# Names of the folders and files of a run, the older columns of the flat table first, and guideline marks of prompts.
SUFFIXES = {"before": "_bandit_before.json", "after": "_bandit_after.json", "patch": ".patch", "prompt": ".prompt.txt"}
FLAT_ORDER = [
    "model", "source_dir", "repo", "case", "report_file", "filename", "line_number", "test_id", "test_name", "cwe", "severity",
    "confidence", "details", "patch_lines", "patch_added", "patch_removed", "patch_files_touched", "patch_hunks", "patch_churn",
    "patch_net", "prompt_chars", "prompt_lines", "prompt_tokens", "prompt_has_security_guidelines", "temperature", "is_risky",
    "category_prevalence", "category_severity_score", "category_weighted_severity",
]
GUIDELINE_MARKS = ["[security-guidelines]", "owasp", "secure", "deny-list", "allow-list", "parameterized", "no eval", "shell=true"]

RUN = ["source_dir", "model", "case"]
META = f"{readers.META_SCHEMA}, repo_name STRING, repo STRING, functional_tests_run BOOLEAN, functional_correctness_claimed BOOLEAN"
GENERATION = "success BOOLEAN, apply_success BOOLEAN, error STRING, end_to_end_attempt_count INT"


@dataclass
class RunFiles:
    """The files of all runs by kind, with source_dir, case (or name) and text."""

    before: DataFrame
    after: DataFrame
    metadata: DataFrame
    generation: DataFrame
    patches: DataFrame
    prompts: DataFrame


def scan_runs(spark: SparkSession, root: str) -> RunFiles:
    """One listing of everything below ``root``; small files share splits.

    ``<source_dir>/<folder>/<name>`` names a file. A name may also be a folder
    of one part file, and folders may be written ``column=value``, which is what
    a partitioned Spark write leaves. Files of no known kind are not kept.

    Loose files are read once. Packs are tables already, so reports, which are
    most of their bytes, are read where they lie.
    """
    files = readers.scan_files(spark, root)
    folders = {"before": "reports", "after": "reports", "metadata": "metadata", "generation": "generation_metadata", "patch": "patches", "prompt": "patches"}
    ending = {**SUFFIXES, "metadata": ".json", "generation": ".json"}
    of = {k: (F.col("folder") == folders[k]) & F.endswith("name", F.lit(v)) for k, v in ending.items()}

    def known(kinds: Sequence[str]) -> DataFrame:
        kind, cut = F.lit(None).cast("string"), F.lit(0)
        for k in kinds:
            kind, cut = F.when(of[k], F.lit(k)).otherwise(kind), F.when(of[k], F.lit(len(ending[k]))).otherwise(cut)
        any_of = F.expr("false")
        for k in kinds:
            any_of = any_of | of[k]
        return files.where(any_of).select(
            "source_dir", F.substring("name", F.lit(1), F.length("name") - cut).alias("case"), "name", kind.alias("kind"), "text")

    # A file has one kind only: no two have the same folder and endings that agree.
    apart = ["before", "after"] if readers.only_packs(spark, root) else []
    rest = stage(known([k for k in ending if k not in apart]), codec=CODEC)
    part = {k: (known([k]) if k in apart else rest.where(F.col("kind") == k)).drop("kind") for k in ending}
    return RunFiles(part["before"], part["after"], part["metadata"], part["generation"], part["patch"], part["prompt"])


def _keyed(files: DataFrame, models: Mapping[str, str]) -> DataFrame:
    return readers.map_source_dir(files, models)


def valid_runs(files: RunFiles, models: Mapping[str, str]) -> DataFrame:
    """Runs with both reports and readable metadata of an applied patch and a complete experiment."""
    meta = readers.parse_run_metadata(_keyed(files.metadata, models), "text", META).drop("text", "name")
    good = meta.where("metadata_ok = 1 AND patch_apply_success AND experiment_valid")
    for reports in (files.before, files.after):
        good = good.join(_keyed(reports, models).select(*RUN), RUN, "left_semi")
    return good


def _with_texts(runs: DataFrame, files: RunFiles, models: Mapping[str, str]) -> DataFrame:
    """Runs with their patch and prompt metrics and the paths that the patch names."""
    out = runs
    for kind, source in (("patch", files.patches), ("prompt", files.prompts)):
        texts = readers.pick_artifacts(_keyed(source, models), runs.select(*RUN), SUFFIXES[kind], RUN[:2])
        out = out.join(texts.select(*RUN, F.col("text").alias(f"_{kind}")), RUN, "left")
    out = diff_metrics(out, "_patch").withColumn("_parsed", touched_files("_patch"))
    out = text_size(out, "_prompt").withColumn("prompt_has_security_guidelines", has_any("_prompt", GUIDELINE_MARKS))
    return out.drop("_patch", "_prompt")


def _found(reports: DataFrame, marks: str | None = None) -> DataFrame:
    """Findings of reports, or those with ``marks``, with their normalised path and identity."""
    found = readers.parse_reports(reports, "text", marks).withColumn("relative_filename", norm_path("filename", "case"))
    return found.withColumn("finding_fingerprint", fingerprint("relative_filename", "test_id", "cwe", "details"))


def _numbered(reports: DataFrame, models: Mapping[str, str]) -> DataFrame:
    """Reports of known models, each with its number among those of its run: one, unless a file is there more than once."""
    return _keyed(reports, models).withColumn("copy", F.row_number().over(W.partitionBy(*RUN).orderBy(F.md5("text"))))


def _restricted(reports: DataFrame, models: Mapping[str, str], runs: DataFrame, touched: DataFrame) -> DataFrame:
    """The findings in touched files of the valid runs, with what decides their novelty and risk."""
    kept = _numbered(reports, models).drop("name").join(runs.select(*RUN, "run"), RUN)
    found = _found(kept).select("run", "copy", "position", "relative_filename", "finding_fingerprint", "cwe", "severity")
    return stage(restrict_to_touched(found, touched, ["run"]), codec=CODEC)


def _whole(reports: DataFrame, models: Mapping[str, str], columns: DataFrame, marked: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """All columns of the findings in ``marked``, with its ``fields``, and those of their run.

    The findings of a run are one file: what was found out about them meets it
    as one row, and the file is read again, instead of shuffling every column.
    """
    marks = readers.by_position(marked.repartition("run"), ["run", "copy"], "position", fields)
    marks = marks.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("copy", "marks"))).alias("marks"))
    told = columns.join(marks, "run").drop("run")
    rest = [c for c in columns.columns if c not in (*RUN, "run")]
    kept = _numbered(reports, models).withColumnRenamed("name", "report_file").join(told, RUN)
    kept = kept.withColumn("marks", F.try_element_at("marks", F.col("copy"))).drop("copy")
    return _found(kept, "marks").select(
        *RUN, "relative_filename", "report_file", "filename", "line_number", "test_id", "test_name", "cwe", "severity", "confidence", "details",
        "finding_fingerprint", line_key("relative_filename", "line_number", "test_id").alias("finding_line_key"),
        severity_score("severity").alias("severity_score"), F.lit(1).alias("file_touched_by_patch"), *fields, *rest)


@dataclass
class FindingTables:
    """The tables made from the files of the runs."""

    findings: DataFrame
    before: DataFrame
    summary: DataFrame
    common_findings: DataFrame
    common_summary: DataFrame
    status: DataFrame


def _run_columns(runs: DataFrame, temperatures: Mapping[str, float]) -> DataFrame:
    flagged = apply_flags(runs, "apply_strategy", "strict_patch_apply", "fuzzy_patch_apply").drop("strict_patch_apply", "fuzzy_patch_apply")
    degree: Column = F.lit(None).cast("double")
    for model, value in temperatures.items():
        degree = F.when(F.col("model") == model, F.lit(float(value))).otherwise(degree)
    said = {c: F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("functional_tests_run", "functional_correctness_claimed")}
    names = [c for c in runs.columns if c.startswith(("patch_", "prompt_")) and c != "patch_apply_success"]
    return flagged.select(
        "run", *RUN, F.coalesce("repo_name", "repo", F.lit("")).alias("repo"), *names, degree.alias("temperature"),
        F.lit("common_parameters_only").alias("decoding_protocol"), *[F.lit(0).alias(f"{c}_comparable") for c in ("temperature", "top_p", "top_k")],
        F.lit(1).alias("patch_apply_success"), F.lit(1).alias("pipeline_valid"), *[c.alias(n) for n, c in said.items()],
        F.col("strict_apply").alias("strict_patch_apply"), F.col("fuzzy_apply").alias("fuzzy_patch_apply"))


def finding_tables(spark: SparkSession, root: str, models: Mapping[str, str], expected: Sequence[str],
                   temperatures: Mapping[str, float] | None = None) -> FindingTables:
    """All finding tables of the runs below ``root``.

    Findings are restricted to touched files: those listed in the metadata,
    else those that the patch names. An AFTER finding is new when its
    fingerprint occurs more often than before; repeats count in report order.
    ``models`` maps folders to models, ``expected`` are the models that a case
    of the common tables must have a valid run of.
    """
    files = scan_runs(spark, root)
    # Written with the rows, the number of a run is the same for all that read them.
    valid = stage(valid_runs(files, models).withColumn("run", F.monotonically_increasing_id()))
    runs = stage(_with_texts(valid, files, models))
    columns = stage(_run_columns(runs, temperatures or {}))
    touched = touched_paths(runs, "actual_changed_files", "_parsed", ["run", "case"])
    touched = stage(touched.select("run", norm_path("relative_filename", "case").alias("relative_filename")).distinct(), codec=CODEC)
    before = _restricted(files.before, models, runs, touched)
    after = _restricted(files.after, models, runs, touched)

    # Report order is a total order within a report.
    diffed = multiset_diff(before, after, ["run", "finding_fingerprint"], "position", ["copy"])
    diffed = stage(diffed.drop("finding_fingerprint"), codec=CODEC)
    flagged = file_risk_flags(diffed, ["run", "relative_filename"]).withColumn("is_risky", F.col("is_risky_after"))
    flagged = stage(flagged.drop("relative_filename", "severity"), codec=CODEC)

    n_touched = touched.groupBy("run").agg(F.count(F.lit(1)).alias("files_touched"))
    counted = case_model_summary(before, diffed, runs, ["run"])
    summary = counted.join(n_touched, "run", "left").na.fill(0, ["files_touched"]).join(columns, "run")
    rest = [c for c in columns.columns if c not in (*RUN, "run")]
    summary = stage(summary.select("run", *RUN, *counted.columns[1:], "files_touched", *rest))
    common = stage(common_cohort(summary, "case", "model", expected).select("case").distinct())
    common_runs = summary.join(common, "case", "left_semi").select("run")

    flags = ["is_new_finding", "existed_before", "is_risky_after", "is_risky_new", "is_risky"]

    def findings(kept: DataFrame) -> DataFrame:
        whole = _whole(files.after, models, columns, kept, flags)
        return readers.order_columns(category_prevalence(whole, rows=kept), FLAT_ORDER)

    return FindingTables(
        findings(flagged), _whole(files.before, models, columns, before), summary.drop("run"),
        findings(flagged.join(common_runs, "run", "left_semi")),
        summary.join(common, "case", "left_semi").drop("run"), run_status(files, models, expected))


def run_status(files: RunFiles, models: Mapping[str, str], expected: Sequence[str]) -> DataFrame:
    """State of every attempted case for every expected model.

    A case is attempted if any run has metadata, generation metadata or a prompt
    of it. Where several folders are one model, the last name counts.
    """
    parts = {k: _keyed(getattr(files, k), models) for k in ("before", "after", "metadata", "generation", "patches", "prompts")}
    attempted = parts["metadata"].select("case").unionAll(parts["generation"].select("case")).unionAll(parts["prompts"].select("case"))
    seen = None
    for part in parts.values():
        seen = part.select("model", "source_dir") if seen is None else seen.unionAll(part.select("model", "source_dir"))
    # One entry per model, a short list.
    last = seen.groupBy("model").agg(F.max("source_dir").alias("d"))
    folders = last.agg(F.map_from_entries(F.collect_list(F.struct("model", "d")))).scalar()
    members = F.explode(F.array(*[F.lit(m) for m in expected])).alias("model")
    grid = attempted.distinct().select("case", members).withColumn("source_dir", F.coalesce(F.try_element_at(folders, "model"), F.lit("")))

    def read(part: DataFrame, schema: str, out: str) -> DataFrame:
        parsed = readers.parse_run_metadata(part, "text", schema).where("metadata_ok = 1")
        fields = StructType.fromDDL(schema).names
        return parsed.select("case", "model", "source_dir", F.struct(*fields).alias(out), F.col("text").alias(f"{out}_text"))

    key = ["case", "model", "source_dir"]
    both = grid.join(read(parts["metadata"], META, "meta").drop("meta_text"), key, "left").join(
        read(parts["generation"], GENERATION, "generation"), key, "left")
    return execution_status(both).select(
        "model", "source_dir", "case", "status", "pipeline_valid", "generation_success", "apply_success", "artifact_http_429",
        "artifact_http_402", F.col("generation.end_to_end_attempt_count").alias("end_to_end_attempt_count"))


def write_tables(tables: FindingTables, path: str, fmt: str = "parquet") -> dict[str, str]:
    """Every table below ``path`` in the canonical column order; an empty one keeps its schema."""
    out = {}
    for name in ("findings", "before", "summary", "common_findings", "common_summary", "status"):
        out[name] = f"{path}/{name}"
        readers.write_ordered(getattr(tables, name), out[name], FLAT_ORDER if name.endswith("findings") else [], fmt)
    return out
