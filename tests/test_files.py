"""Readers, writers and contracts on real files."""
import json

import pytest

from pairlens.sources import contracts, readers


@pytest.fixture()
def runs(tmp_path):
    item = {"filename": "./a.py", "line_number": 3, "test_id": "B101", "test_name": "t", "issue_severity": "HIGH",
            "issue_confidence": "low", "issue_text": "x", "issue_cwe": {"id": 78}}
    for model in ("m1", "m2"):
        (tmp_path / model / "reports").mkdir(parents=True)
        (tmp_path / model / "metadata").mkdir()
        (tmp_path / model / "patches").mkdir()
        (tmp_path / model / "reports" / "case-1_after.json").write_text(json.dumps({"results": [item, {**item, "issue_cwe": None}]}, indent=1))
        (tmp_path / model / "reports" / "case-1_before.json").write_text(json.dumps({"issues": [item]}))
        (tmp_path / model / "metadata" / "case-1.json").write_text(json.dumps({"patch_apply_success": True, "actual_changed_files": ["a.py"]}))
        (tmp_path / model / "metadata" / "case-2.json").write_text("{broken")
        (tmp_path / model / "patches" / "case-1.patch").write_text("+x\n")
        (tmp_path / model / "patches" / "zz-case-2-b.patch").write_text("+two\n")
        (tmp_path / model / "patches" / "aa-case-2.patch").write_text("+one\n")
    return tmp_path


def test_read_findings(spark, runs):
    after = readers.read_findings(spark, str(runs), "after")
    rows = readers.map_source_dir(after, {"m1": "model one"}).orderBy("position").collect()
    assert [(r["model"], r["case"], r["cwe"], r["severity"], r["confidence"]) for r in rows] == [
        ("model one", "case-1", "CWE-78", "HIGH", "LOW"), ("model one", "case-1", "CWE-Unknown", "HIGH", "LOW")]
    assert readers.read_findings(spark, str(runs), "before").count() == 2


def test_encoded_paths_give_one_key(spark, tmp_path):
    (tmp_path / "m 1" / "reports").mkdir(parents=True)
    (tmp_path / "m 1" / "metadata").mkdir()
    (tmp_path / "m 1" / "reports" / "a b+c_after.json").write_text(json.dumps({"results": [{"filename": "x.py"}]}))
    (tmp_path / "m 1" / "metadata" / "a b+c.json").write_text("{}")
    found = readers.read_findings(spark, str(tmp_path / "m 1"), "after").first()
    meta = readers.read_run_metadata(spark, str(tmp_path / "m 1" / "metadata")).first()
    assert (found["case"], found["source_dir"]) == (meta["case"], meta["source_dir"]) == ("a b+c", "m 1")


def test_read_run_metadata(spark, runs):
    m = {r["case"]: r for r in readers.read_run_metadata(spark, str(runs / "m1" / "metadata")).collect()}
    assert m["case-1"]["metadata_ok"] == 1 and m["case-1"]["actual_changed_files"] == ["a.py"]
    assert m["case-2"]["metadata_ok"] == 0 and m["case-2"]["patch_apply_success"] is None


def test_read_text_artifacts(spark, runs):
    cases = spark.createDataFrame([("case-1",), ("case-2",), ("case-9",)], "case string")
    got = {r["case"]: (r["name"], r["text"]) for r in
           readers.read_text_artifacts(spark, str(runs / "m1" / "patches"), cases, ".patch").collect()}
    assert got == {"case-1": ("case-1.patch", "+x\n"), "case-2": ("aa-case-2.patch", "+one\n")}


def test_packed_files_read_like_loose_ones(spark, runs, tmp_path_factory):
    loose = {tuple(r) for r in readers.scan_files(spark, str(runs)).collect()}
    rows = [(str(f.relative_to(runs)), f.read_bytes()) for f in sorted(runs.rglob("*")) if f.is_file()] + [("m3/patches/bad.patch", b"a\xff\n")]
    packed, mixed = str(tmp_path_factory.mktemp("packed")), str(runs)
    files = spark.createDataFrame(rows, "path string, content binary")
    readers.write_pack(files, packed)
    bad = ("m3", "patches", "bad.patch", "a\n")
    assert len(loose) == 14 and {tuple(r) for r in readers.scan_files(spark, packed).collect()} == loose | {bad}
    # A pack beside loose files adds its own to them.
    readers.write_pack(files.where("path LIKE 'm3/%'"), mixed)
    got = [tuple(r) for r in readers.scan_files(spark, mixed).collect()]
    assert len(got) == 15 and set(got) == loose | {bad}
    assert readers._whole_files(spark, packed, "*.patch").count() == 7


def test_run_folders_of_a_query_are_few_files(spark, sf, monkeypatch):
    """A file per report, patch and prompt costs the driver its name; a pack does not."""
    from pairlens.plans import q_sources
    from pairlens.sources import runs as sources

    seen = []
    monkeypatch.setattr(sources, "finding_tables", lambda spark, root, *rest: seen.append(root))
    monkeypatch.setattr(sources, "write_tables", lambda tables, out: {})
    q_sources.made_tables(spark, sf)
    made = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(seen[0]).count()
    assert made < readers.scan_files(spark, seen[0]).count() / 2


def test_write_ordered_keeps_empty_schema(spark, tmp_path):
    df = spark.createDataFrame([], "b int, a string, extra double")
    readers.write_ordered(df, str(tmp_path / "out"), ["a", "b", "c"])
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["a", "b", "c", "extra"]


def test_contracts(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    assert contracts.require(df, ["k", "v"], unique=["k", "v"], rows=2) is df
    for bad in ({"columns": ["z"]}, {"unique": ["k"]}, {"rows": 3}, {"forbidden": ["v"]}):
        with pytest.raises(contracts.ContractError):
            contracts.require(df, **bad)
    assert contracts.shared_keys(df, df.where("v = 'x'"), "k").count() == 1


def test_json_first(spark):
    rows = [('{"a": {"repo": ""}, "b": [{"Repo": "own/x"}], "repo": "late"}', "own/x"), ('{"repo": 7}', "7"),
            ('{"repo": {"repo": "in"}}', "in"), ('{"repo": null, "name": "n"}', "n"), ("{}", "")]
    df = spark.createDataFrame(rows, "j string, want string")
    assert all(r["value"] == r["want"] for r in readers.json_first(df, "j", ["repo", "name"]).collect())


@pytest.fixture()
def many(tmp_path):
    """Two folders of two models; touched files listed, parsed or absent; broken files; a prompt without a run."""
    def item(name, line, text="Use  of 0xAF", severity="HIGH"):
        return {"filename": name, "line_number": line, "test_id": "B1", "test_name": "t", "issue_severity": severity, "issue_confidence": "low",
                "issue_text": text, "issue_cwe": {"id": 78}}

    good = {"patch_apply_success": True, "experiment_valid": True, "repo_name": "own/x", "apply_strategy": "patch -p1"}
    patch = "diff --git a/src/a.py b/src/a.py\n@@ -1 +1 @@\n-x\n+y\n"

    def put(run, folder, name, text):
        (tmp_path / run / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / run / folder / name).write_text(text if isinstance(text, str) else json.dumps(text))

    for run in ("r1", "r2"):
        put(run, "reports", "c1_bandit_before.json", {"results": [item("/t/swe_before_q/repo/src/a.py", 3), item("src/b.py", 1)]})
        put(run, "reports", "c1_bandit_after.json", {"issues": [item("b/src/a.py", 9), item("./src/a.py", 4), item("src/b.py", 1), item("src/a.py", 4, "other", "low")]})
        put(run, "patches", "x-c1-y.patch", patch)
        put(run, "patches", "c1.prompt.txt", "do\nnot be INSECURE")
    put("r1", "metadata", "c1.json", good)
    put("r2", "metadata", "c1.json", {**good, "actual_changed_files": ["src/b.py"], "strict_patch_apply": True})
    put("r1", "metadata", "c2.json", "{broken")
    put("r1", "reports", "c2_bandit_before.json", "{}")
    put("r1", "reports", "c2_bandit_after.json", {"results": [item("src/a.py", 1)]})
    put("r1", "metadata", "c3.json", good)
    put("r1", "reports", "c3_bandit_after.json", {"results": [item("src/a.py", 1)]})
    put("r1", "metadata", "c4.json", good)
    put("r1", "reports", "c4_bandit_before.json", "{broken")
    put("r1", "reports", "c4_bandit_after.json", {"results": None})
    put("r1", "generation_metadata", "c5.json", {"success": False, "error": "status: 429", "end_to_end_attempt_count": 2})
    put("zz", "reports", "c1_bandit_after.json", {"results": [item("src/a.py", 1)]})
    put("r1", "notes", "c1.json", "ignored")
    return str(tmp_path)


def test_finding_tables_from_files(spark, many):
    from pairlens.sources import runs

    t = runs.finding_tables(spark, many, {"r1": "one", "r2": "two"}, ["one", "two"], {"one": 0.5})
    rows = t.findings.orderBy("model", "line_number", "severity").collect()
    # The first of the two equal findings in report order was there before.
    assert [(r["model"], r["relative_filename"], r["line_number"], r["severity"], r["is_new_finding"], r["is_risky_new"]) for r in rows] == [
        ("one", "src/a.py", 4, "HIGH", 1, 1), ("one", "src/a.py", 4, "LOW", 1, 1), ("one", "src/a.py", 9, "HIGH", 0, 1), ("two", "src/b.py", 1, "HIGH", 0, 0)]
    assert t.findings.columns[:4] == ["model", "source_dir", "repo", "case"] and rows[0]["repo"] == "own/x" and rows[0]["finding_line_key"] == "src/a.py|4|B1"
    assert [r["temperature"] for r in rows] == [0.5, 0.5, 0.5, None] and [r["strict_patch_apply"] for r in rows] == [0, 0, 0, 1]
    assert (rows[0]["prompt_chars"], rows[0]["prompt_has_security_guidelines"], rows[0]["patch_churn"]) == (18, 1, 2)
    s = {(r["case"], r["model"]): r for r in t.summary.collect()}
    assert set(s) == {("c1", "one"), ("c1", "two"), ("c4", "one")}
    assert [s["c1", "one"][c] for c in ("findings_before", "findings_after", "findings_new", "findings_resolved_est", "delta_risk", "files_touched")] == [1, 3, 2, 0, 4, 1]
    assert s["c4", "one"]["findings_after"] == 0
    assert {r["case"] for r in t.common_summary.collect()} == {"c1"} and t.common_findings.count() == 4 and t.before.count() == 2
    state = {(r["case"], r["model"]): (r["status"], r["source_dir"]) for r in t.status.collect()}
    assert state["c1", "one"] == ("pipeline_valid", "r1") and state["c5", "one"] == ("rate_limited", "r1") and state["c5", "two"] == ("not_attempted", "r2")
    assert state["c2", "one"][0] == "not_attempted" and state["c4", "one"][0] == "pipeline_valid" and len(state) == 10


def test_tables_of_no_runs(spark, tmp_path):
    from pairlens.sources import runs

    (tmp_path / "x").mkdir()
    t = runs.finding_tables(spark, str(tmp_path), {"r1": "one"}, ["one"])
    paths = runs.write_tables(t, str(tmp_path / "out"))
    assert all(spark.read.parquet(p).count() == 0 for p in paths.values())
    assert spark.read.parquet(paths["findings"]).columns[0] == "model"


def test_findings_are_staged_without_what_only_the_tables_show(spark, many, tmp_path_factory):
    """The wide columns go from the reports to the tables; reports in packs are not copied."""
    from pathlib import Path

    from pairlens.operators import staging
    from pairlens.sources import runs

    packed = str(tmp_path_factory.mktemp("packed"))
    rows = [(str(f.relative_to(many)), f.read_bytes()) for f in sorted(Path(many).rglob("*")) if f.is_file()]
    readers.write_pack(spark.createDataFrame(rows, "path string, content binary"), packed)
    models = {"r1": "one", "r2": "two"}
    loose = runs.finding_tables(spark, many, models, ["one", "two"])
    staging.release(spark)
    got = runs.finding_tables(spark, packed, models, ["one", "two"])
    made = [spark.read.parquet(p) for p in staging._MADE[spark.sparkContext.applicationId]]
    assert not any({"details", "filename", "test_name"} & set(d.columns) for d in made)
    texts = [d for d in made if "text" in d.columns and "kind" in d.columns]
    assert len(texts) == 1 and {r[0] for r in texts[0].select("kind").distinct().collect()} == {"metadata", "generation", "patch", "prompt"}
    assert got.findings.count() == 4 and got.before.count() == 2 and got.common_findings.columns == loose.common_findings.columns
    staging.release(spark)


def test_report_that_is_there_twice(spark, many):
    """A folder of two part files: the findings of both count, each with its own marks."""
    import shutil
    from pathlib import Path

    from pairlens.sources import runs

    path = Path(many) / "r1" / "reports" / "c1_bandit_after.json"
    first = json.loads(path.read_text())["issues"]
    path.unlink()
    path.mkdir()
    gone = {**first[0], "filename": "src/z.py"}
    (path / "part-0.json").write_text(json.dumps({"issues": [gone, gone, *first]}))
    (path / "part-1.json").write_text(json.dumps({"issues": [first[3], gone, {**first[3], "line_number": 77, "issue_text": "third"}]}))
    t = runs.finding_tables(spark, many, {"r1": "one"}, ["one"])
    rows = sorted((r["line_number"], r["severity"], r["details"], r["relative_filename"]) for r in t.findings.collect())
    low, high = ("LOW", "other", "src/a.py"), ("HIGH", "Use  of 0xAF", "src/a.py")
    assert rows == sorted([(9, *high), (4, *high), (4, *low), (4, *low), (77, "LOW", "third", "src/a.py")])
    assert t.summary.where("case = 'c1'").first()["findings_after"] == 5
    shutil.rmtree(path)


def test_marks_by_position(spark):
    df = spark.createDataFrame([(1, 3, "d"), (1, 0, "a"), (1, 4, "e"), (2, 2, "x")], "k int, p int, v string")
    got = {r["k"]: [None if m is None else (m["place"], m["v"]) for m in r["marks"]] for r in readers.by_position(df, ["k"], "p", ["v"]).collect()}
    assert got == {1: [(0, "a"), None, None, (3, "d"), (4, "e")], 2: [None, None, (2, "x")]}


def test_paths_are_taken_apart_once(spark, many):
    """Conditions on the names of a file do not repeat what makes the names."""
    named = readers.scan_files(spark, many).where("folder = 'reports' AND name LIKE '%after%' AND source_dir <> 'r9' AND length(name) > 1")
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2 and plan.count("regexp_replace") <= 2
    assert named.count() > 0
