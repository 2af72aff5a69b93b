"""Every registered query against its oracle SQL; queries without one must give rows."""
import duckdb
import pytest

from pairlens.operators import staging
from pairlens.operators.staging import release
from pairlens.plans.catalog import ORACLES, QUERIES, TABLES
from pairlens.plans.check import compare


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


# Results that are empty by design: breaches of a contract, and keys that no table lacks.
MAY_BE_EMPTY = {"a5_require"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    out = compare(spark, con, name, sf)
    if out == "EMPTY":
        assert name in MAY_BE_EMPTY, "no rows to compare"
        return
    assert out == "", out


@pytest.fixture(autouse=True)
def staged_tables_go(spark):
    """What a query has staged is removed after it."""
    yield
    release(spark)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name,wanted", [
    ("d2_file_risk_flags", {"relative_filename", "severity"}), ("d2_null_path", {"relative_filename", "severity"}),
    ("f5_flatten_phases", set()), ("b16_derive_targets", {"severity"}),
    ("e12_review_sample", {"relative_filename", "test_id", "cwe", "severity", "confidence", "changed"})])
def test_diff_stages_only_what_is_read(spark, sf, name, wanted):
    staging.release(spark)
    QUERIES[name](spark, sf)
    made = [spark.read.parquet(p).columns for p in staging._MADE[spark.sparkContext.applicationId]]
    needed = {"phase", "case", "model", "finding_fingerprint", "line_number", "row_key"} | wanted
    assert set(made[0]) == needed and set(made[1]) == needed | {"_nb", "_na"}
    staging.release(spark)


def test_fit_builds_diffs_of_labelled_documents_only(spark, sf):
    from pairlens.plans import fixtures as fx
    from pairlens.plans.q_models import fitted_rows

    d, labels = fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels")
    labelled = {f"doc-{r[0]}" for r in d.join(labels, "doc_id", "left_semi").select("doc_id").collect()}
    some = labels.where("doc_id % 2 = 0").select("doc_id")
    built = {r[0] for r in fx.diffs(spark, sf, some).select("case").collect()}
    assert built == {c for c in labelled if int(c[4:]) % 2 == 0}
    assert {r[0] for r in fitted_rows(spark, sf).select("case").collect()} == labelled


def test_novelty_alone_stages_only_its_columns(spark, sf):
    staging.release(spark)
    QUERIES["c2_multiset_diff"](spark, sf)
    made = [spark.read.parquet(p).columns for p in staging._MADE[spark.sparkContext.applicationId]]
    assert set(made[0]) == {"phase", "case", "model", "finding_fingerprint", "line_number", "row_key"}
    staging.release(spark)


def test_findings_travel_once_for_pairs_and_paths(spark, sf):
    """One shuffle holds the findings; the others hold paths and pairs."""
    from pairlens.plans import fixtures as fx

    plan = fx.findings(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    outer = next(k for k, line in enumerate(plan) if "Join" in line)
    assert "LeftSemi" in plan[outer] and "relative_filename" in plan[outer]
    # No other join lies on the side of the findings, the lines under the first branch.
    depth = len(plan[outer]) - len(plan[outer].lstrip(" :+-"))
    findings = [line for line in plan[outer + 1:] if line[depth:depth + 1] == ":"]
    assert findings and not any("Join" in line for line in findings)


def test_staged_table_is_not_written_again(spark):
    once = staging.stage(spark.range(3).selectExpr("id", "id AS _staged"))
    assert staging.stage(once) is once and staging.stage(once.where("id > 0")) is not once
    staging.release(spark)
