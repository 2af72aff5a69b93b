"""The registered queries against their SQL, and the pipeline against a plain version of it."""
import re

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from pairlens.llm import queries as Q
from pairlens.llm.packing import CAPACITIES
from pairlens.llm.secret_scan import RULES

from .test_dedup import plain_copies, plain_exact
from .test_text import plain_spans

NAMES = [f"op{n}_" for n in range(1, 14)]


def test_all_queries():
    assert sorted(re.match(r"op\d+_", n)[0] for n in Q.QUERIES) == sorted(NAMES)
    import __spark_entry__ as entry

    assert {*Q.QUERIES, "pipeline"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(Q.ORACLES[name]).df()
    cols = sorted(want.columns)
    key = [c for c in ("doc_id", "part", "filter_order", "step") if c in cols]
    a, b = (x[cols].sort_values(key).reset_index(drop=True) for x in (Q.QUERIES[name](spark, sf).toPandas(), want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_pipeline(spark, sf, get):
    """Stage by stage: what each keeps follows from the plain versions on what it was given."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = docs.toPandas()
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        after = step(spark, docs, sf).persist()
        got = after.toPandas()
        if k < 4:
            assert after.columns == columns
        if name == "quality_rules":
            kept = Q.quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").toPandas()
            assert sorted(got.doc_id) == sorted(kept.doc_id) and 0 < len(got) < len(before)
        elif name == "exact_dedup":
            assert sorted(got.doc_id) == sorted({r[1] for r in plain_exact(list(before.itertuples(index=False, name=None)))})
        elif name == "simhash_near_dedup":
            groups, least = plain_copies([t or "" for t in before.text]), {}
            for i, g in zip(before.doc_id, groups):
                least[g] = min(i, least.get(g, i))
            assert sorted(got.doc_id) == sorted(least.values())
        elif name == "secret_scan":
            assert sorted(got.doc_id) == sorted(before.doc_id)
            assert not any(plain_spans(t, RULES) for t in got.text)
            assert got[~got.text.str.contains("[REDACTED]", regex=False)].merge(before, on=columns).shape[0] == sum(
                not plain_spans(t, RULES) for t in before.text)
        else:
            assert sorted(got.groupby("doc_id").length.sum()) == sorted(len(t.encode().split()) + 1 for t in before.text)
            bins = got.groupby("bin_id").agg({"length": "sum", "capacity": ["min", "max"]})
            assert (bins[("length", "sum")] <= bins[("capacity", "min")]).all() and set(got.capacity) <= set(CAPACITIES)
        docs, before = spark.createDataFrame(after.collect(), after.schema), got
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == docs.columns and whole.count() == docs.count()


def test_stages_on_nasty_rows(spark, sf, docs, none):
    for given in (docs, none):
        at = given
        for k, (_, step) in enumerate(corpus_pipeline.STAGES):
            at = step(spark, at, sf)
            if k < 4:
                assert at.columns == given.columns
        assert at.count() >= 0
