"""Filter orders against a plain loop over all of them."""
import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pandas as pd
import pytest

from pairlens.llm import filter_audit as A
from pairlens.llm import queries as Q


def plain_audit(rows, labels):
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    firsts = defaultdict(list)
    for i, t, *_ in rows:
        if i is not None:
            firsts[t or ""].append(i)
    docs = []
    for i, t, _, source, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(firsts[t]) < i}
        docs.append((source or "", {f for f, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = defaultdict(int)
        rows_ = []
        for p in permutations("ABCDE"):
            left, gone = mine, []
            for k, f in enumerate(p, 1):
                hit = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left, gone = [d for d in left if f not in d[1]], gone + hit
                shapley[f] += len(hit)
                rows_.append((("".join(p), k, f), (len(left), len(hit), redundant, sum(d[1] == {f} for d in mine), sum(d[2] for d in hit), sum(d[3] for d in hit))))
        out |= {(part, o, k): (*v, shapley[f]) for (o, k, f), v in rows_}
    return out


def test_audit(docs, labels, rows):
    more = labels.unionByName(labels.sparkSession.createDataFrame([(20, 1, 1), (21, 1, None), (6, 1, 0)], labels.schema))
    got = A.audit_filters(docs, more)
    table = {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()}
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert table == plain_audit(rows, [tuple(r) for r in more.collect()])
    assert got.dtypes[:3] == [("part", "string"), ("filter_order", "string"), ("step", "int")] and {t for _, t in got.dtypes[3:]} == {"bigint"}


def test_audit_without_rows(none, docs, labels):
    assert A.audit_filters(none, labels).count() == 0
    bare = {(r[0], r[1], r[2]): tuple(r[3:]) for r in A.audit_filters(docs, labels.where("false")).collect()}
    assert all(v[4] == v[5] == 0 for v in bare.values()) and len(bare) % 600 == 0


def test_other_filters_and_hot_texts(spark):
    """Two filters of a user's own; a third of the rows is one row."""
    ids = [(k % 5, 7, "p", 1, 0, 1) for k in range(5)] + [(9, 9, "p", 0, 1, 400), (9, 9, "q", 0, 0, 3)]
    rows = spark.createDataFrame(ids, "k1 long, k2 long, part string, good int, toxic int, n long")
    fails = spark.createDataFrame([(9, 9, 0), (9, 9, 1), (0, 7, 1), (3, 7, 0)], "k1 long, k2 long, number int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in A.audit_orders(A.Failing(rows, fails), "XY").collect()}
    assert got["p", "XY", 1] == (4, 401, 0, 1, 1, 400, 402) and got["p", "XY", 2] == (3, 1, 400, 1, 1, 0, 402)
    assert got["p", "YX", 1] == (4, 401, 0, 1, 1, 400, 402) and got["q", "YX", 2] == (0, 0, 3, 0, 0, 0, 3) and len(got) == 8


def test_shapley_adds_up(spark, sf):
    got = Q.QUERIES["op12_filter_audit"](spark, sf).toPandas()
    n = duckdb.sql(f"SELECT coalesce(source, '') AS part, count(*) AS n FROM '{sf}/documents.parquet' GROUP BY 1").df().set_index("part").n
    last = got[got.step == 5].set_index("part")
    first = got[(got.filter_order == "ABCDE")].groupby("part").shapley.sum()
    removed = n - last.groupby(level=0).kept.first()
    assert (last.groupby(level=0).kept.nunique() == 1).all() and ((first / 120 - removed).abs() < 1e-9).all()
    assert (got.groupby("part").size() == 600).all() and set(got.part) == set(n.index)
