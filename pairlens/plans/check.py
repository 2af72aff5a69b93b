"""Compare queries with their oracle SQL on one data folder.

usage: python -m pairlens.plans.check SF_DIR [name-prefix ...]
"""
from __future__ import annotations

import math
import sys
import time

import duckdb

from .catalog import ORACLES, QUERIES, TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return str(v) if not isinstance(v, (list, dict)) else str(v)


def _key(row):
    return tuple(
        (0, "") if v is None else (1, f"{v:.4f}") if isinstance(v, float) else (2, str(v)) for v in row
    )


def compare(spark, con, name: str, sf: str) -> str:
    """'' when equal, else the first difference."""
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    if "CartesianProduct" in df._jdf.queryExecution().executedPlan().toString():
        return "cross join"
    got = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    if name not in ORACLES:
        return "" if got else "no rows"
    res = con.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in order) for r in res.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "EMPTY"
    got.sort(key=_key)
    want.sort(key=_key)
    if all(_same(a, b) for a, b in zip(got, want)):
        return ""
    left = set(map(_key, want))
    mine = next((g for g in got if _key(g) not in left), got[0])
    right = set(map(_key, got))
    theirs = [w for w in want if _key(w) not in right] or want
    near = max(theirs, key=lambda w: sum(x == y for x, y in zip(mine, w)))
    diff = {c: (x, y) for c, x, y in zip(cols, mine, near) if not _same((x,), (y,))}
    keep = {c: x for c, x, y in zip(cols, mine, near) if _same((x,), (y,))}
    return f"\n   differ (got, want): {diff}\n   same: {str(keep)[:400]}\n   rows off: {len(theirs)}"


def _same(a, b) -> bool:
    return all(
        type(x) is type(y)
        and (math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-9) if isinstance(x, float) else x == y)
        for x, y in zip(a, b)
    )


def main(argv: list[str]) -> int:
    import os

    from ..session import local_session

    sf, prefixes = argv[0], argv[1:]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            out = compare(spark, con, name, sf)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            out = f"{type(e).__name__}: {str(e)[:1500]}"
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'ok  ' if not out else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {out}", flush=True)
        bad += bool(out)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
