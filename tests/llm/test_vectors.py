"""Learned partitions, whitening: plain versions, recall and special rows."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import learned_partitions as L
from pairlens.llm import queries as Q
from pairlens.llm import whitening as W

NASTY = [(0, [1.0, 2.0, 0.5]), (20, [1.0, 2.0, 0.5]), (20, [1.0, 2.0, 0.5]), (40, [-1.0, 0.0, 3.0]), (1, [1.0, 2.0, 0.5]), (2, None), (3, [1.0, None, 2.0]),
         (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, [0.0, 0.0, 0.0]), (60, [-0.0, 0.0, 0.0]), (7, [5.0]), (8, []), (None, [1.0, 2.0, 0.5]),
         (80, [2.0, 2.0]), (80, [0.5, -1.0, 0.25]), (9, [-3.0, -3.0, -3.0]), (10, [1e18, 1.0, 0.0])]
SCHEMA = "vec_id long, embedding array<float>, part long, v string, x int, n double, score string, c1 string"


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame([(i, v, None, None, None, None, None, None) for i, v in NASTY], SCHEMA).repartition(3)


def plain_nearest(rows, k):
    """(query, rank, vec_id, score) by all pairs; equal rows once, null ids last on ties."""
    d = max((len(v) for _, v in rows if v), default=0)
    left = set()
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            left.add((i, tuple(np.float32(c) + np.float32(0) for c in v) + (np.float32(0),) * (d - len(v))))
    out = []
    for q in left:
        if q[0] is not None and q[0] % 20 == 0:
            best = sorted((-math.fsum(float(a) * float(b) for a, b in zip(q[1], r[1])), r[0] is None, r[0] or 0) for r in left if r != q)[:k]
            out += [(q[0], n, None if none else i, -s) for n, (s, none, i) in enumerate(best, 1)]
    return out


def rounded(rows):
    return sorted(((q, n, -1 if i is None else i, float(f"{s:.9g}")) for q, n, i, s in rows))


@pytest.mark.parametrize("k", [3, 20])
def test_nearest_on_nasty_rows(nasty, k):
    got = L.nearest(nasty, F.col("vec_id") % 20 == 0, k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert rounded([tuple(r) for r in got.collect()]) == rounded(plain_nearest(NASTY, k))


def test_nearest_of_nothing(nasty):
    assert L.nearest(nasty.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert L.nearest(nasty.where("vec_id = 2"), F.col("vec_id") % 20 == 0).count() == 0
    assert L.nearest(nasty.where("vec_id = 9"), F.lit(True)).count() == 0


@pytest.fixture(scope="module")
def clustered():
    """Vectors of unlike lengths around 40 centres, a third of them equal to one."""
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 12))
    v = (centres[r.integers(0, 40, 1800)] + 0.4 * r.standard_normal((1800, 12))) * r.uniform(0.5, 2, (1800, 1))
    v[::3] = v[0]
    return v.astype(np.float32)


def exact(v, ids, asked, k):
    s = v[asked].astype(float) @ v.T.astype(float)
    s[np.arange(len(asked)), asked] = -np.inf
    return [[int(ids[j]) for j in np.lexsort((ids, -np.round(row, 9)))[:k]] for row in s]


def test_recall_with_learned_levels(spark, clustered):
    """Partitions of partitions, a hot vector, few rows at once: recall holds and rows come from the neighbours' partitions."""
    ids = np.arange(len(clustered)) * 5
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, clustered)], "vec_id long, embedding array<float>")
    got = L.nearest(df, F.col("vec_id") % 20 == 0, part_rows=40, sample=300).toPandas()
    asked = np.flatnonzero(ids % 20 == 0)
    want = exact(clustered, ids, asked, 20)
    found = {q: g.sort_values("rank").vec_id.tolist() for q, g in got.groupby("query_id")}
    assert set(found) == {int(ids[a]) for a in asked} and all(len(f) == 20 for f in found.values())
    hits = [len(set(w) & set(found[int(ids[a])])) for a, w in zip(asked, want)]
    assert np.mean(hits) / 20 >= 0.9
    # Queries equal to the hot vector find its smallest ids first.
    hot = [a for a in asked if (clustered[a] == clustered[0]).all()]
    top = (clustered[0].astype(float) @ clustered.T.astype(float)).max()
    if np.isclose(top, clustered[0].astype(float) @ clustered[0].astype(float)):
        assert all(found[int(ids[a])] == want[list(asked).index(a)] for a in hot)


@pytest.mark.parametrize("limits", [(8192, 4096), (7, 5)])
def test_search_blocks_are_whole(spark, clustered, monkeypatch, limits):
    """One partition of any size in blocks of any size is brute force."""
    monkeypatch.setattr(L, "CANDIDATES", limits[0])
    monkeypatch.setattr(L, "QUERIES", limits[1])
    some = clustered[:300]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(some)], "vec_id long, embedding array<float>")
    got = L.nearest(df, F.col("vec_id") % 20 == 0, k=5).toPandas()
    asked = np.arange(0, 300, 20)
    found = {q: g.sort_values("rank").vec_id.tolist() for q, g in got.groupby("query_id")}
    assert [found[a] for a in asked] == exact(some, np.arange(300), asked, 5)


def test_graph_parts_are_balanced():
    r = np.random.default_rng(0)
    v = np.vstack([r.standard_normal((100, 8)) * 0.1 + c for c in r.standard_normal((4, 8)) * 3])
    near = L._neighbours(L.directions(v), L.lifted(v, np.linalg.norm(v, axis=1).max()), 10)
    parts = L.balanced_parts(near, 5, r)
    assert np.bincount(parts).tolist() == [80] * 5
    four = L.balanced_parts(near, 4, r)
    cut = (four[np.repeat(np.arange(400), 10)] != four[near.ravel()]).mean()
    assert np.bincount(four).tolist() == [100] * 4 and cut < 0.1


def test_queries_skip_partitions():
    """On clustered vectors the classifier routes queries to few partitions that hold their neighbours."""
    r = np.random.default_rng(1)
    centres = r.standard_normal((200, 24))
    v = centres[r.integers(0, 200, 6000)] + 0.3 * r.standard_normal((6000, 24))
    split = L.Split(L.learn_split(v[:3000], 16, np.linalg.norm(v, axis=1).max()))
    place = split.place(v)
    row, part, chance = split.probes(v[::50])
    near = np.argsort(-(v[::50] @ v.T), axis=1)[:, :20]
    got = set(zip(row.tolist(), part.tolist()))
    assert np.mean([(k, place[j]) in got for k, js in enumerate(near) for j in js]) >= 0.9
    assert len(row) / len(near) < 11 and (chance > 0).all()


def plain_whitening(rows):
    left = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in left), default=0)
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for _, v in left], dtype=object)
    return [i for i, _ in left], x


def test_whitening_by_dense_eigenvectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = Q.QUERIES["op13_whitening"](spark, sf).toPandas()
    ids, x = plain_whitening([tuple(r) for r in df.select("vec_id", "embedding").collect()])
    x = x.astype(np.int64)
    y = x - x.mean(0)
    e, u = np.linalg.eigh(y.T @ y / len(y))
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    assert len(got) == len(ids) * 32 and (got.n == len(ids)).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = y @ u / np.sqrt(e)
    sign = np.sign((table * want).sum(0))
    assert np.abs(table - sign * want).max() < 1e-8
    assert np.allclose(got[got.vec_id == ids[0]].sort_values("component").explained, e / np.trace(y.T @ y / len(y)), rtol=1e-10)
    dev = dict(zip(ids, ((len(x) * x - x.sum(0)) ** 2).sum(1)))
    assert (got.deviation == got.vec_id.map(dev)).all()


def test_whitening_on_nasty_rows(nasty):
    got = W.whiten_vectors(nasty.where("vec_id IS NULL OR vec_id <> 10")).toPandas()
    ids, x = plain_whitening([r for r in NASTY if r[0] != 10])
    n, s = len(x), x.sum(0)
    dev = sorted(int(v) for v in ((n * x - s) ** 2).sum(1))
    assert sorted(got[got.component == 1].deviation) == dev and set(got.component) == {1, 2, 3} and len(got) == 3 * n
    assert got.vec_id.isna().sum() == 3 and got.identity_error[0] < 1e-9 and abs(got[got.vec_id == 9].explained.sum() - 1) < 1e-9


def test_whitening_of_little(spark, nasty):
    assert W.whiten_vectors(nasty.where("false")).count() == 0
    assert W.whiten_vectors(nasty.where("vec_id = 9")).count() == 0
    assert W.whiten_vectors(nasty.where("vec_id IN (0, 1)")).count() == 0  # equal rows have no spread
    two = W.whiten_vectors(nasty.where("vec_id IN (0, 9)")).collect()
    assert [r["component"] for r in two] == [1, 1] and sorted(round(r["whitened"], 9) for r in two) == [-1.0, 1.0]
    large = W.whiten_vectors(nasty).collect()
    assert {r["deviation"] for r in large if r["vec_id"] == 10} == {None}


@pytest.mark.parametrize("d, components", [(50, 8), (90, 32)])
def test_filter_finds_flat_spectra(spark, d, components):
    """Close eigenvalues and a far smaller rest: residuals are certified, the basis agrees with a dense solver's."""
    r = np.random.default_rng(d)
    scale = np.concatenate([np.linspace(3.0, 2.8, components + 4), np.full(d - components - 4, 0.6)])
    turn, _ = np.linalg.qr(r.standard_normal((d, d)))
    v = (r.standard_normal((700, d)) * scale) @ turn.T
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows, width = W.gridded(df, "embedding", "vec_id")
    model = W.fit(rows, width, components)
    x = np.floor(64 * v).astype(np.int64)
    y = x - x.mean(0)
    e, u = np.linalg.eigh(y.T @ y / len(y))
    assert width == d and np.allclose(model.values, e[::-1][:components], rtol=1e-12)
    assert np.abs(np.abs((model.vectors * u[:, ::-1][:, :components]).sum(0)) - 1).max() < 1e-10 and model.residual < 1e-11
