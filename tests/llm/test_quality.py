"""Text statistics, the learners, packing and sharding."""
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pairlens.llm import packing as K
from pairlens.llm import quality_gam as G
from pairlens.llm import quality_rules as R
from pairlens.llm import sharding as H
from pairlens.llm.text_stats import FEATURES, with_stats


def plain_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_stats(docs, rows, get):
    out = with_stats(docs, ["doc_id"])
    want = sorted(((i, *plain_stats(t)) for i, t, *_ in rows), key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))
    assert get(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want


def test_rules_on_nasty_rows(docs, rows, none, labels, get):
    out = R.quality_rules(docs, labels)
    assert out.count() == len(rows)
    for r in out.collect():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    left = R.keep_quality(docs, labels)
    assert left.columns == docs.columns and left.count() == out.where("kept").count()
    assert R.quality_rules(none, labels).count() == 0 and R.keep_quality(none, labels.limit(0)).count() == 0


def test_covering_finds_conjunctions():
    r = np.random.default_rng(0)
    x = r.random((3000, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 1] <= 0.4) | (x[:, 2] > 0.95)
    rules = R.learn(x, bad, ["log_words", "mean_word", "symbol_rate"])
    names = {"log_words": 0, "mean_word": 1, "symbol_rate": 2}
    said = np.zeros(len(x), bool)
    for rule in rules:
        said |= np.all([x[:, names[n]] <= v if op == "<=" else x[:, names[n]] > v for n, op, v in rule.tests], axis=0)
    assert 1 < len(rules) <= 6 and (said == bad).mean() > 0.97
    assert R.learn(x, bad & False, list(names)) == [] and R.learn(x[:0], bad[:0], list(names)) == []
    # Labels that nothing explains give no rule.
    assert R.learn(x, r.random(3000) < 0.3, list(names)) == []


def test_verdict_names_the_first_rule(spark):
    rows = spark.sql("select 'doc' doc_id, 10L n_words, 5L n_symbols, 10L n_chars union all select 'x', 100L, 0L, 10L union all select 'y', 3L, 0L, 1L")
    rules = [R.Rule((("symbol_rate", ">", 0.2), ("log_words", "<=", 3.0))), R.Rule((("log_words", "<=", 2.0),))]
    assert {r.doc_id: r.v for r in rows.select("doc_id", R.verdict(rules).alias("v")).collect()} == {"doc": 1, "x": None, "y": 2}
    assert str(rules[1]) == "log_words <= 2"


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = G.classify_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    test = out[out.held_out]
    assert len(test) > 50 and (test.predicted == test.quality).mean() > 0.9
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()


def test_labels_of_held_out_rows_are_never_read(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) quality")
    a, b = (G.classify_quality(docs, x).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert a.equals(b)


def test_gam_learns_interactions_and_degenerate_inputs():
    r = np.random.default_rng(4)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = G.fit_gam(x, y)
    assert ((model.predict(x) > 0.5) == (y > 0)).mean() > 0.95 and (0, 1) in model.pairs
    assert 0.5 < G.fit_gam(x, np.ones(4000)).predict(x)[0] < 1
    assert G.fit_gam(x[:0], y[:0]).predict(x)[0] == 0.5
    assert np.isfinite(G.fit_gam(np.zeros((10, 2)), np.arange(10) % 2.0).predict(np.zeros((3, 2)))).all()


def test_gam_on_nasty_rows(docs, rows, none, labels):
    out = G.classify_quality(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert G.classify_quality(none, labels.limit(0)).count() == 0


def test_features_are_finite(docs):
    from pyspark.sql import functions as F

    at = with_stats(docs, ["doc_id"]).select(*(F.expr(f"double({e})").alias(n) for n, e in FEATURES.items())).toPandas()
    assert np.isfinite(at.to_numpy()).all()


def test_packing(docs, rows, none):
    sizes = (16, 64, 256)
    out = K.pack_documents(docs, sizes, group_rows=16).toPandas()
    words = sorted(len((t or "").encode().split()) + 1 for _, t, *_ in rows)
    whole = out.groupby(["doc_id", "piece", "start"], dropna=False).length.sum()
    assert whole.sum() == sum(words) == out.length.sum()
    for _, b in out.groupby("bin_id"):
        b = b.sort_values("offset")
        capacity = b.capacity.iloc[0]
        assert (b.capacity == capacity).all() and b.length.sum() <= capacity
        assert capacity == min(c for c in sizes if c >= b.length.sum())
        assert b.offset.tolist() == [0, *b.length.cumsum().tolist()[:-1]]
    assert K.pack_documents(none).count() == 0


def plain_best_fit(lengths, costs):
    """Quadratic version of the same rules."""
    bins, free = [], []
    for k, n in enumerate(lengths):
        fits = [b for b in range(len(bins)) if free[b] >= n]
        if fits:
            b = min(fits, key=lambda b: free[b])
        else:
            def held(c):
                left = c - n
                for m in lengths[k + 1:]:
                    if m <= left:
                        left -= m
                return c - left

            c = min((c for c in sorted(costs) if c >= n), key=lambda c: (costs[c] / held(c), c))
            bins.append([])
            free.append(c)
            b = len(bins) - 1
        bins[b].append(n)
        free[b] -= n
    return sorted(map(tuple, bins))


def test_best_fit_against_plain():
    r = np.random.default_rng(6)
    for _ in range(60):
        costs = K.costs_of((8, 16, 32))
        lengths = sorted(r.integers(1, 33, r.integers(0, 60)).tolist(), reverse=True)
        where, sizes = K.pack_lengths(lengths, costs)
        bins = [tuple(n for n, w in zip(lengths, where) if w == b) for b in range(len(sizes))]
        # Bins of one room are interchangeable: contents agree as multisets of totals.
        assert sorted(map(sum, bins)) == sorted(map(sum, plain_best_fit(lengths, costs)))
        assert all(sum(b) <= s for b, s in zip(bins, sizes))


def test_waste_is_small(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "id as piece", "id as start", "1 + abs(xxhash64(id)) % 900 as length")
    out = K.best_fit(docs, ["doc_id", "piece", "start"]).groupBy("bin_id").agg({"length": "sum", "capacity": "max"}).toPandas()
    assert out["sum(length)"].sum() / out["max(capacity)"].sum() > 0.98


@pytest.mark.parametrize("shards,group_rows", [(16, 4096), (16, 3), (3, 7), (100, 4)])
def test_sharding(docs, rows, shards, group_rows):
    out = H.shard_rows(docs, shards, group_rows=group_rows).toPandas()
    assert len(out) == len(rows)
    counts = out.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for _, b in out.groupby("shard"):
        assert sorted(b.slot) == list(range(len(b)))
    want = Counter((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter(zip(out.doc_id.fillna(-1).astype(int), out["size"], out.text_crc32)) == want
    mixed = out.groupby(["shard", out.source.fillna("-")]).size().unstack(fill_value=0).reindex(range(shards), fill_value=0)
    share = mixed.sum() / shards
    assert ((mixed - share).abs() <= 2).all().all()


def test_sharding_empty(none):
    out = H.shard_rows(none)
    assert out.count() == 0 and {"doc_id", "shard", "slot"} <= set(out.columns)
