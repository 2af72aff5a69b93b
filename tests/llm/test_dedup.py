"""Exact and near duplicates against plain versions."""
import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlens.llm import exact_dedup as E
from pairlens.llm import simhash as S
from pairlens.llm.common import keep_rows
from pairlens.llm.components import components


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 16])
def test_exact(docs, rows, get, chunk):
    out = E.exact_duplicates(docs, chunk_chars=chunk).persist()
    found = sorted(get(out, "doc_id", "keep_id", "group_size", "text_sha256"), key=lambda t: tuple((x is not None, x) for x in t))
    assert found == plain_exact(rows)
    kept = out.where("kept").collect()
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({r[3] for r in plain_exact(rows)})
    left = keep_rows(docs, out.where("kept"))
    assert left.columns == docs.columns and left.count() == len(kept)


def test_exact_empty(none):
    assert E.exact_duplicates(none).count() == 0


@given(st.binary(max_size=3000), st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_fingerprints_compose(a, b):
    assert E.compose(E.chunk_hash(a), E.chunk_hash(b)) == E.chunk_hash(a + b)
    want = [0, 0]
    for byte in a:
        want = [(h * base + byte) % p for h, base, p in zip(want, E.BASES, E.PRIMES)]
    assert list(E.chunk_hash(a)[:2]) == want


def test_collision_is_found(spark, get):
    docs = spark.createDataFrame([(1, "ab cd"), (2, "abcd"), (3, "abce")], "doc_id long, text string")
    from pairlens.llm.common import text_key

    one = docs.select("doc_id", text_key().alias("tkey"), (docs.doc_id * 0).alias("k"))
    assert get(E.differing(docs, one, ["k"], 2)) == [(0,)]
    assert get(E.differing(docs, one.where("doc_id < 3"), ["k"], 2)) == []


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[k:k + 3]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(values, radius=2):
    """Smallest member of each value's component."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for k, a in enumerate(values):
        for b in values[:k]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {v: root(v) for v in values}


@pytest.mark.parametrize("shard_rows", [1, 4096])
def test_simhash(docs, rows, get, shard_rows):
    prints = [plain_print(t) for _, t, *_ in rows]
    groups, least = plain_groups(prints), {}
    for (i, *_), p in zip(rows, prints):
        if i is not None:
            least[groups[p]] = min(i, least.get(groups[p], i))
    want = sorted(((i, f"{p:016x}", least.get(groups[p])) for (i, *_), p in zip(rows, prints)),
                  key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))
    out = S.near_duplicates(docs, shard_rows).withColumn("print", S.hex_print())
    assert get(out, "doc_id", "print", "component_id") == want
    left = keep_rows(docs, S.near_representatives(docs, shard_rows))
    assert left.count() == len(set(groups.values())) and left.columns == docs.columns


def test_simhash_empty(none):
    assert S.near_duplicates(none).count() == 0
    assert keep_rows(none, S.near_representatives(none)).count() == 0


@pytest.mark.parametrize("shard_rows", [3, 4096])
def test_links_connect_all_within_radius(spark, shard_rows):
    r = random.Random(3)
    values = [r.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    for v in list(values):
        for _ in range(6):
            for _ in range(r.randint(0, 3)):
                v ^= 1 << r.randrange(64)
            values.append(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = S.link_fingerprints(prints, shard_rows).persist()
    found = {r.node: r.root for r in components(links, "a", "b").collect()}
    groups = plain_groups(signed)
    assert {v: found.get(v, v) for v in signed} == groups
    assert all(((x.a ^ x.b) & (1 << 64) - 1).bit_count() <= 4 or groups[x.a] == groups[x.b] for x in links.collect())


def test_tree_follows_only_what_can_be_near():
    r = random.Random(1)
    values = [r.getrandbits(64) for _ in range(300)]
    tree = S.BKTree()
    for v in values + values[:5]:
        tree.add(v)
    assert len(tree.values) == 300
    for q in values[:20]:
        assert sorted(tree.values[k] for k in tree.within(q ^ 5, 2)) == sorted(v for v in values if (v ^ q ^ 5).bit_count() <= 2)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (901, 900), (900, 902)], "a long, b long")
    found = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert found == {**{k: 0 for k in range(1, 201)}, 901: 900, 902: 900}


def plain_shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def plain_copies(texts, least=0.8):
    """The number of each text's component under exact Jaccard similarity of all pairs."""
    sets, parent = [plain_shingles(t) for t in texts], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if a == b or len(a & b) >= least * len(a | b):
                x, y = sorted((root(j), root(k)))
                parent[y] = x
    return [root(k) for k in range(len(texts))]


def planted_copies():
    """Texts, copies with single words changed so that the similarity lies on both sides of 0.8, and clean texts."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(900)]
    texts = []
    for k in range(40):
        base = [r.choice(words) for _ in range(r.choice([30, 60, 150, 400]))]
        texts.append(" ".join(base))
        for changes in (1, len(base) // 60, len(base) // 45, len(base) // 40, len(base) // 30, len(base) // 10):
            copy = list(base)
            for at in r.sample(range(len(base)), changes):
                copy[at] = "changed" + str(r.random())
            texts.append(" ".join(copy))
    shared = " ".join(r.choice(words) for _ in range(40))  # a passage that many clean texts hold
    texts += [" ".join(r.choice(words) for _ in range(80)) + " " + shared for _ in range(40)]
    hot = [r.choice(words) for _ in range(100)]  # a large group, near its middle but not always near each other
    for k in range(80):
        copy = list(hot)
        for at in r.sample(range(100), r.randint(1, 3)):
            copy[at] = f"hot{k}x{at}"
        texts.append(" ".join(copy))
    return texts + ["", None, "one", "One", "one two three four"]


@pytest.mark.parametrize("stars", [0, 2])
def test_near_copies_by_brute_force(spark, get, monkeypatch, stars):
    from pairlens.llm import near_copies as N

    monkeypatch.setattr(N, "STARS", stars)
    texts = planted_copies()
    roots = plain_copies(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = N.copy_representatives(docs)
    assert get(left.select("doc_id")) == [(k,) for k in sorted(set(roots))]
    assert 100 < len(set(roots)) < len(texts) - 150


def test_near_stage_removes_copies_and_keeps_clean(spark, sf, get):
    import corpus_pipeline

    texts = planted_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert get(corpus_pipeline.near_dedup(spark, docs, sf).select("doc_id")) == [(k,) for k in sorted(set(plain_copies(texts)))]


def test_near_copies_on_nasty_rows(docs, none, rows):
    from pairlens.llm import near_copies as N

    left = keep_rows(docs, N.copy_representatives(docs))
    assert left.columns == docs.columns and left.count() == len(set(plain_copies([t for _, t, *_ in rows])))
    assert keep_rows(none, N.copy_representatives(none)).count() == 0
