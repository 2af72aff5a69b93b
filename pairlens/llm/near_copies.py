"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

At similarity 0.8 SimHash fingerprints differ in about ten of 64 bits, too many
for shards of equal blocks. The BK-trees over fingerprints therefore give the
closest links only; MinHash bands give the candidates for the others. Every
link is confirmed by the exact Jaccard similarity of the shingle sets.

1. Equal sets are one node. Fingerprints that the trees link are compared.
2. Nodes that agree in a band meet in its bucket. Two star rounds compare every
   node with one head of the bucket, the node that has most company over all its
   buckets: in a family of edited copies that is the text they were made from.
3. Nodes of a bucket that are in no component with most of it are compared with
   all others there, unless an upper bound excludes it. Both only have in common
   what occurs in another component at all, and of that, counted over ranges of
   the hash, no more than the smaller count of each range. Bounds are exact, so
   no link is lost, and edited copies are told apart by them without being paired.
"""
from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .common import map_rows, text_bytes, text_key
from .components import components
from .simhash import link_fingerprints, print_of, shingle_hashes

WIDTH = 5
LEAST = 0.8
#: Two sets of similarity 0.8 share no band with probability (1 - 0.8 ** 5) ** 32 = 3e-6.
BANDS, BAND_ROWS = 32, 5
#: Star rounds before the rest is compared; the result does not depend on their number.
STARS = 2
#: Ranges of the hash that common shingles are counted over.
RANGES = 32
_DRAW = np.random.default_rng(42)
_XOR = _DRAW.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)[:, None]
_FACTOR = _DRAW.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)[:, None] | np.uint64(1)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; a text of fewer words is one shingle, without words it has none."""
    return np.unique(shingle_hashes(text, width))


def set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def bands_of(hashes: np.ndarray) -> list[int]:
    """One signed integer per band of minima."""
    if not len(hashes):
        return []
    least = np.full(len(_XOR), (1 << 64) - 1, np.uint64)
    for k in range(0, len(hashes), 256):  # blocks that fit the cache, for texts of any length
        x = (hashes[k:k + 256] ^ _XOR) * _FACTOR
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(r.tobytes(), j)).view(np.int64)) for j, r in enumerate(rows)]


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose ``sets`` (node, n, hashes) have a Jaccard similarity of at least ``least``."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    # Sizes first: sets too unlike in size are never carried together.
    sizes = pairs.join(one.drop("ha"), "a").join(two.drop("hb"), "b")
    near = sizes.where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9).select("a", "b")
    both = near.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.select("a", "b", "na", "nb", common.alias("common")).where(
        F.col("common") >= least * (F.col("na") + F.col("nb") - F.col("common")) - 1e-9).select("a", "b")


def _named(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``nodes`` with the root of their component, themselves if they have no link."""
    if roots is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(at: DataFrame) -> DataFrame:
    """``at`` (key, node, root, ...) in buckets with two components or more, with ``main``, the root of most of the bucket."""
    parts = at.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    top = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "root")).alias("top"))
    return at.join(top.where("parts > 1").select("key", F.col("top.root").alias("main")), "key")


def _stars(at: DataFrame, first: bool) -> DataFrame:
    """Pairs (a, b) of the members of open buckets with the head of theirs; after the first round, with a head outside the main component."""
    members = at if first else at.where("root <> main")
    heads = members.groupBy("key").agg(F.max(F.struct("weight", "node", "root")).alias("h")).select(
        "key", F.col("h.node").alias("b"), F.col("h.root").alias("rb"))
    return members.join(heads, "key").where("root <> rb").select(F.col("node").alias("a"), "b").distinct()


def _bounded(at: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members of a bucket in different components that the bounds leave."""
    nodes = at.select("node", "root").distinct()
    spread = stage(nodes.join(sets, "node").select("node", "root", "n", F.explode("hashes").alias("h")))
    shared = spread.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
    counted = spread.join(shared, "h", "left_semi").groupBy("node").agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("c"),
        F.array(*[F.count_if(F.pmod("h", F.lit(RANGES)) == k).cast("short") for k in range(RANGES)]).alias("ranges"))
    able = stage(counted.where(F.col("c") >= least * F.col("n") - 1e-9))
    at = stage(_open(at.drop("main").join(able, "node")))
    one = at.where("root <> main").select("key", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "main", "n", "c", "ranges")])
    two = at.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "c", "ranges")])
    # |A and B| >= t * |A or B| is |A and B| >= t / (1 + t) * (|A| + |B|).
    need = least / (1 + least) * (F.col("n_a") + F.col("n_b")) - 1e-6
    both = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
    met = one.join(two, (one["key"] == two["key"]) & (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main_a")) | (
        F.col("node_a") < F.col("node_b"))) & (F.least("c_a", "c_b") >= need) & (both >= need))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_copies(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(doc_id, tkey, node, root) for every row of ``docs`` (doc_id, text); rows with one root are near copies.

    Connected through pairs at or above ``least``. Null and empty texts, and
    repeated rows, are copies of each other. No rows give no rows.
    """
    body = "__body"
    texts = docs.select("doc_id", text_key().alias("tkey"), text_bytes().alias(body))

    def sketch(text: bytes) -> tuple:
        hashes = shingle_set(text, width)
        return set_id(hashes), print_of(hashes), bands_of(hashes)

    rows = stage(map_rows(texts, sketch, [body], "node long, fp long, bands array<long>"))
    nodes = stage(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("tkey").alias("tkey")))
    keys = nodes.select("node", "tkey", F.explode("bands").alias("key"))
    sizes = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    met = stage(keys.join(sizes, "key"))
    weights = met.groupBy("node").agg(F.sum("size").alias("weight"))
    prints = nodes.where("size(bands) > 0").groupBy("fp").agg(F.min(F.struct("node", "tkey")).alias("x")).select("fp", "x.node", "x.tkey")
    prints = stage(prints)
    close = link_fingerprints(prints.select("fp"))
    close = stage(close.join(prints.select(F.col("fp").alias("a"), F.col("node").alias("na"), F.col("tkey").alias("ta")), "a").join(
        prints.select(F.col("fp").alias("b"), F.col("node").alias("nb"), F.col("tkey").alias("tb")), "b").select("na", "nb", "ta", "tb"))
    # Sets of candidates only, one text for each node.
    wanted = met.select("tkey").unionAll(close.select("ta")).unionAll(close.select("tb")).distinct()
    some = texts.select("tkey", body).join(wanted, "tkey", "left_semi").dropDuplicates(["tkey"])

    def members(text: bytes) -> tuple:
        hashes = shingle_set(text, width)
        return set_id(hashes), len(hashes), hashes.view(np.int64).tolist()

    sets = stage(map_rows(some, members, [body], "node long, n long, hashes array<long>")).select("node", "n", "hashes")
    at = stage(met.select("key", "node").join(weights, "node"))
    links = stage(confirmed(close.select(F.col("na").alias("a"), F.col("nb").alias("b")), sets, least))
    for k in range(STARS):
        roots = components(links, "a", "b")
        open_ = stage(_open(_named(at, roots)))
        links = links.unionAll(stage(confirmed(_stars(open_, k == 0), sets, least)))
    open_ = stage(_open(_named(at.drop("weight"), components(links, "a", "b"))))
    links = links.unionAll(stage(confirmed(_bounded(open_, sets, least), sets, least)))
    return _named(rows.select("doc_id", "tkey", "node"), stage(components(links, "a", "b"))).select("doc_id", "tkey", "node", "root")


def copy_representatives(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(doc_id, tkey) of the document with the smallest id (null last) of every group of near copies."""
    head = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "tkey")).alias("head")
    return near_copies(docs, width, least).groupBy("root").agg(head).select("head.doc_id", "head.tkey")
