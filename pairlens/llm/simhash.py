"""SimHash near-duplicates, linked through BK-trees.

Equal fingerprints are one node. Four 16-bit blocks of a fingerprint give six
shards of two blocks each; fingerprints that differ in two bits or fewer agree
in at least two blocks and so meet in a shard. A shard builds one BK-tree
(children keyed by their distance to the parent) and follows only the edges
within the radius. In a shard above ``SHARD_ROWS`` the bits that its members do
not share are cut into four blocks again, and once more; shards that share 56
bits have 256 fingerprints at most, so that every tree is small.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .common import arrow, map_rows, text_bytes, text_key
from .components import components

RADIUS = 2
SHINGLE = 3
SHARD_ROWS = 4096
_PAIRS = [(i, j) for i in range(4) for j in range(i)]


def _finer(mask: int) -> list[int]:
    """Masks of a shard's shards: its shared bits and two of the four blocks of the others."""
    rest = [k for k in range(64) if not mask >> k & 1]
    blocks = [sum(1 << k for k in rest[n * len(rest) // 4:(n + 1) * len(rest) // 4]) for n in range(4)]
    return [mask | blocks[i] | blocks[j] for i, j in _PAIRS]


#: The masks of the shards, and of the shards that each is split into.
_FIRST = _finer(0)
_SPLIT = {m: _finer(m) for m in [*_FIRST, *(f for m in _FIRST for f in _finer(m))]}


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The hash of every run of ``width`` words; a text of fewer words is one run."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    n = max(len(words) - width + 1, 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[:n].tolist()
    stops = (ends - 1)[min(width, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, stops)], "<u8")


def fingerprint_of(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text as a signed integer."""
    return print_of(shingle_hashes(text, width))


def print_of(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: bits set in over half of them."""
    n = len(h)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 8192):  # a block of bits at a time, for very long texts
        ones += np.unpackbits(h[k:k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


class BKTree:
    """A metric tree over 64-bit integers under the Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        if self.values:
            while True:
                d = (self.values[at] ^ value).bit_count()
                if d == 0:
                    return
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = len(self.values)
                    break
                at = nxt
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """The places of all values at most ``radius`` bits away."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            stack.extend(c for e, c in self.children[at].items() if d - radius <= e <= d + radius)
        return found


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """For every value linked in this shard, its smallest connected value."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    values = sorted(set(values))
    for k, v in enumerate(values):
        for near in tree.within(v & (1 << 64) - 1, radius):
            a, b = root(near), root(k)
            parent[max(a, b)] = min(a, b)
        tree.add(v & (1 << 64) - 1)
    return [(v, values[root(k)]) for k, v in enumerate(values) if root(k) != k]


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key:
                    if len(held) > 1:
                        out += tree_links(held, radius)
                    key, held = k, []
                held.append(v)
            if out:
                yield batch()
                out = []
        if len(held) > 1:
            out += tree_links(held, radius)
        if out:
            yield batch()

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def link_fingerprints(prints: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that connect what lies within two bits among the distinct ``fp`` values."""
    masks = F.array(*[F.lit(_signed(m)) for m in _FIRST])
    finer = F.create_map(*[x for m, fs in _SPLIT.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in fs]))])
    members, links = prints.select("fp", F.explode(masks).alias("mask")), None
    for last in (False, False, True):
        members = members.withColumn("shared", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = members.groupBy("mask", "shared").count().where("count > 1")
        met = stage(members.join(sizes, ["mask", "shared"]))
        small = met if last else met.where(F.col("count") <= shard_rows)
        key = F.xxhash64("mask", "shared")
        # Shards whose hashes are equal share a tree, which finds the links of both.
        shards = small.select(key.alias("key"), "fp").repartition("key").sortWithinPartitions("key")
        found = arrow(shards, _shard_links(RADIUS), "a long, b long")
        links = found if links is None else links.unionAll(found)
        if not last:
            members = met.where(F.col("count") > shard_rows).select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
    return links


def near_duplicates(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, tkey, fp, root, component_id) for every row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows with a null id get a component; it is named by its smallest id, null if
    it has none.
    """
    body = "__body"
    rows = stage(map_rows(docs.select("doc_id", text_key().alias("tkey"), text_bytes().alias(body)),
                          lambda t: (fingerprint_of(t),), [body], "fp long"))
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = components(link_fingerprints(prints.select("fp"), shard_rows), "a", "b").withColumnRenamed("node", "fp")
    named = prints.join(links, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = stage(named.join(least, "root").select("fp", "root", "component_id"))
    return rows.join(names, "fp").select("doc_id", "tkey", "fp", "root", "component_id")


def hex_print(col: str = "fp"):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def near_representatives(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, tkey) of the document with the smallest id (null last) of every component."""
    rows = near_duplicates(docs, shard_rows)
    head = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "tkey")).alias("head")
    return rows.groupBy("root").agg(head).select("head.doc_id", "head.tkey")
