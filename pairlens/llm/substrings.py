"""Removal of repeated passages by prefix-partitioned suffix trees over words.

A suffix matters if its first ``window`` words also begin another suffix. Not
every suffix has to be looked at: of the ``ANCHOR``-word prefixes that begin
inside a window the one with the least hash is the window's anchor, and equal
windows have equal anchors at the same place. The steps:

1. Neighbouring windows with one anchor form a context. An anchor that occurs
   once makes all windows of its context unique; a context that occurs twice
   makes all of them repeated. Counting settles what no tree could tell apart,
   and copies however many are combined before the shuffle.
2. What is left are distinct contexts that share an anchor, as at the edges of
   copied passages. The suffixes that begin in them are grouped by the anchor, a
   prefix of 8 words. A group of more than ``group_words`` words is split by
   prefixes of 12, 18 and 27 words, step by step until each part fits; a
   suffix that is alone under a prefix is unique. A part that is too large
   under the full ``window`` is a single node, and needs no tree.
3. A task builds the subtrees of its groups: suffixes in order and, between
   neighbours, the depth of the node that joins them. The deepest internal node
   above a suffix is the longest repeat that begins there; nodes of ``window``
   words and more are the repeats that are removed.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .common import arrow, text_bytes, text_key

WINDOW = 35
ANCHOR = 8
#: Words of the contexts or suffixes of one group, and of the groups whose trees a task builds at once.
GROUP_WORDS, TREE_WORDS = 1 << 18, 1 << 19
#: Lengths of the prefixes that large groups are split by.
LONGER = (12, 18, 27)
#: Bits that tell which texts hold a context of a large group, 2 MB however many there are.
FILTER_BITS = 1 << 24
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Hashes(dict):
    """XXH64 of words, remembered for the words of one task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


@lru_cache(maxsize=2)
def _powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any stretch of a sequence of word hashes."""

    def __init__(self, words: np.ndarray) -> None:
        log = max(int(len(words)).bit_length(), 12)
        up, self.down = _powers(log)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:len(words)], dtype=np.uint64)])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start] + np.uint64(31) * np.asarray(size).astype(np.uint64))


def contexts_of(words: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(lo, n, anchor hash, context hash) of the runs of windows that share their anchor."""
    windows, span = len(words) - window + 1, window - anchor + 1
    if windows < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    rolling = Rolling(words)
    grams = rolling.of(np.arange(len(words) - anchor + 1), anchor)
    # Leftmost minimum of every stretch of ``span`` grams, by doubling.
    value, at, reach = grams, np.arange(len(grams)), 1
    while reach < span:
        step = min(reach, span - reach)
        right = value[step:] < value[:-step]
        value = np.where(right, value[step:], value[:-step])
        at = np.where(right, at[step:], at[:-step])
        reach += step
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(lo, windows))
    return lo, n, grams[at[lo]], rolling.of(lo, n + window - 1)


def word_hashes(text: bytes, known: dict) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _long(values: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(values).view(np.int64))


def anchored(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, tkey, lo, n, anchor, context for every context of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            parts: list[tuple] = []
            rows: list[np.ndarray] = []
            size = 0

            def flush() -> pa.RecordBatch:
                at = pa.array(np.concatenate(rows))
                lo, n, a, c = zip(*parts)
                return pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(lo).astype(np.int32)),
                     pa.array(np.concatenate(n).astype(np.int32)), _long(a), _long(c)],
                    names=["doc_id", "tkey", "lo", "n", "anchor", "context"])

            for k, text in enumerate(b.column(2)):
                found = contexts_of(word_hashes(text.as_py(), known), window)
                parts.append(found)
                rows.append(np.full(len(found[0]), k))
                size += len(found[0])
                if size > 100_000:
                    yield flush()
                    parts, rows, size = [], [], 0
            if parts:
                yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", text_key().alias("tkey"), text_bytes().alias("body"))
    return arrow(source, run, f"doc_id {kind}, tkey long, lo int, n int, anchor long, context long")


def longest_repeats(words: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """For every suffix ``starts`` of the stretches that end before ``stops``, the depth of the deepest internal node above it.

    Each stretch is followed by a place of its own in ``words``, whose word does
    not matter: nothing equals an end. Ranks of stretches of 1, 2, 4 ... words
    come from pairs of ranks; the last ones put the suffixes in order, and the
    words that neighbours share are found by going down the ranks again. That
    is the depth of the node where their branches part.
    """
    if len(starts) < 2:
        return np.zeros(len(starts), np.int64)
    known, level = np.unique(words, return_inverse=True)
    ends = np.unique(stops)
    level[ends] = len(known) + np.arange(len(ends))
    longest = int(np.diff(np.concatenate([[-1], ends])).max())
    ranks, reach = [level.astype(np.int64)], 1
    while reach < longest:
        now = ranks[-1]
        after = np.concatenate([now[reach:] + 1, np.zeros(min(reach, len(now)), np.int64)])
        ranks.append(np.unique(now * (int(now.max()) + 2) + after, return_inverse=True)[1].astype(np.int64))
        reach *= 2
    order = np.argsort(ranks[-1][starts], kind="stable")
    left, right = starts[order[:-1]].copy(), starts[order[1:]].copy()
    shared = np.zeros(len(left), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.maximum(left, right) < len(words)
        same = inside & (ranks[k][np.where(inside, left, 0)] == ranks[k][np.where(inside, right, 0)])
        shared[same] += 1 << k
        left[same] += 1 << k
        right[same] += 1 << k
    out = np.zeros(len(starts), np.int64)
    out[order[1:]] = shared
    out[order[:-1]] = np.maximum(out[order[:-1]], shared)
    return out


def _trees(window: int, hold: int = TREE_WORDS):
    """Subtrees of the groups in a stream sorted by group; gives the runs of repeated windows."""

    def solve(rows: list[tuple]) -> list[tuple]:
        words = [np.frombuffer(r[5], np.uint64) for r in rows]
        sizes = np.array([len(w) for w in words])
        base = np.cumsum(sizes + 1) - sizes - 1
        end = np.zeros(1, np.uint64)
        n = np.array([r[4] for r in rows])
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        depth = longest_repeats(np.concatenate([x for w in words for x in (w, end)]), np.repeat(base, n) + inside, base + sizes)
        hit = depth >= window
        row, place = np.repeat(np.arange(len(rows)), n)[hit], inside[hit]
        if not len(row):
            return []
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]))
        runs = np.diff(np.append(first, len(row)))
        return [(rows[r][1], rows[r][2], rows[r][3] + p, int(s)) for r, p, s in zip(row[first], place[first].tolist(), runs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def solved() -> pa.RecordBatch:
            cols = list(zip(*solve(held))) or [(), (), (), ()]
            kinds = [kind, pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "tkey", "lo", "n"])

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(1).type
            for row in zip(*(c.to_pylist() for c in b.columns)):
                # Enough is held and a new group begins: the groups so far are whole.
                if size >= hold and row[0] != held[-1][0]:
                    yield solved()
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) // 8
        if held:
            yield solved()

    return run


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["d"]) & (left["tkey"] == right["t"])


def _may_hold(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``source`` whose text key may be one of ``wanted``: all that are, and few others.

    Bits set by the keys are sent to all tasks, so that the other texts are not shuffled.
    """

    def place(key: str) -> tuple[Column, Column]:
        slot = F.pmod(key, F.lit(FILTER_BITS))
        return F.floor(slot / (1 << 15)).alias("part"), slot % (1 << 15)

    part, at = place("t")
    bits = wanted.groupBy(part).agg(F.bitmap_construct_agg(at).alias("bits"))
    part, at = place("tkey")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = source.withColumn("part", part).withColumn("at", at).join(F.broadcast(bits), "part")
    return met.where(F.getbit(byte, F.col("at") % 8) == 1).select(source.columns)


def repeated_runs(docs: DataFrame, window: int = WINDOW, group_words: int = GROUP_WORDS) -> DataFrame:
    """doc_id, tkey, lo, n: the windows lo to lo + n - 1 of the text also begin elsewhere."""
    anchors = stage(anchored(docs, window))
    totals = anchors.groupBy("anchor").agg(F.count("*").alias("total"), F.min("context").alias("c0"), F.max("context").alias("c1"))
    # Written first: a join whose sides both come from a shuffle is one whose hot keys Spark splits.
    shared = stage(totals.where("total > 1").select("anchor", (F.col("c0") == F.col("c1")).alias("alike")))
    met = stage(anchors.join(shared, "anchor"))
    run = ["doc_id", "tkey", "lo", "n"]
    settled = met.where("alike").select(*run)
    mixed = met.where("not alike")
    distinct = stage(mixed.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.min(F.struct(*run)).alias("at")))
    twice = stage(distinct.where("times > 1").select("anchor", "context"))
    settled = settled.unionAll(mixed.join(twice, ["anchor", "context"], "left_semi").select(*run))
    # One occurrence of each distinct context carries its words to the others of its anchor.
    words = F.sum(F.col("at.n") + F.lit(window - 1))
    large = stage(distinct.groupBy("anchor").agg(words.alias("words")).where(F.col("words") > group_words).select("anchor", F.lit(True).alias("large")))
    placed = distinct.join(large, "anchor", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def spelled(some: DataFrame, suffixes: bool) -> DataFrame:
        wanted = some.groupBy(F.col("at.doc_id").alias("d"), F.col("at.tkey").alias("t")).agg(
            F.collect_list(F.struct("anchor", "at.lo", "at.n")).alias("wanted"))
        source = docs.select("doc_id", text_key().alias("tkey"), text_bytes().alias("body"))
        if suffixes:  # written on their own: few texts hold them, and the others need not move again
            source = _may_hold(source, wanted)
        texts = source.join(wanted, _same_row(source, wanted)).select("doc_id", "tkey", "body", "wanted")
        return arrow(texts, _spell(window, suffixes), f"group long, doc_id {kind}, tkey long, lo int, n int, words binary, prefixes array<long>")

    def trees(some: DataFrame) -> DataFrame:
        grouped = some.select("group", *run, "words").repartition("group").sortWithinPartitions("group")
        return arrow(grouped, _trees(window), f"doc_id {kind}, tkey long, lo int, n int")

    found = trees(spelled(placed.where("not large"), False))
    if large.isEmpty():
        return settled.unionAll(found)
    # One row per suffix of the large groups. Repeated rows of one text give one context, so that each place counts once.
    left = stage(spelled(placed.where("large"), True))
    for k in range(len(LONGER)):
        tagged = left.withColumn("group", F.xxhash64("group", F.get("prefixes", F.lit(k))))
        sizes = stage(tagged.groupBy("group").count().where("count > 1"))
        tagged = stage(tagged.join(sizes, "group"))
        fits = F.col("count") * window <= group_words
        found = found.unionAll(trees(tagged.where(fits)))
        left = tagged.where(~fits).drop("count")
        if left.isEmpty():
            return settled.unionAll(found)
    # Still too large under all words of the window: one deep node each.
    node = F.xxhash64("group", "words")
    deep = stage(left.groupBy(node.alias("node")).count().where("count > 1").select("node"))
    return settled.unionAll(found).unionAll(left.withColumn("node", node).join(deep, "node", "left_semi").select(*run))


def _spell(window: int, suffixes: bool):
    """The words of wanted contexts, or each suffix that begins in them by its window and the hashes of its longer prefixes."""
    lengths = [min(n, window) for n in LONGER]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            kinds = [pa.int64(), b.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            names = ["group", "doc_id", "tkey", "lo", "n", "words", "prefixes"]
            out: list[tuple] = []

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)

            for ident, tkey, body, wanted in zip(*b.columns):
                ident, tkey = ident.as_py(), tkey.as_py()
                words = word_hashes(body.as_py(), known)
                rolling = Rolling(words) if suffixes else None
                for w in wanted.as_py():
                    lo, n = w["lo"], w["n"]
                    if rolling is None:
                        out.append((w["anchor"], ident, tkey, lo, n, words[lo:lo + n + window - 1].tobytes(), None))
                        continue
                    hashes = np.stack([rolling.of(np.arange(lo, lo + n), m) for m in lengths], 1).view(np.int64).tolist()
                    out += [(w["anchor"], ident, tkey, lo + k, 1, words[lo + k:lo + k + window].tobytes(), h) for k, h in enumerate(hashes)]
                if len(out) > 10_000:
                    yield flush()
                    out = []
            if out:
                yield flush()

    return run


def cut_text(body: bytes, runs: list[dict] | None, window: int) -> tuple[list[bytes], np.ndarray]:
    """Words of the text and which of them no run covers."""
    words = body.split()
    keep = np.ones(len(words), bool)
    for r in runs or ():
        keep[r["lo"]:r["lo"] + r["n"] + window - 1] = False
    return words, keep


def remove_repeats(docs: DataFrame, window: int = WINDOW, group_words: int = GROUP_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and ``removed`` for every row of ``docs`` (doc_id, text).

    ``removed`` holds the maximal stretches of words (start, stop) that are
    covered by repeated windows. A null or empty text has no words. Repeated
    rows and equal texts repeat each other; texts shorter than the window stay
    as they are. Ids may be null or repeated.
    """
    runs = repeated_runs(docs, window, group_words).groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("t")).agg(
        F.collect_set(F.struct("lo", "n")).alias("runs"))
    source = docs.select("doc_id", text_key().alias("tkey"), text_bytes().alias("body"))
    at = source.join(runs, _same_row(source, runs), "left").select("doc_id", "body", "runs")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for b in batches:
            out = []
            for body, runs in zip(b.column(1), b.column(2)):
                words, keep = cut_text(body.as_py(), runs.as_py(), window)
                edge = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
                kept = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
                out.append((len(words), int(len(words) - keep.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(),
                            [{"start": int(s), "stop": int(e)} for s, e in edge.reshape(-1, 2)]))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), span)))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    return arrow(at, run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,stop:int>>")
