"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each at a cost. Pieces are placed in
decreasing length into the open bin they fit best; where none fits, the size is
opened whose cost per filled unit is least, looking ahead at what is left to
place. At the end every bin shrinks to the least size that holds its contents.

Pieces are dealt by a hash into groups of about ``group_rows``; a group is
packed in one task. Only the last few bins of a group are not full, so that the
loss against packing all pieces together stays below one part in a hundred.
"""
from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from ..shipping import ship
from .common import GROUP_ROWS, map_rows, text_bytes

CAPACITIES = (256, 512, 1024, 2048)
#: Cost of a sequence beside its length.
OVERHEAD = 32


def costs_of(capacities: Sequence[int]) -> dict[int, float]:
    return {c: c + OVERHEAD for c in capacities}


def pack_lengths(lengths: Sequence[int], costs: dict[int, float]) -> tuple[list[int], list[int]]:
    """Bin of every length (given in decreasing order), and the final size of every bin.

    Lengths are 1 to the largest size.
    """
    sizes, n = sorted(costs), len(lengths)
    falling = [-x for x in lengths]
    room: list[int] = []  # distinct free rooms, ascending
    by_room: dict[int, list[int]] = {}
    used: list[int] = []
    free: list[int] = []
    where: list[int] = []

    def filled(capacity: int, start: int) -> int:
        """What the size would hold, taking the largest pieces left that fit."""
        left, j = capacity - lengths[start], start + 1
        while left > 0:
            j = max(j, bisect_left(falling, -left))
            if j >= n:
                break
            left -= lengths[j]
            j += 1
        return capacity - left

    for k, length in enumerate(lengths):
        at = bisect_left(room, length)
        if at < len(room):
            r = room[at]
            b = by_room[r].pop()
            if not by_room[r]:
                del by_room[r]
                room.pop(at)
        else:
            size = min((c for c in sizes if c >= length), key=lambda c: (costs[c] / filled(c, k), c))
            b, r = len(used), size
            used.append(0)
            free.append(size)
        used[b] += length
        r -= length
        free[b] = r
        if r:
            if r not in by_room:
                by_room[r] = []
                insort(room, r)
            by_room[r].append(b)
        where.append(b)
    return where, [sizes[bisect_left(sizes, u)] for u in used]


def pieces_of(docs: DataFrame, longest: int) -> DataFrame:
    """doc_id, piece, start and length in words of the pieces of every row; texts without a word have one of length 1.

    A text above the largest size is cut into full pieces and a rest. Length
    counts one separator at the end of a text.
    """
    rows = map_rows(docs.select("doc_id", text_bytes().alias("__body")), lambda b: (len(b.split()) + 1,), ["__body"], "total long")
    rows = stage(rows)
    cut = F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / longest).cast("long"))
    return (rows.select("doc_id", "total", F.explode(cut).alias("piece")).withColumn("start", F.col("piece") * longest)
            .select("doc_id", "piece", "start", F.least(F.col("total") - F.col("start"), F.lit(longest)).alias("length")))


def best_fit(pieces: DataFrame, keys: list[str], capacities: Sequence[int] = CAPACITIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` (keys, length) with bin_id, capacity and offset; lengths lie between 1 and the largest size.

    Repeated rows are pieces of their own. An empty input gives no bins.
    """
    costs = costs_of(capacities)
    pieces = stage(pieces)
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(17), *keys, F.monotonically_increasing_id()), F.lit(groups)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", *keys], ascending=[False] + [True] * len(keys), kind="stable")
        lengths = frame["length"].to_numpy()
        where, sizes = pack_lengths(lengths.tolist(), costs)
        where = np.array(where, np.int64)
        frame["bin_id"] = (frame["group"].to_numpy() << 24) + where
        frame["capacity"] = np.array(sizes, np.int64)[where]
        frame["offset"] = frame["length"].groupby(where).cumsum().to_numpy() - lengths
        return frame

    ship(dealt.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return dealt.groupBy("group").applyInPandas(run, f"{schema}, bin_id long, capacity long, offset long").drop("group")


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, piece, start, length, bin_id, capacity, offset for every piece of ``docs`` (doc_id, text).

    Repeated rows are packed each for itself; no rows give no bins.
    """
    return best_fit(pieces_of(docs, max(capacities)), ["doc_id", "piece", "start"], capacities, group_rows)
