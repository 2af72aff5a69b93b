"""Seeded pseudo-random draws that depend on row content only.

A draw never depends on partitioning, task order or retries, so a recomputed
partition gives the same rows again.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Modulus of the affine replicate hash (a Mersenne prime below 2**31).
PRIME = 2147483647


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_hex(*parts) -> Column:
    """md5 of the parts joined by '|'."""
    return F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]))


def md5_draw(*parts, word: int = 0) -> Column:
    """32-bit unsigned draw from eight hex digits of the md5, the first ones unless ``word`` says otherwise."""
    return F.conv(F.substring(md5_hex(*parts), 1 + 8 * word, 8), 16, 10).cast("long")


def replicate_constants(seed: int, replicates: int):
    """Two multipliers and the offset of each replicate's affine hash, as int64 arrays.

    ``(a * x + c * y + b) % PRIME`` is pairwise independent over the ids (x, y)
    of 62 bits, which is what the variance of a resampled sum needs.
    """
    import hashlib

    import numpy as np

    def word(rep: int, kind: str) -> int:
        return int(hashlib.md5(f"{seed}|{rep}|{kind}".encode()).hexdigest()[:8], 16)

    reps = range(1, replicates + 1)
    a = np.array([1 + word(r, "a") % (PRIME - 1) for r in reps], dtype=np.int64)
    c = np.array([1 + word(r, "c") % (PRIME - 1) for r in reps], dtype=np.int64)
    b = np.array([word(r, "b") % PRIME for r in reps], dtype=np.int64)
    return a, c, b


# Increments and multipliers of the 32-bit draws (published avalanche constants).
STEP, DRAW_STEP = 0x9E3779B1, 0x85EBCA77
MIX = ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1))


def mix32(x):
    """Every bit of a 32-bit number spread over all of them, on uint32 arrays (products wrap)."""
    import numpy as np

    for shift, factor in MIX:
        x = x ^ (x >> np.uint32(shift))
        if factor != 1:
            x = x * np.uint32(factor)
    return x


def replicate_seeds(name: str, replicates):
    """One 32-bit seed per replicate number (from 0) of what ``name`` names."""
    import hashlib

    import numpy as np

    base = np.uint32(int(hashlib.md5(name.encode()).hexdigest()[:8], 16))
    return mix32(np.asarray(replicates, np.uint32) * np.uint32(STEP) + base)


def picks(seeds, j, m: int):
    """Draw number ``j`` (from 0) of each seed: uniform over 0 .. m-1."""
    import numpy as np

    u = mix32(np.asarray(j).astype(np.uint32) * np.uint32(DRAW_STEP) + seeds)
    return ((u.astype(np.uint64) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
