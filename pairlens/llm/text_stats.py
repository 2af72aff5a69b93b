"""Counts over one text, taken from its UTF-8 bytes.

A word is a maximal run of characters other than ASCII white space. All counts
cover the whole text; a null text counts as empty.
"""
from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, text_bytes

_CLASS = {
    "space": b" \t\n\v\f\r", "symbol": b"#*$%&|<>", "digit": b"0123456789", "stop": b".!?", "comma": b",;:",
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "bang": b"!", "bracket": b"()[]{}\"'",
}
_MASKS = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _CLASS.items()}
_START = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, n_lines long, "
    "n_short_lines long, n_digits long, n_upper long, n_lower long, n_stops long, n_bangs long, n_commas long, "
    "n_brackets long, n_distinct long, n_top long, n_long_words long, n_marked long"
)


def repeated_words(ids: np.ndarray, width: int, distinct: int) -> int:
    """Positions inside some window of ``width`` words that occurs twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    codes, base = ids[:n].copy(), max(distinct, 1)
    for j in range(1, width):
        if int(codes.max() + 1) > (1 << 62) // base:
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        codes = codes * base + ids[j:n + j]
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for j in range(width):
        covered[j:n + j] |= twice
    return int(covered.sum())


def stats_of(text: bytes) -> tuple:
    """The values of ``STATS`` for one text."""
    words = text.split()
    n = len(words)
    seen: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(seen.__getitem__, words), np.int64, n)
    freq = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    sums = {k: int(freq[m].sum()) for k, m in _MASKS.items()}
    chars = int(freq[_START].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    return (
        n, chars - sums["space"], sums["symbol"], len(lines) - len(set(lines)), repeated_words(ids, 3, len(seen)), chars,
        len(lines), sum(len(x) < 40 for x in lines), sums["digit"], sums["upper"], sums["lower"], sums["stop"], sums["bang"],
        sums["comma"], sums["bracket"], len(seen), int(np.bincount(ids).max()) if n else 0, int((lengths > 15).sum()),
        int((_MASKS["symbol"] | _MASKS["bang"])[last].sum()),
    )


def with_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts of ``STATS`` of every row's text."""
    body = "__body"
    return map_rows(docs.select(*keep, text_bytes(text).alias(body)), stats_of, [body], STATS)


#: Ratios that models read, as SQL over the columns of STATS.
FEATURES = {
    "log_words": "ln(1 + n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_chars, 1)",
    "marked_rate": "n_marked / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "short_line_rate": "n_short_lines / greatest(n_lines, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "digit_rate": "n_digits / greatest(n_chars, 1)",
    "upper_rate": "n_upper / greatest(n_upper + n_lower, 1)",
    "stop_rate": "n_stops / greatest(n_words, 1)",
    "bang_rate": "n_bangs / greatest(n_words, 1)",
    "comma_rate": "n_commas / greatest(n_words, 1)",
    "bracket_rate": "n_brackets / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "top_rate": "n_top / greatest(n_words, 1)",
    "long_word_rate": "n_long_words / greatest(n_words, 1)",
}
