"""Encoding and decoding with a public BPE vocabulary, long texts by tree concatenation.

White space always parts tokens, so a text is encoded word by word. A word is
one or two pieces whose ids and places are looked up after the first time; all
else is indexing of arrays. A text longer than ``leaf_chars``
is cut into leaves, white space or not, which many tasks encode on their own.
Halves are then joined pairwise: a window around the join is encoded again, and
grows until its tokens agree with those of the left side at its beginning and
with those of the right side at its end.

Why agreement is enough: a sequence of BPE tokens is the encoding of its text
if and only if each two neighbours are the encoding of theirs. Up to the first
shared tokens all neighbours come from the left side, then from the window,
then from the right side.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import map_blocks, map_rows, text_bytes, text_key

LEAF_CHARS = 1 << 15
#: Neighbouring tokens that must be shared for a side to agree.
AGREE = 2
WORD_BYTES = 64
WORDS_HELD = 500_000
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())

_LOADED: dict[int, "Codec"] = {}


#: Bytes that ``bytes.split`` splits at.
_BLANKS = np.zeros(33, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True


def _tail(core: bytes, word: bytes) -> bytes:
    """What of the punctuation after ``core`` is a piece of its own: all of it, or nothing where a token could span both."""
    if not core or len(core) == len(word):
        return b""
    if core[-1] >= 0x80:
        last = core[-4:].decode(errors="ignore")[-1:]
        # Only letters that stay one letter in lower case.
        if not ("\u00c0" <= last <= "\u024f" and last.isalpha() and len(last.lower()) == 1):
            return b""
    return word[len(core):]


class Codec:
    """One process's tokenizer with the pieces of the words it has met."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.plain = self.tokenizer.decoder is None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.strings = np.array([self.tokenizer.id_to_token(k) or "" for k in range(size)], dtype=object)
        self.known = np.array([self.tokenizer.id_to_token(k) is not None for k in range(size)])
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pair = np.zeros((1 << 15, 2), np.int32)
        # Piece 0 is empty.
        self.pieces: dict[bytes, int] = {b"": 0}
        self.first, self.size, self.chars = (np.zeros(1 << 15, np.int32) for _ in range(3))
        self.used = 0
        self.flat, self.start, self.stop = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)

    def _learn_pieces(self, fresh: list[bytes]) -> None:
        """Many pieces with a space between are one text; the places of tokens tell whose they are."""
        blocks = [fresh[k:k + 512] for k in range(0, len(fresh), 512)]
        texts = [b" ".join(b).decode() for b in blocks]
        for block, text, e in zip(blocks, texts, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            chars = np.fromiter(map(len, text.split(" ")), np.int32, len(block))
            at = np.concatenate([[0], np.cumsum(chars[:-1] + 1)]).astype(np.int64)
            places = np.array(e.offsets, np.int64).reshape(-1, 2)
            n, k, m = len(places), len(self.pieces), len(block)
            while k + m > len(self.first):
                self.first, self.size, self.chars = (np.resize(v, 2 * len(v)) for v in (self.first, self.size, self.chars))
            while self.used + n > len(self.flat):
                self.flat, self.start, self.stop = (np.resize(v, 2 * len(v)) for v in (self.flat, self.start, self.stop))
            cuts = np.append(np.searchsorted(places[:, 0], at), n)
            self.first[k:k + m], self.size[k:k + m], self.chars[k:k + m] = self.used + cuts[:-1], np.diff(cuts), chars
            own = np.repeat(at, np.diff(cuts))
            held = slice(self.used, self.used + n)
            self.flat[held], self.start[held], self.stop[held] = e.ids, places[:, 0] - own, places[:, 1] - own
            self.pieces.update(zip(block, range(k, k + m)))
            self.used += n

    def learn(self, words: Iterable[bytes]) -> None:
        """Look up what is new among ``words``: a word and the punctuation after it are looked up apart."""
        if len(self.number) > WORDS_HELD:
            self.clear()
        fresh = [w for w in set(words).difference(self.number) if len(w) <= WORD_BYTES]
        if not fresh:
            return
        # Words that may hold a special token stay as they are.
        lower = [w if b"<|" in w else w.lower() for w in fresh]
        cores = [w if b"<|" in w else w.rstrip(_PUNCTUATION) for w in lower]
        tails = [_tail(c, w) if len(c) < len(w) else b"" for c, w in zip(cores, lower)]
        cores = [c if t else w for c, t, w in zip(cores, tails, lower)]
        self._learn_pieces(list({*cores, *tails}.difference(self.pieces)))
        k, n = len(self.number), len(fresh)
        while k + n > len(self.pair):
            self.pair = np.resize(self.pair, (2 * len(self.pair), 2))
        for side, pieces in enumerate((cores, tails)):
            self.pair[k:k + n, side] = np.fromiter(map(self.pieces.__getitem__, pieces), np.int32, n)
        self.number.update(zip(fresh, range(k, k + n)))

    def _tokens(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the arrays of all tokens of the pieces, and the tokens of each."""
        size = self.size[pieces].astype(np.int64)
        return np.repeat(self.first[pieces] - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), size

    def _runs(self, words: list[bytes]) -> Iterable[tuple[int, int, np.ndarray | None]]:
        """(from, to, pairs of pieces) of the words; None for a single one that is not held."""
        n, at = len(words), 0
        k = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, n)
        for out in [*np.flatnonzero(k < 0).tolist(), n]:
            if out > at:
                yield at, out, self.pair[k[at:out]]
            if out < n:
                yield out, out + 1, None
            at = out + 1

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """The ids of each text; words of unusual length are not remembered."""
        split = [t.split() for t in texts]
        self.learn(chain.from_iterable(split))
        return [self._ids(words) for words in split]

    def _ids(self, words: list[bytes]) -> np.ndarray:
        runs = [np.array(self.tokenizer.encode(words[a].decode(), add_special_tokens=False).ids, np.uint32) if pairs is None
                else self.flat[self._tokens(pairs.ravel())[0]] for a, _, pairs in self._runs(words)]
        return np.concatenate(runs) if len(runs) > 1 else runs[0] if runs else np.zeros(0, np.uint32)

    def spans(self, text: str, at: int = 0) -> np.ndarray:
        """(id, start, stop) of every token, places shifted by ``at``."""
        words = text.encode().split()
        self.learn(words)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        blank = _BLANKS[np.minimum(code, 32)] & (code <= 32)
        begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(code) else np.zeros(0, np.int64)
        out = [np.zeros((0, 3), np.int64)]
        for a, b, pairs in self._runs(words):
            if pairs is None:
                e = self.tokenizer.encode(words[a].decode(), add_special_tokens=False)
                out.append(np.column_stack([np.array(e.ids, np.int64), np.array(e.offsets, np.int64).reshape(-1, 2) + begins[a]]))
                continue
            tokens, size = self._tokens(pairs.ravel())
            base = np.repeat(np.column_stack([begins[a:b], begins[a:b] + self.chars[pairs[:, 0]]]).ravel(), size)
            out.append(np.column_stack([self.flat[tokens].astype(np.int64), base + self.start[tokens], base + self.stop[tokens]]))
        found = np.concatenate(out)
        found[:, 1:] += at
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The tokenizer's decoding, special tokens kept; without a decoder that is the tokens with a space between."""
        if self.plain:
            ids = ids[ids < len(self.strings)]
            return " ".join(self.strings[ids[self.known[ids]]].tolist())
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def codec(spec: str) -> Codec:
    key = hash(spec)
    if key not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
        _LOADED[key] = Codec(spec)
    return _LOADED[key]


#: (id, start, stop) per token, in whole texts or stretches of them.
Tokens = np.ndarray
Spans = Callable[[str, int], Tokens]


def _parts(text: str, at: int) -> bool:
    """Whether normalisation never reaches across ``at``: no mark or jamo that composes with what is before."""
    if at in (0, len(text)):
        return True
    c = text[at]
    return c.isascii() or not (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff")


def _clean(text: str, tokens: Tokens, k: int) -> bool:
    """Whether the text can be cut where token k begins."""
    at = int(tokens[k][1])
    return (k == 0 or at >= tokens[k - 1][2]) and _parts(text, at)


def _shared(text: str, left: Tokens, right: Tokens) -> tuple[int, int] | None:
    """Places in both windows of the first ``AGREE`` neighbouring tokens they share."""
    one, two = [tuple(t) for t in left.tolist()], [tuple(t) for t in right.tolist()]
    where = {t: k for k, t in enumerate(two)}
    for k in range(len(one) - AGREE + 1):
        m = where.get(one[k])
        if m is not None and one[k:k + AGREE] == two[m:m + AGREE] and _clean(text, one, k) and _clean(text, two, m):
            return k, m
    return None


def join(text: str, left: Tokens, right: Tokens, spans: Spans, start: int, stop: int, window: int = 8) -> Tokens:
    """The tokens of ``text[start:stop]`` from those of its two halves; only the window around the join is looked at."""
    while True:
        i, j = max(0, len(left) - window), min(len(right), window)
        while i > 0 and not _clean(text, left, i):
            i -= 1
        while j < len(right) and not _clean(text, right, j):
            j += 1
        a = int(left[i][1]) if i else start
        b = int(right[j][1]) if j < len(right) else stop
        middle = spans(text[a:b], a)
        head = _shared(text, left[i:], middle) if i else (0, 0)
        tail = _shared(text, middle, right[:j]) if j < len(right) else (len(middle), 0)
        if head is not None and tail is not None and head[1] <= tail[0]:
            rest = right[tail[1]:] if j < len(right) else right[:0]
            return np.concatenate([left[:i + head[0]], middle[head[1]:tail[0]], rest])
        window *= 4


def tree_encode(text: str, spans: Spans, leaf_chars: int) -> Tokens:
    """The tokens of a text by halves, as the distributed path computes them."""
    leaves = [(a, min(a + leaf_chars, len(text))) for a in range(0, max(len(text), 1), leaf_chars)]
    return fold(text, leaves, [spans(text[a:b], a) for a, b in leaves], spans)


def fold(text: str, cuts: Sequence[tuple[int, int]], parts: list[Tokens], spans: Spans) -> Tokens:
    """Join neighbours level by level; ``cuts`` are the stretches of the parts."""
    cuts = list(cuts)
    while len(parts) > 1:
        made, stretch = [], []
        for k in range(0, len(parts) - 1, 2):
            a, b = cuts[k][0], cuts[k + 1][1]
            made.append(join(text, parts[k], parts[k + 1], spans, a, b))
            stretch.append((a, b))
        if len(parts) % 2:
            made.append(parts[-1])
            stretch.append(cuts[-1])
        parts, cuts = made, stretch
    return parts[0] if parts else np.zeros((0, 3), np.int64)


def _bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def vocabulary(path: str) -> str:
    """The tokenizer's JSON; a file of fixed size that tasks get with their closure's broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens and ``ids`` (little-endian unsigned 32-bit) of every row of ``docs`` (doc_id, text).

    A null text is empty and has no tokens. Rows with null or repeated ids are
    encoded each for itself; long texts that are repeated under one id once.
    """
    spark: SparkSession = docs.sparkSession
    spec = spark.sparkContext.broadcast(vocabulary(path))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), (F.length(text) > leaf_chars).alias("long"))
    short = map_blocks(rows.where("not long").select("doc_id", text_bytes().alias("__body")),
                       lambda texts: [(len(ids), _bytes(ids)) for ids in codec(spec.value).encode_batch(texts)],
                       ["__body"], "n_tokens long, ids binary")
    wide = rows.where("long").select("doc_id", text_key().alias("tkey"), "text")
    count = F.floor((F.length("text") - 1) / leaf_chars).cast("int")
    leaves = (wide.dropDuplicates(["doc_id", "tkey"]).select("doc_id", "tkey", "text", F.explode(F.sequence(F.lit(0), count)).alias("no"))
              .select("doc_id", "tkey", "no", F.expr(f"substring(text, no * {leaf_chars} + 1, {leaf_chars})").alias("leaf"))
              .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "tkey", "no"))

    def leaf_tokens(leaf: str) -> tuple:
        return leaf, codec(spec.value).spans(leaf).astype(np.int32).tobytes()

    coded = map_rows(leaves, leaf_tokens, ["leaf"], "leaf string, tokens binary")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("no")
        texts = frame["leaf"].tolist()
        stops = np.cumsum([len(t) for t in texts]).tolist()
        cuts = list(zip([0, *stops[:-1]], stops))
        parts = [np.frombuffer(raw, np.int32).reshape(-1, 3) + np.array([0, a, a]) for (a, _), raw in zip(cuts, frame["tokens"])]
        ids = fold("".join(texts), cuts, parts, codec(spec.value).spans)[:, 0].astype(np.uint32)
        out = frame[["doc_id", "tkey"]].head(1).copy()
        out["n_tokens"], out["ids"] = [len(ids)], [_bytes(ids)]
        return out

    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # The leaves of one text meet in one task, as the text itself did when it was read.
    done = coded.groupBy("doc_id", "tkey").applyInPandas(merge, f"doc_id {kind}, tkey long, n_tokens long, ids binary")
    done = done.withColumnsRenamed({"doc_id": "d", "tkey": "t"})
    keys = wide.select("doc_id", "tkey")
    found = keys.join(done, keys["doc_id"].eqNullSafe(done["d"]) & (keys["tkey"] == done["t"]))
    return short.unionByName(found.select("doc_id", "n_tokens", "ids"))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (with ``ids``) and the ``decoded`` text, special tokens kept."""
    spec = tokens.sparkSession.sparkContext.broadcast(vocabulary(path))

    def text(ids: bytes) -> tuple:
        return ids, codec(spec.value).decode(np.frombuffer(ids, "<u4"))

    return map_rows(tokens, text, ["ids"], "ids binary, decoded string")
