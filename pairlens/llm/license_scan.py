"""License scans by an exact set-similarity join with license templates.

A text block matches a template if it holds at least ``threshold`` of
the template's distinct words. Words are ordered by their frequency over the
whole corpus, rarest first. A block that shares ``need`` words with a template
must share one of the template's first ``size - need + 1`` words (prefix
filter), must hold ``need`` template words at all (length filter), and at the
first shared word enough words must be left on both sides (positional filter).
Only words of templates count: a block's other words cannot be shared.
Blocks are the lines of a text and, so that wrapped notices are found, the windows of consecutive words across
lines that are as long as the template, longer by the part that may be missing (``span_of``). Marks of comments are no words.
Notices that differ in a word, as versions do, match each other's templates; such a block has the label of the
template that it holds the larger part of, and among equals of the larger one (``rivals_of``).
Every text is taken apart once; what is joined is the template words in it. Everything is DataFrame expressions.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .common import text_key

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice whose words mark a block as licensed under ``label``."""

    label: str
    text: str


# The customary notices of public licenses.
TEMPLATES = (
    Template("mit-notice", "Released under the MIT License."),
    Template("mit-notice", "Licensed under the MIT License."),
    Template("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files, to deal in the Software without restriction"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
             "http://www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation"),
    Template("lgpl-notice", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    Template("agpl-notice", "This program is licensed under the GNU Affero General Public License, version 3."),
    Template("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
             "the following conditions are met"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("cc-by-4.0", "Licensed under CC BY 4.0."),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    Template("cc0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
)
THRESHOLD = 0.85
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EDGES = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def template_words(text: str) -> list[str]:
    """Distinct words of a template (ASCII text), in order."""
    return list(dict.fromkeys("".join(c.lower() if c.isalnum() else " " for c in text).split()))


def need_of(size: int, threshold: float) -> int:
    """Words of a template of ``size`` that a block must hold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def span_of(text: str, threshold: float) -> int:
    """Consecutive words of a block that is to hold the template ``text``."""
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return math.ceil(len(words) / threshold - 1e-9)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case."""
    body = F.btrim(F.translate(text, _UPPER, _LOWER), F.lit(_EDGES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, NOT_WORD))


def places_of(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand one after another; texts without its words are not searched."""
    parts = phrase.split()
    there = F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {phrase} "))
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        hit = words[i] == parts[0]
        for k, w in enumerate(parts[1:], 1):
            hit = hit & (words[i + k] == w)
        return hit

    return F.when(there, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def rivals_of(templates: Sequence[Template], threshold: float) -> list[tuple[int, int]]:
    """(a, b): template a is also matched by a block that is the text of template b."""
    sets = [set(template_words(t.text)) for t in templates]
    return [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets)
            if a != b and x and len(x & y) >= need_of(len(x), threshold)]


def _vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in template_words(t.text)})


def scanned(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """What the joins need of every text, from one pass over the texts.

    doc_id, tkey, n_words, the places p0, p1 ... of the phrases, ``held``, the
    numbers of all its template words, ``lines`` (number, block, distinct template
    words) and ``mine`` (word, at) over all lines. Lines and texts with too few
    template words to match anything are not taken apart further.
    """
    vocabulary = _vocabulary(templates)
    number = F.create_map(*(x for k, w in enumerate(vocabulary) for x in (F.lit(w), F.lit(k))))
    least = min((need_of(len(template_words(t.text)), threshold) for t in templates if template_words(t.text)), default=1)
    seen = sorted({*vocabulary, *(w for p in PHRASES for w in p.split())})
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_key().alias("tkey"), text.alias("body__"), words_of(text).alias("words__"))
    rows = rows.select("*", F.filter("words__", lambda w: w.isin(seen)).alias("seen__"))
    rows = rows.select("*", F.filter("seen__", lambda w: w.isin(vocabulary)).alias("own__"))
    enough = F.size(F.array_distinct("own__")) >= least

    def line(block: Column, k: Column) -> Column:
        own = F.array_distinct(F.filter(words_of(block), lambda w: w.isin(vocabulary)))
        return F.struct(k.alias("line"), block.alias("block"), F.transform(own, lambda w: number[w]).alias("words"))

    lines = F.filter(F.transform(F.split("body__", "\n"), line), lambda x: F.size(x["words"]) >= least)
    at = F.filter(F.transform("words__", lambda w, i: F.struct(number[w].alias("word"), i.alias("at"))), lambda x: x["word"].isNotNull())
    several = enough & F.contains("body__", F.lit("\n"))
    # Where a phrase's words are not all seen, the text is not searched for it.
    places = [F.when(F.size(F.array_except(F.array(*map(F.lit, p.split())), "seen__")) == 0, places_of(F.col("words__"), p)).otherwise(
        F.array().cast("array<int>")).alias(f"p{k}") for k, p in enumerate(PHRASES)]
    return stage(rows.select("doc_id", "tkey", F.size("words__").cast("long").alias("n_words"), *places,
                             F.transform("own__", lambda w: number[w]).alias("held"), F.when(enough, lines).alias("lines"), F.when(several, at).alias("mine")))


@dataclass
class Index:
    """Templates with the ranks of their words, their prefixes as a table, and ``rank``, the rank of each word number."""

    ranked: list[tuple]
    rank: list[int]
    prefixes: DataFrame
    rare: list[int]
    least: int

    def ranks(self, numbers: Column) -> Column:
        places = F.array(*map(F.lit, self.rank))
        return F.transform(numbers, lambda n: F.get(places, n))


def _index(texts: DataFrame, templates: Sequence[Template], threshold: float) -> Index:
    """Words ranked by how often they occur; as many counts as template words go to the driver."""
    vocabulary = _vocabulary(templates)
    found = texts.select(F.explode("held").alias("word")).groupBy("word").count().collect()
    counts = {vocabulary[r["word"]]: r["count"] for r in found}
    rank = {w: n for n, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    sets = [(k, t, template_words(t.text)) for k, t in enumerate(templates)]
    ranked = [(k, t.label, sorted(rank[w] for w in words), need_of(len(words), threshold), span_of(t.text, threshold)) for k, t, words in sets if words]
    prefixes = texts.sparkSession.createDataFrame(
        [(k, label, len(r), need, span, r, j, r[j]) for k, label, r, need, span in ranked for j in range(len(r) - need + 1)],
        "template int, label string, size int, need int, span int, ranks array<int>, at int, word int")
    rare = sorted({r[j] for _, _, r, need, _ in ranked for j in range(len(r) - need + 1)})
    return Index(ranked, [rank[w] for w in vocabulary], prefixes, rare, min((need for *_, need, _ in ranked), default=1))


def _line_matches(texts: DataFrame, index: Index) -> DataFrame:
    lines = texts.where("lines IS NOT NULL").select("doc_id", "tkey", F.explode("lines").alias("l"))
    sure = lines.select("doc_id", "tkey", "l.line", "l.block", F.array_sort(index.ranks(F.col("l.words"))).alias("mine"))
    sure = stage(sure.where(F.arrays_overlap("mine", F.array(*map(F.lit, index.rare)))))
    met = sure.select("*", F.posexplode("mine").alias("pos", "word")).join(index.prefixes, "word")
    # The first shared word: as many words must follow on both sides as are still needed.
    first = F.filter("mine", lambda w: F.array_contains("ranks", w))[0] == F.col("word")
    close = met.where(first).where(F.least(F.size("mine") - F.col("pos"), F.col("size") - F.col("at")) >= F.col("need"))
    shared = F.size(F.array_intersect("mine", "ranks"))
    return close.withColumn("shared", shared).where("shared >= need").select(
        "doc_id", "tkey", "line", "block", "template", "label", "shared", "size", (F.col("shared") / F.col("size")).alias("containment"))


def template_matches(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, tkey, line (from 0), block (its text), template (its number), label, shared, size and containment of every line and
    template above the threshold.

    Repeated lines give repeated rows.
    """
    texts = scanned(docs, templates, threshold)
    return _line_matches(texts, _index(texts, templates, threshold))


def _window_matches(texts: DataFrame, index: Index) -> DataFrame:
    widest = max(span for *_, span in index.ranked)
    places = F.array(*map(F.lit, index.rank))
    mine = F.transform("mine", lambda x: F.struct(F.get(places, x["word"]).alias("word"), x["at"].alias("at")))
    some = texts.where(F.col("mine").isNotNull()).select("doc_id", "tkey", mine.alias("mine"))
    rare_at = F.filter(F.transform("mine", lambda x, i: F.struct(x["word"].alias("word"), x["at"].alias("at"), i.alias("i"))),
                       lambda x: x["word"].isin(index.rare))
    # Words stand at rising places, so that a window has no more entries than words.
    spots = F.transform(rare_at, lambda x: F.struct(x["word"].alias("word"), x["at"].alias("at"), F.slice(
        "mine", F.greatest(x["i"] - widest, F.lit(0)) + 1, F.lit(2 * widest + 1)).alias("near")))
    blocks = stage(some.select("doc_id", "tkey", F.explode(spots).alias("s")).select("doc_id", "tkey", "s.*"))
    met = blocks.join(index.prefixes.withColumnRenamed("at", "place"), "word")
    own = F.filter("near", lambda x: F.array_contains("ranks", x["word"]) & (x["at"] > F.col("at") - F.col("span")) & (x["at"] < F.col("at") + F.col("span")))
    close = met.withColumn("own", own).where(F.size("own") >= F.col("need"))
    best = F.array_max(F.transform(F.filter("own", lambda x: x["at"] <= F.col("at")), lambda s: F.size(F.array_distinct(F.transform(
        F.filter("own", lambda x: (x["at"] >= s["at"]) & (x["at"] < s["at"] + F.col("span"))), lambda x: x["word"])))))
    return close.withColumn("shared", best).where("shared >= need").select(
        "doc_id", "tkey", "template", "label", "at", "span", "size", (F.col("shared") / F.col("size")).alias("containment"))


def window_matches(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, tkey, template, label, at (word of the window), span, size and containment of every template that a window of its
    span reaches, in texts of several lines.

    A window must hold one of the template's prefix words; around each of these
    all windows are tried that begin at a shared word.
    """
    texts = scanned(docs, templates, threshold)
    return _window_matches(texts, _index(texts, templates, threshold))


def _labels(matches: Column, templates: Sequence[Template], threshold: float) -> Column:
    """Of matches (template, label, a, z, size, containment) in one text, those without a better rival that overlaps them."""
    rivals = F.array(*[F.lit(f"{a}-{b}") for a, b in rivals_of(templates, threshold)]).cast("array<string>")

    def beaten(m: Column) -> Column:
        def better(o: Column) -> Column:
            more = (o["containment"] > m["containment"]) | ((o["containment"] == m["containment"]) & (o["size"] > m["size"]))
            return more & (o["a"] <= m["z"]) & (m["a"] <= o["z"]) & F.array_contains(rivals, F.concat(m["template"].cast("string"), F.lit("-"), o["template"].cast("string")))
        return F.exists(matches, better)

    return F.array_sort(F.array_distinct(F.transform(F.filter(matches, lambda m: ~beaten(m)), lambda m: m["label"])))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A phrase is found in full, so that a text with one scores 1; else the score
    is the best containment of a template, 0 without any. Null and empty texts
    have no words and no labels. Null and repeated ids are scanned row by row.
    """
    texts = scanned(docs, templates, threshold)
    index = _index(texts, templates, threshold)
    fields = ["template", "label", "a", "z", "size", "containment"]
    zero = F.lit(0)
    lines = _line_matches(texts, index).withColumns({"a": zero, "z": zero})
    windows = _window_matches(texts, index).withColumns({"a": F.col("at") - F.col("span"), "z": F.col("at") + F.col("span")})
    parts = [m.groupBy("doc_id", "tkey", *by).agg(F.collect_set(F.struct(*fields)).alias("matches"), F.max("containment").alias("best")).select(
        F.col("doc_id").alias("d"), F.col("tkey").alias("t"), "best", F.explode(_labels(F.col("matches"), templates, threshold)).alias("label"))
        for m, by in ((lines, ["line"]), (windows, []))]
    best = parts[0].unionAll(parts[1]).groupBy("d", "t").agg(F.collect_set("label").alias("found"), F.max("best").alias("best"))
    cols = [F.col(f"p{k}") for k in range(len(PHRASES))]
    every = F.concat(*cols)
    own = F.array_compact(F.array(*(F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(cols, PHRASES.values()))))
    based = texts.select("doc_id", "tkey", "n_words", F.size(every).cast("long").alias("n_base"),
                         F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
                         F.array_sort(F.array_distinct(own)).alias("own"))
    at = based.join(best, based["doc_id"].eqNullSafe(best["d"]) & (based["tkey"] == best["t"]), "left")
    labels = F.array_sort(F.array_union("own", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return at.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"),
                     F.array_join(labels, ",").alias("labels"), score.alias("score"))
