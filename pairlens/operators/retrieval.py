"""Cited locations, relevant paths and lexical retrieval of source windows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import candidate_path
from ..functions.text import lines

# Words that never count as retrieval terms.
STOP_WORDS = [
    "about", "after", "before", "being", "below", "cannot", "could", "description", "does", "field",
    "fields", "from", "have", "into", "issue", "model", "should", "some", "that", "their", "there",
    "these", "this", "value", "values", "when", "where", "which", "with", "would",
]
# Weights of symbols, quoted terms, plain words and definition lines.
W_SYMBOL, W_QUOTED, W_WORD, W_DEFINITION = 10, 8, 1, 20
# Fixed value: the format of a traceback line.
TRACE = r"""File\s+["']([^"']+\.py)["'],\s+line\s+(\d+)"""


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def referenced_locations(df: DataFrame, text: str, tests: str) -> DataFrame:
    """Python paths and traceback lines cited in a statement, in order.

    Adds ``trace`` (path, line) and ``ref_paths``, both cleaned; paths that
    leave the repository are dropped.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    both = F.concat_ws("\n", t, F.coalesce(F.col(tests), F.lit("")))
    traced = F.zip_with(
        _all(t, TRACE, 1), _all(t, TRACE, 2),
        lambda p, n: F.struct(candidate_path(p).alias("path"), n.try_cast("int").alias("line")),
    )
    trace = F.filter(traced, lambda s: s["path"].isNotNull())
    tokens = F.filter(F.split(both, r"\s+"), lambda x: F.contains(x, F.lit(".py")))
    cut = F.transform(
        tokens,
        lambda x: candidate_path(
            F.regexp_replace(F.concat(F.substring_index(x, ".py", 1), F.lit(".py")), r"^[`\"'(\[{]+", "")
        ),
    )
    cited = F.filter(cut, lambda p: p.isNotNull())
    out = df.withColumn("trace", trace)
    return out.withColumn(
        "ref_paths", F.array_distinct(F.concat(F.transform("trace", lambda s: s["path"]), cited))
    )


def location_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per distinct cited (path, line); a path without lines has a null line."""
    pairs = F.transform(
        F.filter("ref_paths", lambda p: ~F.exists("trace", lambda s: s["path"] == p)),
        lambda p: F.struct(p.alias("path"), F.lit(None).cast("int").alias("line")),
    )
    every = F.array_distinct(F.concat("trace", pairs))
    return df.select(*keys, F.explode(every).alias("_l")).select(*keys, "_l.path", "_l.line")


def relevant_paths(df: DataFrame, listed: str, top: int = 12, out: str = "relevant_paths") -> DataFrame:
    """Ranked paths of a case: cited and listed, traced, listed, cited elsewhere.

    Needs the columns of ``referenced_locations``; ``listed`` has one path per line.
    """
    explicit = F.array_distinct(
        F.filter(F.transform(lines(listed), lambda p: candidate_path(p)), lambda p: p.isNotNull())
    )
    step = df.withColumn("_explicit", explicit).withColumn(
        "_matched", F.filter("ref_paths", lambda p: F.array_contains("_explicit", p))
    ).withColumn(
        "_traced",
        F.filter("ref_paths", lambda p: F.exists("trace", lambda s: s["path"] == p)
                 & ~F.array_contains("_matched", p)),
    )
    extra = F.filter(
        "ref_paths",
        lambda p: ~F.array_contains("_explicit", p) & ~F.array_contains("_traced", p) & F.contains(p, F.lit("/")),
    )
    ranked = F.slice(F.array_distinct(F.concat("_matched", "_traced", "_explicit", extra)), 1, top)
    return step.withColumn(out, ranked).drop("_explicit", "_matched", "_traced")


def issue_terms(df: DataFrame, title: str, text: str, tests: str, top: int = 100, out: str = "terms") -> DataFrame:
    """Weighted search terms of a case: the first ``top`` by weight, length and name.

    A symbol after "in" or "::" weighs 10, a back-quoted term 8, any other word
    of four letters that is no stop word 1. A later back-quote overrides a symbol.
    """
    t, h, q = (F.coalesce(F.col(c), F.lit("")) for c in (text, title, tests))
    whole = F.concat_ws("\n", h, t, q)
    symbols = F.array_distinct(F.transform(
        F.concat(_all(t, r"(?<![\p{L}\p{N}_])in\s+([A-Za-z_][\p{L}\p{N}_]*)", 1),
                 _all(q, r"::([A-Za-z_][\p{L}\p{N}_]*)", 1)), F.lower))
    quoted = F.array_distinct(F.transform(
        F.flatten(F.transform(
            _all(whole, r"`([^`\n]{2,100})`", 1), lambda s: _all(s, r"[A-Za-z_][A-Za-z0-9_.]{2,}", 0))),
        F.lower))
    words = F.array_distinct(F.transform(_all(whole, r"[A-Za-z_][A-Za-z0-9_.]{3,}", 0), F.lower))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    step = df.withColumns({"_s": symbols, "_q": quoted, "_w": F.array_except(words, stop)})

    def weighted(terms, weight):
        return F.transform(terms, lambda x: F.struct(
            F.lit(-weight).alias("w"), (-F.length(x)).alias("l"), x.alias("term")))

    plain = F.array_except(F.array_except("_w", "_s"), F.col("_q"))
    every = F.concat(
        weighted(F.col("_q"), W_QUOTED),
        weighted(F.array_except("_s", "_q"), W_SYMBOL),
        weighted(plain, W_WORD),
    )
    best = F.slice(F.array_sort(every), 1, top)
    return step.withColumn(
        out, F.transform(best, lambda x: F.struct(x["term"].alias("term"), (-x["w"]).alias("weight")))
    ).drop("_s", "_q", "_w")


def line_scores(files: DataFrame, terms: DataFrame, keys: Sequence[str], text: str,
                out: str = "scored") -> DataFrame:
    """Lines of each file that hit a term: array of (score, line index).

    A term scores its weight when the line contains it, plus 20 when the line
    defines it. The terms (at most a hundred) come to the file's row, so no
    line-term pairs are built.
    """
    keys = list(keys)

    def prepared(line):
        low = F.lower(line)
        return F.struct(low.alias("low"), F.regexp_replace(low, r"^\s+", "").alias("head"))

    def score(line):
        def add(total, t):
            defines = F.startswith(line["head"], F.concat(F.lit("class "), t["term"])) | F.startswith(
                line["head"], F.concat(F.lit("def "), t["term"]))
            gain = t["weight"] + F.when(defines, W_DEFINITION).otherwise(0)
            return total + F.when(F.contains(line["low"], t["term"]), gain).otherwise(0)

        return F.aggregate("terms", F.lit(0), add)

    joined = files.join(terms.select(*keys, "terms"), keys).withColumn("_ls", lines(text))
    # Lower case and indentation are taken off once per line, not once per term.
    scored = F.transform(F.transform("_ls", prepared), lambda x, i: F.struct(score(x).alias("score"), i.alias("index")))
    return joined.withColumn(out, F.filter(scored, lambda s: s["score"] > 0)).drop("terms")


def rank_lines(files: DataFrame, terms: DataFrame, keys: Sequence[str], text: str,
               preferred: str | None = None, radius: int = 12, max_windows: int = 3) -> DataFrame:
    """The first ``max_windows`` source windows of each file, zero-based and inclusive.

    Traceback lines (``preferred``, 1-based) come first, then lines by score. A
    window that touches an earlier one widens it.
    """
    keys = list(keys)
    d = line_scores(files, terms, keys, text).withColumn("_last", F.size("_ls") - 1)
    wins = "array<struct<start:int,end:int>>"

    def clip(index):
        return (F.greatest(F.lit(0), index - radius).cast("int"),
                F.least(F.col("_last"), index + radius).cast("int"))

    def add(windows, index):
        s, e = clip(index)
        touching = F.array_position(
            F.transform(windows, lambda v: (s <= v["end"] + 1) & (e >= v["start"] - 1)), True
        )
        widened = F.transform(windows, lambda v, i: F.when(
            i + 1 == touching,
            F.struct(F.least(s, v["start"]).alias("start"), F.greatest(e, v["end"]).alias("end")),
        ).otherwise(v))
        return F.when(touching > 0, widened).otherwise(
            F.concat(windows, F.array(F.struct(s.alias("start"), e.alias("end"))))
        )

    def fold(items, windows, skip_inside):
        def step(state, index):
            inside = F.exists(state["w"], lambda v: (v["start"] <= index) & (index <= v["end"]))
            skip = state["done"] | inside if skip_inside else state["done"]
            grown = F.when(skip, state["w"]).otherwise(add(state["w"], index))
            full = state["done"] | (~skip & (F.size(grown) >= max_windows))
            return F.struct(grown.cast(wins).alias("w"), full.alias("done"))

        init = F.struct(windows.cast(wins).alias("w"), F.lit(False).alias("done"))
        return F.aggregate(items, init, step, lambda s: s["w"])

    first = F.array().cast(wins)
    if preferred is not None:
        traced = F.transform(preferred, lambda n: F.greatest(F.lit(0), F.least(F.col("_last"), n - 1)).cast("int"))
        first = fold(traced, first, False)
    d = d.withColumn("_first", first)
    order = F.transform(
        F.array_sort(F.transform("scored", lambda s: F.struct((-s["score"]).alias("s"), s["index"].alias("i")))),
        lambda s: s["i"].cast("int"),
    )
    d = d.withColumn("_order", order).withColumn("_found", fold(F.col("_order"), F.col("_first"), True))
    half = F.greatest(F.lit(20), F.least(F.lit(60), F.floor(F.size("_ls") / 8))).cast("int")
    fallback = F.array(
        F.struct(F.lit(0).alias("start"), (half - 1).alias("end")),
        F.struct(F.greatest(F.lit(0), F.size("_ls") - half).alias("start"), F.col("_last").alias("end")),
    ).cast(wins)
    final = F.when(F.size("_found") > 0, F.col("_found")).otherwise(fallback)
    return d.select(*keys, F.posexplode(final).alias("place", "_v")).select(
        *keys, "place", F.col("_v.start").alias("start"), F.col("_v.end").alias("end")
    )
