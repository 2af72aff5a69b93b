"""Text features as column expressions over a whole corpus (no Python per row)."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import lexicons as lx
from .draws import col

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

#: The line breaks besides \\n.
ODD_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def _odd(t: Column) -> Column:
    """True when the text holds a line break other than \\n."""
    held = F.lit(False)
    for c in ODD_BREAKS:
        held = held | F.contains(t, F.lit(c))
    return held


def lines(text) -> Column:
    """Lines of the text; a final line break does not open another line."""
    t = F.coalesce(col(text), F.lit(""))
    # Most texts only hold \\n, which splits without the regular expression.
    parts = F.when(_odd(t), F.split(t, LINE_BREAK)).otherwise(F.split(t, "\n"))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(t: Column) -> Column:
    """The number of ``lines``, which texts that only hold \\n do not have to be split for."""
    breaks = count_of(t, "\n") + F.when((t == "") | F.endswith(t, F.lit("\n")), 0).otherwise(1)
    return F.when(_odd(t), F.size(lines(t)).cast("long")).otherwise(breaks)


def bullet_count(t: Column) -> Column:
    """The number of ``lines`` that begin with a bullet."""
    by_line = F.size(F.filter(lines(t), lambda x: x.rlike(BULLET))).cast("long")
    return F.when(_odd(t), by_line).otherwise(_lit_count(t, BULLET_LINE))


def norm_text(text) -> Column:
    """Trim, lower, squeeze blanks, hex literals to ``<hex>``."""
    c = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), f"{lx.SPACE}+", " ")
    # What stands before a literal is looked at where one may begin, not at every place.
    return F.regexp_replace(F.btrim(c, F.lit(" ")), rf"0(?<!{lx.WORD}0)x[0-9a-f]+(?!{lx.WORD})", "<hex>")


def text_size(df: DataFrame, text: str, prefix: str = "prompt_") -> DataFrame:
    """Characters, lines and the quarter-length token estimate."""
    t = F.coalesce(F.col(text), F.lit(""))
    chars = F.length(t)
    return df.withColumns({
        f"{prefix}chars": chars.cast("long"),
        f"{prefix}lines": line_count(t),
        f"{prefix}tokens": F.when(chars == 0, F.lit(0))
        .otherwise(F.greatest(F.lit(1), F.floor(chars / 4))).cast("long"),
    })


def has_any(text, terms: Sequence[str]) -> Column:
    """1 when any term occurs, ignoring case."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(low, F.lit(term))
    return hit.cast("int")


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    gone = F.length(F.replace(text, F.lit(needle), F.lit("")))
    return ((F.length(text) - gone) / len(needle)).cast("long")


def _lit_count(text: Column, pattern: str, *guards: str) -> Column:
    """Matches of a pattern; with guards only texts that hold one of them are searched."""
    found = F.regexp_count(text, F.lit(pattern)).cast("long")
    if not guards:
        return found
    held = F.lit(False)
    for g in guards:
        held = held | F.contains(text, F.lit(g))
    return F.when(held, found).otherwise(F.lit(0).cast("long"))


def tokens(text: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(text, F.lit(f"{lx.WORD}+"), F.lit(0))


def lexicon_hits(toks: Column, *lists: Sequence[str], fold: bool = False) -> Column:
    """The few tokens that any one-word pattern of the lists can match.

    One hash lookup per token decides, whatever the number of patterns; the
    patterns themselves then only run on this short array.
    """
    words, stems = lx.token_filter([p for ps in lists for p in ps])

    def wanted(t):
        t = F.lower(t) if fold else t
        keep = t.isin(words) if words else F.lit(False)
        return keep | F.substring(t, 1, lx.STEM).isin(stems) if stems else keep

    return F.filter(toks, wanted)


def pattern_count(patterns: Sequence[str], low: Column, hits: Column) -> Column:
    """Sum over patterns of their matches: one-word patterns on the hit tokens,
    the others on the lower-cased text when it holds their literal part."""
    bodies = [t for t in map(lx.single_token, patterns) if t]
    total = F.lit(0).cast("long")
    if bodies:
        whole = f"^(?:{'|'.join(bodies)})$"
        total = total + F.size(F.filter(hits, lambda h: h.rlike(whole))).cast("long")
    for p in patterns:
        if not lx.single_token(p):
            total = total + _lit_count(low, lx.unicode_pattern(p), lx.plain_part(p))
    return total


FILE_PATH = (
    rf"(?<![\p{{L}}\p{{N}}_./-])(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.(?:{lx.FILE_ENDINGS})"
)
IDENTIFIER = (
    rf"(?=[A-Za-z_])(?<!{lx.WORD})[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_.]*{lx.EDGE}"
)
NUMBER = rf"(?=\p{{Nd}})(?<!{lx.WORD})\p{{Nd}}+(?:\.\p{{Nd}}+)?{lx.EDGE}"
BULLET = rf"^{lx.SPACE}*(?:[-*+]|\p{{Nd}}+[.)]){lx.SPACE}+"
_INLINE = r"[\s\x1c-\x1f\x85\p{Z}&&[^\n]]"
#: ``BULLET`` on every line of a text whose lines end in \n.
BULLET_LINE = rf"(?dm)^{_INLINE}*(?:[-*+]|\p{{Nd}}+[.)]){_INLINE}+"
TEST_WORD = (
    rf"(?<!{lx.WORD})test(?:s|ing)?(?!{lx.WORD})|pytest|unittest|fail_to_pass|pass_to_pass"
)
TRACEBACK = (
    rf"(?<!{lx.WORD})traceback(?!{lx.WORD})|"
    rf"file{lx.SPACE}+[\"'][^\"']+[\"'],{lx.SPACE}+line{lx.SPACE}+\p{{Nd}}+"
)
URL = r"https?://[^\s\x1c-\x1f\x85\p{Z})\]>]+"


def _identifiers(t: Column) -> Column:
    return F.when(t.rlike(r"\.[A-Za-z_]"), _lit_count(t, IDENTIFIER)).otherwise(F.lit(0).cast("long"))


def _prepare(df: DataFrame, text: str, *lists: Sequence[str]) -> DataFrame:
    """Text, lower-cased text, its tokens, and the lexicon hits, each computed once."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({"_t": t, "_low": F.lower(t)})
    out = out.withColumn("_tok", tokens(F.col("_low")))
    return out.withColumn("_hits", lexicon_hits(F.col("_tok"), *lists))


_WORK = ("_t", "_low", "_tok", "_hits")


def _density(prefix: str) -> dict[str, Column]:
    t, low, hits = F.col("_t"), F.col("_low"), F.col("_hits")
    # Lower-casing a dotted capital I splits its word; such texts are counted as they are.
    words = F.when(F.contains(t, F.lit("\u0130")), _lit_count(t, f"{lx.WORD}+")).otherwise(F.size("_tok"))
    return {
        f"{prefix}chars": F.length(t).cast("long"),
        f"{prefix}lines": line_count(t),
        f"{prefix}words": words.cast("long"),
        f"{prefix}questions": count_of(t, "?"),
        f"{prefix}numeric_literal_count": _lit_count(t, NUMBER),
        f"{prefix}identifier_count": _identifiers(t),
        f"{prefix}bullet_count": bullet_count(t),
        f"{prefix}constraint_count": pattern_count(lx.CONSTRAINTS, low, hits),
        f"{prefix}modal_count": pattern_count(lx.MODALS, low, hits),
    }


def _ratios(prefix: str) -> dict[str, Column]:
    n_lines = F.greatest(F.col(f"{prefix}lines"), F.lit(1))
    n_words = F.greatest(F.col(f"{prefix}words"), F.lit(1))
    return {
        f"{prefix}chars_per_line": F.col(f"{prefix}chars") / n_lines,
        f"{prefix}words_per_line": F.col(f"{prefix}words") / n_lines,
        f"{prefix}identifier_density": F.col(f"{prefix}identifier_count") / n_words,
        f"{prefix}numeric_density": F.col(f"{prefix}numeric_literal_count") / n_words,
    }


def density_features(df: DataFrame, text: str, prefix: str = "ps_") -> DataFrame:
    """Counts, ratios and densities of a statement (13 columns)."""
    out = _prepare(df, text, lx.CONSTRAINTS, lx.MODALS).withColumns(_density(prefix)).drop(*_WORK)
    return out.withColumns(_ratios(prefix))


def _paths(t: Column) -> Column:
    found = F.regexp_extract_all(t, F.lit(FILE_PATH), F.lit(0))
    return F.when(F.contains(t, F.lit("/")), found).otherwise(F.array().cast("array<string>"))


def _fences() -> Column:
    return F.floor(count_of(F.col("_t"), "```") / 2).cast("long")


def _evidence(prefix: str) -> dict[str, Column]:
    low = F.col("_low")
    return {
        f"{prefix}file_path_count": F.size("_paths").cast("long"),
        f"{prefix}unique_file_path_count": F.size(F.array_distinct("_paths")).cast("long"),
        f"{prefix}test_reference_count": _lit_count(low, TEST_WORD, "test", "_to_pass"),
        f"{prefix}traceback_count": _lit_count(low, TRACEBACK, "traceback", "file"),
        f"{prefix}url_count": _lit_count(low, URL, "http"),
    }


def evidence_features(df: DataFrame, text: str, prefix: str = "ps_") -> DataFrame:
    """Paths, test words, tracebacks, URLs and fenced blocks (6 columns)."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({"_t": t, "_low": F.lower(t), "_paths": _paths(t)}).withColumns({
        **_evidence(prefix), f"{prefix}code_fence_count": _fences(),
    })
    return out.drop("_t", "_low", "_paths")


def lexicon_features(
    df: DataFrame,
    text: str,
    lexicon: Mapping[str, Sequence[str]] = lx.STATEMENT_DOMAINS,
    explicit: str = "explicit_security",
    prefix: str = "ps_",
) -> DataFrame:
    """Per domain a flag and a count, and the number of implicit domains hit."""
    out = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("_hits", lexicon_hits(tokens(F.col("_low")), *lexicon.values()))
    return _domain_flags(out.withColumns(_domain_counts(lexicon, prefix)).drop("_hits", "_low"), lexicon, explicit, prefix)


def _domain_counts(lexicon: Mapping[str, Sequence[str]], prefix: str) -> dict[str, Column]:
    return {f"{prefix}domain_{d}_count": pattern_count(ps, F.col("_low"), F.col("_hits")) for d, ps in lexicon.items()}


def _domain_flags(out: DataFrame, lexicon: Mapping[str, Sequence[str]], explicit: str, prefix: str) -> DataFrame:
    out = out.withColumns({
        f"{prefix}domain_{d}": (F.col(f"{prefix}domain_{d}_count") > 0).cast("int") for d in lexicon
    })
    implicit = F.lit(0)
    for d in lexicon:
        if d != explicit:
            implicit = implicit + F.col(f"{prefix}domain_{d}")
    return out.withColumns({
        f"{prefix}security_relevant_domain_count": implicit.cast("int"),
        f"{prefix}explicit_security_term_count": F.col(f"{prefix}domain_{explicit}_count"),
    })


def statement_features(df: DataFrame, text: str) -> DataFrame:
    """All 49 statement features; the text is lower-cased and taken apart once for all of them."""
    lexicon, prefix = lx.STATEMENT_DOMAINS, "ps_"
    out = _prepare(df, text, lx.CONSTRAINTS, lx.MODALS, *lexicon.values()).withColumn("_paths", _paths(F.col("_t")))
    out = out.withColumns({
        **_density(prefix), **_evidence(prefix), f"{prefix}code_fence_count": _fences(), **_domain_counts(lexicon, prefix),
    }).drop(*_WORK, "_paths")
    return _domain_flags(out.withColumns(_ratios(prefix)), lexicon, "explicit_security", prefix)


def envelope_features(df: DataFrame, text: str, prefix: str = "sem_") -> DataFrame:
    """The 35 features of a whole prompt envelope."""
    domains = lx.ENVELOPE_DOMAINS
    t, low, hits = F.col("_t"), F.col("_low"), F.col("_hits")
    imperative = (
        rf"(?imd)^{lx.SPACE}*(?:[-*]{lx.SPACE}*)?(?:{'|'.join(lx.IMPERATIVES)})(?!{lx.WORD})"
    )
    section = rf"(?imd)^{lx.SPACE}*\[(?:RULES|OBJECTIVE|REQUIREMENTS?)\]{lx.SPACE}*$"

    def said(*terms):
        return has_any(t, terms)

    out = _prepare(df, text, *domains.values(), lx.ENVELOPE_CONSTRAINTS, lx.NEGATIONS, lx.MODALS)
    out = out.withColumn("_paths", _paths(t)).withColumns({
        **_evidence(prefix),
        **{f"_n_{d}": pattern_count(ps, low, hits) for d, ps in domains.items()},
        f"{prefix}bullet_count": bullet_count(t),
        f"{prefix}question_count": count_of(t, "?"),
        f"{prefix}code_block_count": F.floor(count_of(t, "```") / 2).cast("long"),
        f"{prefix}constraint_count": pattern_count(lx.ENVELOPE_CONSTRAINTS, low, hits),
        f"{prefix}negation_constraint_count": pattern_count(lx.NEGATIONS, low, hits),
        f"{prefix}modal_count": pattern_count(lx.MODALS, low, hits),
        f"{prefix}imperative_count": _lit_count(t, imperative),
        f"{prefix}identifier_count": _identifiers(t),
        f"{prefix}numeric_literal_count": _lit_count(t, NUMBER),
        "_sections": _lit_count(t, section, "["),
        f"{prefix}has_explicit_security_guidance": said(
            "[security-guidelines]", "security guidelines", "secure coding"
        ),
        f"{prefix}has_test_objective": said("[objective]", "tests pass", "make these tests pass"),
        f"{prefix}has_relevant_files_section": said("[relevant files]"),
        f"{prefix}has_repository_context": said("[repository]", "commit_base:", "repo:"),
    }).drop(*_WORK, "_paths")
    out = out.withColumns({
        f"{prefix}mentions_{d}": (F.col(f"_n_{d}") > 0).cast("int") for d in domains
    })
    terms, domains_hit = F.lit(0), F.lit(0)
    for d in lx.ENVELOPE_SECURITY_TERMS:
        terms = terms + F.col(f"_n_{d}")
    for d in domains:
        domains_hit = domains_hit + F.col(f"{prefix}mentions_{d}")
    return out.withColumns({
        f"{prefix}requirement_count": F.col(f"{prefix}bullet_count") + F.col(f"{prefix}modal_count")
        + F.col("_sections"),
        f"{prefix}security_term_count": terms.cast("long"),
        f"{prefix}domain_count": domains_hit.cast("int"),
    }).drop("_sections", *[f"_n_{d}" for d in domains])


def _first_spellings(terms: Column) -> Column:
    """Terms that differ by more than case, in first-seen order and spelling."""
    terms = F.array_distinct(terms)
    low = F.transform(terms, F.lower)
    return F.filter(terms, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)


def lexical_audit(
    df: DataFrame,
    text: str,
    lexicon: Mapping[str, Sequence[str]] = lx.STATEMENT_DOMAINS,
    explicit: str = "explicit_security",
) -> DataFrame:
    """The concrete terms found per domain, ' | '-joined, with their number."""
    t, low = F.col("_t"), F.col("_low")
    raw = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({"_t": raw, "_low": F.lower(raw)}).withColumn(
        "_hits", F.array_distinct(lexicon_hits(tokens(t), *lexicon.values(), fold=True)))

    def spelled(token):
        return F.filter("_hits", lambda h: F.lower(h).rlike(f"^(?:{token})$"))

    def found(patterns):
        parts = []
        for p in patterns:
            token = lx.single_token(p)
            if token:
                parts.append(spelled(token))
            else:
                said = F.regexp_extract_all(t, F.lit("(?i)" + lx.unicode_pattern(p)), F.lit(0))
                held = F.contains(low, F.lit(lx.plain_part(p)))
                parts.append(F.when(held, said).otherwise(F.array().cast("array<string>")))
        return _first_spellings(F.flatten(F.array(*parts)))

    out = out.withColumns({f"_t_{d}": found(ps) for d, ps in lexicon.items()})
    implicit = F.lit(0)
    for d in lexicon:
        if d != explicit:
            implicit = implicit + F.size(f"_t_{d}")
    return out.withColumns({
        "prompt_chars_for_audit": F.length(t).cast("long"),
        **{f"audit_{d}_count": F.size(f"_t_{d}").cast("int") for d in lexicon},
        **{f"audit_{d}_terms": F.concat_ws(" | ", f"_t_{d}") for d in lexicon},
        "audit_has_explicit_security_terms": (F.size(f"_t_{explicit}") > 0).cast("int"),
        "audit_has_security_relevant_task_terms": (implicit > 0).cast("int"),
    }).drop("_hits", "_t", "_low", *[f"_t_{d}" for d in lexicon])


def strip_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"^{lx.SPACE}+|{lx.SPACE}+$", "")


#: The characters of ``lx.SPACE``.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip_short(c: Column) -> Column:
    """``strip_blanks`` of names and single lines, without a regular expression."""
    return F.btrim(c, F.lit(BLANKS))


def extract_diff(text) -> Column:
    """The unified diff inside a free-text answer, or the empty string."""
    t = F.replace(F.coalesce(col(text), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    t = F.regexp_replace(t, rf"```(?:[A-Za-z0-9_-]+)?{lx.SPACE}*\n?", "")
    t = F.replace(t, F.lit("```"), F.lit(""))
    git = F.instr(t, "diff --git ")
    header = rf"(?md)^---{lx.SPACE}+(?:a/)?[^\n]+\n^\+\+\+{lx.SPACE}+(?:b/)?[^\n]+"
    plain = F.regexp_instr(t, F.lit(header))
    start = F.when(git > 0, git).otherwise(plain)
    body = F.concat(strip_blanks(F.substring(t, start, F.length(t))), F.lit("\n"))
    return F.when(start > 0, body).otherwise(F.lit(""))


TRUNCATED = "\n\n[issue truncated for shared context budget]"


def compact_text(text, title, limit: int) -> Column:
    """Issue text without comments or a repeated copy, squeezed and cut to ``limit``."""
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    head = F.coalesce(col(title), F.lit(""))
    start = F.greatest(F.length(head), F.floor(F.length(t) / 3)) + 1
    again = F.when(head == "", F.lit(0)).otherwise(
        F.call_function("locate", head, t, start.cast("int"))
    )
    t = F.when(again > 1, F.substring(t, F.lit(1), (again - 1).cast("int"))).otherwise(t)
    t = F.when(
        (head != "") & F.startswith(t, head),
        F.regexp_replace(F.substring(t, F.length(head) + 1, F.length(t)), f"^{lx.SPACE}+", ""),
    ).otherwise(t)
    t = strip_blanks(F.regexp_replace(t, r"\n{3,}", "\n\n"))
    if limit <= 0:
        return t
    room = max(0, limit - len(TRUNCATED))
    cut = F.regexp_replace(F.substring(t, F.lit(1), F.lit(room)), f"{lx.SPACE}+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(cut, F.lit(TRUNCATED)))


# The label sets of a review record.
VALIDITY = ["VALID_SECURITY_FINDING", "LIKELY_FALSE_POSITIVE", "UNCERTAIN"]
ATTRIBUTION = ["INTRODUCED_OR_AFFECTED_BY_PATCH", "PRE_EXISTING", "UNCERTAIN"]
LABEL_SCHEMA = "validity STRING, patch_attribution STRING, confidence STRING, reasoning STRING"


def parse_labels(df: DataFrame, text: str) -> DataFrame:
    """Label record out of free text; anything off the label sets gives nulls."""
    raw = strip_blanks(F.coalesce(F.col(text), F.lit("")))

    def valid(rec):
        # The record holds plain strings only if every field was present.
        grade = rec["confidence"].try_cast("int")
        ok = (
            rec["validity"].isin(VALIDITY)
            & rec["patch_attribution"].isin(ATTRIBUTION)
            & rec["confidence"].rlike("^[1-5]$")
            & rec["reasoning"].isNotNull()
        )
        return F.when(
            ok,
            F.struct(
                rec["validity"].alias("validity"),
                rec["patch_attribution"].alias("patch_attribution"),
                grade.alias("confidence"),
                rec["reasoning"].alias("reasoning"),
            ),
        )

    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    out = df.withColumns({
        "_whole": F.from_json(F.when(F.startswith(raw, F.lit("{")), raw), LABEL_SCHEMA),
        "_inner": F.from_json(F.when(braces != "", braces), LABEL_SCHEMA),
    })
    rec = F.coalesce(valid(F.col("_whole")), valid(F.col("_inner")))
    return out.withColumn("_rec", rec).select(
        *df.columns, *[F.col(f"_rec.{f}").alias(f) for f in
                       ("validity", "patch_attribution", "confidence", "reasoning")]
    )
