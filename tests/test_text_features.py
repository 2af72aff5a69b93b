"""Text features against plain regular expressions on accented and odd texts."""
import random
import re

import pytest
from pyspark.sql import functions as F

from pairlens.functions import diffs, lexicons as lx, paths, scores, text as tx

WORDS = ["security", "Sécurité", "sql", "sqlé", "vulnerable", "must", "should not", "don't", "do not", "user input",
         "request data", "no new", "exec(", "os.system", "CWE-79", "éauth", "auth", "naïve", "x²", "3.14", "12", "foo.bar",
         "a/b/c.py", "src/é/x.json", "https://x.y/z)", "```", "- fix", "* Make", "1. add", "\n", "\n\n", "?", "[RULES]",
         "Traceback", 'File "a.py", line 3', "needs to", "required to", "test", "tests", "pytest", "API", "key", "open("]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = ["", "\n", "a", "- x\n", "[OBJECTIVE]\nfix it"]
    for _ in range(120):
        out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40))))
        out.append("".join(rng.choice(WORDS) + rng.choice([" ", "\n", ", ", ""]) for _ in range(rng.randint(1, 30))))
    return out


@pytest.fixture(scope="module")
def df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def n(patterns, t):
    return sum(len(re.findall(p, t, flags=re.I)) for p in patterns)


PATH = r"(?<![\w./-])(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.(?:" + lx.FILE_ENDINGS + ")"


def test_statement_features(df, texts):
    got = {r["i"]: r for r in tx.statement_features(df, "t").collect()}
    assert len([c for c in tx.statement_features(df, "t").columns if c.startswith("ps_")]) == 49
    for i, t in enumerate(texts):
        r, low = got[i], t.lower()
        assert r["ps_chars"] == len(t) and r["ps_lines"] == len(t.splitlines()), repr(t)
        assert r["ps_words"] == len(re.findall(r"\b\w+\b", t)), repr(t)
        assert r["ps_identifier_count"] == len(re.findall(r"\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_.]*\b", t)), repr(t)
        assert r["ps_numeric_literal_count"] == len(re.findall(r"\b\d+(?:\.\d+)?\b", t)), repr(t)
        assert r["ps_constraint_count"] == n(lx.CONSTRAINTS, low) and r["ps_modal_count"] == n(lx.MODALS, low)
        assert r["ps_bullet_count"] == sum(bool(re.match(r"^\s*(?:[-*+]|\d+[.)])\s+", x)) for x in t.splitlines())
        found = re.findall(PATH, t)
        assert r["ps_file_path_count"] == len(found) and r["ps_unique_file_path_count"] == len(set(found)), repr(t)
        assert r["ps_code_fence_count"] == t.count("```") // 2
        for d, ps in lx.STATEMENT_DOMAINS.items():
            assert r[f"ps_domain_{d}_count"] == n(ps, low), (d, t)
            assert r[f"ps_domain_{d}"] == int(n(ps, low) > 0)


def test_envelope_features(df, texts):
    out = tx.envelope_features(df, "t")
    assert len([c for c in out.columns if c.startswith("sem_")]) == 35
    got = {r["i"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        r, low = got[i], t.lower()
        for d, ps in lx.ENVELOPE_DOMAINS.items():
            assert r[f"sem_mentions_{d}"] == int(n(ps, low) > 0), (d, t)
        assert r["sem_imperative_count"] == sum(
            len(re.findall(rf"(?im)^\s*(?:[-*]\s*)?{w}\b", t)) for w in lx.IMPERATIVES), repr(t)
        assert r["sem_negation_constraint_count"] == n(lx.NEGATIONS, low)
        assert r["sem_security_term_count"] == sum(n(lx.ENVELOPE_DOMAINS[d], low) for d in lx.ENVELOPE_SECURITY_TERMS)
        sections = len(re.findall(r"(?im)^\s*\[(?:RULES|OBJECTIVE|REQUIREMENTS?)\]\s*$", t))
        assert r["sem_requirement_count"] == r["sem_bullet_count"] + r["sem_modal_count"] + sections, repr(t)


def test_lexical_audit(df, texts):
    got = {r["i"]: r for r in tx.lexical_audit(df, "t").collect()}
    for i, t in enumerate(texts):
        for d, ps in lx.STATEMENT_DOMAINS.items():
            terms, seen = [], set()
            for p in ps:
                for m in re.finditer(p, t, flags=re.I):
                    if m.group(0).lower() not in seen:
                        seen.add(m.group(0).lower())
                        terms.append(m.group(0))
            assert got[i][f"audit_{d}_terms"] == " | ".join(terms), (d, t)


def test_norm_text_and_paths(spark):
    df = spark.createDataFrame([
        ("  A\tB  0xFF x0x1 ", "/w/repos_patched/c1/./src//a.py", "c1"),
        ("é 0x1g", "/tmp/swe_before_9/repo/pkg/b.py/", "c1"),
        ("", "./././b/x/c1/y.py", "c1"), ("q", "a\\b\\c.py", ""),
    ], "t string, p string, c string")
    got = df.select(tx.norm_text("t").alias("t"), paths.norm_path("p", "c").alias("p")).collect()
    assert [r["t"] for r in got] == ["a b <hex> x0x1", "é 0x1g", "", "q"]
    assert [r["p"] for r in got] == ["./src/a.py", "pkg/b.py", "y.py", "b/c.py"]
    twice = spark.createDataFrame([("a/proj/proj/x.py",)], "p string")
    assert twice.select(paths.norm_path("p", None, ["proj"]).alias("p")).first()["p"] == "proj/x.py"


def test_diff_metrics(spark):
    patch = ("diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n-a\n+b\n c\n"
             "diff --git a/y.py b/y.py\n@@ -1 +1 @@\n+++weird\n+z\n")
    plain = "--- a/q.py\t2024\n+++ b/q.py\t2024\n@@ -1 +1 @@\n-a\n+b\n--- a/q\n+++ /dev/null\n"
    df = spark.createDataFrame([(patch,), (plain,), ("",), (None,)], "p string")
    rows = diffs.diff_metrics(df, "p").collect()
    pick = lambda r: tuple(r[f"patch_{k}"] for k in ("lines", "added", "removed", "hunks", "files_touched", "churn", "net"))
    assert pick(rows[0]) == (11, 2, 1, 2, 2, 3, 1)
    assert pick(rows[1]) == (7, 1, 1, 1, 1, 2, 0)
    assert pick(rows[2]) == (0, 0, 0, 0, 0, 0, 0) == pick(rows[3])


def test_equivalence_key(spark):
    import hashlib

    df = spark.createDataFrame([("C1", "a.py", "B1", "CWE-1", " Msg ", 5, "   4: x\n>>     5:  y  = 1\n")],
                               "c string, p string, t string, w string, d string, l int, x string")
    want = hashlib.sha256("||".join(["c1", "a.py", "b1", "cwe-1", "msg", "y = 1"]).encode()).hexdigest()[:16]
    assert df.select(scores.equivalence_key("c", "p", "t", "w", "d", "l", "x")).first()[0] == want


def test_parse_labels(spark):
    good = '{"validity": "UNCERTAIN", "patch_attribution": "PRE_EXISTING", "confidence": 3, "reasoning": "r"}'
    df = spark.createDataFrame([(good,), ("noise " + good + " end",), (good.replace("3", "9"),), (good.replace("UNCERTAIN", "X"),),
                                ("",), ("{broken",)], "t string")
    got = [r["confidence"] for r in tx.parse_labels(df, "t").collect()]
    assert got == [3, 3, None, None, None, None]


def test_size_and_terms(spark):
    df = spark.createDataFrame([("abcdefgh\n",), ("",), ("No EVAL here",)], "t string")
    rows = tx.text_size(df, "t").select("*", tx.has_any("t", lx.GUIDELINE_TERMS).alias("g")).collect()
    assert [(r["prompt_chars"], r["prompt_lines"], r["prompt_tokens"], r["g"]) for r in rows] == [
        (9, 1, 2, 0), (0, 0, 0, 0), (12, 1, 3, 1)]


def test_pointed_line_and_blanks(spark):
    """The marked line is found in the text as by its list of lines; every blank of the class is stripped, and only those."""
    import itertools

    from pairlens.functions import scores as sc
    from pairlens.functions.text import lines

    parts = ["", "x", ">>", " >> 3 : a  b ", "\n", "\r\n", "\x0b", "\x85", " ", "\x1f>> 12:c", "\t\xa0>>d\x1c", "7: >>"]
    df = spark.createDataFrame([("".join(p),) for p in itertools.product(parts, repeat=3)] + [(None,)], "t string")
    marked = F.filter(lines("t"), lambda x: x.rlike(f"^{lx.SPACE}*>>"))
    code = F.coalesce(F.get(marked, F.lit(0)), F.lit(""))
    for head in (">>", ""):
        code = F.regexp_replace(code, rf"^{lx.SPACE}*{head}{lx.SPACE}*\p{{Nd}}+{lx.SPACE}*:{lx.SPACE}*", "")
    code = F.regexp_replace(F.regexp_replace(code, f"^{lx.SPACE}+|{lx.SPACE}+$", ""), f"{lx.SPACE}+", " ")
    assert df.where(sc.pointed_line("t") != code).count() == 0 and df.where(sc.pointed_line("t") != "").count() > 100
    rows = spark.range(0, 0xD800, 1, 4).selectExpr("decode(encode(char(0), 'UTF-16BE'), 'UTF-16BE') AS z", "id").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    for around in ((F.col("c"), F.lit("x"), F.col("c")), (F.lit("x"), F.col("c")), (F.col("c"), F.lit("x")), (F.col("c"),)):
        text = F.concat(*around)
        assert rows.where(tx.strip_short(text) != F.regexp_replace(text, f"^{lx.SPACE}+|{lx.SPACE}+$", "")).count() == 0
    # Texts without the mark are not searched: the plan asks first, and no list of lines is made.
    plan = df.select(sc.pointed_line("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and "filter(" not in plan


def test_lines_are_counted_as_they_are_split(spark):
    """Counts without splitting agree with the lines, whatever breaks, blanks and ends the text has."""
    r = random.Random(5)
    parts = ["\n", "\n\n", "\r", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", " ", " ", " ", "\t", "- ", "-", "* x", "+", "1. ", "12)", "٣. ", "x", "é"]
    kept = [p for p in parts if p not in ("\r", "\r\n", "\x0b", "\x1c", "\x85", " ")]
    texts = ["", "\n", "- ", "-\n", "- \n- x", "\n\n  - x\n"] + ["".join(r.choice(some) for _ in range(r.randint(1, 14))) for some in (parts, kept) for _ in range(400)]
    t = F.col("t")
    slow = F.size(tx.lines(t)).cast("long"), F.size(F.filter(tx.lines(t), lambda x: x.rlike(tx.BULLET))).cast("long")
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", tx.line_count(t), tx.bullet_count(t), *slow).collect()
    assert [x for x in got if x[1:3] != x[3:5]] == [] and sum(x[4] for x in got) > 100


def test_statement_is_taken_apart_once(spark):
    """One search for tokens serves all 49 features."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        made = tx.statement_features(spark.createDataFrame([("a/b.py must", )], "t string"), "t")
        plan = made._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert len(re.findall(r"regexp_extract_all\(_low#\d+, \[\\p\{L\}\\p\{N\}_\]\+, 0\)", plan)) == 1


def test_normalised_paths_and_texts_are_cheap_to_use(spark):
    """A path that cannot be null is not made again to see whether it is; blanks are squeezed once."""
    df = spark.createDataFrame([(" a  0x1F\t\x1cB 0xG é0x1 0x2_ 0x3\U0001D400 \x85", None)], "t string, p string")
    assert not df.select(paths.norm_path("p", "t").alias("p")).schema["p"].nullable
    assert tx.norm_text("t")._jc.toString().count("regexp_replace") == 2
    made = df.select(tx.norm_text("t").alias("t"))
    assert made.first()["t"] == "a <hex> b 0xg é0x1 0x2_ 0x3\U0001D400"
