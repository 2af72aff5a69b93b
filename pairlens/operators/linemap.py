"""Line-level work on unified diffs and source files."""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.text import lines
from ..shipping import ship

# Relation labels of a mapped line.
OUTSIDE, CONTEXT = "UNCHANGED_OUTSIDE_DIFF", "CONTEXT_LINE_IN_HUNK"
ADDED, NO_DIFF = "ADDED_IN_PATCH", "UNCHANGED_NO_DIFF"

STRICT_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
# The formats of unified diffs, with the deviations that models produce.
LOOSE_HUNK = r"^@@+\s*-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s*@@+(.*)$"
GIT_HEADER = r"^diff --git\s+(\S+)\s+(\S+)\s*$"
STAMP = r"\s+\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:\s*[+-]\d{4})?\s*$"


def _header(line: Column, pattern: str) -> dict[str, Column]:
    def num(i):
        return F.regexp_extract(line, pattern, i)

    def count(i):
        return F.when(num(i) == "", F.lit(1)).otherwise(num(i).try_cast("int"))

    return {
        "old_start": num(1).try_cast("int"), "old_count": count(2),
        "new_start": num(3).try_cast("int"), "new_count": count(4),
    }


def map_lines(findings: DataFrame, diffs: DataFrame, keys: Sequence[str], line: str, patch: str) -> DataFrame:
    """BEFORE line and relation label for each AFTER line.

    Adds mapped_before_line and line_mapping_relation. ``diffs`` has one row
    per key. The text is parsed once per diff; findings meet single lines
    through an equi-join on (key, line).
    """
    keys = list(keys)
    header = F.filter(lines(patch), lambda x: x.rlike(STRICT_HUNK))
    hunks = diffs.select(
        *keys,
        F.transform(
            header, lambda x: F.struct(*[c.alias(n) for n, c in _header(x, STRICT_HUNK).items()])
        ).alias("_hunks"),
    )
    w = W.partitionBy(*keys).orderBy("_i")
    exploded = diffs.select(*keys, F.posexplode(lines(patch)).alias("_i", "_x"))
    is_head = F.col("_x").rlike(STRICT_HUNK)
    rows = exploded.withColumn("_head", is_head).withColumn(
        "_hunk", F.sum(F.col("_head").cast("int")).over(w)
    )
    in_hunk = W.partitionBy(*keys, "_hunk").orderBy("_i")
    earlier = in_hunk.rowsBetween(W.unboundedPreceding, -1)
    git = F.startswith("_x", F.lit("diff --git ")).cast("int")
    kind = (
        F.when(F.col("_head") | F.startswith("_x", F.lit("\\ No newline")), F.lit(""))
        .when((F.col("_x") == "") | F.startswith("_x", F.lit(" ")), F.lit(" "))
        .when(F.startswith("_x", F.lit("+")) & ~F.startswith("_x", F.lit("+++")), F.lit("+"))
        .when(F.startswith("_x", F.lit("-")) & ~F.startswith("_x", F.lit("---")), F.lit("-"))
        .otherwise("")
    )
    head = _header(F.col("_x"), STRICT_HUNK)
    rows = rows.where("_hunk > 0").withColumns({
        "_kind": kind,
        "_ended": F.sum(git).over(in_hunk),
        "_os": F.first(F.when(F.col("_head"), head["old_start"]), True).over(in_hunk),
        "_ns": F.first(F.when(F.col("_head"), head["new_start"]), True).over(in_hunk),
    })
    rows = rows.withColumns({
        "_old": F.col("_os") + F.coalesce(
            F.sum(F.col("_kind").isin(" ", "-").cast("int")).over(earlier), F.lit(0)),
        "_new": F.col("_ns") + F.coalesce(
            F.sum(F.col("_kind").isin(" ", "+").cast("int")).over(earlier), F.lit(0)),
    })
    spots = (
        rows.where((F.col("_ended") == 0) & F.col("_kind").isin(" ", "+"))
        .groupBy(*keys, F.col("_new").alias(line))
        .agg(F.min(F.struct("_hunk", F.col("_old").alias("old"), F.col("_kind").alias("kind"))).alias("_hit"))
    )
    out = findings.join(hunks, keys, "left").join(spots, [*keys, line], "left")
    hs, at = F.col("_hunks"), F.col(line)
    first_after = F.array_position(F.transform(hs, lambda h: h["new_start"] > at), True).cast("int")
    before = F.when(first_after == 0, F.size(hs)).otherwise(first_after - 1)
    last = F.get(hs, before - 1)
    offset = F.coalesce(
        last["old_start"] + last["old_count"] - last["new_start"] - last["new_count"], F.lit(0)
    )
    hit = F.col("_hit")
    inside = hit.isNotNull() & ((first_after == 0) | (hit["_hunk"] < first_after))
    none = F.coalesce(F.size(hs), F.lit(0)) <= 0
    mapped = (
        F.when(none, at)
        .when(inside & (hit["kind"] == " "), hit["old"])
        .when(inside, F.greatest(F.lit(1), hit["old"]))
        .otherwise(at + offset)
    )
    relation = (
        F.when(none, NO_DIFF)
        .when(inside & (hit["kind"] == " "), CONTEXT)
        .when(inside, ADDED)
        .otherwise(OUTSIDE)
    )
    return out.withColumns({
        "mapped_before_line": mapped.cast("int"), "line_mapping_relation": relation
    }).drop("_hunks", "_hit")


def context_window(
    findings: DataFrame, files: DataFrame, keys: Sequence[str], line: str, text: str,
    radius: int = 8, out: str = "code_context",
) -> DataFrame:
    """Source lines round each finding, the line itself marked with '>>'.

    Each file is opened once for its distinct lines, so a file with many
    findings does not carry its text along with every one of them.
    """
    keys = list(keys)
    wanted = findings.where(F.col(line).isNotNull() & (F.col(line) != 0)).groupBy(*keys).agg(
        F.collect_set(line).alias("_ns")
    )
    opened = files.join(wanted, keys).select(*keys, lines(text).alias("_ls"), "_ns").where(F.size("_ls") > 0)

    def window(n):
        at = F.greatest(F.lit(1), F.least(F.size("_ls"), n))
        low = F.greatest(F.lit(1), at - radius)
        high = F.least(F.size("_ls"), at + radius)
        return F.array_join(
            F.transform(
                F.sequence(low, high),
                lambda i: F.format_string(
                    "%s %5d: %s", F.when(i == at, ">>").otherwise("  "), i, F.element_at(F.col("_ls"), i)
                ),
            ),
            "\n",
        )

    contexts = opened.select(
        *keys,
        F.explode(F.transform("_ns", lambda n: F.struct(n.alias("n"), window(n).alias("c")))).alias("_w"),
    ).select(*keys, F.col("_w.n").alias(line), F.col("_w.c").alias(out))
    return findings.join(contexts, [*keys, line], "left").withColumn(out, F.coalesce(out, F.lit("")))


def hunk_lines(diffs: DataFrame, keys: Sequence[str], patch: str) -> DataFrame:
    """Body lines of every hunk, with file and hunk numbers and declared counts.

    A hunk ends at the first line that cannot belong to it; an empty line
    belongs to it when the next non-empty line does. Hunks without any body
    line have one row with a null ``pos``.
    """
    keys = list(keys)
    text = F.regexp_replace(F.coalesce(F.col(patch), F.lit("")), r"\r\n?", "\n")
    rows = diffs.select(*keys, F.posexplode(F.split(text, "\n")).alias("_i", "_x"))
    w = W.partitionBy(*keys).orderBy("_i")
    back = W.partitionBy(*keys).orderBy(F.desc("_i")).rowsBetween(W.unboundedPreceding, -1)
    past = w.rowsBetween(W.unboundedPreceding, -1)
    x = F.col("_x")

    def starts(c, p):
        return F.startswith(c, F.lit(p))

    rows = rows.withColumns({
        "_next": F.lead("_x").over(w),
        "_filled": F.last(F.when(x != "", x), True).over(back),
        "_g": x.rlike(GIT_HEADER),
    })
    rows = rows.withColumn(
        "_p", ~F.col("_g") & starts(x, "--- ") & F.coalesce(starts(F.col("_next"), "+++ "), F.lit(False))
    )
    rows = rows.withColumns({
        "_plus": F.coalesce(F.lag("_p").over(w), F.lit(False)),
        "_open": F.sum((F.col("_g") | F.col("_p")).cast("int")).over(w),
    })
    rows = rows.withColumn("_h", x.rlike(LOOSE_HUNK) & ~F.col("_plus") & (F.col("_open") > 0))
    rows = rows.withColumn(
        "_ev", F.when(F.col("_g"), "G").when(F.col("_p"), "P").when(F.col("_h"), "H")
    )
    rows = rows.withColumn("_prev", F.last("_ev", True).over(past))
    opens = F.col("_g") | (F.col("_p") & (F.col("_prev").isNull() | (F.col("_prev") == "H")))
    rows = rows.withColumns({
        "file_id": F.sum(opens.cast("int")).over(w),
        "hunk_id": F.sum(F.col("_h").cast("int")).over(w),
        "_region": F.col("_ev").isNull() & ~F.col("_plus") & (F.col("_prev") == "H"),
    })

    def bodyish(c):
        return F.substring(c, 1, 1).isin(" ", "+", "-", "\\") & ~starts(c, "--- ") & ~starts(c, "+++ ")

    filled = F.col("_filled")
    blank_ok = filled.isNotNull() & ~starts(filled, "diff --git") & ~filled.rlike(LOOSE_HUNK) & bodyish(filled)
    rows = rows.withColumn("_ok", F.when(x == "", F.coalesce(blank_ok, F.lit(False))).otherwise(bodyish(x)))
    in_hunk = W.partitionBy(*keys, "hunk_id").orderBy("_i")
    head = _header(x, LOOSE_HUNK)
    old_path = F.regexp_replace(
        F.regexp_replace(F.btrim(F.substring_index(F.substring(x, 5, 1 << 30), "\t", 1)), STAMP, ""),
        "^[ab]/", "",
    )
    rows = rows.withColumns({
        "_broken": F.sum((F.col("_region") & ~F.col("_ok")).cast("int")).over(in_hunk),
        "_old": F.when(F.col("_p"), old_path).when(
            F.col("_g"), F.regexp_replace(F.regexp_extract(x, GIT_HEADER, 1), "^[ab]/", "")
        ),
        **{f"_d_{n}": F.when(F.col("_h"), c) for n, c in head.items()},
    })
    rows = rows.withColumns({
        "old_path": F.last("_old", True).over(w),
        **{n: F.last(f"_d_{n}", True).over(w) for n in head},
    })
    is_body = F.col("_region") & F.col("_ok") & (F.col("_broken") == 0)
    marked = F.when(x == "", F.lit(" ")).otherwise(x)
    return rows.where(F.col("_h") | is_body).select(
        *keys, "file_id", "hunk_id", "old_path", *head,
        F.when(is_body, F.col("_i")).alias("pos"),
        F.when(is_body, F.substring(marked, 1, 1)).alias("prefix"),
        F.when(is_body, F.substring(marked, 2, 1 << 30)).alias("line"),
    )


def _hunks(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per hunk; its lines in order, bounded by one hunk's text."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "prefix", "line"))))
    return table.groupBy(
        *keys, "file_id", "hunk_id", "old_path", "old_start", "old_count", "new_start", "new_count"
    ).agg(ordered.alias("body"))


def _side(body: Column, kinds: Sequence[str]) -> Column:
    return F.transform(F.filter(body, lambda b: b["prefix"].isin(list(kinds))), lambda b: b["line"])


def hunk_audit(diffs: DataFrame, keys: Sequence[str], patch: str) -> DataFrame:
    """Per diff: kept and dropped files and hunks, and miscounted hunk headers."""
    keys = list(keys)
    h = _hunks(hunk_lines(diffs, keys, patch), keys)
    body = F.col("body")
    empty = F.size(body) == 0
    noop = ~empty & (_side(body, "-") == _side(body, "+"))
    kept = ~empty & ~noop
    wrong = kept & (
        (F.size(_side(body, " -")) != F.col("old_count")) | (F.size(_side(body, " +")) != F.col("new_count"))
    )
    per_file = h.groupBy(*keys, "file_id").agg(
        F.count_if(empty).alias("_e"), F.count_if(noop).alias("_n"),
        F.count_if(kept).alias("_k"), F.count_if(wrong).alias("_w"),
    )
    found = per_file.groupBy(*keys).agg(
        F.count_if(F.col("_k") > 0).alias("files_kept"),
        F.count_if(F.col("_k") == 0).alias("files_without_useful_hunk"),
        F.sum("_k").alias("hunks_kept"), F.sum("_n").alias("hunks_dropped_noop"),
        F.sum("_e").alias("hunks_dropped_empty"), F.sum("_w").alias("hunks_recounted"),
    )
    names = [c for c in found.columns if c not in keys]
    return diffs.select(*keys).join(found, keys, "left").select(
        *keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names]
    )


#: What is taken off lines before they are compared, in this order.
FORMS = (lambda x: x, str.rstrip, str.strip)


class _Lines:
    """The places of those lines of a file that occur in its hunks, for one form of comparing."""

    def __init__(self, source: Sequence[str], wanted: set[str]):
        self.source, self.places = source, {x: [] for x in wanted}
        for i, x in enumerate(source):
            if x in self.places:
                self.places[x].append(i)

    def find(self, block: Sequence[str], floor: int, hint: int) -> int | None:
        """The start of ``block`` at or after ``floor`` that is nearest to ``hint``, the smaller of two.

        Only places of the block's rarest line are tried, from the hint outwards.
        """
        rare = min(range(len(block)), key=lambda j: len(self.places[block[j]]))
        at = self.places[block[rare]]
        right = bisect_left(at, hint + rare)
        left = right - 1
        while left >= 0 or right < len(at):
            if right == len(at) or left >= 0 and hint + rare - at[left] <= at[right] - hint - rare:
                start, left = at[left] - rare, left - 1
            else:
                start, right = at[right] - rare, right + 1
            if start >= floor and self.source[start:start + len(block)] == block:
                return start
        return None


def place_hunks(text: str, hunks: Sequence[tuple[int, Sequence[str]]]) -> list[int | None]:
    """Start (0-based) of the old side of every hunk (hint, lines) in a file, each after the one before."""
    source, indexes, out, floor = text.replace("\r\n", "\n").split("\n"), {}, [], 0
    for hint, block in hunks:
        found = None
        for k, form in enumerate(FORMS if block else ()):
            if k not in indexes:
                indexes[k] = _Lines([form(x) for x in source], {form(x) for _, b in hunks for x in b})
            found = indexes[k].find([form(x) for x in block], floor, hint)
            if found is not None:
                break
        out.append(found)
        floor = floor if found is None else found + 1
    return out


def relocate_hunks(
    diffs: DataFrame, files: DataFrame, keys: Sequence[str], patch: str, path: str, text: str
) -> DataFrame:
    """True position of each hunk's old side in the base file.

    Lines are compared exactly, then without trailing and then without any
    surrounding blanks; hunks of a file are placed in order, each after the one
    before. A section of a diff meets its file in one row; there the places of
    the rarest line of a hunk are its candidates.
    """
    keys = list(keys)
    h = _hunks(hunk_lines(diffs, keys, patch), keys)
    sections = h.groupBy(*keys, "file_id", F.col("old_path").alias(path)).agg(
        F.array_sort(F.collect_list(F.struct("hunk_id", "old_start", _side(F.col("body"), " -").alias("block")))).alias("_hs")
    ).where(F.col(path) != "/dev/null")
    joined = sections.join(files.select(path, F.col(text).alias("_src")), path, "left")
    item = T.ArrayType(T.StructType([T.StructField("hunk_id", T.LongType()), T.StructField("old_start", T.IntegerType()),
                                     T.StructField("found", T.IntegerType())]))
    kept = [*keys, "file_id", path]
    schema = T.StructType([*[joined.schema[c] for c in kept], T.StructField("_has", T.BooleanType()), T.StructField("_os", item)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for whole in batches:
            for k in range(whole.num_rows):
                row = whole.slice(k, 1)
                hunks, source = row.column("_hs")[0].as_py(), row.column("_src")[0].as_py()
                spots = [None] * len(hunks) if source is None else place_hunks(source, [(x["old_start"] - 1, x["block"]) for x in hunks])
                placed = [{"hunk_id": x["hunk_id"], "old_start": x["old_start"], "found": s} for x, s in zip(hunks, spots)]
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in kept], pa.array([source is not None]),
                                                  pa.array([placed], type=to_arrow_type(item))], names=[*kept, "_has", "_os"])

    ship(diffs.sparkSession)
    placed = joined.mapInArrow(run, schema).select(*kept, "_has", F.explode("_os").alias("_o"))
    found = F.col("_o.found")
    status = (
        F.when(~F.col("_has"), "no_file")
        .when(found.isNull(), "not_found")
        .when(found + 1 == F.col("_o.old_start"), "already_correct")
        .otherwise("relocated")
    )
    return placed.select(
        *keys, "file_id", path, F.col("_o.hunk_id").alias("hunk_id"),
        F.col("_o.old_start").alias("declared_start"),
        F.when(F.col("_has"), found + 1).alias("found_start"), status.alias("relocation"),
    )
