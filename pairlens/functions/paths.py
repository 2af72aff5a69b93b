"""Path and repository-name normalisation as column expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .draws import col


def _after_marker(path: Column, marker: Column) -> Column:
    """What follows the first occurrence of the marker, else the whole path."""
    at = F.position(marker, path)
    return F.when(at > 0, F.substr(path, at + F.length(marker))).otherwise(path)


def norm_path(path, case=None, repo_dirs: Sequence[str] = ()) -> Column:
    """Repository-relative path: one identity for BEFORE and AFTER reports.

    Unifies slashes, drops ``./``, the root of the temporary BEFORE worktree,
    everything up to the case directory, an ``a/`` or ``b/`` prefix, and a
    repository directory written twice.
    """
    p = F.replace(F.coalesce(col(path), F.lit("")), F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(p, "/{2,}", "/")
    p = F.regexp_replace(p, r"^(?:\./)+", "")
    # The directory formats of the BEFORE worktree and of the patched copies.
    p = F.regexp_replace(p, r"^.*?/swe_before_[^/]+/repo/(?=.)", "")
    if case is not None:
        key = F.coalesce(col(case), F.lit(""))
        for lead in ("/repos_patched/", "/"):
            p = _after_marker(p, F.concat(F.lit(lead), key, F.lit("/")))
    p = F.regexp_replace(p, "^[ab]/", "")
    for name in repo_dirs:
        p = F.replace(p, F.lit(f"{name}/{name}/"), F.lit(f"{name}/"))
    # Never null, and said so: joins on it would else look whether it is, and make it once more for that.
    return F.coalesce(F.btrim(p, F.lit("/")), F.lit(""))


def _trimmed(c) -> Column:
    return F.regexp_replace(F.btrim(F.coalesce(col(c), F.lit(""))), "/+$", "")


def repo_slug(*candidates) -> Column:
    """First candidate of the form owner/name, else the empty string."""
    options = [F.when(_trimmed(c).rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), _trimmed(c))
               for c in candidates]
    return F.coalesce(*options, F.lit(""))


def repo_short_name(repo) -> Column:
    """Last path element of a repository name."""
    return F.substring_index(_trimmed(repo), "/", -1)


def repo_url_slug(url) -> Column:
    """owner__name from a clone URL, with unsafe characters replaced."""
    u = F.regexp_replace(F.coalesce(col(url), F.lit("")), "/+$", "")
    tail = F.replace(F.substring_index(u, "/", -2), F.lit("/"), F.lit("__"))
    tail = F.regexp_replace(F.regexp_replace(tail, r"\.git$", ""), "[^A-Za-z0-9_.-]+", "_")
    return F.when(tail == "", F.lit("repo")).otherwise(tail)


def candidate_path(token) -> Column:
    """A cited path cleaned of quotes, or null when it leaves the repository."""
    p = F.btrim(F.coalesce(col(token), F.lit("")))
    p = F.replace(F.btrim(p, F.lit("`\"'()[]{}<>,:")), F.lit("\\"), F.lit("/"))
    bad = (
        (p == "")
        | F.startswith(p, F.lit("~/"))
        | F.startswith(p, F.lit("site-packages/"))
        | F.contains(p, F.lit("/site-packages/"))
        | F.startswith(p, F.lit("/"))
        | p.rlike(r"(?:^|/)\.\.(?:/|$)")
    )
    clean = F.regexp_replace(F.regexp_replace(p, "/{2,}", "/"), r"(?<=^|/)\./", "")
    return F.when(~bad, F.regexp_replace(clean, "/$", ""))
