"""Which notes and chunks take part: path rules, tag rules and retrieval filters, all as predicates that push down."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer patterns, or such with more stars, are compared as plain text.
MAX_PATTERN, MAX_STARS = 256, 12


def normal_folder(folder: str) -> str:
    return folder.strip().replace("\\", "/").strip("/")


def under_folder(path: Column, folder: str) -> Column:
    """Whether a path is the folder or lies in it; the blank folder holds everything."""
    f = normal_folder(folder)
    p = F.regexp_replace(path, "^/+|/+$", "")
    return F.lit(True) if not f else (p == f) | p.startswith(f + "/")


def pattern_regex(pattern: str) -> str | None:
    """The regular expression of a path pattern: ``*`` stays within a folder, ``**`` does not; None if it is plain text."""
    if "*" not in pattern or len(pattern) > MAX_PATTERN or pattern.count("*") > MAX_STARS:
        return None
    parts = re.split(r"(\*\*|\*)", pattern)
    # a question mark keeps its meaning in regular expressions: it is not a wildcard of its own
    return "(?i)^" + "".join({"**": ".*", "*": "[^/]*"}.get(p) or re.sub(r"[.+^${}()|\[\]\\]", lambda m: "\\" + m[0], p) for p in parts) + "$"


def matches_pattern(path: Column, pattern: str) -> Column:
    regex = pattern_regex(pattern)
    return path.rlike(regex) if regex else F.lower(path).contains(pattern.replace("*", "").lower())


def eligible(path: Column, include: list[str] = (), exclude: list[str] = (), patterns: list[str] = ()) -> Column:
    """Path rules of a scan. Blank entries of ``include`` are ignored; a blank entry of ``exclude`` excludes everything."""
    ok = F.lit(True)
    wanted = [f for f in include if f.strip()]
    if wanted:
        ok = F.lit(False)
        for f in wanted:
            ok = ok | under_folder(path, f)
    for f in exclude:
        ok = ok & ~under_folder(path, f)
    for p in patterns:
        if p.strip():
            ok = ok & ~matches_pattern(path, p.strip())
    return ok


def _bare_tag(t: str) -> str:
    return t.strip().removeprefix("#").lower()


def has_tag(tags: Column, wanted: list[str]) -> Column:
    """Whether any of the tags is wanted, whatever the case, one leading ``#`` aside; null tags are none."""
    names = [_bare_tag(t) for t in wanted if _bare_tag(t)]
    return F.coalesce(F.exists(tags, lambda t: F.lower(F.regexp_replace(t, "^#", "")).isin(names)), F.lit(False)) if names else F.lit(False)


def own_artifact(path: Column, root: str = "Memory") -> Column:
    """Whether a path is one of the engine's own files: its index or the copy of its settings."""
    return under_folder(path, f"{root}/Index") | under_folder(path, f"{root}/Config")


def retrieval_condition(folder: str | None = None, tag: str | None = None, project_folder: str | None = None, since_mtime: int | None = None) -> Column:
    """Which chunks a search is about."""
    out = F.lit(True)
    if folder:
        out = out & under_folder(F.col("note_path"), folder)
    if project_folder:
        out = out & under_folder(F.col("note_path"), project_folder)
    if tag:
        out = out & has_tag(F.col("tags"), [tag])
    if since_mtime:
        out = out & (F.col("mtime") >= since_mtime)
    return out


def retrieval_filter(chunks: DataFrame, folder: str | None = None, tag: str | None = None, project_folder: str | None = None, since_mtime: int | None = None) -> DataFrame:
    """The chunks a search is about; statistics are made of these only."""
    return chunks.where(retrieval_condition(folder, tag, project_folder, since_mtime))
