"""Reading parts of notes: ranges, passages, outlines, assembled contexts, sessions and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import budget
from marginalia.operators.ordered import placed, previous, running

#: Limits of what one answer holds (fixed values).
LEAST_CHARS, MOST_CHARS, DEFAULT_CHARS, SESSIONS, MOST_SESSIONS = 1000, 50_000, 12_000, 5, 20
LEAST_CARRY, MOST_CARRY = 12, 200
GLOBAL_FILES = ["profile", "preferences", "conventions"]
PROJECT_FILES = ["overview", "architecture", "decisions", "tasks", "open-questions"]


def clamp(n: int | None, low: int, high: int, default: int) -> int:
    return default if n is None else max(low, min(high, int(n)))


def in_range(first: int, last: int) -> Column:
    """Chunks whose lines meet a range counted from 1; 0 leaves a side open."""
    ok = F.lit(True)
    if first > 0:
        ok = ok & (F.col("end_line") + 1 >= first)
    if last > 0:
        ok = ok & (F.col("start_line") + 1 <= last)
    return ok


def carry_length(previous: Column, text: Column) -> Column:
    """Length of the longest beginning of ``text``, between LEAST_CARRY and MOST_CARRY, with which ``previous`` ends; else 0."""
    sizes = F.sequence(F.lit(LEAST_CARRY), F.greatest(F.lit(LEAST_CARRY), F.least(F.lit(MOST_CARRY), F.length(text))))
    fits = F.filter(sizes, lambda n: (F.length(text) >= n) & previous.endswith(F.substring(text, F.lit(1), n)))
    return F.coalesce(F.array_max(fits), F.lit(0))


def section_groups(chunks: DataFrame) -> DataFrame:
    """``group_no`` and ``own_text`` of chunks: windows of one section belong together if each begins with the end of the one
    before (behind the repeated heading line), and their own text leaves that carry out.

    Only the ends of the texts that can overlap are ordered and compared, in parts of a note (see ``ordered``)."""
    order = ["start_line", "end_line", "chunk_id"]
    body = F.when(F.coalesce("heading", F.lit("")) != "", F.regexp_replace("text", "^#{1,6} [^\\n]*\\n\\n?", "")).otherwise(F.col("text"))
    slim = chunks.select("note_path", *order, F.struct("heading", "heading_path").alias("section"), F.right("text", F.lit(MOST_CARRY)).alias("tail"), F.left(body, F.lit(MOST_CARRY)).alias("head"))
    before = previous(placed(slim, ["note_path"], order), ["note_path"], order, "section", "tail")
    carry = F.when(F.col("previous.section") == F.col("section"), carry_length(F.col("previous.tail"), F.col("head"))).otherwise(0)
    carried = before.select("note_path", *order, "__part", F.coalesce(carry, F.lit(0)).alias("carry"))
    numbered = running(carried, ["note_path"], order, starts=(F.col("carry") == 0).cast("int"))
    groups = numbered.select("chunk_id", F.col("note_path").alias("__note"), "carry", (F.col("before_starts") + (F.col("carry") == 0).cast("int")).alias("group_no"))
    both = chunks.withColumn("__body", body).join(groups, "chunk_id").where(F.col("note_path").eqNullSafe(F.col("__note")))
    own = F.when(F.col("carry") > 0, T.strip_ws(F.expr("substring(__body, carry + 1)"))).otherwise(F.col("text"))
    return both.select(*chunks.columns, "group_no", own.alias("own_text"))


def outline(chunks: DataFrame) -> DataFrame:
    """One row a section: note_path, group_no, label, first and last line from 1."""
    g = section_groups(chunks).withColumn("label", T.breadcrumb(F.col("heading_path"), F.col("heading")))
    return g.groupBy("note_path", "group_no").agg(F.min_by("label", "start_line").alias("label"), (F.min("start_line") + 1).alias("first_line"), (F.max("end_line") + 1).alias("last_line"))


def passage(chunks: DataFrame, first: int = 0, last: int = 0, most: int = DEFAULT_CHARS) -> DataFrame:
    """What of each note fits one answer: note_path, pieces, chars, next_line (0-based line to go on from, null at the end)."""
    pieces = section_groups(chunks.where(in_range(first, last)))
    return budget.passage(pieces, "own_text", ["note_path"], ["start_line", "end_line", "chunk_id"], most)


def projects(paths: DataFrame, root: str) -> DataFrame:
    """Names of the projects below a folder: the first segment of every path in it."""
    rest = F.expr(f"substring(path, {len(root) + 2})")
    return paths.where(F.col("path").startswith(root + "/")).select(F.split(rest, "/")[0].alias("project")).where("project <> ''").distinct()


def note_contents(chunks: DataFrame, wanted: Column, most: int = DEFAULT_CHARS) -> DataFrame:
    """note_path, content of the wanted notes, put together from their chunks: as far as ``most`` characters need them."""
    own = chunks.where(wanted).select("note_path", "start_line", "chunk_id", "text")
    near = running(own, ["note_path"], ["start_line", "chunk_id"], chars=F.length("text")).where(F.col("before_chars") <= most)
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))
    return near.groupBy("note_path").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("content"))


def named_files(root: str = "", folder: str | None = None, names: list[str] | None = None) -> Column:
    """Whether ``note_path`` is one of the named files of a folder, or of any folder directly below ``root``."""
    if folder is not None:
        return F.col("note_path").isin([f"{folder}/{n}.md" for n in names or []])
    inside = F.split(F.expr(f"substring(note_path, {len(root) + 2})"), "/")
    return F.col("note_path").startswith(root + "/") & (F.size(inside) == 2) & (inside[0] != "") & inside[1].isin([f"{n}.md" for n in names or []])


def assembled_context(notes: DataFrame, names: list[str], folder: str, most: int = DEFAULT_CHARS) -> DataFrame:
    """The named files of a folder in their fixed order, blank ones left out, within a budget: ord, note_path, shown, kept."""
    order = F.coalesce(*[F.when(F.col("note_path") == f"{folder}/{n}.md", F.lit(i)) for i, n in enumerate(names)])
    return _assembled(notes.withColumn("folder", F.lit(folder)).withColumn("ord", order), most).drop("folder")


def project_contexts(notes: DataFrame, root: str, most: int = DEFAULT_CHARS) -> DataFrame:
    """The contexts of all projects below a folder, each within its own budget: folder, ord, note_path, shown, kept."""
    inside = F.split(F.expr(f"substring(note_path, {len(root) + 2})"), "/")
    order = F.coalesce(*[F.when(inside[1] == f"{n}.md", F.lit(i)) for i, n in enumerate(PROJECT_FILES)])
    direct = notes.where(named_files(root, names=PROJECT_FILES))
    return _assembled(direct.withColumn("folder", F.concat(F.lit(root + "/"), inside[0])).withColumn("ord", order), most)


def _assembled(notes: DataFrame, most: int) -> DataFrame:
    some = notes.where("ord is not null").withColumn("content", T.strip_ws(F.col("content"))).where("content <> ''")
    return budget.assembled(some, "content", ["folder"], ["ord"], most).select("folder", "ord", "note_path", "kept", "shown")


def recent(notes: DataFrame, folder: str, limit: int = SESSIONS) -> DataFrame:
    """The latest notes of a folder by name."""
    return notes.where(F.col("note_path").startswith(folder + "/")).orderBy(F.desc("note_path")).limit(clamp(limit, 1, MOST_SESSIONS, SESSIONS))
