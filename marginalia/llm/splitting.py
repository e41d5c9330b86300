"""Oversized texts cut into overlapping pieces at natural boundaries, by one bounded regular expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2000
OVERLAP = 150
#: Boundaries from the strongest to none at all; a cut is named by its place in this list.
LEVELS = ["paragraph", "line", "word", "none"]
_BLANK = " \t\r\n"
#: Blank lines between two paragraphs: from the end of one line to the beginning of another, with only white space between.
_BREAK = "\\n[ \\t\\r\\n]*\\n"
_WHITE = "[ \\t\\r\\n]*+"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def piece_pattern(limit: int, overlap: int) -> str:
    """Consumes a trimmed text whole, part by part: a part's own text and the separator behind it.

    The own text is as long as it can be with the overlap in front (``limit - overlap``; the first part has none and may use
    the limit). Boundaries are tried from the strongest: the end of the text, blank lines, a line end, a sentence end, white
    space, and at last any character. A paragraph, line or word that fits the limit but not beside a whole overlap is kept
    whole all the same. White space in front of a word that does not fit with it is skipped. All quantifiers of characters
    are bounded, so the time is linear in the text.
    """

    def ways(*sizes: int) -> list[str]:
        some = [f"[\\s\\S]{{1,{n}}}" for n in sizes]
        return [
            *[x + e for x in some for e in ("\\z", _BREAK)],
            *[x + "\\n" for x in some],
            f"{some[0]}(?<=[.!?])(?=[ \\t]){_WHITE}",
            *[f"{_WHITE}{x}(?:\\z|(?=[ \\t\\r\\n]){_WHITE})" for x in some],
            f"{_WHITE}{some[0]}",
        ]

    return "|".join([f"\\A(?:{'|'.join(ways(limit))})", *ways(limit - overlap, limit)])


def longest(text: Column, separator: str) -> Column:
    return F.array_max(F.transform(F.split(text, separator), F.length))


def cut_level(text: Column, limit: int) -> Column:
    """The strongest boundary at which a text can always be cut below the limit, from its lengths alone: what the cuts that
    are made must agree with (tests compare them)."""
    return F.when(longest(text, _BREAK) <= limit, "paragraph").when(longest(text, "\\n") <= limit, "line").when(longest(text, "[ \\t\\r\\n]++") <= limit, "word").otherwise("none")


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Chunks whose trimmed text has more than ``limit`` code points, each once, with ``body`` (that text) and ``lead`` (lines
    that trimming took from its front). Null texts and ids are left out. Of several rows of a chunk id, equal ones collapse."""
    own = chunks.select("chunk_id", "heading_path", "start_line", "text").where(F.col("chunk_id").isNotNull() & (F.length("text") > limit))
    body = own.withColumn("body", trimmed(F.col("text"))).where(F.length("body") > limit).dropDuplicates(["chunk_id", "text", "start_line"])
    return body.select("chunk_id", "heading_path", "start_line", "body", _breaks(F.regexp_extract("text", "\\A" + _WHITE, 0)).alias("lead"))


def _breaks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def split_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the oversized chunks: chunk_id, piece_no (from 0), heading_path, start_line, lap, piece, cut_at.

    A piece is at most ``limit`` code points: first the last ``lap`` characters of what comes before its own text (0 for the
    first piece, else ``overlap``, or less where a paragraph, line or word would not fit beside it), then its own text. The
    own texts in order are the trimmed text but for the white space at the cuts. ``start_line`` is the line on which the
    own text begins. ``cut_at`` is the weakest boundary at which the chunk was in fact cut. Texts without any boundary are
    cut by characters. Chunks within the limit, and empty tables, give no rows.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    parts = oversized(chunks, limit).withColumn("parts", F.regexp_extract_all("body", F.lit(piece_pattern(limit, overlap)), F.lit(0))).drop("body")

    def cut(m: Column, i: Column) -> Column:
        """Of one part what was matched, its own text with the white space before it, and how it was cut. A cut is at a paragraph
        or line only if what stands before the break fits the limit: else white space was skipped to make it fit."""
        paragraph, line = F.regexp_replace(m, f"{_BREAK}\\z", ""), F.regexp_replace(m, "\\n\\z", "")
        is_last = i == F.size("parts") - 1
        level = (
            F.when(is_last, F.when(F.length(m) > limit, 2).otherwise(-1))
            .when((F.length(paragraph) < F.length(m)) & (F.length(paragraph) <= limit), 0)
            .when((F.length(line) < F.length(m)) & (F.length(line) <= limit), 1)
            .when(m.rlike("[ \\t\\r\\n]\\z"), 2)
            .otherwise(3)
        )
        own = F.when(is_last, m).when(level == 0, paragraph).when(level == 1, line).otherwise(F.regexp_replace(m, "[ \\t\\r\\n]++\\z", ""))
        return F.struct(m.alias("m"), own.alias("own"), level.alias("level"))

    def fold(acc: Column, c: Column) -> Column:
        own = F.when(F.length(c["own"]) > limit, F.regexp_replace(c["own"], "\\A" + _WHITE, "")).otherwise(c["own"])
        skipped = F.left(c["own"], F.length(c["own"]) - F.length(own))
        before = F.right(F.concat(acc["tail"], skipped), F.lit(overlap))
        lap = F.least(F.length(before), F.lit(limit) - F.length(own))
        piece = F.struct(lap.alias("lap"), F.concat(F.right(before, lap), own).alias("piece"), (acc["line"] + _breaks(skipped)).alias("line"))
        return F.struct(F.right(F.concat(acc["tail"], c["m"]), F.lit(overlap)).alias("tail"), (acc["line"] + _breaks(c["m"])).alias("line"), F.concat(acc["out"], F.array(piece)).alias("out"))

    none = F.array().cast("array<struct<lap:int,piece:string,line:int>>")
    start = F.struct(F.lit("").alias("tail"), F.coalesce(F.col("start_line") + F.col("lead"), F.col("lead")).cast("int").alias("line"), none.alias("out"))
    known = parts.withColumn("cuts", F.transform("parts", cut))
    weakest = F.array_max(F.transform("cuts", lambda c: c["level"]))
    done = known.select("chunk_id", "heading_path", F.element_at(F.array(*map(F.lit, LEVELS)), weakest + 1).alias("cut_at"), F.aggregate("cuts", start, fold, lambda acc: acc["out"]).alias("pieces"))
    each = done.select("chunk_id", "heading_path", "cut_at", F.posexplode("pieces").alias("piece_no", "p"))
    return each.select("chunk_id", "piece_no", "heading_path", F.col("p.line").alias("start_line"), F.col("p.lap").alias("lap"), F.col("p.piece").alias("piece"), "cut_at")
