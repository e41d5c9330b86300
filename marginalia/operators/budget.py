"""Budgets over ordered texts: what fits, what is cut, what is left out.

Lengths are ordered and summed apart from the texts, over any number of tasks a group (see ``ordered.running``); texts are
read once more where something of them is shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.ordered import running

#: Characters between two assembled blocks.
SEPARATOR = 7
CLIP_CHARS = 1 << 20
CORPUS_CHARS = 32 << 20


def within_corpus_budget(rows: DataFrame, text: str, group: list[str], order: list[str], budget: int = CORPUS_CHARS) -> DataFrame:
    """Rows before which less than ``budget`` characters have been emitted; the last may overshoot. ``order`` must name a row.

    No group: the budget is that of the whole table."""
    keys = [*group, *(c for c in order if c not in group)]
    slim = rows.select(*keys, F.length(text).alias("__chars"))
    kept = running(slim, group, order, chars="__chars").where(F.col("before_chars") < budget).select(*keys)
    return rows.join(kept, keys, "left_semi")


def assembled(blocks: DataFrame, text: str, group: list[str], order: list[str], most: int) -> DataFrame:
    """``kept`` and ``shown`` of every block of a group: blocks are kept while the running size stays within ``most``; the
    first is cut to it if need be, and after one that is left out all are. ``order`` must name a block of its group."""
    keys = [*group, *(c for c in order if c not in group)]
    slim = blocks.select(*keys, F.length(text).alias("__chars"))
    total = F.col("before_chars") + F.coalesce("__chars", F.lit(0)) + (F.col("n") - 1) * SEPARATOR
    placed = running(slim, group, order, chars="__chars").select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("n").alias("__n"), ((total <= most) | (F.col("n") == 1)).alias("kept"))
    on = [blocks[c].eqNullSafe(placed[f"__{c}"]) for c in keys]
    both = blocks.join(placed, on)
    shown = F.when(F.col("kept"), F.substring(F.col(text), F.lit(1), F.when(F.col("__n") == 1, F.lit(most)).otherwise(F.length(text))))
    return both.select(*blocks.columns, "kept", shown.alias("shown"))


def listed(links: DataFrame, title: str, group: list[str], most: int = 1500) -> DataFrame:
    """``shown`` of every title in order: the first always, others while the running length stays within ``most``."""
    placed = running(links, group, [title], chars=F.length(title) + 1)
    return placed.withColumn("shown", (F.col("before_chars") + F.length(title) + 1 <= most) | (F.col("n") == 1)).drop("n", "before_chars")


def passage(pieces: DataFrame, text: str, group: list[str], order: list[str], most: int) -> DataFrame:
    """Pieces that fit a passage per group: group, pieces, chars, next_line (start line of the first piece left out, null if none)."""
    cut = assembled(pieces, text, group, order, most)
    return cut.groupBy(*group).agg(
        F.sum(F.col("kept").cast("int")).alias("pieces"), F.coalesce(F.sum(F.length("shown")), F.lit(0)).alias("chars"), F.min(F.when(~F.col("kept"), F.col("start_line"))).alias("next_line")
    )
