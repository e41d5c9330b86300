"""Result pages: order, cap per note with backfill, near-duplicates, snippets."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import StringType

SNIPPET, LEAD, NEAR = 220, 73, 0.8


def note_cap(limit: int) -> int:
    return max(2, math.ceil(limit / 3))


def diversified(scored: DataFrame, limit: int, cap: int | None = None, order: list | None = None, query: str = "query_id") -> DataFrame:
    """The page of every query: ``limit`` rows with ``rank`` (from 1), at most ``cap`` a note as long as other notes have any.

    Exact form of the greedy fill: rows beyond the cap come after all others. Only the first ``limit`` of a note can be on
    a page, which bounds what is sorted for a query.
    """
    cap = cap or note_cap(limit)
    order = order or [F.desc(F.round("score", 6)), "chunk_id"]
    in_note = W.Window.partitionBy(query, "note_path").orderBy(*order)
    few = scored.withColumn("__n", F.row_number().over(in_note)).where(F.col("__n") <= limit)
    page = W.Window.partitionBy(query).orderBy(F.col("__n") > cap, *order)
    return few.withColumn("rank", F.row_number().over(page)).where(F.col("rank") <= limit).drop("__n")


def jaccard(a, b):
    """Common part of two token sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def without_near_duplicates(page: DataFrame, tokens: str, query: str = "query_id", threshold: float = NEAR) -> DataFrame:
    """A page of ranked rows without those whose tokens are near those of a row kept before; rows without tokens stay."""
    row = F.struct("rank", "chunk_id", F.array_distinct(tokens).alias("t"))
    pages = page.groupBy(query).agg(F.array_sort(F.collect_list(row)).alias("rows"))  # a page is small

    def near(kept, x):
        return F.exists(kept, lambda k: jaccard(k["t"], x["t"]) >= threshold)

    kept = F.aggregate("rows", F.slice("rows", 1, 0), lambda kept, x: F.when(near(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    return pages.select(query, F.posexplode(kept).alias("pos", "x")).select(query, (F.col("pos") + 1).alias("rank"), F.col("x.chunk_id").alias("chunk_id"))


def term_spans(text: str, terms: list[str]) -> list[tuple[int, int]]:
    """Where whole terms stand in a text, whatever the case."""
    if not terms:
        return []
    some = "|".join(re.escape(t) for t in sorted(set(terms), key=len, reverse=True))
    return [m.span() for m in re.finditer(rf"(?i)(?<![a-z0-9])(?:{some})(?![a-z0-9])", text)]


def snippet_of(text: str | None, terms: list[str]) -> str:
    """The stretch with most matches, the earliest of equals, on one line."""
    flat = " ".join((text or "").split())
    if len(flat) <= SNIPPET:
        return flat
    spans, best, begin = term_spans(flat, terms), 0, 0
    for s, _ in spans:
        lo = max(0, min(s - LEAD, len(flat) - SNIPPET))
        n = sum(lo <= a and b <= lo + SNIPPET for a, b in spans)
        if n > best:
            best, begin = n, lo
    end = min(len(flat), begin + SNIPPET)
    return ("…" if begin else "") + flat[begin:end].strip() + ("…" if end < len(flat) else "")


def marked(text: str | None, terms: list[str]) -> str:
    """The text with its terms between ``<mark>`` tags."""
    out, at = [], 0
    for a, b in term_spans(text or "", terms):
        out += [(text or "")[at:a], "<mark>", (text or "")[a:b], "</mark>"]
        at = b
    return "".join([*out, (text or "")[at:]])


@F.pandas_udf(StringType())
def snippet(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, terms in rows:
        yield pd.Series([snippet_of(t, list(q) if q is not None else []) for t, q in zip(text, terms, strict=True)])


@F.pandas_udf(StringType())
def highlight(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, terms in rows:
        yield pd.Series([marked(t, list(q) if q is not None else []) for t, q in zip(text, terms, strict=True)])
