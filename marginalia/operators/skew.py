"""Lookup joins that stay balanced when a few keys hold much of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many of the most frequent keys are handled apart; any key beyond them holds less than 1/MOST_HOT of the rows.
MOST_HOT = 200
#: Keys of fewer rows are never worth it.
LEAST_HOT_ROWS = 10_000


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", least_rows: int = LEAST_HOT_ROWS) -> DataFrame:
    """Join ``left`` with ``right`` (at most one row a key) on ``key``, hot keys by broadcast, the others by shuffle.

    The most frequent keys of the left side are found by a map-side combined count. There are at most ``MOST_HOT`` of
    them, so their right rows are broadcast and the hot left rows never move; every other key is joined by an ordinary
    shuffle, in which no key holds more than ``1 / MOST_HOT`` of the rows. ``how`` is ``left`` or ``inner``. Null keys
    match nothing and are kept by ``left``. An empty side gives the usual result of the join.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    hot = [r[key] for r in counts.where(F.col("__n") >= least_rows).orderBy(F.desc("__n")).limit(MOST_HOT).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    spread = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return spread.unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))
