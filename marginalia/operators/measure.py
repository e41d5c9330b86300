"""Measures of a search: percentiles, recall and reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def percentiles(rows: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles and the mean of a value per group: group, p50, p95, ..., mean. Null values are left out.

    Equal values are counted first, so what a group ranks is its distinct values: two aggregations and a running count."""
    from marginalia.operators.ordered import running

    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("__c"))
    total = counts.groupBy(group).agg(F.sum("__c").alias("__t"), (F.sum(F.col(value) * F.col("__c")) / F.sum("__c")).alias("mean"))
    placed = running(counts, [group], [value], held=F.col("__c")).select(F.col(group).alias("__g"), value, (F.col("before_held") + F.col("__c")).alias("__upto"))
    both = placed.join(total, placed["__g"].eqNullSafe(total[group]))
    reached = [F.min(F.when(F.col("__upto") >= F.ceil(F.col("__t") * F.lit(s)), F.col(value))).alias(f"p{round(s * 100)}") for s in shares]
    return both.groupBy(group).agg(*reached, F.first("mean").alias("mean"))


def recall_and_rank(pages: DataFrame, truth: DataFrame, group: str, k: int = 8) -> DataFrame:
    """Recall at ``k`` and mean reciprocal rank per group of queries: group, queries, recall, mrr.

    ``pages``: query_id, rank (from 1), chunk_id; ``truth``: query_id, chunk_id (what is wanted, one or more), group. A query
    without wanted chunks is none; one whose page holds none has recall and reciprocal rank 0."""
    best = pages.where(F.col("rank") <= k).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    met = truth.distinct().join(best, ["query_id", "chunk_id"], "left")
    each = met.groupBy(group, "query_id").agg((F.count("rank") / F.count("*")).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return each.groupBy(group).agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"))
