"""Running numbers and totals of ordered groups of any size: a hot group is spread over many tasks.

Rows are spread by ranges of group and order, so a large group fills several partitions, each of which is numbered and summed
by itself; the totals of a group's partitions (at most as many rows as there are partitions) are summed up and added.
Only what is ordered and summed moves; callers join texts back where they need them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from marginalia.session import materialize


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows with ``__part``: parts of a group follow each other in the given order. Written, so that parts stay what they are."""
    spread = rows.repartitionByRange(*group, *order) if group or order else rows.coalesce(1)
    return materialize(spread.withColumn("__part", F.spark_partition_id()), "placed")


def _same(group: list[str], left: DataFrame, right: DataFrame, more: list[str]) -> Column:
    """Equality of the group columns (nulls are one group) and of some others."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"__{c}"]) for c in group] + [left[c] == right[f"__{c}"] for c in more])


def running(rows: DataFrame, group: list[str], order: list[str], **sizes: Column | str) -> DataFrame:
    """``rows`` with ``n`` (place in its group, from 1) and for each size ``before_<name>`` (total of the group's earlier rows).

    Ties of the order must not matter or be broken by it. Null groups are one group, null sizes count 0. Empty tables stay empty."""
    sized = rows.select("*", *[F.coalesce(F.expr(s) if isinstance(s, str) else s, F.lit(0)).cast("long").alias(f"__size_{k}") for k, s in sizes.items()])
    held = sized if "__part" in rows.columns else placed(sized, group, order)
    total = held.groupBy(*group, "__part").agg(F.count("*").alias("__rows"), *[F.sum(f"__size_{k}").alias(f"__sum_{k}") for k in sizes])
    earlier = W.Window.partitionBy(*group).orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)
    shift = total.select(
        *[F.col(c).alias(f"__{c}") for c in [*group, "__part"]],
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__shift"),
        *[F.coalesce(F.sum(f"__sum_{k}").over(earlier), F.lit(0)).alias(f"__shift_{k}") for k in sizes],
    )
    local = W.Window.partitionBy(*group, "__part").orderBy(*order)
    behind = local.rowsBetween(W.Window.unboundedPreceding, -1)
    counted = held.select("*", F.row_number().over(local).alias("__n"), *[F.coalesce(F.sum(f"__size_{k}").over(behind), F.lit(0)).alias(f"__before_{k}") for k in sizes])
    both = counted.join(shift, _same(group, counted, shift, ["__part"]))
    return both.select(*rows.columns, (F.col("__n") + F.col("__shift")).cast("long").alias("n"), *[(F.col(f"__before_{k}") + F.col(f"__shift_{k}")).alias(f"before_{k}") for k in sizes])


def previous(rows: DataFrame, group: list[str], order: list[str], *columns: str) -> DataFrame:
    """``rows`` (with ``__part``) and ``previous``: a struct of the columns of the row before it in its group, null for the first."""
    held = rows if "__part" in rows.columns else placed(rows, group, order)
    row = F.struct(*columns)
    ends = held.groupBy(*group, "__part").agg(F.max_by(row, F.struct(*order)).alias("__end"))
    before = ends.select(*[F.col(c).alias(f"__{c}") for c in [*group, "__part"]], F.lag("__end").over(W.Window.partitionBy(*group).orderBy("__part")).alias("__edge"))
    local = W.Window.partitionBy(*group, "__part").orderBy(*order)
    known = held.withColumn("__lag", F.lag(row).over(local))
    both = known.join(before, _same(group, known, before, ["__part"]))
    return both.select(*[c for c in held.columns], F.coalesce("__lag", "__edge").alias("previous"))
