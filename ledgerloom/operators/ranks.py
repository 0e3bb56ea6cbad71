"""Numbering and running values of whole tables, without one task that puts them in order.

Rows are dealt by sampled ranges of the order and put in order within each range, once, and written with
their range and place.  What a range needs of those before it is one row a range: its
count, its sum, its greatest value.  So a rank costs one exchange of the rows, whatever their
order is made of: sparse or string keys, nulls (last), repeats.  Rows that are
equal in the order are told apart by chance, so a key that a third of all rows share fills no single range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import written

#: Where the range's number starts in what tells the rows' places.
_PLACE_BITS = 33


def ranged(df: DataFrame, order: list[str | Column], name: str = "ranged", width: int | None = None) -> DataFrame:
    """``df``, written, with ``__range`` and ``__place`` (from 0 within the range) of each row in ``order``, nulls last; ranges follow each other.

    ``width``: about how many rows a range has; by default there are as many ranges as a shuffle has partitions.
    """
    keys = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    parts = [max(1, -(-df.count() // width))] if width else []
    dealt = df.withColumn("__chance", F.rand(7)).repartitionByRange(*parts, *keys, F.col("__chance")).sortWithinPartitions(*keys, F.col("__chance"))
    # The number that Spark gives to a partition's rows as they come: the partition above, the row below.
    numbered_ = dealt.drop("__chance").withColumn("__number", F.monotonically_increasing_id())
    out = numbered_.withColumns({"__range": F.shiftright("__number", _PLACE_BITS), "__place": F.col("__number").bitwiseAND((1 << _PLACE_BITS) - 1)}).drop("__number")
    return written(out, name)


def before(sums: DataFrame, groups: list[str], value: str, f=F.sum) -> DataFrame:
    """Of one row a range and group: ``value`` as ``f`` makes it of the ranges before (null for the first)."""
    order = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(value, f(value).over(order))


def numbered(df: DataFrame, order: str | Column | list, name: str, width: int | None = None) -> DataFrame:
    """``df`` with the 1-based rank of every row in ``order`` as ``name``; nulls are last, equal rows follow each other in any order."""
    rows = ranged(df, order if isinstance(order, list) else [order], width=width)
    starts = before(rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__start")), [], "__start")
    met = rows.join(F.broadcast(starts), "__range")  # one row a range
    return met.withColumn(name, F.coalesce("__start", F.lit(0)) + F.col("__place") + 1).drop("__start", "__range", "__place")


def running_sum(df: DataFrame, groups: list[str], order: list[str | Column], value: str | Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over its group's rows up to each row, nulls as 0; a group may hold most of the table."""
    rows = ranged(df.withColumn("__value", F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))), [*groups, *order])
    within = Window.partitionBy("__range", *groups).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    carried = before(rows.groupBy("__range", *groups).agg(F.sum("__value").alias("__carried")), groups, "__carried").where("__carried is not null")
    carried = carried.select(F.col("__range").alias("__r"), *[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)], "__carried")
    same = [F.col("__range") == F.col("__r"), *[F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(groups)]]
    # Only a range's first group can come from ranges before: at most one row a range.
    met = rows.withColumn(name, F.sum("__value").over(within)).join(F.broadcast(carried), same, "left")
    return met.withColumn(name, F.col(name) + F.coalesce("__carried", F.lit(0))).select(*df.columns, name)


def covered(df: DataFrame, groups: list[str], start: str, end: str, length) -> DataFrame:
    """Of each group: ``covered``, the length of the union of its intervals (``length`` of two columns); touching ones merge.

    Intervals are merged within ranges of their starts.  All that starts before a range covers
    the time up to its latest end without a gap from any of the range's starts on, so what a merged
    interval adds is its part after that end: one row a range and group carries it over.
    """
    rows = ranged(df.select(*groups, start, F.col(end).alias("__end")), [*groups, start, "__end"], "intervals")
    within = Window.partitionBy("__range", *groups).orderBy("__place")
    latest = F.max("__end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(latest.isNull() | (F.col(start) > latest), 1).otherwise(0)
    islands = rows.withColumn("__opens", opens).withColumn("__island", F.sum("__opens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("__range", *groups, "__island").agg(F.min(start).alias("__from"), F.max("__end").alias("__to"))
    carried = before(rows.groupBy("__range", *groups).agg(F.max("__end").alias("__until")), groups, "__until", F.max).where("__until is not null")
    carried = carried.select(F.col("__range").alias("__r"), *[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)], "__until")
    same = [F.col("__range") == F.col("__r"), *[F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(groups)]]
    met = merged.join(F.broadcast(carried), same, "left")
    own = length(F.greatest("__from", F.coalesce("__until", F.col("__from"))), F.greatest("__to", F.coalesce("__until", F.col("__to"))))
    return met.groupBy(*groups).agg(F.sum(own).alias("covered"))
