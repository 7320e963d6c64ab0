"""Ranks and running totals over a whole result, without one task sorting it all.

A window with an ordering and no partition key sorts every row in one task.
Here what decides the order is dealt out by value ranges, the window runs per range, and
each range adds the sum of the ranges before it. The way is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.session import stage

#: Ranges of values a rank is cut into at most; more than tasks at once is of no use.
MOST_RANGES = 1_000
#: So many values and their ranks, some megabytes, are sent to where the rows are.
FEW_VALUES = 100_000


def _in_ranges(df: DataFrame, order: Column, ranges: int | None, label: str) -> DataFrame:
    """``df`` with ``_range``, ascending along ``order``, written once so that it stays."""
    ranged = df.repartitionByRange(order) if ranges is None else df.repartitionByRange(ranges, order)
    return stage(ranged.withColumn("_range", F.spark_partition_id()), label)[0]


def _sums(ranged: DataFrame, order: Column, measure: str, name: str, last: int) -> DataFrame:
    """Add the sum of ``measure`` from the first row to the row ``last`` places from this one."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.sum(measure).alias("_sum")).select(
        "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(
        Window.unboundedPreceding, last
    )
    return (
        ranged.join(F.broadcast(offsets), "_range")  # a row per range
        .withColumn(name, F.coalesce(F.sum(measure).over(within), F.lit(0)) + F.col("_before"))
        .drop("_range", "_before")
    )


def _bounds(rows: DataFrame, by: str, ranges: int | None) -> tuple[list, int]:
    """Values that cut the rows into about equal ranges, and about how many values there are."""
    count = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / count for i in range(1, min(count, MOST_RANGES))] or [0.5]
    found, distinct = rows.agg(
        F.percentile_approx(by, F.array(*map(F.lit, shares))), F.approx_count_distinct(by)
    ).first()
    return sorted(set(found or [])), distinct


def global_rank(df: DataFrame, by: str, name: str, ranges: int | None = None) -> DataFrame:
    """Add ``RANK() OVER (ORDER BY by DESC NULLS FIRST)`` as a long; ``by`` is a number or a date.

    A rank is one more than the rows with a larger value. So rows are counted per value,
    before any shuffle, and only values are put in order, range by range. A range is told by the
    value alone, so no row is written or moved for it. The ranks then meet the rows in one
    join: up to FEW_VALUES of them are sent to the rows, beyond that Spark splits a value that many
    rows share. Rows are staged first, because counts and rows must see the same doubles.
    """
    rows, _ = stage(df, "rank")
    counts = rows.groupBy(F.col(by).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    bounds, distinct = _bounds(rows, by, ranges)
    above = [(F.lit(bound) > F.col("_value")).cast("int") for bound in bounds]
    place = F.aggregate(F.array(*above), F.lit(0), lambda n, one: n + one) if above else F.lit(0)
    ranged = counts.withColumn("_range", F.when(F.col("_value").isNull(), -1).otherwise(place))
    ranks = _sums(ranged, F.col("_value").desc_nulls_first(), "_rows", "_larger", -1).select(
        "_value", (F.col("_larger") + 1).alias(name)
    )
    if distinct <= FEW_VALUES:
        ranks = F.broadcast(ranks)
    columns = [*(F.col(f"`{c}`") for c in df.columns), F.col(name)]
    return rows.join(ranks, F.col(by).eqNullSafe(F.col("_value"))).select(*columns)


def numbered(df: DataFrame, name: str, *order: Column, ranges: int | None = None) -> DataFrame:
    """``df`` with the position of each row in the sorted whole, from one.

    ``order`` should leave no ties; tied rows get their positions in any order.
    """
    ranged = df.repartitionByRange(*order) if ranges is None else df.repartitionByRange(ranges, *order)
    ranged, _ = stage(ranged.withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.join(F.broadcast(offsets), "_range")  # a row per range
        .withColumn(name, F.row_number().over(within) + F.col("_before"))
        .drop("_range", "_before")
    )


def running_total(
    df: DataFrame, position: str, value: str, name: str, ranges: int | None = None
) -> DataFrame:
    """Add the sum of ``value`` from the lowest ``position`` up to this row.

    ``position`` is unique, as after grouping by it.
    """
    order = F.col(position).asc()
    return _sums(_in_ranges(df, order, ranges, "running"), order, value, name, Window.currentRow)
