"""Distinct counts from mergeable sketches.

A HyperLogLog sketch per day and store is kept in a table by month. Any range of days and any
group of stores is then the union of a few sketches, where an exact count would have to read
all orders again. Sketches forget repeats, so a day that is loaded twice counts once;
an order cannot be taken out again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.columns import day_of

#: Two to this power are the counters of a sketch; a full one takes as many bytes.
LG_COUNTERS = 12
COUNTED = ("customer_id", "product_sku")


def relative_error(lg_counters: int = LG_COUNTERS) -> float:
    """Standard error of an estimate over merged sketches, as share of the count."""
    return 1.04 / math.sqrt(2 ** lg_counters)


def daily_sketches(
    orders: DataFrame, counted: Sequence[str] = COUNTED, lg_counters: int = LG_COUNTERS
) -> DataFrame:
    """One row per day and store, with a sketch of each of the ``counted`` columns."""
    day = day_of(F.col("order_date"))
    return orders.groupBy(
        F.date_format(day, "yyyy-MM").alias("month"), day.alias("order_day"), "store_id"
    ).agg(*(F.hll_sketch_agg(c, F.lit(lg_counters)).alias(c) for c in counted))


def append(sketches: DataFrame, table: str) -> None:
    """Add sketches of a load; what was there stays as it is."""
    rows = sketches.repartition("month")  # a file per month and load
    rows.write.format("parquet").mode("append").partitionBy("month").saveAsTable(table)


def merged(sketches: DataFrame, by: Sequence[str | Column], counted: Sequence[str] = COUNTED) -> DataFrame:
    """The sketches of each group brought together, still mergeable. Combines before the shuffle."""
    return sketches.groupBy(*by).agg(*(F.hll_union_agg(c).alias(c) for c in counted))


def estimates(sketches: DataFrame, counted: Sequence[str] = COUNTED) -> DataFrame:
    """Sketches replaced by the count they stand for."""
    return sketches.withColumns({c: F.hll_sketch_estimate(c) for c in counted})


def distinct_between(
    spark: SparkSession, table: str, first: str, last: str, by: Sequence[str] = ("store_id",),
    counted: Sequence[str] = COUNTED,
) -> DataFrame:
    """Distinct ``counted`` of each group from the day ``first`` to ``last``; reads those months only."""
    days = spark.table(table).filter(
        F.col("month").between(first[:7], last[:7])
        & F.col("order_day").between(
            F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))
    )
    return estimates(merged(days, by, counted), counted)
