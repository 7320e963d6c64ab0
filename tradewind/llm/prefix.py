"""Exact running sums within groups, without a group in one task.

Rows get a bucket that sorts as they do. Buckets are summed first, offsets come from a
window over the buckets, and the rows of a bucket are summed by themselves; a hot group
is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_before(
    df: DataFrame, group: str, bucket: str, order: list[str | Column], value: str, name: str
) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its group before it.

    ``bucket`` must not decrease along ``order`` within a group and have few values;
    both keys must not be null.
    """
    by_bucket = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    offsets = by_bucket.select(
        F.col(group).alias("_group"), F.col(bucket).alias("_bucket"),
        (F.sum("_sum").over(
            Window.partitionBy(group).orderBy(bucket)
        ) - F.col("_sum")).alias("_offset"),
    )
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = df.withColumn("_inside", F.sum(value).over(inside) - F.col(value))
    return ranked.join(
        offsets, (F.col(group) == F.col("_group")) & (F.col(bucket) == F.col("_bucket"))
    ).withColumn(name, F.col("_offset") + F.col("_inside")).drop(
        "_group", "_bucket", "_offset", "_inside"
    )
