"""Joins on keys of which a few hold much of the rows.

A sketch of frequent items finds the hot keys in one pass of bounded memory. Their rows are
dealt out by a salt, and the few rows of the other side are repeated once per salt; all other
keys are joined as they are. What reaches the driver, and every executor, is a row per hot
key, of which there are at most one over the share that makes a key hot.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 0.01


def hot_keys(df: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """(key, rows, total): keys with at least ``share`` of all rows, about how many,
    and the rows of all keys.

    The sketch tracks ten times as many keys as can be hot, so it misses none and counts each
    to about a tenth of the share. Null keys are left out.
    """
    most = math.ceil(1 / share)
    found = df.filter(F.col(key).isNotNull()).agg(
        F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k(`{key}`, {most}, {most * 16})").alias("top")
    )
    return found.select("total", F.inline("top")).filter(F.col("count") >= F.col("total") * share).select(
        F.col("item").alias(key), F.col("count").alias("rows"), "total"
    )


def skewed_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = SHARE,
    partitions: int | None = None,
) -> DataFrame:
    """``left.join(right, key, how)`` for a hot ``key`` on the left; ``how`` is inner or left.

    A hot key is spread over as many of the ``partitions`` (by default as many as a shuffle
    has) as its rows fill. Columns come as in a plain join: the key, then left, then right.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    spark = left.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(left, key, share).collect()
    if not hot:
        return left.join(right, key, how)
    rows_per_task = max(1.0, hot[0]["total"] / count)
    kind = left.schema[key].dataType.simpleString()
    spread = spark.createDataFrame(
        [(r[key], math.ceil(r["rows"] / rows_per_task)) for r in hot],
        f"`{key}` {kind}, _spread int",
    )
    small = F.broadcast(spread)
    # equal rows of different partitions get different salts; a task that is run again gets the same
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)) + F.spark_partition_id(), F.col("_spread"))
    hot_left = left.join(small, key).withColumn("_salt", salt.cast("int")).drop("_spread")
    hot_right = right.join(small, key).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_spread") - 1))
    ).drop("_spread")
    joined = hot_left.join(hot_right, [key, "_salt"], how).drop("_salt")
    return joined.unionByName(left.join(small, key, "left_anti").join(right, key, how))
