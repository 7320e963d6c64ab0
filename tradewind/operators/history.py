"""Changes over time: upsert, product price history, schema drift, load volumes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.functions.columns import as_of_timestamp, percent, short_id, utc_now
from tradewind.sources.ops import SCHEMA_CHANGES

TRACKED = ("product_name", "category", "price", "stock_quantity")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str] | None = None,
) -> DataFrame:
    """``target`` with matched rows updated from ``source`` and new rows added.

    A key that repeats in ``source`` raises. Both joins keep the target or the source on
    their outer side, which lets Spark split a key that is frequent there.
    """
    columns = [c for c in target.columns if c not in keys]
    source = one_per_key(source, list(keys))
    updated = set(columns if update is None else update)
    changes = source.select(
        *keys, F.lit(True).alias("_matched"), *(F.col(c).alias(f"_new_{c}") for c in columns)
    )
    merged = target.join(changes, list(keys), "left").select(
        *keys,
        *(
            F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in updated
            else F.col(c)
            for c in columns
        ),
    )
    added = source.join(target.select(*keys).distinct(), list(keys), "left_anti")
    return merged.select(*target.columns).unionByName(added.select(*target.columns))


def _changed() -> Column:
    """Any tracked column differs; null differs from every value but null."""
    same = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in TRACKED]
    return ~reduce(Column.__and__, same)


def one_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` as they are; the job that reads them fails if a key repeats."""
    others = [c for c in rows.columns if c not in keys]
    counted = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.any_value(F.struct(F.lit(0).alias("_any"), *others)).alias("_row"),
    )
    alone = F.when(
        F.col("_rows") > 1, F.raise_error(F.lit(f"more than one row for a key of {list(keys)}"))
    ).otherwise(F.col("_row"))
    return counted.select(*keys, alone.alias("_row")).select(
        *(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns)
    )


def open_versions(snapshot: DataFrame, at) -> DataFrame:
    """Snapshot rows as the current version of their product from ``at`` on."""
    start = as_of_timestamp(at)
    return snapshot.select(
        short_id(F.col("product_sku"), start.cast("string")).alias("surrogate_key"),
        "product_sku", *TRACKED,
        start.alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.lit(True).alias("is_current"),
        "_source", "_loaded_at",
    )


def apply_snapshot(
    history: DataFrame, snapshot: DataFrame, at, close_missing: bool = False
) -> DataFrame:
    """New product history after ``snapshot`` was seen at ``at``; a repeated SKU raises.

    Unchanged products keep their open version; changed ones get it closed and
    a new one opened. Both sides have one row per SKU; closed versions pass
    through without a shuffle.
    """
    now = as_of_timestamp(at)
    closed, current = history.filter(~F.col("is_current")), history.filter("is_current")
    fresh = open_versions(one_per_key(snapshot, ["product_sku"]), at).select(*history.columns)
    joined = current.alias("old").join(
        fresh.alias("new"), F.col("old.product_sku") == F.col("new.product_sku"), "full_outer"
    )
    is_old, is_new = F.col("old.product_sku").isNotNull(), F.col("new.product_sku").isNotNull()
    changed = _changed()
    ends = F.when(is_new, changed).otherwise(F.lit(close_missing))
    kept = {
        "valid_to": F.when(ends, now).otherwise(F.col("old.valid_to")),
        "is_current": ~ends,
    }
    old_row = F.struct(*(kept.get(c, F.col(f"old.{c}")).alias(c) for c in history.columns))
    new_row = F.struct(*(F.col(f"new.{c}").alias(c) for c in history.columns))
    versions = F.array(
        F.when(is_old, old_row), F.when(is_new & (~is_old | changed), new_row)
    )
    return closed.unionByName(joined.select(F.inline(F.array_compact(versions))))


def schema_changes(
    spark: SparkSession, source: str, stored: T.StructType, incoming: T.StructType,
    at: dt.datetime | None = None,
) -> DataFrame:
    """ADDED, REMOVED and TYPE_CHANGED columns between two schemas."""
    before = {f.name.upper(): f.dataType.simpleString() for f in stored}
    after = {f.name.upper(): f.dataType.simpleString() for f in incoming}
    at = at or utc_now()
    rows = []
    for name in [*before, *(n for n in after if n not in before)]:
        old, new = before.get(name), after.get(name)
        if old != new:
            kind = "ADDED" if old is None else "REMOVED" if new is None else "TYPE_CHANGED"
            rows.append((None, source, kind, name, old, new, at))
    changes = spark.createDataFrame(rows, SCHEMA_CHANGES)
    return changes.withColumn(
        "change_id",
        short_id(F.col("source_name"), F.col("column_name"), F.col("detected_at").cast("string")),
    )


def volume_history(loads: DataFrame) -> DataFrame:
    """Rows per source and load, against the load before it.

    ``loads`` holds raw rows with ``_source`` and ``_loaded_at``; the window
    sees one row per load.
    """
    counted = loads.groupBy(
        F.col("_source").alias("source_name"), F.col("_loaded_at").alias("recorded_at")
    ).agg(F.count(F.lit(1)).alias("record_count"))
    by_load = Window.partitionBy("source_name").orderBy("recorded_at")
    change = F.col("record_count") - F.col("previous_count")
    return (
        counted.withColumn("previous_count", F.lag("record_count").over(by_load))
        .withColumn("change", change)
        .withColumn("change_pct", percent(change, F.col("previous_count"), 1))
    )
