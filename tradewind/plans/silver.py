"""Silver models: newest valid row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind import rules
from tradewind.functions.columns import as_of_timestamp, has_text, matches_whole
from tradewind.operators.dedup import latest_per_key

ORDER_COLUMNS = (
    "order_id", "store_id", "customer_id", "order_date", "product_sku", "quantity",
    "unit_price", "total_amount", "order_status", "_source", "_loaded_at", "_run_id",
)
INVENTORY_COLUMNS = (
    "inventory_id", "store_id", "product_sku", "product_name", "quantity_on_hand",
    "reorder_point", "unit_cost", "_source", "_loaded_at", "_run_id",
)
STORE_COLUMNS = (
    "store_id", "store_name", "city", "state", "country", "store_type",
    "monthly_target", "is_active", "_source", "_loaded_at",
)


def newest_orders(bronze: DataFrame) -> DataFrame:
    """The newest row of each order, valid or not."""
    return latest_per_key(
        bronze.select(*ORDER_COLUMNS), ["order_id"], "_loaded_at", ["total_amount"]
    )


def valid_order(as_of=None, sku: str = rules.sku_pattern()) -> Column:
    return (
        F.col("store_id").isNotNull()
        & F.col("customer_id").isNotNull()
        & F.col("order_date").isNotNull()
        & F.col("product_sku").isNotNull()
        & (F.col("quantity") > 0)
        & (F.col("unit_price") > 0)
        & (F.col("total_amount") > 0)
        & (F.col("order_date") <= as_of_timestamp(as_of))
        & matches_whole(F.col("product_sku"), sku)
    )


def silver_orders(bronze: DataFrame, as_of=None, sku: str = rules.sku_pattern()) -> DataFrame:
    """The newest row of an order counts even if invalid: the order then drops out."""
    newest = newest_orders(bronze)
    return newest.filter(valid_order(as_of, sku)).withColumn("_silver_loaded_at", as_of_timestamp(as_of))


def silver_inventory(bronze: DataFrame, as_of=None) -> DataFrame:
    newest = latest_per_key(bronze.select(*INVENTORY_COLUMNS), ["inventory_id"], "_loaded_at")
    valid = (
        F.col("product_sku").isNotNull()
        & F.col("store_id").isNotNull()
        & has_text(F.col("product_name"))
        & (F.col("quantity_on_hand") >= 0)
        & (F.col("unit_cost") > 0)
    )
    return newest.filter(valid).withColumn("_silver_loaded_at", as_of_timestamp(as_of))


def silver_stores(bronze: DataFrame, as_of=None, dedup: bool = False) -> DataFrame:
    """Every load of a store stays a row, so store models count each load again.

    ``dedup=True`` keeps the newest load of a store only.
    """
    stores = bronze.select(*STORE_COLUMNS)
    if dedup:
        stores = latest_per_key(stores, ["store_id"], "_loaded_at")
    named = F.col("store_id").isNotNull() & has_text(F.col("store_name"))
    return stores.filter(named).withColumn("_silver_loaded_at", as_of_timestamp(as_of))
