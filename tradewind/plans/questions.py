"""Named business questions over the Gold models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators.ranking import numbered


def top_store(performance: DataFrame) -> DataFrame:
    """Which store has the highest revenue?"""
    return performance.filter("revenue_rank = 1").select(
        "store_id", "store_name", "total_revenue"
    )


def low_stock(products: DataFrame) -> DataFrame:
    """Which products run low?"""
    low = products.filter(F.col("stock_status").isin("LOW_STOCK", "OUT_OF_STOCK"))
    return low.select(
        "product_sku", "product_name", "current_stock", "reorder_point", "stock_status"
    ).orderBy("current_stock", "product_sku")


def daily_trend(daily: DataFrame) -> DataFrame:
    """How does revenue develop by day?"""
    return daily.select(
        "order_day", "daily_revenue", "cumulative_revenue", "day_over_day_growth_pct"
    ).orderBy("order_day")


def negative_margin(products: DataFrame) -> DataFrame:
    """Which products sell below cost?"""
    return products.filter("unit_margin < 0").select(
        "product_sku", "product_name", "avg_selling_price", "avg_unit_cost", "unit_margin"
    ).orderBy("unit_margin", "product_sku")


def store_ranking(performance: DataFrame) -> DataFrame:
    """How do the stores rank by revenue?"""
    return performance.select(
        "revenue_rank", "store_id", "store_name", "total_revenue"
    ).orderBy("revenue_rank", "store_id")


def reorder_need(stock: DataFrame) -> DataFrame:
    """Which stores must reorder, and how many items?"""
    due = stock.filter(F.col("stock_alert").isin("REORDER_NOW", "OUT_OF_STOCK"))
    return due.groupBy("store_id", "store_name").agg(
        F.count(F.lit(1)).alias("items_to_reorder"),
        F.count_if(F.col("stock_alert") == "OUT_OF_STOCK").alias("items_out_of_stock"),
    ).orderBy(F.col("items_to_reorder").desc(), "store_id")


def total_revenue(performance: DataFrame) -> DataFrame:
    """What is the revenue of all stores?"""
    return performance.agg(
        F.round(F.sum("total_revenue"), 2).alias("total_revenue"),
        F.sum("total_orders").alias("total_orders"),
    )


def top_products(products: DataFrame, n: int = 3) -> DataFrame:
    """Which products sell the most units?"""
    return products.select("product_sku", "product_name", "total_units_sold").orderBy(
        F.col("total_units_sold").desc(), "product_sku"
    ).limit(n)


def targets_by_revenue(store_targets: DataFrame) -> DataFrame:
    """Stores against target, highest revenue first, those without sales last; with ``position``."""
    order = F.col("actual_revenue").desc_nulls_last(), F.col("store_id")
    return numbered(store_targets, "position", *order)


def stock_by_alert(inventory_status: DataFrame) -> DataFrame:
    """Stock rows, the most urgent first: what is out, what is to be reordered, the rest, each by
    quantity; with ``position``."""
    urgency = F.when(F.col("quantity_on_hand") == 0, 1).when(
        F.col("quantity_on_hand") <= F.col("reorder_point"), 2).otherwise(3)
    order = urgency.asc(), F.col("quantity_on_hand"), F.col("inventory_id"), F.col("store_id")
    return numbered(inventory_status, "position", *order)
