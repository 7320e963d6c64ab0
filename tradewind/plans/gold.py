"""Gold models.

Each takes Silver orders (one row per order id), inventory and stores and
returns a DataFrame. Orders are aggregated before they meet another table:
the joins then run over one row per store and customer, or per SKU, and a
store or SKU that holds a large share of all orders is a row like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind import rules
from tradewind.functions.columns import (
    as_of_timestamp, day_of, days_between, percent, ratio, tier,
)
from tradewind.operators.ranking import global_rank


def _stamp(df: DataFrame, as_of) -> DataFrame:
    return df.withColumn("_gold_loaded_at", as_of_timestamp(as_of))


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


# Shared grains -----------------------------------------------------------------

def store_customer_sales(orders: DataFrame) -> DataFrame:
    """One row per store and customer: the grain behind all five store models."""
    return orders.groupBy("store_id", "customer_id").agg(
        F.count("order_id").alias("orders"),
        F.sum("total_amount").alias("revenue"),
        F.count("total_amount").alias("priced_orders"),
        F.sum("quantity").alias("units"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )


def _per_store(sales: DataFrame) -> DataFrame:
    return sales.groupBy("store_id").agg(
        F.sum("orders").alias("orders"),
        F.sum("revenue").alias("revenue"),
        F.sum("priced_orders").alias("priced_orders"),
        F.count("customer_id").alias("customers"),
        F.sum("units").alias("units"),
        F.min("first_order_date").alias("first_order_date"),
        F.max("last_order_date").alias("last_order_date"),
    )


def _store_dims(stores: DataFrame, *columns: str) -> DataFrame:
    """Distinct store attributes with the number of store rows that carry them.

    Stores are kept once per load, and joining each load multiplies sums. The
    count reproduces that without multiplying the rows.
    """
    return stores.groupBy("store_id", *columns).agg(F.count(F.lit(1)).alias("copies"))


def sku_sales(orders: DataFrame) -> DataFrame:
    return orders.groupBy("product_sku").agg(
        F.count("order_id").alias("orders"),
        F.sum("quantity").alias("units"),
        F.sum("total_amount").alias("revenue"),
        F.avg("unit_price").alias("avg_price"),
        F.sum(F.col("quantity") * F.col("unit_price")).alias("list_value"),
    )


def sku_stock(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("product_sku").agg(
        F.max("product_name").alias("product_name"),
        F.sum("quantity_on_hand").alias("on_hand"),
        F.avg("unit_cost").alias("avg_cost"),
        F.sum("unit_cost").alias("cost_sum"),
        F.min("reorder_point").alias("reorder_point"),
        F.count(F.lit(1)).alias("stock_rows"),
    )


# Store models --------------------------------------------------------------------

def store_performance(sales: DataFrame, stores: DataFrame, as_of=None) -> DataFrame:
    dims = _store_dims(
        stores, "store_name", "city", "state", "store_type", "monthly_target"
    )
    copies = F.col("copies")
    measured = _per_store(sales).join(dims, "store_id").select(
        "store_id", "store_name", "city", "state", "store_type", "monthly_target",
        (F.col("orders") * copies).alias("total_orders"),
        (F.col("revenue") * copies).alias("revenue"),
        ratio(F.col("revenue"), F.col("priced_orders")).alias("avg_order_value"),
        F.col("customers").alias("unique_customers"),
        (F.col("units") * copies).alias("total_units_sold"),
        "first_order_date", "last_order_date",
    )
    ranked = global_rank(measured, "revenue", "revenue_rank")
    return _stamp(
        ranked.select(
            "store_id", "store_name", "city", "state", "store_type", "monthly_target",
            "total_orders",
            F.round("revenue", 2).alias("total_revenue"),
            F.round("avg_order_value", 2).alias("avg_order_value"),
            "unique_customers", "total_units_sold", "first_order_date", "last_order_date",
            percent(F.col("revenue"), F.col("monthly_target"), 1).alias("target_pct"),
            "revenue_rank",
        ),
        as_of,
    )


def _by_channel(sales: DataFrame, stores: DataFrame, *columns: str) -> DataFrame:
    """Sales per combination of store attributes, distinct customers included."""
    joined = sales.join(_store_dims(stores, *columns), "store_id")
    copies = F.col("copies")
    return joined.groupBy(*columns).agg(
        F.sum("orders").alias("total_orders"),
        F.sum(F.col("revenue") * copies).alias("total_revenue"),
        F.sum(F.col("priced_orders") * copies).alias("_priced"),
        F.sum(F.col("units") * copies).alias("total_units_sold"),
        F.count_distinct("customer_id").alias("customers"),
    ).withColumn("avg_order_value", ratio(F.col("total_revenue"), F.col("_priced")))


def revenue_by_channel(sales: DataFrame, stores: DataFrame, as_of=None) -> DataFrame:
    channels = _by_channel(sales, stores, "store_type")
    total = F.sum("total_revenue").over(Window.partitionBy(F.lit(0)))  # a row per store type
    return _stamp(
        channels.select(
            F.col("store_type").alias("channel"), "total_orders", "total_revenue",
            "avg_order_value", F.col("customers").alias("unique_customers"),
            "total_units_sold",
            percent(F.col("total_revenue"), total, 2).alias("revenue_share_pct"),
        ),
        as_of,
    )


def tariff_impact(
    sales: DataFrame, stores: DataFrame, as_of=None, rates: dict[str, float] = rules.TARIFF_RATES
) -> DataFrame:
    copies = F.col("copies")
    totals = (
        _per_store(sales)
        .join(_store_dims(stores, "country", "store_type"), "store_id")
        .groupBy("country", "store_type")
        .agg(
            F.sum("orders").alias("total_orders"),
            F.sum(F.col("revenue") * copies).alias("total_revenue"),
            F.sum(F.col("priced_orders") * copies).alias("_priced"),
        )
    )
    risk = F.lit(rules.TARIFF_RISK_DEFAULT)
    for country, level in rules.TARIFF_RISK.items():
        risk = F.when(F.col("country") == country, level).otherwise(risk)
    return _stamp(
        totals.select(
            "country", "store_type", "total_orders", "total_revenue",
            ratio(F.col("total_revenue"), F.col("_priced")).alias("avg_order_value"),
            *(F.round(F.col("total_revenue") * rate, 2).alias(n) for n, rate in rates.items()),
            risk.alias("tariff_risk_level"),
        ),
        as_of,
    )


def store_targets(sales: DataFrame, stores: DataFrame, as_of=None) -> DataFrame:
    """All stores against target. A store without sales has null sums and, since
    nulls sort as the largest, shares rank one."""
    dims = _store_dims(
        stores, "store_name", "city", "state", "country", "store_type", "monthly_target"
    )
    revenue, target = F.col("actual_revenue"), F.col("monthly_target")
    measured = dims.join(_per_store(sales), "store_id", "left").select(
        "store_id", "store_name", "city", "state", "country", "store_type", "monthly_target",
        _zero("orders").alias("total_orders"),
        (F.col("revenue") * F.col("copies")).alias("actual_revenue"),
        _zero("customers").alias("unique_customers"),
        ratio(F.col("revenue"), F.col("priced_orders")).alias("avg_order_value"),
    )
    ranked = global_rank(measured, "actual_revenue", "revenue_rank")
    return _stamp(
        ranked.select(
            "store_id", "store_name", "city", "state", "country", "store_type",
            "monthly_target", "total_orders", "actual_revenue",
            F.round(target - revenue, 2).alias("target_gap"),
            percent(revenue, target, 2).alias("target_achievement_pct"),
            "unique_customers", "avg_order_value", "revenue_rank",
            F.when(revenue >= target, "ON_TRACK")
            .when(revenue >= target * rules.AT_RISK_TARGET_SHARE, "AT_RISK")
            .otherwise("BELOW_TARGET")
            .alias("performance_status"),
        ),
        as_of,
    )


def channel_roi(sales: DataFrame, stores: DataFrame, as_of=None) -> DataFrame:
    groups = _by_channel(sales, stores, "store_type", "state", "country")
    return _stamp(
        groups.select(
            F.col("store_type").alias("channel"), F.col("state").alias("region"), "country",
            F.col("customers").alias("total_customers"), "total_orders", "total_revenue",
            "avg_order_value",
            F.round(ratio(F.col("total_orders"), F.col("customers")), 2).alias(
                "orders_per_customer"
            ),
            F.round(ratio(F.col("total_revenue"), F.col("customers")), 2).alias(
                "revenue_per_customer"
            ),
            tier(
                F.col("avg_order_value"), rules.CHANNEL_TIERS, rules.CHANNEL_TIER_DEFAULT
            ).alias("channel_tier"),
        ),
        as_of,
    )


# Product models ------------------------------------------------------------------

def product_analysis(orders: DataFrame, inventory: DataFrame, as_of=None) -> DataFrame:
    return product_analysis_of(sku_sales(orders), inventory, as_of)


def product_analysis_of(sold: DataFrame, inventory: DataFrame, as_of=None) -> DataFrame:
    """``sold`` as from ``sku_sales``."""
    both = sold.join(sku_stock(inventory), "product_sku", "full_outer")
    measured = both.select(
        "product_sku", "product_name",
        _zero("orders").alias("total_orders"),
        _zero("units").alias("total_units_sold"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        "avg_price",
        _zero("on_hand").alias("current_stock"),
        F.coalesce("avg_cost", F.lit(0.0)).alias("cost"),
        _zero("reorder_point").alias("reorder_point"),
    )
    price, cost = F.coalesce("avg_price", F.lit(0.0)), F.col("cost")
    return _stamp(
        global_rank(measured, "revenue", "revenue_rank").select(
            "product_sku", "product_name", "total_orders", "total_units_sold",
            F.round("revenue", 2).alias("total_revenue"),
            F.round(price, 2).alias("avg_selling_price"),
            "current_stock",
            F.round(cost, 2).alias("avg_unit_cost"),
            "reorder_point",
            F.round(price - cost, 2).alias("unit_margin"),
            percent(price - cost, F.col("avg_price"), 1).alias("margin_pct"),
            F.when(F.col("current_stock") == 0, "OUT_OF_STOCK")
            .when(F.col("current_stock") <= F.col("reorder_point"), "LOW_STOCK")
            .otherwise("IN_STOCK")
            .alias("stock_status"),
            "revenue_rank",
        ),
        as_of,
    )


def inventory_status(inventory: DataFrame, stores: DataFrame, as_of=None) -> DataFrame:
    """One row per stock row and store row. Severity follows the alert.

    Both sides are sorted by store. Spark would judge the stock rows by the size of the files they
    come from and might gather all of them in the driver to broadcast them.
    """
    on_hand, reorder = F.col("quantity_on_hand"), F.col("reorder_point")
    alert = (
        F.when(on_hand == 0, F.array(F.lit("OUT_OF_STOCK"), F.lit("CRITICAL")))
        .when(on_hand <= reorder, F.array(F.lit("REORDER_NOW"), F.lit("HIGH")))
        .when(
            on_hand <= reorder * rules.LOW_STOCK_FACTOR,
            F.array(F.lit("LOW_STOCK"), F.lit("MEDIUM")),
        )
        .otherwise(F.array(F.lit("HEALTHY"), F.lit("LOW")))
    )
    named = inventory.hint("merge").join(stores.select("store_id", "store_name", "city"), "store_id")
    return _stamp(
        named.select(
            "inventory_id", "store_id", "store_name", "city", "product_sku", "product_name",
            "quantity_on_hand", "reorder_point", "unit_cost",
            F.round(on_hand * F.col("unit_cost"), 2).alias("stock_value"),
            alert[0].alias("stock_alert"), alert[1].alias("alert_severity"),
        ),
        as_of,
    )


def product_margins(
    orders: DataFrame, inventory: DataFrame, as_of=None, fanout: bool = True
) -> DataFrame:
    """Margins per sold SKU.

    Joining each order with each stock row of its SKU counts the order once per
    stock row. Sums over that join equal the plain sums times the number of
    stock rows, so both sides are aggregated first and no row is multiplied.
    ``fanout=False`` counts every order once.
    """
    return product_margins_of(sku_sales(orders), inventory, as_of, fanout)


def product_margins_of(
    sold: DataFrame, inventory: DataFrame, as_of=None, fanout: bool = True
) -> DataFrame:
    """``sold`` as from ``sku_sales``."""
    both = sold.join(sku_stock(inventory), "product_sku", "left")
    rows = F.coalesce("stock_rows", F.lit(1)) if fanout else F.lit(1)
    cost = F.coalesce("cost_sum" if fanout else "avg_cost", F.lit(0.0))
    measured = both.select(
        "product_sku", "product_name", F.col("orders").alias("total_orders"),
        (F.col("units") * rows).alias("total_units_sold"),
        F.col("avg_price").alias("avg_selling_price"),
        F.col("avg_cost").alias("avg_unit_cost"),
        (F.col("revenue") * rows).alias("total_revenue"),
        (F.col("list_value") * rows - F.col("units") * cost).alias("total_gross_profit"),
    )
    price, revenue = F.col("avg_selling_price"), F.col("total_revenue")
    margin = price - F.col("avg_unit_cost")
    return _stamp(
        global_rank(measured, "total_revenue", "revenue_rank").select(
            "product_sku", "product_name", "total_orders", "total_units_sold",
            "avg_selling_price", "avg_unit_cost", "total_revenue",
            F.round(margin, 2).alias("gross_margin_per_unit"),
            percent(margin, price, 2).alias("gross_margin_pct"),
            "total_gross_profit",
            tier(revenue, rules.PRODUCT_TIERS, rules.PRODUCT_TIER_DEFAULT).alias("product_tier"),
            "revenue_rank",
        ),
        as_of,
    )


# Time and customer models ----------------------------------------------------------

def daily_sales(orders: DataFrame) -> DataFrame:
    """One row per day with orders."""
    return orders.groupBy(day_of(F.col("order_date")).alias("order_day")).agg(
        F.count("order_id").alias("total_orders"),
        F.sum("total_amount").alias("revenue"),
        F.avg("total_amount").alias("avg_order_value"),
        F.count_distinct("store_id").alias("active_stores"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.sum("quantity").alias("total_units"),
    )


def daily_revenue(orders: DataFrame, as_of=None) -> DataFrame:
    """One row per day with orders; "previous" is the previous such day."""
    return daily_revenue_of(daily_sales(orders), as_of)


def daily_revenue_of(daily: DataFrame, as_of=None) -> DataFrame:
    """``daily`` as from ``daily_sales``."""
    # One task orders the days. The calendar bounds them: a century is 36,525 rows.
    by_day = Window.orderBy("order_day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    series = daily.withColumns(
        {
            "cumulative": F.sum("revenue").over(so_far),
            "previous": F.lag("revenue", 1).over(by_day),
        }
    )
    return _stamp(
        series.select(
            "order_day", "total_orders",
            F.round("revenue", 2).alias("daily_revenue"),
            F.round("avg_order_value", 2).alias("avg_order_value"),
            "active_stores", "unique_customers", "total_units",
            F.round("cumulative", 2).alias("cumulative_revenue"),
            F.round("previous", 2).alias("prev_day_revenue"),
            percent(F.col("revenue") - F.col("previous"), F.col("previous"), 1).alias(
                "day_over_day_growth_pct"
            ),
        ),
        as_of,
    )


def customer_sales(orders: DataFrame) -> DataFrame:
    """One row per customer."""
    return orders.groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("total_amount").alias("lifetime_value"),
        F.avg("total_amount").alias("avg_order_value"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.count_distinct("product_sku").alias("unique_products_bought"),
        F.count_distinct("store_id").alias("stores_visited"),
        F.sum("quantity").alias("total_units_purchased"),
    )


def customer_360(orders: DataFrame, as_of=None) -> DataFrame:
    return customer_360_of(customer_sales(orders), as_of)


def customer_360_of(per_customer: DataFrame, as_of=None) -> DataFrame:
    """``per_customer`` as from ``customer_sales``."""
    idle_days = days_between(F.col("last_order_date"), as_of_timestamp(as_of))
    return _stamp(
        global_rank(per_customer, "lifetime_value", "value_rank").select(
            "customer_id", "total_orders", "lifetime_value", "avg_order_value",
            "first_order_date", "last_order_date",
            days_between(F.col("first_order_date"), F.col("last_order_date")).alias(
                "customer_age_days"
            ),
            "unique_products_bought", "stores_visited", "total_units_purchased",
            tier(
                F.col("lifetime_value"), rules.CUSTOMER_SEGMENTS, rules.CUSTOMER_SEGMENT_DEFAULT
            ).alias("customer_segment"),
            F.when(idle_days <= rules.ACTIVE_WITHIN_DAYS, "ACTIVE")
            .when(idle_days <= rules.AT_RISK_WITHIN_DAYS, "AT_RISK")
            .otherwise("CHURNED")
            .alias("activity_status"),
            "value_rank",
        ),
        as_of,
    )
