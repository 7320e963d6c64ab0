"""Silver and Gold models on the seed rows, against results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from seed import AS_OF, bronze_tables
from tradewind.plans import gold, questions, silver


class Shop:
    def __init__(self, spark, syncs=1, dedup_stores=False):
        bronze = bronze_tables(spark, syncs)
        self.orders = silver.silver_orders(bronze["orders"], AS_OF).cache()
        self.inventory = silver.silver_inventory(bronze["inventory"], AS_OF).cache()
        self.stores = silver.silver_stores(bronze["stores"], AS_OF, dedup_stores).cache()
        self.sales = gold.store_customer_sales(self.orders).cache()


@pytest.fixture(scope="module")
def shop(spark):
    return Shop(spark)


def rows(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def test_store_performance(shop):
    got = rows(
        gold.store_performance(shop.sales, shop.stores, AS_OF), "store_id", "total_orders",
        "total_revenue", "avg_order_value", "unique_customers", "total_units_sold",
        "target_pct", "revenue_rank",
    )
    assert got == {
        2: (3, 94.0, 31.33, 3, 7, 0.1, 1), 1: (3, 44.0, 14.67, 3, 4, 0.0, 2),
        3: (2, 42.0, 21.0, 2, 5, 0.0, 3), 5: (1, 24.0, 24.0, 1, 3, 0.0, 4),
        4: (1, 20.0, 20.0, 1, 2, 0.0, 5),
    }


def test_product_analysis(shop):
    got = rows(
        gold.product_analysis(shop.orders, shop.inventory, AS_OF), "product_sku",
        "total_orders", "total_units_sold", "total_revenue", "current_stock", "unit_margin",
        "margin_pct", "revenue_rank", "stock_status",
    )
    assert got["ELF-83428"] == (2, 3, 30.0, 458, 4.5, 45.0, 4, "IN_STOCK")
    assert got["ELF-84024"] == (1, 2, 30.0, 255, 7.5, 50.0, 4, "IN_STOCK")
    assert got["ELF-83025"] == (1, 3, 24.0, 280, 4.0, 50.0, 6, "IN_STOCK")
    assert got["ELF-81788"] == (1, 1, 10.0, 550, 5.0, 50.0, 8, "IN_STOCK")
    assert len(got) == 8


def test_product_analysis_stock_states_and_unmatched_sides(spark, shop):
    stock = shop.inventory.withColumn(
        "quantity_on_hand",
        F.expr("case inventory_id when 3 then 90 when 5 then 0 else quantity_on_hand end"),
    ).filter("product_sku <> 'ELF-84201'")
    sold = shop.orders.filter("product_sku <> 'ELF-83025'")
    got = rows(
        gold.product_analysis(sold, stock, AS_OF), "product_sku", "stock_status",
        "margin_pct", "total_orders", "unit_margin", "revenue_rank",
    )
    assert got["ELF-82416"][0] == "LOW_STOCK"
    assert got["ELF-81788"][0] == "OUT_OF_STOCK"
    assert got["ELF-84201"] == ("OUT_OF_STOCK", 100.0, 1, 10.0, 6)
    assert got["ELF-83025"] == ("IN_STOCK", None, 0, -4.0, 8)
    low = questions.low_stock(gold.product_analysis(sold, stock, AS_OF)).collect()
    assert [r.product_sku for r in low] == ["ELF-81788", "ELF-84201", "ELF-82416"]


def test_daily_revenue(shop):
    got = [
        tuple(r)[1:-1]
        for r in gold.daily_revenue(shop.orders, AS_OF).orderBy("order_day").collect()
    ]
    assert got == [
        (5, 110.0, 22.0, 3, 5, 9, 110.0, None, None),
        (5, 114.0, 22.8, 5, 5, 12, 224.0, 110.0, 3.6),
    ]


def test_inventory_status(spark, shop):
    got = rows(
        gold.inventory_status(shop.inventory, shop.stores, AS_OF), "inventory_id",
        "stock_alert", "alert_severity", "stock_value",
    )
    assert got[10] == ("REORDER_NOW", "HIGH", 44.0)
    assert got[9] == ("REORDER_NOW", "HIGH", 112.5)
    assert {got[i][:2] for i in range(1, 9)} == {("HEALTHY", "LOW")}
    edges = shop.inventory.withColumn(
        "quantity_on_hand", F.expr("case inventory_id when 1 then 0 when 2 then 120 "
                                   "when 3 then 136 when 4 then 60 else 999 end")
    )
    got = rows(gold.inventory_status(edges, shop.stores, AS_OF), "inventory_id",
               "stock_alert", "alert_severity")
    assert got[1] == ("OUT_OF_STOCK", "CRITICAL")
    assert got[2] == ("LOW_STOCK", "MEDIUM")
    assert got[3] == ("HEALTHY", "LOW")
    assert got[4] == ("REORDER_NOW", "HIGH")


def test_revenue_by_channel(shop):
    got = rows(gold.revenue_by_channel(shop.sales, shop.stores, AS_OF), "channel",
               "total_orders", "total_revenue", "revenue_share_pct", "unique_customers")
    assert got == {"Standard": (6, 156.0, 69.64, 6), "Flagship": (3, 44.0, 19.64, 3),
                   "Premium": (1, 24.0, 10.71, 1)}


def test_tariff_impact(spark, shop):
    got = rows(gold.tariff_impact(shop.sales, shop.stores, AS_OF), "store_type",
               "estimated_tariff_cost", "revenue_after_tariff", "high_tariff_scenario",
               "revenue_after_high_tariff", "tariff_risk_level")
    assert got == {
        "Standard": (23.4, 132.6, 93.6, 62.4, "HIGH_RISK"),
        "Flagship": (6.6, 37.4, 26.4, 17.6, "HIGH_RISK"),
        "Premium": (3.6, 20.4, 14.4, 9.6, "HIGH_RISK"),
    }
    moved = shop.stores.withColumn(
        "country", F.expr("case store_id when 1 then 'CHINA' when 5 then null else 'PERU' end")
    )
    got = rows(gold.tariff_impact(shop.sales, moved, AS_OF), "country", "tariff_risk_level")
    assert got == {"CHINA": ("CRITICAL_RISK",), None: ("LOW_RISK",), "PERU": ("LOW_RISK",)}


def test_store_targets(spark, shop):
    got = rows(gold.store_targets(shop.sales, shop.stores, AS_OF), "store_id",
               "target_gap", "target_achievement_pct", "performance_status", "revenue_rank")
    assert got == {
        2: (119906.0, 0.08, "BELOW_TARGET", 1), 1: (149956.0, 0.03, "BELOW_TARGET", 2),
        3: (89958.0, 0.05, "BELOW_TARGET", 3), 5: (109976.0, 0.02, "BELOW_TARGET", 4),
        4: (84980.0, 0.02, "BELOW_TARGET", 5),
    }


def test_store_without_sales_ranks_first_and_statuses(spark, shop):
    sales = shop.sales.filter("store_id <> 5")
    stores = shop.stores.withColumn(
        "monthly_target", F.expr("case store_id when 2 then 94.0 when 1 then 55.0 "
                                 "when 3 then 0.0 else 110000.0 end")
    )
    got = rows(gold.store_targets(sales, stores, AS_OF), "store_id", "total_orders",
               "actual_revenue", "target_achievement_pct", "performance_status", "revenue_rank")
    assert got[5] == (0, None, None, "BELOW_TARGET", 1)
    assert got[2] == (3, 94.0, 100.0, "ON_TRACK", 2)
    assert got[1] == (3, 44.0, 80.0, "AT_RISK", 3)
    assert got[3] == (2, 42.0, None, "ON_TRACK", 4)


def test_channel_roi(spark, shop):
    got = rows(gold.channel_roi(shop.sales, shop.stores, AS_OF), "region", "channel",
               "total_customers", "total_orders", "total_revenue", "channel_tier")
    assert got["CA"] == ("Standard", 3, 3, 94.0, "LOW_VALUE_CHANNEL")
    assert got["FL"] == ("Premium", 1, 1, 24.0, "LOW_VALUE_CHANNEL")
    richer = gold.store_customer_sales(
        shop.orders.withColumn("total_amount", F.col("total_amount") * F.expr(
            "case store_id when 5 then 10 when 4 then 2.5 else 1 end"))
    )
    got = rows(gold.channel_roi(richer, shop.stores, AS_OF), "region", "channel_tier",
               "orders_per_customer", "revenue_per_customer")
    assert got["FL"] == ("HIGH_VALUE_CHANNEL", 1.0, 240.0)
    assert got["TX"] == ("MEDIUM_VALUE_CHANNEL", 1.0, 50.0)


def test_product_margins(shop):
    got = rows(gold.product_margins(shop.orders, shop.inventory, AS_OF), "product_sku",
               "total_orders", "total_units_sold", "total_revenue", "gross_margin_pct",
               "total_gross_profit", "revenue_rank", "product_tier")
    assert got["ELF-83428"] == (2, 6, 60.0, 45.0, 27.0, 1, "WEAK_PRODUCT")
    assert got["ELF-84024"] == (1, 4, 60.0, 50.0, 30.0, 1, "WEAK_PRODUCT")
    assert got["ELF-83729"] == (2, 3, 42.0, 50.0, 21.0, 3, "WEAK_PRODUCT")
    assert got["ELF-81788"] == (1, 1, 10.0, 50.0, 5.0, 8, "WEAK_PRODUCT")
    once = rows(gold.product_margins(shop.orders, shop.inventory, AS_OF, fanout=False),
                "product_sku", "total_units_sold", "total_revenue", "total_gross_profit")
    assert once["ELF-83428"] == (3, 30.0, 13.5)


@pytest.mark.parametrize("factor, tier", [
    (1000, "HERO_PRODUCT"), (500, "STRONG_PRODUCT"), (100, "GROWING_PRODUCT"),
    (99, "WEAK_PRODUCT"),
])
def test_product_tiers(shop, factor, tier):
    dearer = shop.orders.withColumn("total_amount", F.col("total_amount") * factor)
    got = rows(gold.product_margins(dearer, shop.inventory, AS_OF), "product_sku", "product_tier")
    assert got["ELF-81788"] == (tier,)


def test_margins_equal_the_row_by_row_join(spark, shop):
    """Aggregating before the join gives what joining every row gives."""
    stock = shop.inventory.withColumn(
        "unit_cost", F.when(F.col("inventory_id") != 9, F.col("unit_cost"))
    ).unionByName(shop.inventory.withColumn("inventory_id", F.col("inventory_id") + 100))
    sold = shop.orders.withColumn(
        "product_sku", F.when(F.col("order_id") == 1008, "ELF-00000").otherwise(F.col("product_sku"))
    )
    naive = sold.join(stock.drop("store_id"), "product_sku", "left").groupBy("product_sku").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("quantity").alias("total_units_sold"),
        F.avg("unit_cost").alias("avg_unit_cost"),
        F.sum("total_amount").alias("total_revenue"),
        F.sum(F.col("quantity") * (F.col("unit_price") - F.coalesce("unit_cost", F.lit(0.0))))
        .alias("total_gross_profit"),
    )
    columns = naive.columns
    got = gold.product_margins(sold, stock, AS_OF).select(*columns)
    def tidy(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                      for r in df.collect())
    assert tidy(got) == tidy(naive)


def test_customer_360(spark, shop):
    got = gold.customer_360(shop.orders, AS_OF).collect()
    assert len(got) == 10
    assert {r.customer_segment for r in got} == {"NEW"}
    assert {r.activity_status for r in got} == {"ACTIVE"}
    assert {r.customer_age_days for r in got} == {0}
    edges = shop.orders.withColumn("customer_id", F.lit(1)).withColumn(
        "total_amount", F.lit(500.0)
    ).withColumn("order_date", F.expr(
        "case when order_id = 1001 then timestamp_ntz'2026-01-01 23:59:00' "
        "else timestamp_ntz'2026-01-30 00:01:00' end"))
    (row,) = gold.customer_360(edges, "2026-04-30 00:00:00").collect()
    assert (row.lifetime_value, row.customer_segment) == (5000.0, "LOYAL")
    assert row.customer_age_days == 29  # midnights crossed, not elapsed days
    assert row.activity_status == "AT_RISK"  # exactly 90 days
    (row,) = gold.customer_360(edges, "2026-05-01 00:00:00").collect()
    assert row.activity_status == "CHURNED"
    assert (row.unique_products_bought, row.stores_visited) == (8, 5)


@pytest.mark.parametrize("value, segment", [
    (10000.0, "VIP"), (9999.99, "LOYAL"), (1000.0, "REGULAR"), (999.99, "NEW"),
])
def test_customer_segments(shop, value, segment):
    one = shop.orders.filter("order_id = 1001").withColumn("total_amount", F.lit(value))
    assert gold.customer_360(one, AS_OF).first().customer_segment == segment


def test_second_sync_multiplies_store_models(spark):
    twice = Shop(spark, syncs=2)
    assert (twice.orders.count(), twice.stores.count()) == (10, 10)
    got = rows(gold.store_performance(twice.sales, twice.stores, AS_OF), "store_id",
               "total_orders", "total_revenue", "unique_customers", "avg_order_value")
    assert got[2] == (6, 188.0, 3, 31.33)
    assert gold.inventory_status(twice.inventory, twice.stores, AS_OF).count() == 20
    channels = rows(gold.revenue_by_channel(twice.sales, twice.stores, AS_OF), "channel",
                    "total_orders", "total_revenue", "revenue_share_pct")
    assert channels["Standard"] == (6, 312.0, 69.64)  # orders are counted once
    clean = Shop(spark, syncs=2, dedup_stores=True)
    got = rows(gold.store_performance(clean.sales, clean.stores, AS_OF), "store_id",
               "total_revenue")
    assert got[2] == (94.0,)


def test_silver_orders_drops_an_order_whose_newest_row_is_invalid(spark):
    old = bronze_tables(spark)["orders"]
    def newer(condition, column, value):
        return old.filter(condition).withColumn(column, value).withColumn(
            "_loaded_at", F.expr("_loaded_at + interval 1 day"))
    bad = (
        newer("order_id = 1001", "quantity", F.lit(0))
        .unionByName(newer("order_id = 1002", "product_sku", F.lit("ELF-83729\n")))
        .unionByName(newer("order_id = 1003", "order_date",
                           F.expr("timestamp_ntz'2026-04-30 00:00:01'")))
        .unionByName(newer("order_id = 1004", "customer_id", F.lit(None).cast("bigint")))
        .unionByName(newer("order_id = 1005", "total_amount", F.lit(11.0)))
        .unionByName(newer("order_id = 1006", "order_id", F.lit(None).cast("bigint")))
        .unionByName(newer("order_id = 1007", "product_sku", F.lit("xELF-84201")))
    )
    got = rows(silver.silver_orders(old.unionByName(bad), AS_OF), "order_id", "total_amount")
    assert set(got) == {1005, 1006, 1008, 1009, 1010}
    assert got[1005] == (11.0,)


def test_silver_inventory_and_stores_rules(spark):
    bronze = bronze_tables(spark)
    stock = bronze["inventory"].withColumns({
        "product_name": F.expr("case inventory_id when 1 then '  ' when 2 then null "
                               "when 3 then '\t' else product_name end"),
        "quantity_on_hand": F.expr("case inventory_id when 4 then -1 when 5 then 0 "
                                   "else quantity_on_hand end"),
        "unit_cost": F.expr("case inventory_id when 6 then 0.0D else unit_cost end"),
    })
    got = rows(silver.silver_inventory(stock, AS_OF), "inventory_id")
    assert set(got) == {3, 5, 7, 8, 9, 10}  # only spaces count as blank, so the tab stays
    stores = bronze["stores"].withColumn(
        "store_name", F.expr("case store_id when 1 then ' ' when 2 then null else store_name end")
    )
    assert set(rows(silver.silver_stores(stores, AS_OF), "store_id")) == {3, 4, 5}
