"""Gold models on random data where one store, customer, SKU and day hold a third of
all orders and stores were loaded several times, against the plain SQL definitions."""

import random

import duckdb
import pandas as pd
import pytest

from registry import oracle
from registry.queries import AS_OF, plain, rounded
from tradewind.plans import gold

ROWS = 6000


def hot(i, values, random_):
    return values[0] if i % 3 == 0 else random_.choice(values)


@pytest.fixture(scope="module")
def shop(spark):
    r = random.Random(11)
    skus = [f"ELF-{i:05d}" for i in range(60)]
    orders = [
        (i, hot(i, range(40), r), hot(i, range(500), r), hot(i, range(300), r),
         hot(i, skus, r), r.randint(1, 9), r.uniform(1, 90), r.uniform(1, 900))
        for i in range(ROWS)
    ]
    stores = [
        (k % 45, f"Store {k % 45}", f"City {k % 7}", f"S{k % 5}",
         (None, "USA", "CHINA", "PERU")[k % 4], ("Flagship", "Standard", "Outlet")[k // 45 % 3],
         float(k % 6 * 2000), 1)
        for k in range(110)
    ]
    stock = [
        (i, r.randrange(45), r.choice([*skus[:50], "ELF-99999"]), r.choice(["a", "b", None]),
         r.randint(0, 300), r.randint(0, 150), r.choice([None, 1.25, 7.5, 30.0]))
        for i in range(400)
    ]
    tables = {
        "silver_orders": spark.createDataFrame(
            orders, "order_id bigint, store_id bigint, customer_id bigint, day int, "
            "product_sku string, quantity bigint, unit_price double, total_amount double"
        ).selectExpr("*", "timestamp_ntz'2000-10-01 10:00:00' + make_dt_interval(day) as order_date"),
        "silver_stores": spark.createDataFrame(
            stores, "store_id bigint, store_name string, city string, state string, "
            "country string, store_type string, monthly_target double, is_active bigint"),
        "silver_inventory": spark.createDataFrame(
            stock, "inventory_id bigint, store_id bigint, product_sku string, "
            "product_name string, quantity_on_hand bigint, reorder_point bigint, "
            "unit_cost double"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"_{name}", df.toPandas())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
    for name in ("sold", "per_day"):
        con.execute(f"CREATE VIEW {name} AS {oracle.INPUTS[name]}")
    return {n: df.repartition(6).cache() for n, df in tables.items()}, con


def money(df, *sums, mean="avg_order_value", digits=2):
    """Sums to the given digits and the mean to two, as the SQL gives them."""
    return rounded(rounded(plain(df), *sums, digits=digits), mean)


MODELS = {
    "store_performance": lambda o, i, s, v: plain(gold.store_performance(v, s, AS_OF)),
    "product_analysis": lambda o, i, s, v: plain(gold.product_analysis(o, i, AS_OF)),
    "daily_revenue": lambda o, i, s, v: plain(gold.daily_revenue(o, AS_OF)),
    "inventory_status": lambda o, i, s, v: plain(gold.inventory_status(i, s, AS_OF)),
    "revenue_by_channel": lambda o, i, s, v: money(
        gold.revenue_by_channel(v, s, AS_OF), "total_revenue"),
    "tariff_impact": lambda o, i, s, v: money(
        gold.tariff_impact(v, s, AS_OF), "total_revenue"),
    "store_targets": lambda o, i, s, v: money(
        gold.store_targets(v, s, AS_OF), "actual_revenue", digits=6),
    "channel_roi": lambda o, i, s, v: money(
        gold.channel_roi(v, s, AS_OF), "total_revenue"),
    "product_margins": lambda o, i, s, v: money(
        gold.product_margins(o, i, AS_OF), "avg_selling_price", "total_revenue",
        mean="gross_margin_pct", digits=6).drop("avg_unit_cost", "total_gross_profit"),
    "product_profit": lambda o, i, s, v: rounded(
        gold.product_margins(o, i, AS_OF).select("product_sku", "total_gross_profit"),
        "total_gross_profit", digits=4),
    "customer_360": lambda o, i, s, v: money(
        gold.customer_360(o, AS_OF), "lifetime_value", digits=6),
}


@pytest.mark.parametrize("name", MODELS)
def test_model_equals_plain_sql(shop, name):
    tables, con = shop
    orders, stores, stock = (
        tables[f"silver_{n}"] for n in ("orders", "stores", "inventory")
    )
    got = MODELS[name](orders, stock, stores, gold.store_customer_sales(orders)).toPandas()
    sql = oracle.INPUTS["product_margins" if name == "product_profit" else name]
    want = con.execute(sql).fetch_df()
    want = want[[c for c in want.columns if c in got.columns]]
    assert sorted(got.columns) == sorted(want.columns)
    exact = sorted(c for c in want.columns if want[c].dtype.kind != "f")
    left, right = (
        f[sorted(f.columns)].sort_values(exact, ignore_index=True) for f in (got, want)
    )
    pd.testing.assert_frame_equal(left, right, check_dtype=False, rtol=1e-9, atol=1e-6)
