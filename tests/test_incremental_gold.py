"""Gold load by load against one rebuild, sketches against exact counts."""

import datetime as dt
import os
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators import sketches
from tradewind.plans import gold, incremental_gold, pipeline, silver
from tradewind.rules import TableNames
from tradewind.session import staging_path

AS_OF = "2026-06-01 00:00:00"
ORDER = (
    "order_id long, store_id long, customer_id long, order_date timestamp_ntz, product_sku string, "
    "quantity long, unit_price double, total_amount double, order_status string, _source string, "
    "_loaded_at timestamp_ntz, _run_id string"
)


def orders(spark, rows, load):
    """(order, store, customer, day of 2026, product, quantity); a price follows from the product."""
    loaded = dt.datetime(2026, 1, 1) + dt.timedelta(days=load)
    made = []
    for order, store, customer, day, product, quantity in rows:
        price = 1.5 + (product or 0)
        made.append((
            order, store, customer, dt.datetime(2026, 1, 1, 9) + dt.timedelta(days=day),
            f"ELF-{product:05d}" if product is not None else "bad", quantity, price,
            price * (quantity or 0), "done", "S", loaded, f"run{load}",
        ))
    return spark.createDataFrame(made, ORDER)


def loads(spark):
    first = [(i, i % 3, i % 5, i % 7, i % 4, 1 + i % 3) for i in range(40)]
    second = [(i, i % 3, i % 5, i % 7, i % 4, 2) for i in range(40, 55)]
    second += [(3, 0, 99, 2, 1, 5), (4, 1, 4, 4, 0, 2), (5, 2, 0, 5, None, 1)]  # moved, same, now invalid
    second += [(60, 1, 1, 100, 2, 1), (61, 1, 1, 200, 2, 1)]  # one due later, one not yet
    third = [(5, 2, 0, 5, 1, 1), (7, None, 2, 0, 3, 1), (0, 0, 0, 0, 0, 1), (0, 0, 0, 0, 0, 1)]
    third += [(61, 1, 1, 200, 2, 3), (None, 1, 1, 1, 1, 1)]
    return [orders(spark, rows, n) for n, rows in enumerate((first, second, third))]


def tables(sales, sold, daily, customers, stock, shops, as_of):
    return {
        "store_performance": gold.store_performance(sales, shops, as_of),
        "store_targets": gold.store_targets(sales, shops, as_of),
        "revenue_by_channel": gold.revenue_by_channel(sales, shops, as_of),
        "tariff_impact": gold.tariff_impact(sales, shops, as_of),
        "channel_roi": gold.channel_roi(sales, shops, as_of),
        "product_analysis": gold.product_analysis_of(sold, stock, as_of),
        "product_margins": gold.product_margins_of(sold, stock, as_of),
        "daily_revenue": gold.daily_revenue_of(daily, as_of),
        "customer_360": gold.customer_360_of(customers, as_of),
    }


def rows(df):
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return sorted(map(str, df.select(*rounded).select(*sorted(df.columns)).collect()))


@pytest.fixture
def dims(spark):
    stock = spark.sql(
        "SELECT id AS inventory_id, 0L AS store_id, concat('ELF-0000', id % 5) AS product_sku, 'p' AS "
        "product_name, id AS quantity_on_hand, 3 AS reorder_point, 1.0D AS unit_cost FROM range(9)")
    shops = spark.sql(
        "SELECT id AS store_id, concat('S', id) AS store_name, 'c' AS city, 's' AS state, 'USA' AS country, "
        "if(id = 0, 'Outlet', 'Flagship') AS store_type, 50.0D AS monthly_target FROM range(4)")
    return stock, shops


def check(spark, state, batches, dims, as_of):
    valid = silver.silver_orders(
        reduce(DataFrame.unionByName, batches), as_of)
    want = tables(
        gold.store_customer_sales(valid), gold.sku_sales(valid), gold.daily_sales(valid),
        gold.customer_sales(valid), *dims, as_of)
    got = tables(state.sales(), state.sold(), state.daily(), state.customers(), *dims, as_of)
    for name in want:
        assert rows(got[name]) == rows(want[name]), name


def test_three_loads_equal_one_rebuild(spark, dims):
    batches = loads(spark)
    state = incremental_gold.State(spark, staging_path(spark, "gold"))
    assert state.commits() == [] and state.rows("visits") is None
    with pytest.raises(ValueError, match="no load"):
        state.sums("visits")
    for n, as_of in enumerate(("2026-02-01 00:00:00", "2026-04-01 00:00:00", AS_OF)):
        assert state.add(batches[n], f"load-{n}", as_of)
        check(spark, state, batches[: n + 1], dims, as_of)
    assert not state.add(batches[2], "load-2", AS_OF)  # taken once
    with pytest.raises(ValueError, match="before"):
        state.add(batches[0], "load-9", "2026-01-15 00:00:00")
    # what an attempt without commit left does not count, and is overwritten
    with pytest.raises(Exception, match="stop here"):
        state.add(batches[0].withColumn("quantity", F.raise_error(F.lit("stop here")).cast("long")), "x", AS_OF)
    check(spark, state, batches, dims, AS_OF)
    state.compact()
    check(spark, state, batches, dims, AS_OF)
    # due by its date alone: no new order, the day has come
    assert state.add(batches[0].limit(0), "empty", "2026-12-01 00:00:00")
    check(spark, state, batches, dims, "2026-12-01 00:00:00")
    state.vacuum()
    check(spark, state, batches, dims, "2026-12-01 00:00:00")
    folders = os.listdir(f"{state.root.removeprefix('file:')}/visits")
    assert sorted(f for f in folders if f.startswith("_load")) == ["_load=4", "_load=5"]
    state.compact()
    state.compact()  # nothing to bring together any more
    assert len(state.commits()) == 6


def test_a_load_writes_what_it_brings_only(spark):
    state = incremental_gold.State(spark, staging_path(spark, "gold"))
    first, second, _ = loads(spark)
    state.add(first, "a", AS_OF)
    folder = state.root.removeprefix("file:")

    def files():
        return {
            os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for layer in ("newest", *incremental_gold.GRAINS) for d, _, fs in os.walk(f"{folder}/{layer}") for f in fs
        }

    before = files()
    state.add(second.filter("order_id = 4"), "b", AS_OF)
    assert before.items() <= files().items()
    # the same order again: taken out and put in, so nothing is left to add
    assert spark.read.parquet(f"{folder}/visits/_load=2").count() == 0


def test_models_are_written(spark, dims, empty_catalog):
    state = incremental_gold.State(spark, staging_path(spark, "gold"))
    for n, batch in enumerate(loads(spark)):
        state.add(batch, str(n), AS_OF)
    planned = incremental_gold.models(state, lambda: dims[0], lambda: dims[1], AS_OF)
    report = pipeline.run_models(spark, planned)
    assert report["status"] == "success" and report["models_succeeded"] == 10
    valid = silver.silver_orders(
        reduce(DataFrame.unionByName, loads(spark)), AS_OF)
    assert rows(spark.table(TableNames().brand_gold("customer_360")).drop("_gold_loaded_at")) == rows(
        gold.customer_360(valid, AS_OF).drop("_gold_loaded_at"))


def test_sketches_merge_over_any_range(spark, empty_catalog):
    valid = spark.range(60_000).select(
        (F.col("id") % 3).alias("store_id"), F.expr("id * 7919 % 5000").alias("customer_id"),
        F.concat(F.lit("p"), F.expr("id % 40")).alias("product_sku"),
        F.expr("timestamp_ntz'2026-01-01 10:00:00' + make_dt_interval(cast(id % 90 AS int))").alias("order_date"),
    )
    half = F.col("order_date") < "2026-02-10"
    for part in (half, ~half, half):  # a load that comes twice counts once
        sketches.append(sketches.daily_sketches(valid.filter(part)), "SKETCHES")
    assert [r[0] for r in spark.sql("SHOW PARTITIONS SKETCHES").collect()] == [
        "month=2026-01", "month=2026-02", "month=2026-03"]
    for first, last, by in (("2026-01-20", "2026-02-20", ("store_id",)), ("2025-01-01", "2027-01-01", ())):
        inside = valid.filter((F.col("order_date") >= first) & (F.to_date("order_date") <= last))
        exact = {tuple(r)[: len(by)]: tuple(r)[len(by):] for r in inside.groupBy(*by).agg(
            F.count_distinct("customer_id"), F.count_distinct("product_sku")).collect()}
        got = sketches.distinct_between(spark, "SKETCHES", first, last, by)
        for r in got.collect():
            for estimate, count in zip((r.customer_id, r.product_sku), exact[tuple(r)[: len(by)]]):
                assert abs(estimate - count) <= 4 * sketches.relative_error() * count
        assert got.count() == len(exact)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
