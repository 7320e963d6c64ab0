"""Stored layouts, hot keys, switched views, and runs that rebuild what has changed."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F
from seed import AS_OF, bronze_tables

from tradewind.functions import columns
from tradewind.functions.columns import bytes_to_digits
from tradewind.operators import history, skew
from tradewind.operators.dedup import latest_per_key
from tradewind.plans import dependency, gold
from tradewind.plans.pipeline import Model, Options
from tradewind.rules import TableNames
from tradewind.sources import warehouse

NAMES = TableNames()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_need_no_shuffle(spark, empty_catalog):
    rows = spark.range(2000).select((F.col("id") % 500).alias("k"), F.col("id").alias("v"), F.lit(1).alias("at"))
    warehouse.write_bucketed(rows, "T", ["k"], 4)
    warehouse.write_bucketed(rows.filter("v >= 1900").withColumn("v", -F.col("v")), "U", ["k"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        newest = latest_per_key(spark.table("T"), ["k"], "at", ["v"])
        merged = history.upsert(newest, spark.table("U"), ["k"])
        joined = spark.table("T").join(spark.table("U"), "k")
        for df in (newest, merged, joined):
            assert "Exchange" not in plan(df), plan(df)
        assert "Exchange" in plan(rows.join(rows, "k"))
        assert {r.k: r.v for r in merged.collect()} == {
            k: -(1500 + k) if k >= 400 else 1500 + k for k in range(500)}
        assert joined.count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def hot_rows(spark, n=30_000):
    """A third of all rows on one key, a tenth on another, the rest on many; some without."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, 11).when(
        F.col("id") % 50 == 2, F.lit(None)).otherwise(1000 + F.col("id") % 5000)
    return spark.range(0, n, 1, 8).select(key.cast("long").alias("k"), F.lit("x").alias("same"))


def test_hot_keys_are_found(spark):
    rows = hot_rows(spark)
    got = {r.k: r.rows for r in skew.hot_keys(rows, "k", 0.05).collect()}
    exact = {r.k: r["count"] for r in rows.groupBy("k").count().filter("k in (7, 11)").collect()}
    assert set(got) == {7, 11} and all(abs(got[k] - exact[k]) < 0.01 * 30_000 for k in got)
    assert skew.hot_keys(rows.limit(0), "k").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skewed_join_equals_plain_join(spark, how):
    left = hot_rows(spark, 3000)
    right = spark.range(0, 6000).filter("id % 2 = 1 OR id > 2000").select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    right = right.union(right.filter("k = 7"))  # two rows for the hot key
    got, want = skew.skewed_join(left, right, "k", how, 0.05), left.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        skew.skewed_join(left, right, "k", "full")


def test_hot_rows_are_spread(spark):
    left = hot_rows(spark)
    right = spark.range(0, 7000).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def largest(joined):
            sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect())
            return sizes[-1] / sizes[len(sizes) // 2]

        assert largest(left.filter("k is not null").join(right, "k")) > 2
        assert largest(skew.skewed_join(left, right, "k", partitions=32)) <= 2
    finally:
        for c, v in before.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)


def test_readers_never_see_a_gap(spark, empty_catalog):
    warehouse.switch(spark.range(10).toDF("id"), "V")
    stop, failures, seen = threading.Event(), [], set()

    def read():
        while not stop.is_set():
            try:
                seen.add(spark.table("V").count())
            except Exception as failure:
                failures.append(failure)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 16):
        assert warehouse.switch(spark.range(10 + n).toDF("id"), "V") == 10 + n
    stop.set()
    reader.join()
    assert not failures and seen <= set(range(10, 26)) and spark.table("V").count() == 25
    assert warehouse.versions(spark, "V") == [15, 16]


def test_a_switch_that_failed_is_not_shown(spark, empty_catalog):
    warehouse.switch(spark.range(3).toDF("id"), "V")
    with pytest.raises(Exception, match="stop here"):
        warehouse.switch(spark.range(5).selectExpr("raise_error('stop here') AS id"), "V")
    # written, but the view was not turned: as after a crash between the two steps
    spark.range(99).toDF("id").write.saveAsTable("V__v7")
    assert spark.table("V").count() == 3
    assert warehouse.switch(spark.table("V").union(spark.range(1)), "V") == 4  # may read what it replaces
    assert spark.table("V").count() == 4 and warehouse.versions(spark, "V")[-1] == 8
    warehouse.switch(spark.range(6).toDF("id"), "V")
    assert warehouse.versions(spark, "V") == [8, 9] and spark.table("V").count() == 6


def outcomes(report):
    return {o["table"]: o["status"] for o in report}


def test_only_what_changed_is_built(spark, empty_catalog):
    for name, df in bronze_tables(spark).items():
        warehouse.append(df, NAMES.bronze(name))
    first = dependency.run_all(spark, AS_OF)
    assert set(outcomes(first).values()) == {"SUCCESS"} and len(first) == 13
    assert set(outcomes(dependency.run_all(spark, AS_OF)).values()) == {"UNCHANGED"}
    warehouse.append(bronze_tables(spark)["stores"], NAMES.bronze("stores"))
    third = outcomes(dependency.run_all(spark, AS_OF))
    assert {t for t, s in third.items() if s == "SUCCESS"} == {
        NAMES.silver("stores"), NAMES.gold("store_performance"), NAMES.gold("inventory_status"),
        *(NAMES.brand_gold(m) for m in ("revenue_by_channel", "tariff_impact", "store_performance", "marketing_roi"))}
    spark.sql(f"DROP TABLE {NAMES.gold('daily_revenue')}")
    fourth = outcomes(dependency.run_all(spark, AS_OF))
    assert {t for t, s in fourth.items() if s == "SUCCESS"} == {NAMES.gold("daily_revenue")}
    assert set(outcomes(dependency.run_all(spark, "2026-05-01 00:00:00")).values()) == {"SUCCESS"}
    other = Options(dedup_stores=True)
    for status in ("SUCCESS", "UNCHANGED"):
        found = dependency.run_all(spark, "2026-05-01 00:00:00", options=other)
        assert set(outcomes(found).values()) == {status}


def test_failed_inputs_skip_what_needs_them(spark, empty_catalog):
    warehouse.append(spark.range(5).toDF("id"), "SRC")

    def fail():
        raise ValueError("no such thing")

    planned = [
        Model("GOLD", "C", lambda: spark.table("B"), ("B",)),
        Model("GOLD", "D", lambda: spark.table("A"), ("a",)),
        Model("SILVER", "B", fail, ("SRC",)),
        Model("SILVER", "A", lambda: spark.table("SRC"), ("SRC",)),
        Model("GOLD", "E", lambda: spark.table("C"), ("C", "A")),
        Model("GOLD", "F", lambda: spark.table("X"), ("X",)),
    ]
    report = dependency.run(spark, planned)
    assert outcomes(report) == {
        "A": "SUCCESS", "B": "FAILED", "C": "SKIPPED", "D": "SUCCESS", "E": "SKIPPED", "F": "FAILED"}
    assert {o["table"]: o.get("reason") for o in report if o["status"] == "SKIPPED"} == {
        "C": "no new B", "E": "no new C"}
    planned[2] = Model("SILVER", "B", lambda: spark.table("SRC"), ("SRC",))
    again = outcomes(dependency.run(spark, planned))
    assert again == {
        "A": "UNCHANGED", "B": "SUCCESS", "C": "SUCCESS", "D": "UNCHANGED", "E": "SUCCESS", "F": "FAILED"}
    with pytest.raises(ValueError):
        dependency.run(spark, [Model("S", "P", fail, ("Q",)), Model("S", "Q", fail, ("P",))])


def test_bytes_of_any_width(spark):
    values = [0, 1, 255, 2**63 - 1, 2**63, 2**64 - 1, 2**64, 10**27, 2**200 + 12345, 256**40 - 1]
    cells = [v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big") for v in values] + [bytes(12), b"", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, b binary")
    got = {r.i: r.d for r in df.select("i", bytes_to_digits(F.col("b")).alias("d")).collect()}
    assert [got[i] for i in range(len(values))] == [str(v) for v in values]
    assert got[len(values)] == "0" and got[len(values) + 2] is None


def test_bytes_up_to_sixteen_are_worked_out_without_loops(spark):
    r = random.Random(3)
    edges = [10**18, 10**27, 10**36, 10**38, 2**64, 2**72, 2**127, 2**128, 2**136]
    values = [v + d for v in edges for d in (-1, 0, 1)] + [r.getrandbits(n) for n in range(1, 400, 3)]
    cells = [v.to_bytes(max(1, (v.bit_length() + 7) // 8) + pad, "big") for v in values for pad in (0, 1, 5)]
    cells += [bytes(n) for n in (8, 9, 16, 17)] + [b"\xff" * n for n in (8, 9, 15, 16, 17, 32, 33)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, b binary")
    got = {x.i: x.d for x in df.select("i", bytes_to_digits(F.col("b")).alias("d")).collect()}
    assert [got[i] for i in range(len(cells))] == [str(int.from_bytes(c, "big")) for c in cells]
    halves = plan(df.select(columns._digits_of_halves(F.col("b"))))
    assert "decimal(20,0)" in halves and "lambda" not in halves


def test_stock_rows_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    stock = spark.range(40_000).selectExpr(
        "id as inventory_id", "id % 9 as store_id", "'ELF-00001' as product_sku", "'a product' as product_name",
        "id % 300 as quantity_on_hand", "60 as reorder_point", "1.5D as unit_cost",
        "timestamp_ntz'2001-01-01' as _loaded_at")
    stock.write.parquet(str(tmp_path / "stock"))
    newest = latest_per_key(spark.read.parquet(str(tmp_path / "stock")), ["inventory_id"], "_loaded_at")
    stores = spark.range(12).selectExpr("id as store_id", "concat('Store ', id) as store_name", "'here' as city")
    got = gold.inventory_status(newest, stores.hint("merge").join(stores.select("store_id"), "store_id"), AS_OF)
    assert "Broadcast" not in plan(got)
    assert (got.count(), got.select("store_name").distinct().count()) == (40_000, 9)


def test_logs_stay_few_files(spark, empty_catalog):
    from tradewind.sources import ops

    def log(n):
        ops.append_rows(spark, "QUERY_HISTORY", [(f"q{n}", "?", "SELECT 1", 1, 1, dt.datetime(2026, 1, 1))])

    for n in range(12):
        log(n)
        ops.compact(spark, most_files=4)
    assert len(spark.table("QUERY_HISTORY").inputFiles()) <= 5
    assert {r.query_id for r in spark.table("QUERY_HISTORY").collect()} == {f"q{n}" for n in range(12)}
    assert ops.compact(spark, most_files=4) in ([], ["QUERY_HISTORY"]) and ops.compact(spark, most_files=4) == []
    log(12)  # the log takes entries as before
    assert spark.table("QUERY_HISTORY").count() == 13
