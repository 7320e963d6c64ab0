import datetime as dt

from seed import AS_OF, bronze_tables, source_tables
from test_ingest import Source
import pytest

from tradewind.plans import ask, pipeline
from tradewind.rules import TableNames
from tradewind.sources import warehouse
from tradewind.streaming import incremental

NAMES = TableNames()


def shop_source(spark):
    return Source({f"{NAMES.code.lower()}_{n}": df for n, df in source_tables(spark).items()})


def test_run_all_leaves_no_staged_data_of_its_own(spark, empty_catalog):
    import os

    from tradewind.session import stage, staging_root

    other, _ = stage(spark.range(3), "other")
    folder = staging_root(spark).removeprefix("file:") + "/tradewind"
    before = set(os.listdir(folder))
    for name, df in bronze_tables(spark).items():
        warehouse.append(df, NAMES.bronze(name))
    assert pipeline.run_all(spark, AS_OF)["status"] == "success"
    assert set(os.listdir(folder)) == before
    assert other.count() == 3
    assert pipeline.check_all_bronze(spark, AS_OF).count() == 3


def test_nothing_to_check(spark, empty_catalog):
    assert pipeline.check_all_bronze(spark, AS_OF).count() == 0


def test_run_all_and_status(spark, empty_catalog):
    for name, df in bronze_tables(spark).items():
        warehouse.append(df, NAMES.bronze(name))
    report = pipeline.run_all(spark, AS_OF)
    assert report["status"] == "success" and report["models_succeeded"] == 13
    assert [t["records"] for t in report["silver_tables"]] == [5, 10, 10]
    assert {t["table"]: t["records"] for t in report["gold_tables"]} == {
        "GOLD_STORE_PERFORMANCE": 5, "GOLD_PRODUCT_ANALYSIS": 8, "GOLD_DAILY_REVENUE": 2,
        "GOLD_INVENTORY_STATUS": 10, NAMES.brand_gold("revenue_by_channel"): 3,
        NAMES.brand_gold("tariff_impact"): 3, NAMES.brand_gold("store_performance"): 5,
        NAMES.brand_gold("marketing_roi"): 5, NAMES.brand_gold("product_margins"): 8,
        NAMES.brand_gold("customer_360"): 10,
    }
    status = {r.table_name: (r.exists, r.record_count) for r in pipeline.status(spark).collect()}
    assert len(status) == 13 and status["GOLD_DAILY_REVENUE"] == (True, 2)
    assert spark.catalog.tableExists(NAMES.product_history)
    assert pipeline.run_all(spark, AS_OF)["status"] == "success"  # replaces, does not append
    assert spark.table("GOLD_DAILY_REVENUE").count() == 2


def test_options_reach_the_models(spark, empty_catalog):
    tables = bronze_tables(spark)
    for name, df in tables.items():
        warehouse.append(df, NAMES.bronze(name))
    warehouse.append(tables["stores"], NAMES.bronze("stores"))  # a second load
    rates = {"estimated_tariff_cost": 0.5}
    chosen = pipeline.Options(dedup_stores=True, stock_fanout=False, tariff_rates=rates)
    assert pipeline.run_all(spark, AS_OF, options=chosen)["status"] == "success"
    stores = spark.table(NAMES.silver("stores"))
    assert stores.count() == stores.select("store_id").distinct().count()
    tariffs = spark.table(NAMES.brand_gold("tariff_impact"))
    assert "high_tariff_scenario" not in tariffs.columns
    assert all(abs(r.estimated_tariff_cost - r.total_revenue / 2) < 0.01 for r in tariffs.collect())
    margins = spark.table(NAMES.brand_gold("product_margins"))
    from tradewind.plans import gold

    want = gold.product_margins(
        spark.table(NAMES.silver("orders")), spark.table(NAMES.silver("inventory")), AS_OF, fanout=False)
    assert sorted(map(str, margins.collect())) == sorted(map(str, want.collect()))


def test_product_history_table(spark, empty_catalog):
    def snapshot(price):
        return spark.sql(
            f"SELECT 'a' product_sku, 'A' product_name, 'c' category, {price}D price, "
            "5L stock_quantity, 'S' _source, timestamp_ntz'2026-01-01' _loaded_at"
        )
    assert pipeline.record_products(spark, snapshot(1.0), "2026-01-01") == 1
    assert pipeline.record_products(spark, snapshot(1.0), "2026-01-02") == 1
    assert pipeline.record_products(spark, snapshot(2.0), "2026-01-03") == 2
    history = spark.table(NAMES.product_history)
    assert {(r.price, r.is_current) for r in history.collect()} == {(1.0, False), (2.0, True)}


def test_failed_model_does_not_stop_the_others(spark, empty_catalog):
    bronze = bronze_tables(spark)
    for name in ("stores", "orders"):
        warehouse.append(bronze[name], NAMES.bronze(name))
    report = pipeline.run_all(spark, AS_OF)
    assert report["status"] == "partial"
    assert {e["table"] for e in report["errors"]} == {
        NAMES.silver("inventory"), "GOLD_PRODUCT_ANALYSIS", "GOLD_INVENTORY_STATUS",
        NAMES.brand_gold("product_margins"),
    }
    status = {r.table_name: r.exists for r in pipeline.status(spark).collect()}
    assert not status["GOLD_INVENTORY_STATUS"] and status["GOLD_DAILY_REVENUE"]


def test_status_of_an_empty_catalog(spark, empty_catalog):
    assert {(r.exists, r.record_count) for r in pipeline.status(spark).collect()} == {(False, 0)}


def test_cycle_and_questions(spark, empty_catalog):
    origin = shop_source(spark)
    first = incremental.run_cycle(spark, origin, AS_OF)
    assert first["tables_synced"] == 3 and first["transform"]["status"] == "success"
    assert {r.health_score for r in first["health"].collect()} == {100.0}
    second = incremental.run_cycle(spark, origin, AS_OF)
    assert {r.health_score for r in second["health"].collect()} == {50.0}
    assert {r.alert_type for r in spark.table("ALERT_LOG").collect()} == {"DUPLICATE_RECORDS"}
    assert spark.table("ALERT_LOG").count() == 3

    answer = ask.run_query(
        spark, "SELECT store_name, total_revenue FROM GOLD_STORE_PERFORMANCE "
        "ORDER BY revenue_rank", "Which store has highest revenue?",
    )
    assert answer["status"] == "success" and answer["total_rows"] == 5
    assert answer["results"][0] == {"store_name": "Store 2", "total_revenue": "188.0"}
    wrong = ask.run_query(spark, "SELECT nothing FROM nowhere")
    assert wrong["status"] == "error"
    (logged,) = spark.table("QUERY_HISTORY").collect()
    assert (logged.rows_returned, logged.question) == (5, "Which store has highest revenue?")


def test_result_caps(spark, empty_catalog):
    warehouse.replace(spark.range(300).toDF("id"), "T")
    whole = ask.run_query(spark, "SELECT id, CAST(NULL AS INT) n FROM T ORDER BY id DESC")
    assert whole["total_rows"] == 300
    assert (len(whole["results"]), len(whole["chart_data"])) == (50, 20)
    assert whole["results"][0] == {"id": "299", "n": "N/A"}
    assert [r["id"] for r in whole["results"]] == [str(i) for i in range(299, 249, -1)]
    assert ask.run_query(spark, "SELECT id FROM T", limit=100)["total_rows"] == 100


def test_failing_replacement_keeps_the_old_table(spark, empty_catalog):
    warehouse.replace(spark.range(3).toDF("id"), "T")
    with pytest.raises(Exception, match="stop here"):
        warehouse.replace(spark.range(5).selectExpr("raise_error('stop here') AS id"), "T")
    assert spark.table("T").count() == 3 and warehouse.names(spark) == ["t"]


def test_stream_takes_each_file_once(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k bigint, a string, b string, c string, d string, e string"
    full = spark.createDataFrame([(i, "x", "x", "x", "x", "x") for i in range(4)], schema)
    sparse = spark.createDataFrame([(9, None, "", " ", None, None)], schema)
    full.coalesce(1).write.mode("append").parquet(inbox)
    stream = incremental.arrivals(spark, inbox, full.schema, maxFilesPerTrigger="1")
    seen = []
    loaded = incremental.load_arrivals(stream, store, "FILES", lambda: seen.append(1))
    assert loaded.count() == 4
    sparse.unionByName(full).coalesce(1).write.mode("append").parquet(inbox)
    loaded = incremental.load_arrivals(stream, store, "FILES", lambda: seen.append(1))
    assert loaded.count() == 8 and len(seen) == 2
    assert incremental.load_arrivals(stream, store, "FILES").count() == 8  # nothing new
    refused = spark.read.parquet(f"{store}/quarantine").collect()
    assert [r.rejection_reason for r in refused] == ["TOO_MANY_NULLS_5_of_6_columns"]
    assert {r._RUN_ID for r in loaded.collect()} == {"batch-0", "batch-1"}


def test_stream_cycle_rebuilds_the_models(spark, empty_catalog, tmp_path):
    tables = source_tables(spark)
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / "in" / name))
    streams = {
        n: incremental.arrivals(spark, str(tmp_path / "in" / n), df.schema)
        for n, df in tables.items()
    }
    store = str(tmp_path / "store")
    first = incremental.stream_cycle(spark, streams, store, AS_OF)
    assert first["transform"]["status"] == "success", first["transform"]["errors"]
    assert {r.health_score for r in first["health"].collect()} == {100.0}
    more = tables["orders"].selectExpr(
        *("order_id + 100 as order_id" if c == "order_id" else c for c in tables["orders"].columns)
    )
    more.write.mode("append").parquet(str(tmp_path / "in" / "orders"))
    second = incremental.stream_cycle(spark, streams, store, AS_OF)
    counts = {t["table"]: t["records"] for t in second["transform"]["silver_tables"]}
    assert counts == {NAMES.silver("orders"): 20, NAMES.silver("stores"): 5,
                      NAMES.silver("inventory"): 10}
    top = spark.table("GOLD_STORE_PERFORMANCE").filter("revenue_rank = 1").first()
    assert (top.store_id, top.total_revenue, top.unique_customers) == (2, 188.0, 3)


def test_quality_log_times(spark, empty_catalog):
    warehouse.append(bronze_tables(spark, syncs=2)["orders"], "BRZ_X")
    pipeline.check_quality(spark, ["BRZ_X"], AS_OF, dt.datetime(2026, 5, 1))
    (alert,) = spark.table("ALERT_LOG").collect()
    assert alert.created_at == dt.datetime(2026, 5, 1) and alert.resolved_at is None
