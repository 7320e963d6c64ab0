"""Registered queries: each reads the given tables whole and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewind.functions.columns import add_days, bytes_to_digits, bytes_to_long
from tradewind.operators import audit, history, profiles, quality, ranking, reshape, skew, sketches, validation
from tradewind.plans import ask as asking
from tradewind.plans import dependency, gold, ingest, pipeline, questions, silver
from tradewind.plans import incremental_gold as by_load
from tradewind.rules import TableNames
from tradewind.session import stage, staging_path
from tradewind.sources import files, relational, warehouse
from tradewind.sources import star_schema as star
from tradewind.streaming import incremental

AS_OF = star.AS_OF
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    """Double sums differ in the last bits between engines, so money is rounded.

    Amounts have up to six decimals. Six digits leave no ties in the small sums per
    product or customer; means and the few large sums need two, far above their last bits.
    """
    return df.withColumns({c: F.round(c, digits) for c in columns})


def plain(df: DataFrame) -> DataFrame:
    """Without the load stamp, which tells when the query ran."""
    return df.drop("_gold_loaded_at")


# Inputs ----------------------------------------------------------------------------

def orders(spark, folder):
    return silver.silver_orders(star.bronze_orders(spark, folder), AS_OF)


def inventory(spark, folder):
    return silver.silver_inventory(star.bronze_inventory(spark, folder), AS_OF)


def stores(spark, folder):
    return silver.silver_stores(star.bronze_stores(spark, folder), AS_OF)


def sales(spark, folder):
    return gold.store_customer_sales(orders(spark, folder))


# Gold models -------------------------------------------------------------------------

def store_performance(spark, folder):
    return plain(gold.store_performance(sales(spark, folder), stores(spark, folder), AS_OF))


def product_analysis(spark, folder):
    return plain(gold.product_analysis(orders(spark, folder), inventory(spark, folder), AS_OF))


def daily_revenue(spark, folder):
    return plain(gold.daily_revenue(orders(spark, folder), AS_OF))


def inventory_status(spark, folder):
    return plain(gold.inventory_status(inventory(spark, folder), stores(spark, folder), AS_OF))


def revenue_by_channel(spark, folder):
    model = gold.revenue_by_channel(sales(spark, folder), stores(spark, folder), AS_OF)
    return rounded(plain(model), "total_revenue", "avg_order_value")


def tariff_impact(spark, folder):
    model = gold.tariff_impact(sales(spark, folder), stores(spark, folder), AS_OF)
    return rounded(plain(model), "total_revenue", "avg_order_value")


def store_targets(spark, folder):
    model = gold.store_targets(sales(spark, folder), stores(spark, folder), AS_OF)
    return rounded(rounded(plain(model), "actual_revenue", digits=6), "avg_order_value")


def channel_roi(spark, folder):
    model = gold.channel_roi(sales(spark, folder), stores(spark, folder), AS_OF)
    return rounded(plain(model), "total_revenue", "avg_order_value")


def product_margins(spark, folder):
    model = gold.product_margins(orders(spark, folder), inventory(spark, folder), AS_OF)
    money = rounded(plain(model), "avg_selling_price", "total_revenue", digits=6)
    return rounded(money, "avg_unit_cost", "total_gross_profit", digits=4)


def customer_360(spark, folder):
    model = gold.customer_360(orders(spark, folder), AS_OF)
    return rounded(rounded(plain(model), "lifetime_value", digits=6), "avg_order_value")


# Quality -------------------------------------------------------------------------------

def bronze_tables(spark, folder):
    return {
        "bronze_orders": star.bronze_orders(spark, folder),
        "bronze_inventory": star.bronze_inventory(spark, folder),
        "bronze_stores": star.bronze_stores(spark, folder),
    }


def quality_issues(kind: str, as_of: str = AS_OF) -> Query:
    def query(spark, folder):
        counts = quality.check_tables(bronze_tables(spark, folder), as_of, only=[kind])
        return quality.issues(counts)

    return query


def health_score(spark, folder):
    return quality.health(quality.check_tables(bronze_tables(spark, folder), AS_OF))


def alert_log(spark, folder):
    counts = quality.check_tables(bronze_tables(spark, folder), AS_OF)
    return quality.alerts(quality.issues(counts), AS_OF).drop("alert_id", "resolved_at")


def load_profiles(spark, folder):
    """Issues of all Bronze tables from the profiles that three loads of each have left; the
    duplicates, which come from sketches, as in ``quality_duplicates`` up to their error."""
    written = []
    for name, rows in bronze_tables(spark, folder).items():
        rows, _ = stage(rows, name)
        turn = F.pmod(F.xxhash64("_loaded_at"), F.lit(3))
        written += [profiles.profile(rows.filter(turn == n), name, f"load-{n}", AS_OF) for n in range(3)]
    kept, _ = stage(reduce(DataFrame.unionByName, written), "profiles")
    return quality.issues(profiles.merged(kept).filter(
        F.col("issue_type").isNull() | (F.col("issue_type") != quality.DUPLICATES)))


# Ingest ----------------------------------------------------------------------------------

FEED = ("order_key", "customer", "status", "price", "ordered", "priority")


def order_feed(spark, folder):
    """Orders as text cells, some rows blanked: all cells, five of six, four of six."""
    raw = star.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"),
        *(
            F.col(c).cast("string").alias(n)
            for c, n in zip(
                ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                 "o_orderpriority"), FEED,
            )
        ),
    )

    def cell(i: int, name: str) -> Column:
        blank = F.lit((None, "  ", "\t")[i % 3])
        emptied = (
            (F.col("key") % 29 == 0)
            | ((F.col("key") % 31 == 0) & (i > 0))
            | ((F.col("key") % 37 == 0) & (i > 1))
        )
        return F.when(emptied, blank).otherwise(F.col(name)).alias(name)

    return raw.select(*(cell(i, n) for i, n in enumerate(FEED)))


def validate_rows(spark, folder):
    return validation.with_reason(order_feed(spark, folder)).select(
        "order_key", "priority", "rejection_reason"
    )


def quarantine_reasons(spark, folder):
    checked = validation.with_reason(order_feed(spark, folder))
    return validation.rejected(checked).groupBy("rejection_reason").agg(
        F.count(F.lit(1)).alias("rows")
    )


def feed_files(spark, folder) -> str:
    """Folder of CSV files that hold the feed."""
    path = staging_path(spark, "feed") + ".csv"
    order_feed(spark, folder).write.options(
        header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


def file_ingest(spark, folder):
    """The feed written as CSV files, read back with inferred types, and validated."""
    checked = validation.with_reason(files.read_csv(spark, feed_files(spark, folder)))
    kept = F.col("rejection_reason").isNull()
    return checked.agg(
        F.count(F.lit(1)).alias("records_fetched"),
        F.count_if(kept).alias("records_loaded"),
        F.count_if(~kept).alias("records_quarantined"),
        F.sum(F.when(kept, F.length("CUSTOMER"))).alias("kept_customer_characters"),
    ).withColumn(
        "load_health",
        validation.load_health(F.col("records_fetched"), F.col("records_loaded")),
    )


def relational_load(spark, folder):
    origin = relational.FolderSource(spark, folder, ("customer",))
    rows = relational.map_types(origin.read("customer"), origin.column_types("customer"))
    return validation.drop_all_null(rows)


def bytes_to_number(spark, folder):
    key = F.col("o_orderkey")
    return star.table(spark, folder, "orders").select(
        "o_orderkey", bytes_to_long(F.unhex(F.lpad(F.hex(key), 16, "0"))).alias("from_bytes"),
        *(
            bytes_to_digits(F.unhex(F.concat(F.lit(lead), F.lpad(F.hex(key), 12, "0")))).alias(name)
            for name, lead in (("from_2_63", "8000"), ("up_to_2_64", "FFFF"), ("nine_bytes", "FE0000"),
                               ("sixteen_bytes", "01000000000000000000"))
        ),
    )


def null_profile(spark, folder):
    return validation.null_profile(star.bronze_orders(spark, folder))


def load_verification(spark, folder):
    """Bronze orders against the number of line items they come from."""
    expected = star.table(spark, folder, "lineitem").agg(F.count(F.lit(1))).scalar()
    checked = validation.load_verification(star.bronze_orders(spark, folder), expected)
    return checked.select(
        "verified", "expected_count", "loaded_count", "missing_records", "column_count",
        F.coalesce(F.col("null_summary")["store_id"], F.lit(0)).alias("null_store_ids"),
        F.cardinality("null_summary").cast("long").alias("columns_with_nulls"),
    )


def table_counts(spark, folder):
    return audit.table_counts(bronze_tables(spark, folder))


def stream_ingest(spark, folder):
    """Order files taken in as a stream, batch by batch, then counted by status."""
    source = star.table(spark, folder, "orders")
    stream = incremental.arrivals(spark, folder, source.schema, pathGlobFilter="orders.parquet")
    loaded = incremental.load_arrivals(stream, staging_path(spark, "stream"), "FILES_ORDERS")
    return loaded.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_custkey").alias("customer_keys")
    )


#: Rows of a file, about, in a delivery of several files.
DELIVERY_FILE_ROWS = 100_000


def order_deliveries(spark, folder) -> tuple[str, StructType, int]:
    """Folder of order files, one delivery per year of loading, their schema, and files per delivery.

    Each delivery also repeats rows of the year before; the last one repeats rows of the first year.
    """
    bronze, total = stage(star.bronze_orders(spark, folder), "orders")
    year = F.year("_loaded_at")
    first, last = bronze.agg(F.min(year), F.max(year)).first()
    path = staging_path(spark, "deliveries")
    again, long_ago = F.col("order_id") % 7 == 0, F.col("order_id") % 11 == 0
    files_each = min(len(bronze.inputFiles()), 1 + total // (DELIVERY_FILE_ROWS * (last - first + 1)))
    for n in range(first, last + 1):
        rows = (year == n) | ((year == n - 1) & again)
        delivery = bronze.filter(rows)
        if n == last:
            delivery = delivery.unionByName(bronze.filter((year == first) & long_ago))
        delivery.coalesce(files_each).write.mode("append").parquet(path)  # one after the other
        written = len(spark.read.schema(bronze.schema).parquet(path).inputFiles())
        for _ in range(written, (n - first + 1) * files_each):  # tasks without rows leave no file
            bronze.limit(0).coalesce(1).write.mode("append").parquet(path)
    return path, bronze.schema, files_each


def stream_distinct(spark, folder):
    """Orders from deliveries with repeats and late rows, newest per order, by status."""
    path, schema, files_each = order_deliveries(spark, folder)
    stream = incremental.arrivals(spark, path, schema, maxFilesPerTrigger=str(files_each))
    orders, late = incremental.distinct_arrivals(
        stream, staging_path(spark, "distinct"), schema.names, "_loaded_at", "800 days"
    )
    newest = silver.newest_orders(orders)
    return newest.groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("quantity").alias("units"),
        F.lit(orders.count()).cast("long").alias("rows_stored"), F.lit(late).cast("long").alias("rows_late"),
    )


# Run log and reports -----------------------------------------------------------------------

def run_log(spark, folder):
    """Events as pipeline runs: an error event is a run that loaded nothing."""
    failed = F.col("event_type") == "error"
    fetched = F.floor(F.col("value") * 10).cast("long")
    refused = F.when(failed, F.lit(0)).otherwise(F.floor(fetched / 10).cast("long"))
    return star.table(spark, folder, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("event_type").alias("source_name"),
        F.col("ts").alias("start_time"),
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        fetched.alias("records_fetched"),
        F.when(failed, F.lit(0)).otherwise(fetched - refused).alias("records_loaded"),
        refused.alias("records_quarantined"),
    )


def run_statistics(spark, folder):
    return audit.run_statistics(run_log(spark, folder))


def success_rate(spark, folder):
    return audit.success_rate(run_log(spark, folder))


def run_series(spark, folder):
    return audit.run_series(run_log(spark, folder))


def newest_n(spark, folder):
    return audit.newest(run_log(spark, folder), "start_time", 20, "run_id")


def newest_of(table: str, *columns: str) -> Query:
    """The newest entries of an operations table, with the events as its rows."""
    moment, key, _ = audit.REPORTS[table]

    def query(spark, folder):
        log = star.table(spark, folder, "events").select(
            F.col("ts").alias(moment), F.col("event_id").alias(key), *map(F.expr, columns)
        )
        return audit.recent(log, table)

    return query


def chart_series(spark, folder):
    ranking_of_stores = questions.store_ranking(store_performance(spark, folder))
    return audit.chart_series(ranking_of_stores.select("store_name", "total_revenue"))


def result_text(spark, folder):
    products = product_analysis(spark, folder)
    return audit.as_text(
        products.select("product_sku", "product_name", "current_stock", "margin_pct")
    )


# Ranks, running totals, history --------------------------------------------------------------

RANGES = 16  # given, so that small data is not brought together in one range


def global_rank(spark, folder):
    lines = star.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    return ranking.global_rank(lines, "l_extendedprice", "price_rank", RANGES)


def global_rank_ties(spark, folder):
    """Fifty quantities over all lines: every value is shared by many rows."""
    lines = star.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity"
    )
    return ranking.global_rank(lines, "l_quantity", "quantity_rank", RANGES)


def running_total(spark, folder):
    heads = star.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    totals = ranking.running_total(
        heads, "o_orderkey", "o_totalprice", "total_so_far", RANGES
    )
    return rounded(totals, "total_so_far")


def upsert(spark, folder):
    """The last stock delivery merged into the deliveries before it."""
    loads = star.bronze_inventory(spark, folder)
    last = F.lit("2001-01-05 00:00:00").cast("timestamp_ntz")
    earlier = loads.filter(F.col("_loaded_at") < last)
    return history.upsert(earlier, loads.filter(F.col("_loaded_at") >= last), ["inventory_id"])


def product_snapshots(spark, folder):
    """The product list twice: later some prices and stocks change, small sizes are
    new and the largest are gone."""
    parts = star.table(spark, folder, "part")

    def snapshot(day: str, price: Column, stock: Column) -> DataFrame:
        return parts.select(
            F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("product_sku"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            price.alias("price"),
            stock.cast("long").alias("stock_quantity"),
            F.lit("SYNTH_PARTS").alias("_source"),
            F.lit(day).cast("timestamp_ntz").alias("_loaded_at"),
            "p_size",
        )

    price, stock = F.col("p_retailprice"), F.col("p_partkey") % 50
    raised = F.when(F.col("p_partkey") % 5 == 0, price + 10).otherwise(price)
    moved = F.when(F.col("p_partkey") % 7 == 0, stock + 1).otherwise(stock)
    first = snapshot("2001-01-01", price, stock).filter("p_size > 5").drop("p_size")
    second = snapshot("2001-02-01", raised, moved).filter("p_size < 45").drop("p_size")
    return first, second


def scd2_history(spark, folder):
    first, second = product_snapshots(spark, folder)
    opened = history.open_versions(first, "2001-01-01")
    return history.apply_snapshot(opened, second, "2001-02-01", close_missing=True).drop(
        "surrogate_key"
    )


def scd2_partitions(spark, folder):
    """The history table after both snapshots: closed versions lie in partitions of their own."""
    first, second = product_snapshots(spark, folder)
    table = TableNames().product_history
    with own_database(spark):
        pipeline.record_products(spark, first, "2001-01-01")
        pipeline.record_products(spark, second, "2001-02-01", close_missing=True)
        kept = spark.table(table).withColumn("in_open", F.col("_period") == pipeline.OPEN)
        return stage(kept.drop("_period"), "product-history")[0]


def schema_changes(spark, folder):
    """Two customer deliveries as text; their schemas are inferred from every row."""
    customers = star.table(spark, folder, "customer")
    before = customers.select(*(F.col(c).cast("string").alias(c) for c in customers.columns))
    nation, balance = F.col("c_nationkey"), F.col("c_acctbal")
    after = customers.select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        "c_name",
        F.when(nation != 0, nation.cast("string")).alias("c_nationkey"),
        F.floor(balance).cast("string").alias("c_acctbal"),
        (balance > 0).cast("string").alias("c_in_credit"),
    )
    schemas = [files.typed(d, files.infer_types(d)).schema for d in (before, after)]
    at = F.lit(AS_OF).cast("timestamp_ntz")
    changes = history.schema_changes(spark, "CSV_CUSTOMER", *schemas)
    return changes.drop("change_id").withColumn("detected_at", at)


def volume_history(spark, folder):
    lineage = [t.select("_source", "_loaded_at") for t in bronze_tables(spark, folder).values()]
    volumes = history.volume_history(lineage[0].unionByName(lineage[1]).unionByName(lineage[2]))
    return volumes.withColumns(
        {c: F.col(c).cast("double") for c in ("previous_count", "change")}
    )


# Distinct counts from sketches, Gold load by load -----------------------------------------

def distinct_sketches(spark, folder):
    """Customers and products per store, of a year and of all time, from sketches kept by day:
    the exact counts, and whether the estimates are within four standard errors."""
    with own_database(spark):
        valid, _ = stage(orders(spark, folder), "orders")
        sketches.append(sketches.daily_sketches(valid), "DISTINCT_SKETCHES")

        def counted(span: str, first: str, last: str) -> DataFrame:
            estimated = sketches.distinct_between(spark, "DISTINCT_SKETCHES", first, last)
            inside = valid.filter(
                (F.col("order_date") >= first) & (F.col("order_date") < F.date_add(F.lit(last), 1))
            )
            exact = inside.groupBy("store_id").agg(
                F.count_distinct("customer_id").alias("customers"),
                F.count_distinct("product_sku").alias("products"),
            )
            error = 4 * sketches.relative_error()

            def near(estimate: str, count: str) -> Column:
                return F.abs(F.col(estimate) - F.col(count)) <= F.col(count) * error

            return exact.join(estimated, "store_id").select(
                F.lit(span).alias("span"), "store_id", "customers", "products",
                near("customer_id", "customers").alias("customers_near"),
                near("product_sku", "products").alias("products_near"),
            )

        both = counted("1996", "1996-01-01", "1996-12-31").union(
            counted("all", "1900-01-01", "2100-01-01"))
        return stage(both, "distinct-counts")[0]


def incremental_gold(spark, folder):
    """Gold after three loads of orders, taken in one by one; later loads replace earlier rows."""
    bronze, _ = stage(star.bronze_orders(spark, folder), "orders")
    state = by_load.State(spark, staging_path(spark, "gold-state"))
    turn = F.year("_loaded_at") % 3
    for n in range(3):
        state.add(bronze.filter(turn == n), f"load-{n}", AS_OF)
    stock, shops = inventory(spark, folder), stores(spark, folder)
    sales, sold = stage(state.sales(), "sales")[0], stage(state.sold(), "sold")[0]

    def rows(model: str, df: DataFrame, key: str, orders: str, revenue: str, detail: str) -> DataFrame:
        return df.select(
            F.lit(model).alias("model"), F.col(key).cast("string").alias("key"),
            F.col(orders).alias("orders"), F.round(revenue, 2).alias("revenue"),
            F.col(detail).cast("double").alias("detail"),
        )

    parts = [
        rows("store_performance", gold.store_performance(sales, shops, AS_OF), "store_id",
             "total_orders", "total_revenue", "unique_customers"),
        rows("store_targets", gold.store_targets(sales, shops, AS_OF), "store_id",
             "total_orders", "actual_revenue", "revenue_rank"),
        rows("revenue_by_channel", gold.revenue_by_channel(sales, shops, AS_OF), "channel",
             "total_orders", "total_revenue", "unique_customers"),
        rows("product_analysis", gold.product_analysis_of(sold, stock, AS_OF), "product_sku",
             "total_orders", "total_revenue", "total_units_sold"),
        rows("product_margins", gold.product_margins_of(sold, stock, AS_OF), "product_sku",
             "total_orders", "total_revenue", "revenue_rank"),
        rows("customer_360", gold.customer_360_of(state.customers(), AS_OF), "customer_id",
             "total_orders", "lifetime_value", "unique_products_bought"),
        rows("daily_revenue", gold.daily_revenue_of(state.daily(), AS_OF).withColumn(
            "order_day", F.date_format("order_day", "yyyy-MM-dd")), "order_day",
             "total_orders", "daily_revenue", "unique_customers"),
    ]
    return reduce(DataFrame.unionByName, parts)


# Stored layouts, hot keys ---------------------------------------------------------------------

def bucketed_upsert(spark, folder):
    """The upsert of ``upsert`` between two tables in buckets by key; neither is shuffled."""
    loads = star.bronze_inventory(spark, folder)
    last = F.lit("2001-01-05 00:00:00").cast("timestamp_ntz")
    with own_database(spark):
        for table, rows in (("STOCK", F.col("_loaded_at") < last), ("DELIVERY", F.col("_loaded_at") >= last)):
            warehouse.write_bucketed(loads.filter(rows), table, ["inventory_id"], 8)
        merged = history.upsert(spark.table("STOCK"), spark.table("DELIVERY"), ["inventory_id"])
        return stage(merged, "bucketed")[0]


def hot_key_join(spark, folder):
    """Line items with the customer of their order, a third of them moved to one customer."""
    heads = star.table(spark, folder, "orders")
    lines = star.table(spark, folder, "lineitem")
    named = lines.join(heads, lines.l_orderkey == heads.o_orderkey).select(
        F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).alias("c_custkey"),
        "l_quantity", "l_linenumber",
    )
    customers = star.table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    joined = skew.skewed_join(named, customers, "c_custkey", "left")
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("units"),
        F.count_distinct("c_custkey").alias("customers"),
    )


# Whole runs, each in a database of its own ------------------------------------------------

@contextmanager
def own_database(spark) -> Iterator[None]:
    """Tables written inside go into a new database, which is dropped at the end."""
    before, name = spark.catalog.currentDatabase(), f"run_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name}")
    spark.catalog.setCurrentDatabase(name)
    try:
        yield
    finally:
        spark.catalog.setCurrentDatabase(before)
        spark.sql(f"DROP DATABASE {name} CASCADE")


def write_bronze(spark, folder):
    for name, rows in bronze_tables(spark, folder).items():
        warehouse.append(rows, TableNames().bronze(name.removeprefix("bronze_")))


def pipeline_run(spark, folder):
    """Every table that a whole run writes, with its rows."""
    with own_database(spark):
        write_bronze(spark, folder)
        pipeline.run_all(spark, AS_OF)
        return stage(pipeline.status(spark), "layer-status")[0]


def pipeline_rerun(spark, folder):
    """What three runs build: the first all, the second nothing, the third what new stock touches."""
    with own_database(spark):
        write_bronze(spark, folder)
        runs = []
        for n in (1, 2, 3):
            if n == 3:
                warehouse.append(star.bronze_inventory(spark, folder), TableNames().bronze("inventory"))
            runs += [(n, o["table"], o["status"]) for o in dependency.run_all(spark, AS_OF)]
        return spark.createDataFrame(runs, "run bigint, table_name string, status string")


def catalog(spark, folder):
    """Bronze tables and their columns, as the catalog describes them."""
    with own_database(spark):
        write_bronze(spark, folder)
        listed = warehouse.catalog_summary(spark, 4).select(
            F.upper("table_name").alias("table_name"), "columns")
        return stage(listed, "catalog")[0]


def check_all(spark, folder):
    """Health of all Bronze tables and the alerts that the check logged for each."""
    with own_database(spark):
        write_bronze(spark, folder)
        health = pipeline.check_all_bronze(spark, AS_OF).withColumn(
            "table_name", F.upper("table_name")  # the catalog lists names in lower case
        )
        alerts = spark.table("ALERT_LOG").groupBy(
            F.upper(F.substring_index("message", ":", 1)).alias("table_name")
        ).agg(F.count(F.lit(1)).alias("alerts"))
        both = health.join(alerts, "table_name", "left").fillna(0, ["alerts"])
        return stage(both, "bronze-health")[0]


SYNCED = ("customer", "nation", "orders", "part", "region", "supplier")


def sync_tables(spark, folder):
    """Rows of each Bronze table after two loads of its source, and what the run log says."""
    with own_database(spark):
        for _ in range(2):
            ingest.sync_all(spark, relational.FolderSource(spark, folder, SYNCED))
        logged = spark.table("PIPELINE_RUNS").filter("status = 'SUCCESS'").groupBy(
            F.concat(F.lit("BRZ_"), "source_name").alias("table_name")
        ).agg(F.count(F.lit(1)).alias("runs"), F.sum("records_loaded").alias("records_loaded"))
        listed = warehouse.list_bronze(spark).select(
            F.upper("table_name").alias("table_name"), "record_count"
        )
        return stage(listed.join(logged, "table_name", "left"), "bronze-tables")[0]


def csv_to_bronze(spark, folder):
    """The feed's files loaded: rows in Bronze, in quarantine and in the logs."""
    with own_database(spark):
        ingest.load_csv_to_bronze(spark, feed_files(spark, folder), "feed")

        def rows_by(table: str, detail: str, rows: Column) -> DataFrame:
            return spark.table(table).groupBy(F.col(detail).alias("detail")).agg(
                rows.alias("rows")
            ).select(F.lit(table).alias("table_name"), "detail", "rows")

        written = rows_by("BRZ_FEED", "_SOURCE", F.count(F.lit(1)))
        refused = rows_by("QUARANTINE_RECORDS", "rejection_reason", F.count("raw_data"))
        runs = rows_by("PIPELINE_RUNS", "status", F.sum("records_loaded"))
        volume = rows_by("VOLUME_HISTORY", "source_name", F.sum("record_count"))
        return stage(written.union(refused).union(runs).union(volume), "feed-load")[0]


def ask_result(spark, folder):
    """Products by units, sorted by free SQL: the rows shown, in order, and the true total."""
    view = f"products_{uuid.uuid4().hex[:12]}"
    product_analysis(spark, folder).createOrReplaceTempView(view)
    with own_database(spark):
        answer = asking.run_query(
            spark,
            "SELECT product_sku, total_units_sold, stock_status "
            f"FROM {view} ORDER BY total_units_sold DESC NULLS LAST, product_sku",
        )
        history = spark.table("QUERY_HISTORY").select("rows_returned").first()
    spark.catalog.dropTempView(view)
    shown = [
        (n, r["product_sku"], r["total_units_sold"], r["stock_status"], answer["total_rows"],
         history["rows_returned"], n <= len(answer["chart_data"]))
        for n, r in enumerate(answer["results"], 1)
    ]
    return spark.createDataFrame(
        shown, "position bigint, product_sku string, units string, stock_status string, "
        "total_rows bigint, logged_rows bigint, charted boolean",
    )


# The SQL surface: joins, windows, reshaping, functions -------------------------------------

def pivot(spark, folder):
    """Revenue per month and channel."""
    sold = orders(spark, folder).join(
        stores(spark, folder).select("store_id", "store_type"), "store_id"
    ).withColumn("month", F.date_format("order_date", "yyyy-MM"))
    kinds = ["Flagship", "Standard", "Premium", "Outlet"]
    wide = reshape.pivot(sold, ["month"], "store_type", kinds, F.sum("total_amount"))
    return rounded(wide.toDF("month", *(k.lower() for k in kinds)), *(k.lower() for k in kinds))


def unpivot(spark, folder):
    products = product_analysis(spark, folder).withColumn(
        "revenue_rank", F.col("revenue_rank").cast("double")
    )
    return reshape.unpivot(
        products, ["product_sku"],
        ["total_revenue", "avg_selling_price", "margin_pct", "revenue_rank"], "metric", "value",
    )


def lead_dense_rank(spark, folder):
    """Units per channel and month: rank in the channel, next month, channel mean."""
    monthly = (
        orders(spark, folder)
        .join(stores(spark, folder).select("store_id", "store_type"), "store_id")
        .groupBy("store_type", F.date_format("order_date", "yyyy-MM").alias("month"))
        .agg(F.sum("quantity").alias("units"))
    )
    channel = Window.partitionBy("store_type")
    return monthly.select(
        "store_type", "month", "units",
        F.row_number().over(channel.orderBy("month")).cast("long").alias("month_number"),
        F.dense_rank().over(channel.orderBy(F.col("units").desc())).cast("long")
        .alias("units_rank"),
        F.coalesce(F.lead("units", 1).over(channel.orderBy("month")), F.lit(0))
        .alias("next_units"),
        F.avg("units").over(channel).alias("mean_units"),
    )


def stddev(spark, folder):
    return orders(spark, folder).groupBy("product_sku").agg(
        F.round(F.stddev("unit_price"), 6).alias("price_stddev"),
        F.count(F.lit(1)).alias("orders"),
    )


def right_join(spark, folder):
    """Every store with its stock rows, stores without stock included."""
    stock = inventory(spark, folder).groupBy("store_id").agg(
        F.count(F.lit(1)).alias("stock_rows"), F.sum("quantity_on_hand").alias("on_hand")
    )
    named = stores(spark, folder).select("store_id", "store_name")
    return stock.join(named, "store_id", "right").select(
        "store_id", "store_name", "stock_rows", "on_hand"
    )


def _stock_keys(spark, folder):
    return inventory(spark, folder).select("product_sku").distinct()


def semi_join(spark, folder):
    """Orders of products that are in stock records."""
    return orders(spark, folder).join(_stock_keys(spark, folder), "product_sku", "left_semi").select(
        "order_id", "product_sku"
    )


def anti_join(spark, folder):
    """Orders of products without a stock record."""
    return orders(spark, folder).join(_stock_keys(spark, folder), "product_sku", "left_anti").select(
        "order_id", "product_sku"
    )


def date_functions(spark, folder):
    hours = F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    ordered = F.col("o_orderdate") + hours  # at all times of day
    return star.table(spark, folder, "orders").select(
        "o_orderkey",
        add_days(ordered, 30).cast("timestamp_ntz").alias("due"),
        F.to_date(F.date_format(ordered, "yyyy-MM-dd")).cast("timestamp_ntz").alias("day"),
        F.date_trunc("month", ordered).cast("timestamp_ntz").alias("month"),
        F.datediff(F.lit(AS_OF).cast("timestamp_ntz"), ordered).cast("long").alias("age_days"),
    )


def text_functions(spark, folder):
    name = F.col("c_name")
    return star.table(spark, folder, "customer").select(
        "c_custkey",
        F.upper(name).alias("upper_name"),
        F.lower("c_mktsegment").alias("segment"),
        F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        name.rlike(r"\ACustomer#[0-9]{9}\z").alias("well_formed"),
    )


FREE_SQL = """
    WITH monthly AS (
        SELECT store_id, date_trunc('MONTH', order_date) AS month, sum(total_amount) AS revenue
        FROM {orders} WHERE store_id IN (SELECT store_id FROM {stores} WHERE is_active = 1)
        GROUP BY ALL
    )
    SELECT store_id, CAST(month AS TIMESTAMP_NTZ) AS month, round(revenue, 2) AS revenue,
           round(revenue - lag(revenue) OVER (PARTITION BY store_id ORDER BY month), 2) AS change,
           revenue > (SELECT avg(revenue) FROM monthly) AS above_average
    FROM monthly
"""


def quality_text(spark, folder):
    """Checks of a table whose columns are text: what does not convert is not checked at all."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("string")
    price = F.col("o_totalprice").cast("string")
    feed = star.table(spark, folder, "orders").select(
        key.cast("string").alias("order_key"),
        F.when(key % 41 == 0, F.concat(F.lit("-"), price)).otherwise(price).alias("total_price"),
        F.when(key % 31 == 0, "none").otherwise("-5").alias("stock_left"),
        date.alias("order_date"),
        F.when(key % 31 == 0, "soon").otherwise(date).alias("due_date"),
    )
    counts = quality.check_tables({"text_feed": feed}, "1997-01-01 00:00:00")
    return quality.issues(counts)


def free_sql(spark, folder):
    return spark.sql(FREE_SQL, orders=orders(spark, folder), stores=stores(spark, folder))


# Named questions ------------------------------------------------------------------------------

def ask(question, model: Query) -> Query:
    return lambda spark, folder: question(model(spark, folder))


QUERIES: dict[str, Query] = {
    "silver_orders": orders,
    "silver_inventory": inventory,
    "silver_stores": stores,
    "store_performance": store_performance,
    "product_analysis": product_analysis,
    "daily_revenue": daily_revenue,
    "inventory_status": inventory_status,
    "revenue_by_channel": revenue_by_channel,
    "tariff_impact": tariff_impact,
    "store_targets": store_targets,
    "channel_roi": channel_roi,
    "product_margins": product_margins,
    "customer_360": customer_360,
    "quality_nulls": quality_issues(quality.NULLS),
    "quality_negatives": quality_issues(quality.NEGATIVES),
    "quality_future_dates": quality_issues(quality.FUTURE_DATES, "2000-06-01 00:00:00"),
    "quality_duplicates": quality_issues(quality.DUPLICATES),
    "quality_text": quality_text,
    "quality_patterns": quality_issues(quality.BAD_SKUS),
    "load_profiles": load_profiles,
    "health_score": health_score,
    "alert_log": alert_log,
    "validate_rows": validate_rows,
    "quarantine_reasons": quarantine_reasons,
    "file_ingest": file_ingest,
    "relational_load": relational_load,
    "bytes_to_number": bytes_to_number,
    "null_profile": null_profile,
    "load_verification": load_verification,
    "table_counts": table_counts,
    "stream_ingest": stream_ingest,
    "stream_distinct": stream_distinct,
    "run_statistics": run_statistics,
    "success_rate": success_rate,
    "run_series": run_series,
    "newest_n": newest_n,
    "newest_quarantine": newest_of("QUARANTINE_RECORDS", "props AS raw_data"),
    "newest_alerts": newest_of("ALERT_LOG", "event_type AS alert_type"),
    "newest_queries": newest_of("QUERY_HISTORY", "user_id AS rows_returned"),
    "chart_series": chart_series,
    "result_text": result_text,
    "global_rank": global_rank,
    "global_rank_ties": global_rank_ties,
    "running_total": running_total,
    "upsert": upsert,
    "scd2_history": scd2_history,
    "scd2_partitions": scd2_partitions,
    "schema_changes": schema_changes,
    "volume_history": volume_history,
    "distinct_sketches": distinct_sketches,
    "incremental_gold": incremental_gold,
    "bucketed_upsert": bucketed_upsert,
    "hot_key_join": hot_key_join,
    "pipeline_run": pipeline_run,
    "pipeline_rerun": pipeline_rerun,
    "catalog": catalog,
    "check_all": check_all,
    "sync_tables": sync_tables,
    "csv_to_bronze": csv_to_bronze,
    "ask_result": ask_result,
    "pivot": pivot,
    "unpivot": unpivot,
    "lead_dense_rank": lead_dense_rank,
    "stddev": stddev,
    "right_join": right_join,
    "semi_join": semi_join,
    "anti_join": anti_join,
    "date_functions": date_functions,
    "text_functions": text_functions,
    "free_sql": free_sql,
    "ask_top_store": ask(questions.top_store, store_performance),
    "ask_low_stock": ask(questions.low_stock, product_analysis),
    "ask_daily_trend": ask(questions.daily_trend, daily_revenue),
    "ask_negative_margin": ask(questions.negative_margin, product_analysis),
    "ask_store_ranking": ask(questions.store_ranking, store_performance),
    "ask_targets_by_revenue": ask(questions.targets_by_revenue, store_targets),
    "ask_stock_by_alert": ask(questions.stock_by_alert, inventory_status),
    "ask_reorder_need": ask(questions.reorder_need, inventory_status),
    "ask_total_revenue": ask(questions.total_revenue, store_performance),
    "ask_top_products": ask(questions.top_products, product_analysis),
}
