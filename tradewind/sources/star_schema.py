"""Bronze retail tables derived from a star-schema dataset of Parquet files.

Line items become orders, suppliers become stores and parts become stock rows.
Defects (missing stores, bad SKUs, negative quantities, repeated loads) follow
from the keys, so the checks and filters downstream have something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.rules import PRODUCT_CODE

AS_OF = "2001-08-01 00:00:00"


# Declared, so that opening a table does not start a job to read file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _lineage(source: str, loaded_at: Column) -> list[Column]:
    return [
        F.lit(source).alias("_source"),
        loaded_at.alias("_loaded_at"),
        F.lit("seed42").alias("_run_id"),
    ]


def _padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 5, "0")


def bronze_orders(spark: SparkSession, folder: str) -> DataFrame:
    key, supplier = F.col("l_orderkey"), F.col("l_suppkey")
    code = F.when(key % 97 == 0, "BAD-").otherwise(f"{PRODUCT_CODE}-")
    lines = table(spark, folder, "lineitem")
    heads = table(spark, folder, "orders")
    return lines.join(heads, lines.l_orderkey == heads.o_orderkey).select(
        (key * 8 + F.col("l_linenumber")).alias("order_id"),
        F.when(supplier % 10 != 9, supplier).alias("store_id"),
        F.when(key % 83 != 0, F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.concat(code, _padded(F.col("l_partkey"))).alias("product_sku"),
        F.when(key % 89 == 0, -F.col("l_quantity"))
        .otherwise(F.col("l_quantity"))
        .cast("long")
        .alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity") * 0.01).alias("unit_price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * 0.01).alias("total_amount"),
        F.col("o_orderstatus").alias("order_status"),
        *_lineage("SYNTH_ORDERS", F.col("l_shipdate")),
    )


def bronze_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Five loads per part; the fifth repeats the stock row of the first."""
    key, load = F.col("p_partkey"), F.col("load")
    stores = table(spark, folder, "supplier").agg(F.count(F.lit(1))).scalar()
    parts = table(spark, folder, "part").withColumn(
        "load", F.explode(F.sequence(F.lit(0), F.lit(4)))
    )
    part_number = F.when(key % 17 == 0, 90000 + key % 10000).otherwise(key)
    return parts.select(
        (key * 4 + load % 4).alias("inventory_id"),
        ((key * 7 + load * 13) % stores).alias("store_id"),
        F.when(
            key % 13 != 0, F.concat(F.lit(f"{PRODUCT_CODE}-"), _padded(part_number))
        ).alias("product_sku"),
        F.when(key % 101 == 0, "  ").otherwise(F.col("p_name")).alias("product_name"),
        F.when(key % 103 == 0, -1)
        .otherwise((key * 31 + load * 17) % 250)
        .cast("long")
        .alias("quantity_on_hand"),
        (60 + (key % 5) * 10).alias("reorder_point"),
        (F.col("p_retailprice") * 0.05).alias("unit_cost"),
        *_lineage(
            "SYNTH_INVENTORY",
            F.lit("2001-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(load),
        ),
    )


def bronze_stores(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region")
    suppliers = table(spark, folder, "supplier")
    # The two small tables first: suppliers are then shuffled once at most.
    places = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    kinds = F.array(*map(F.lit, ("Flagship", "Standard", "Premium", "Outlet")))
    return (
        suppliers.join(places, suppliers.s_nationkey == places.n_nationkey)
        .select(
            F.col("s_suppkey").alias("store_id"),
            F.col("s_name").alias("store_name"),
            F.col("n_name").alias("city"),
            F.col("n_name").alias("state"),
            F.when(F.col("r_name") == "AMERICA", "USA")
            .when(F.col("r_name") == "ASIA", "CHINA")
            .otherwise(F.col("r_name"))
            .alias("country"),
            F.element_at(kinds, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("store_type"),
            (F.greatest(F.col("s_acctbal"), F.lit(0.0)) * 50).alias("monthly_target"),
            (F.col("s_acctbal") >= 0).cast("long").alias("is_active"),
            *_lineage("SYNTH_STORES", F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")),
        )
    )
