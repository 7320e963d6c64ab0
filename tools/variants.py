"""Time alternative plans for the same result, interleaved, median of three.

    python tools/variants.py [folder]
"""

from __future__ import annotations

import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from registry import queries as q  # noqa: E402
from tradewind.operators import quality, ranking  # noqa: E402
from tradewind.plans import gold, pipeline, silver  # noqa: E402
from tradewind.rules import TableNames  # noqa: E402
from tradewind.session import local_session  # noqa: E402
from tradewind.sources import star_schema as star  # noqa: E402
from tradewind.sources import warehouse  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def dedup_by_window(bronze):
    newest_first = Window.partitionBy("order_id").orderBy(F.col("_loaded_at").desc_nulls_first())
    rows = bronze.select(*silver.ORDER_COLUMNS).filter("order_id is not null")
    return rows.withColumn("n", F.row_number().over(newest_first)).filter("n = 1")


def margins_by_join(orders, inventory):
    joined = orders.join(inventory.drop("store_id"), "product_sku", "left")
    return joined.groupBy("product_sku").agg(
        F.max("product_name"), F.count_distinct("order_id"), F.sum("quantity"),
        F.avg("unit_price"), F.avg("unit_cost"), F.sum("total_amount"),
        F.sum(F.col("quantity") * (F.col("unit_price") - F.coalesce("unit_cost", F.lit(0.0)))),
    ).withColumn("r", F.rank().over(Window.orderBy(F.col("sum(total_amount)").desc())))


def customer_values(orders):
    return orders.groupBy("customer_id").agg(F.sum("total_amount").alias("value"))


def plain_rank(df):
    return df.withColumn("r", F.rank().over(Window.orderBy(F.col("value").desc_nulls_first())))


def check_by_check(df) -> None:
    for column in quality.business_columns(df):
        df.filter(F.col(column).isNull()).count()
    for column in ("quantity", "unit_price", "total_amount"):
        df.filter(F.col(column) < 0).count()
    df.filter(F.col("order_date") > F.lit(q.AS_OF).cast("timestamp_ntz")).count()
    df.groupBy("order_id").count().filter("count > 1").count()
    df.filter(~F.col("product_sku").rlike(r"^ELF-[0-9]{5}$")).count()


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="run-")
    spark = local_session(8, "tradewind-variants", **{"spark.sql.warehouse.dir": scratch})
    names = TableNames()
    for entity, build in (("orders", star.bronze_orders), ("inventory", star.bronze_inventory),
                          ("stores", star.bronze_stores)):
        warehouse.replace(build(spark, folder), names.bronze(entity))
    bronze = spark.table(names.bronze("orders"))
    reports = []

    def whole():
        reports.append(pipeline.run_all(spark, q.AS_OF))

    whole()

    def orders():
        return spark.table(names.silver("orders"))

    def inventory():
        return spark.table(names.silver("inventory"))

    variants = {
        "dedup: maximum of the row": lambda: run(silver.silver_orders(bronze, q.AS_OF)),
        "dedup: row_number": lambda: run(dedup_by_window(bronze)),
        "margins: aggregate, then join": lambda: run(
            gold.product_margins(orders(), inventory(), q.AS_OF)),
        "margins: join, then aggregate": lambda: run(margins_by_join(orders(), inventory())),
        "customer rank: staged ranges": lambda: run(
            ranking.global_rank(customer_values(orders()), "value", "r")),
        "customer rank: one window": lambda: run(plain_rank(customer_values(orders()))),
        "quality: one pass": lambda: run(quality.check_counts(bronze, "T", q.AS_OF)),
        "quality: query per check": lambda: check_by_check(bronze),
        "whole pipeline": whole,
    }
    times: dict[str, list[float]] = {name: [] for name in variants}
    for _ in range(4):
        for name, action in variants.items():
            start = time.perf_counter()
            action()
            times[name].append(time.perf_counter() - start)
    for name, taken in times.items():
        print(f"| {name} | {statistics.median(taken[1:]):.2f} s |")
    for outcome in (*reports[-1]["silver_tables"], *reports[-1]["gold_tables"]):
        print(f"| {outcome['table']} | {outcome['records']} | {outcome['duration_seconds']} s |")


if __name__ == "__main__":
    main()
