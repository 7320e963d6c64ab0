"""Bronze to Silver to Gold, and the checks in between."""

from __future__ import annotations

import datetime as dt
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind import rules
from tradewind.functions.columns import utc_now
from tradewind.operators import history, quality
from tradewind.plans import gold, silver
from tradewind.rules import TableNames
from tradewind.session import stage, staging_scope
from tradewind.sources import ops, warehouse


@dataclass(frozen=True)
class Model:
    layer: str
    table: str
    build: Callable[[], DataFrame]
    #: Tables that ``build`` reads.
    inputs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Options:
    """Choices of the models; by default they compute what the reports were made for."""

    #: Keep the newest load of a store only.
    dedup_stores: bool = False
    #: Multiply the orders of a SKU by its stock rows in the margins.
    stock_fanout: bool = True
    tariff_rates: dict[str, float] = field(default_factory=lambda: dict(rules.TARIFF_RATES))


class Once:
    """A DataFrame staged the first time a model asks for it."""

    def __init__(self, build: Callable[[], DataFrame], label: str):
        self._build, self._label, self._staged = build, label, None
        self._lock = threading.Lock()

    def __call__(self) -> DataFrame:
        with self._lock:
            if self._staged is None:
                self._staged, _ = stage(self._build(), self._label)
        return self._staged


def models(
    spark: SparkSession, as_of=None, names: TableNames = TableNames(), options: Options = Options()
) -> list[Model]:
    """All models in dependency order. Gold reads the written Silver tables.

    Five Gold models share one staged aggregate of the orders per store and
    customer, so the orders are shuffled for them once.
    """
    def orders() -> DataFrame:
        return spark.table(names.silver("orders"))

    def inventory() -> DataFrame:
        return spark.table(names.silver("inventory"))

    def stores() -> DataFrame:
        return spark.table(names.silver("stores"))

    def bronze(entity: str) -> DataFrame:
        return spark.table(names.bronze(entity))

    sales = Once(lambda: gold.store_customer_sales(orders()), "sales")
    def silver_model(entity: str, build: Callable[[], DataFrame]) -> Model:
        return Model("SILVER", names.silver(entity), build, (names.bronze(entity),))

    def gold_model(table: str, build: Callable[[], DataFrame], *entities: str) -> Model:
        return Model("GOLD", table, build, tuple(map(names.silver, entities)))

    by_store, by_stock = ("orders", "stores"), ("orders", "inventory")
    return [
        silver_model("stores", lambda: silver.silver_stores(
            bronze("stores"), as_of, options.dedup_stores)),
        silver_model("orders", lambda: silver.silver_orders(
            bronze("orders"), as_of, rules.sku_pattern(names.code))),
        silver_model("inventory", lambda: silver.silver_inventory(bronze("inventory"), as_of)),
        gold_model(names.gold("store_performance"),
                   lambda: gold.store_performance(sales(), stores(), as_of), *by_store),
        gold_model(names.gold("product_analysis"),
                   lambda: gold.product_analysis(orders(), inventory(), as_of), *by_stock),
        gold_model(names.gold("daily_revenue"),
                   lambda: gold.daily_revenue(orders(), as_of), "orders"),
        gold_model(names.gold("inventory_status"),
                   lambda: gold.inventory_status(inventory(), stores(), as_of), "inventory", "stores"),
        gold_model(names.brand_gold("revenue_by_channel"),
                   lambda: gold.revenue_by_channel(sales(), stores(), as_of), *by_store),
        gold_model(names.brand_gold("tariff_impact"),
                   lambda: gold.tariff_impact(sales(), stores(), as_of, options.tariff_rates),
                   *by_store),
        gold_model(names.brand_gold("store_performance"),
                   lambda: gold.store_targets(sales(), stores(), as_of), *by_store),
        gold_model(names.brand_gold("marketing_roi"),
                   lambda: gold.channel_roi(sales(), stores(), as_of), *by_store),
        gold_model(names.brand_gold("product_margins"),
                   lambda: gold.product_margins(orders(), inventory(), as_of, options.stock_fanout),
                   *by_stock),
        gold_model(names.brand_gold("customer_360"),
                   lambda: gold.customer_360(orders(), as_of), "orders"),
    ]


def run_model(model: Model) -> dict:
    start = time.monotonic()
    outcome = {"table": model.table, "layer": model.layer}
    try:
        rows = warehouse.replace(model.build(), model.table)
        outcome |= {"status": "SUCCESS", "records": rows}
    except Exception as failure:  # one failed model must not stop the others
        outcome |= {"status": "FAILED", "records": 0, "error": str(failure)[:500]}
    return outcome | {"duration_seconds": round(time.monotonic() - start, 3)}


def run_all(
    spark: SparkSession, as_of=None, names: TableNames = TableNames(), parallel: int = 4,
    options: Options = Options(),
) -> dict:
    """Build every model, Silver before Gold; ``partial`` when some failed."""
    create_product_history(spark, names.product_history)
    return run_models(spark, models(spark, as_of, names, options), parallel)


def run_models(spark: SparkSession, planned: list[Model], parallel: int = 4) -> dict:
    """Build ``planned`` layer by layer and report on each.

    Models of a layer do not depend on each other, so their Spark jobs are
    submitted ``parallel`` at a time and one model's last tasks leave no core idle.
    """
    start = time.monotonic()
    outcomes = []
    with staging_scope(spark), ThreadPoolExecutor(parallel) as submit:
        for layer in ("SILVER", "GOLD"):
            running = [
                submit.submit(copy_context().run, run_model, m)
                for m in planned
                if m.layer == layer
            ]
            outcomes += [r.result() for r in running]
    done = [o for o in outcomes if o["status"] == "SUCCESS"]
    failed = [o for o in outcomes if o["status"] != "SUCCESS"]
    return {
        "status": "partial" if failed else "success",
        "run_id": uuid.uuid4().hex[:8],
        "total_duration_seconds": round(time.monotonic() - start, 3),
        "models_succeeded": len(done),
        "models_failed": len(failed),
        "silver_tables": [o for o in done if o["layer"] == "SILVER"],
        "gold_tables": [o for o in done if o["layer"] == "GOLD"],
        "errors": failed,
    }


#: Partition of the versions that are valid now; all others are closed for good.
OPEN, PERIOD = "open", "_period"


def create_product_history(spark: SparkSession, table: str) -> None:
    """The history table, partitioned by the snapshot that closed a version."""
    if not spark.catalog.tableExists(table):
        empty = spark.createDataFrame([], f"{ops.PRODUCT_HISTORY}, {PERIOD} string")
        empty.write.format("parquet").partitionBy(PERIOD).saveAsTable(table)


def record_products(
    spark: SparkSession, snapshot: DataFrame, at=None, names: TableNames = TableNames(),
    close_missing: bool = False,
) -> int:
    """Bring the product history table up to ``snapshot``, one row per SKU; rows it has then.

    Only open versions are read and written again. What the snapshot closes goes into a partition
    of its own first, then the open partition is replaced; a call that failed in between is
    simply made again. A table without partitions, as older versions made it, is rewritten whole.
    """
    table = names.product_history
    create_product_history(spark, table)
    past = spark.table(table)
    if PERIOD not in past.columns:
        return warehouse.swap(history.apply_snapshot(past, snapshot, at, close_missing), table)
    moment = dt.datetime.fromisoformat(str(at)) if at is not None else utc_now()
    period = moment.strftime("%Y%m%dT%H%M%S%f")
    current = past.filter(F.col(PERIOD) == OPEN).drop(PERIOD)
    with staging_scope(spark):
        versions, _ = stage(
            history.apply_snapshot(current, snapshot, moment, close_missing), "products"
        )
        ended, still_open = versions.agg(
            F.count_if(~F.col("is_current")), F.count_if(F.col("is_current"))
        ).first()
        if ended:
            closed = versions.filter("NOT is_current").withColumn(PERIOD, F.lit(period))
            same_moment = past.filter(F.col(PERIOD) == period).join(
                closed.select("surrogate_key"), "surrogate_key", "left_anti"
            )
            warehouse.overwrite_partitions(closed.unionByName(same_moment), table, PERIOD)
        if still_open:
            warehouse.overwrite_partitions(
                versions.filter("is_current").withColumn(PERIOD, F.lit(OPEN)), table, PERIOD
            )
        else:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({PERIOD} = '{OPEN}')")
    return spark.table(table).count()


def status(spark: SparkSession, names: TableNames = TableNames()) -> DataFrame:
    return warehouse.layer_status(spark, {m.table: m.layer for m in models(spark, names=names)})


def check_quality(
    spark: SparkSession, tables: list[str], as_of=None, logged_at: dt.datetime | None = None,
    code: str = rules.PRODUCT_CODE,
) -> DataFrame:
    """Check Bronze tables, log an alert per issue, return health per table."""
    if not tables:
        return spark.createDataFrame([], quality.HEALTH_SCHEMA)
    checked = quality.check_tables(
        {t: spark.table(t) for t in tables}, as_of, sku=rules.sku_pattern(code)
    )
    with staging_scope(spark):
        counts, _ = stage(checked, "checks")
        ops.append(quality.alerts(quality.issues(counts, code), logged_at), "ALERT_LOG")
        health = quality.health(counts)
        # a row per table, so that the staged counts can go
        return spark.createDataFrame(health.collect(), health.schema)


def check_all_bronze(
    spark: SparkSession, as_of=None, code: str = rules.PRODUCT_CODE
) -> DataFrame:
    return check_quality(spark, warehouse.names(spark, "BRZ_"), as_of, code=code)
