"""Gold kept up to date load by load, from partial aggregates instead of a full rebuild.

A load adds to four layers under one folder, each in a partition of its own, and changes none
that is there: the newest row per order of the load, and three partial aggregates of orders.
Orders that an earlier load brought already are taken out with negative counts and put in
again as they are now, so the sums of a layer over its loads are those of a full rebuild.
Everything the Gold models need is a sum at one of the three grains: what is distinct is
counted as rows whose number of orders is above zero, first and last dates likewise.

A load counts once its commit is written. What an attempt without commit left is overwritten
by the next one, and a load id that is committed is not taken again. Many loads are brought
together by ``compact``. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind import rules
from tradewind.functions.columns import as_of_timestamp, day_of, utc_now
from tradewind.plans import gold, silver
from tradewind.plans.pipeline import Model, Once
from tradewind.rules import TableNames
from tradewind.session import delete_paths, path_exists, stage, staging_scope

COMMITS = "number long, load_id string, kind string, as_of timestamp_ntz"
LOAD, BASE = "load", "base"

SIGN = "_sign"
#: Sums of each layer, by name; all are taken with the sign of the row.
GRAINS: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "visits": (
        ("store_id", "customer_id", "order_date"),
        {"units": "quantity", "revenue": "total_amount"},
    ),
    "products": (
        ("product_sku",),
        {
            "units": "quantity", "revenue": "total_amount", "price_sum": "unit_price",
            "list_value": "quantity * unit_price",
        },
    ),
    "baskets": (("customer_id", "product_sku"), {}),
}
NEWEST = "newest"


def partial(signed: DataFrame, layer: str) -> DataFrame:
    """Sums of signed orders at the grain of ``layer``; what cancels out is left out."""
    keys, sums = GRAINS[layer]
    added = signed.groupBy(*keys).agg(
        F.sum(SIGN).alias("orders"),
        *(F.sum(F.col(SIGN) * F.expr(value)).alias(name) for name, value in sums.items()),
    )
    return added.filter(" OR ".join(f"{c} <> 0" for c in ("orders", *sums)))


@dataclass(frozen=True)
class State:
    """The layers under ``root``, a folder that all executors reach."""

    spark: SparkSession
    root: str

    # What is committed --------------------------------------------------------------

    def commits(self) -> list:
        """Commits in order: a row per load or compaction."""
        path = f"{self.root}/commits"
        if not path_exists(self.spark, path):
            return []
        rows = self.spark.read.schema(COMMITS).parquet(path)
        return sorted(rows.collect(), key=lambda c: c["number"])

    @staticmethod
    def _active(commits: list) -> list[int]:
        """Numbers to read: the last compaction and the loads after it."""
        base = max((c["number"] for c in commits if c["kind"] == BASE), default=0)
        return [c["number"] for c in commits if c["number"] >= base]

    def rows(self, layer: str) -> DataFrame | None:
        """Rows of a layer as the loads wrote them; nothing before the first load."""
        active = self._active(self.commits())
        if not active:
            return None
        return self.spark.read.parquet(f"{self.root}/{layer}").filter(F.col("_load").isin(active))

    def sums(self, layer: str) -> DataFrame:
        """A layer over all loads, without what is not ordered any more."""
        keys, sums = GRAINS[layer]
        rows = self.rows(layer)
        if rows is None:
            raise ValueError(f"no load under {self.root}")
        totals = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("orders", *sums)))
        return totals.filter("orders > 0")

    # Writing --------------------------------------------------------------------------

    def _write(self, rows: DataFrame, layer: str, number: int) -> DataFrame:
        path = f"{self.root}/{layer}/_load={number}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _commit(self, number: int, load_id: str, kind: str, as_of: dt.datetime) -> None:
        row = self.spark.createDataFrame([(number, load_id, kind, as_of)], COMMITS)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def add(
        self, batch: DataFrame, load_id: str, as_of: dt.datetime | str | None = None,
        sku: str = rules.sku_pattern(),
    ) -> bool:
        """Take in raw orders; false if ``load_id`` has been taken before.

        Only orders of the batch, and those whose date has come since the last load, are looked
        up among the earlier ones. ``as_of`` must not go back.
        """
        commits = self.commits()
        if any(c["load_id"] == load_id for c in commits):
            return False
        now = dt.datetime.fromisoformat(str(as_of)) if as_of is not None else utc_now()
        past = commits[-1]["as_of"] if commits else None
        if past is not None and now < past:
            raise ValueError(f"as_of {now} is before that of the last load, {past}")
        number = commits[-1]["number"] + 1 if commits else 1
        earlier = self.rows(NEWEST)
        fresh = self._write(silver.newest_orders(batch), NEWEST, number)
        after, parts = fresh, []
        if earlier is not None:
            due = earlier.filter(
                (F.col("order_date") > as_of_timestamp(past))
                & (F.col("order_date") <= as_of_timestamp(now))
            )
            touched = fresh.select("order_id").union(due.select("order_id")).distinct()
            before = silver.newest_orders(earlier.join(touched, "order_id", "left_semi"))
            after = silver.newest_orders(before.unionByName(fresh))
            parts = [before.filter(silver.valid_order(past, sku)).withColumn(SIGN, F.lit(-1))]
        parts.append(after.filter(silver.valid_order(now, sku)).withColumn(SIGN, F.lit(1)))
        with staging_scope(self.spark):
            signed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            signed, _ = stage(signed, "signed-orders")
            for layer in GRAINS:
                self._write(partial(signed, layer), layer, number)
        self._commit(number, load_id, LOAD, now)
        return True

    def compact(self) -> None:
        """Bring all loads together in one partition per layer, which from then on is read alone."""
        commits = self.commits()
        if len(self._active(commits)) < 2:
            return
        number = commits[-1]["number"] + 1
        self._write(silver.newest_orders(self.rows(NEWEST)), NEWEST, number)
        for layer in GRAINS:
            self._write(self.sums(layer), layer, number)
        self._commit(number, f"{BASE}-{number}", BASE, commits[-1]["as_of"])

    def vacuum(self) -> None:
        """Delete partitions that a compaction replaced; call it when no reader uses them."""
        commits = self.commits()
        active = set(self._active(commits))
        gone = [c["number"] for c in commits if c["number"] not in active]
        delete_paths(self.spark, [
            f"{self.root}/{layer}/_load={n}" for n in gone for layer in (NEWEST, *GRAINS)
        ])

    # What the models start from --------------------------------------------------------

    def sales(self) -> DataFrame:
        """As ``gold.store_customer_sales``."""
        return self.sums("visits").groupBy("store_id", "customer_id").agg(
            F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"),
            F.sum("orders").alias("priced_orders"), F.sum("units").alias("units"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
        )

    def sold(self) -> DataFrame:
        """As ``gold.sku_sales``."""
        return self.sums("products").select(
            "product_sku", "orders", "units", "revenue",
            (F.col("price_sum") / F.col("orders")).alias("avg_price"), "list_value",
        )

    def daily(self) -> DataFrame:
        """As ``gold.daily_sales``: distinct stores and customers are rows at their grain."""
        visits = self.sums("visits").withColumn("order_day", day_of(F.col("order_date")))
        by_store = visits.groupBy("order_day", "store_id").agg(
            *(F.sum(c).alias(c) for c in ("orders", "revenue", "units"))
        ).groupBy("order_day").agg(
            F.sum("orders").alias("total_orders"), F.sum("revenue").alias("revenue"),
            F.count("store_id").alias("active_stores"), F.sum("units").alias("total_units"),
        )
        customers = visits.select("order_day", "customer_id").distinct().groupBy("order_day").agg(
            F.count("customer_id").alias("unique_customers")
        )
        return by_store.join(customers, "order_day").withColumn(
            "avg_order_value", F.col("revenue") / F.col("total_orders")
        )

    def customers(self) -> DataFrame:
        """As ``gold.customer_sales``."""
        by_customer = self.sales().groupBy("customer_id").agg(
            F.sum("orders").alias("total_orders"), F.sum("revenue").alias("lifetime_value"),
            F.min("first_order_date").alias("first_order_date"),
            F.max("last_order_date").alias("last_order_date"),
            F.count("store_id").alias("stores_visited"),
            F.sum("units").alias("total_units_purchased"),
        ).withColumn("avg_order_value", F.col("lifetime_value") / F.col("total_orders"))
        bought = self.sums("baskets").groupBy("customer_id").agg(
            F.count("product_sku").alias("unique_products_bought")
        )
        return by_customer.join(bought, "customer_id")


def models(
    state: State, inventory: Callable[[], DataFrame], stores: Callable[[], DataFrame], as_of=None,
    names: TableNames = TableNames(),
) -> list[Model]:
    """The Gold models over what is committed, for ``pipeline.run_models``."""
    sales, sold = Once(state.sales, "sales"), Once(state.sold, "sold")

    def model(table: str, build: Callable[[], DataFrame]) -> Model:
        return Model("GOLD", table, build)

    return [
        model(names.gold("store_performance"),
              lambda: gold.store_performance(sales(), stores(), as_of)),
        model(names.gold("product_analysis"),
              lambda: gold.product_analysis_of(sold(), inventory(), as_of)),
        model(names.gold("daily_revenue"), lambda: gold.daily_revenue_of(state.daily(), as_of)),
        model(names.gold("inventory_status"),
              lambda: gold.inventory_status(inventory(), stores(), as_of)),
        model(names.brand_gold("revenue_by_channel"),
              lambda: gold.revenue_by_channel(sales(), stores(), as_of)),
        model(names.brand_gold("tariff_impact"),
              lambda: gold.tariff_impact(sales(), stores(), as_of)),
        model(names.brand_gold("store_performance"),
              lambda: gold.store_targets(sales(), stores(), as_of)),
        model(names.brand_gold("marketing_roi"),
              lambda: gold.channel_roi(sales(), stores(), as_of)),
        model(names.brand_gold("product_margins"),
              lambda: gold.product_margins_of(sold(), inventory(), as_of)),
        model(names.brand_gold("customer_360"),
              lambda: gold.customer_360_of(state.customers(), as_of)),
    ]
