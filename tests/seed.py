"""A small shop: five stores, ten stock rows, ten orders, with known results."""

AS_OF = "2026-04-30 00:00:00"
LOADED = "2026-04-20 00:00:00"

STORES = [
    (1, "Store 1", "New York", "NY", "USA", "Flagship", 150000.0, 1),
    (2, "Store 2", "Los Angeles", "CA", "USA", "Standard", 120000.0, 1),
    (3, "Store 3", "Chicago", "IL", "USA", "Standard", 90000.0, 1),
    (4, "Store 4", "Houston", "TX", "USA", "Standard", 85000.0, 1),
    (5, "Store 5", "Miami", "FL", "USA", "Premium", 110000.0, 1),
]
STORE_SCHEMA = (
    "store_id bigint, store_name string, city string, state string, country string, "
    "store_type string, monthly_target double, is_active bigint"
)
INVENTORY = [
    (1, 1, "ELF-83428", "Item A", 450, 100, 5.5), (2, 1, "ELF-83729", "Item B", 320, 80, 7.0),
    (3, 2, "ELF-82416", "Item C", 380, 90, 6.0), (4, 2, "ELF-84024", "Item D", 240, 60, 7.5),
    (5, 3, "ELF-81788", "Item E", 550, 120, 5.0), (6, 3, "ELF-83331", "Item F", 400, 100, 4.0),
    (7, 4, "ELF-84201", "Item G", 340, 80, 5.0), (8, 5, "ELF-83025", "Item H", 280, 70, 4.0),
    (9, 1, "ELF-84024", "Item D", 15, 60, 7.5), (10, 4, "ELF-83428", "Item A", 8, 100, 5.5),
]
INVENTORY_SCHEMA = (
    "inventory_id bigint, store_id bigint, product_sku string, product_name string, "
    "quantity_on_hand bigint, reorder_point bigint, unit_cost double"
)
ORDERS = [
    (1001, 1, 501, "2026-04-09 10:23:00", "ELF-83428", 2, 10.0, 20.0, "COMPLETED"),
    (1002, 1, 502, "2026-04-09 11:45:00", "ELF-83729", 1, 14.0, 14.0, "COMPLETED"),
    (1003, 2, 503, "2026-04-09 12:30:00", "ELF-82416", 3, 12.0, 36.0, "COMPLETED"),
    (1004, 2, 504, "2026-04-09 14:15:00", "ELF-84024", 2, 15.0, 30.0, "COMPLETED"),
    (1005, 3, 505, "2026-04-09 15:00:00", "ELF-81788", 1, 10.0, 10.0, "COMPLETED"),
    (1006, 3, 506, "2026-04-10 09:30:00", "ELF-83331", 4, 8.0, 32.0, "COMPLETED"),
    (1007, 4, 507, "2026-04-10 10:45:00", "ELF-84201", 2, 10.0, 20.0, "COMPLETED"),
    (1008, 5, 508, "2026-04-10 11:20:00", "ELF-83025", 3, 8.0, 24.0, "COMPLETED"),
    (1009, 1, 509, "2026-04-10 13:00:00", "ELF-83428", 1, 10.0, 10.0, "PENDING"),
    (1010, 2, 510, "2026-04-10 14:30:00", "ELF-83729", 2, 14.0, 28.0, "COMPLETED"),
]
ORDER_SCHEMA = (
    "order_id bigint, store_id bigint, customer_id bigint, order_date string, "
    "product_sku string, quantity bigint, unit_price double, total_amount double, "
    "order_status string"
)


def _frame(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    if "order_date" in df.columns:
        df = df.selectExpr(
            *(f"cast({c} as timestamp_ntz) {c}" if c == "order_date" else c for c in df.columns)
        )
    return df


def source_tables(spark):
    return {
        "stores": _frame(spark, STORES, STORE_SCHEMA),
        "inventory": _frame(spark, INVENTORY, INVENTORY_SCHEMA),
        "orders": _frame(spark, ORDERS, ORDER_SCHEMA),
    }


def bronze_tables(spark, syncs=1):
    """The source tables as loaded by one or more syncs."""
    tables = {}
    for name, df in source_tables(spark).items():
        loads = None
        for run in range(syncs):
            load = df.selectExpr(
                "*",
                "'SEED' as _source",
                f"cast('{LOADED}' as timestamp_ntz) + make_dt_interval({run}) as _loaded_at",
                f"'run{run}' as _run_id",
            )
            loads = load if loads is None else loads.unionByName(load)
        tables[name] = loads
    return tables
