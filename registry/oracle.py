"""DuckDB statements that state, naively, what each registered query must return.

They join first and aggregate afterwards, and rank with one plain window, so
they share no shortcut with the Spark plans they check.
"""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"


def half_up(value: str, digits: int) -> str:
    """Round the decimal digits of a double, as Spark does. DuckDB's own ``round``
    multiplies first, which can turn 4094.6549999999997 into a tie."""
    decimal = f"CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 18))"
    return f"CAST(round({decimal}, {digits}) AS DOUBLE)"


SNAPSHOTS = """
    snapshots AS (
        SELECT 'P-' || p_partkey AS product_sku, p_name AS product_name, p_type AS category,
               p_retailprice AS price, p_partkey % 50 AS stock_quantity,
               p_retailprice + CASE WHEN p_partkey % 5 = 0 THEN 10 ELSE 0 END AS later_price,
               p_partkey % 50 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS later_stock,
               p_size > 5 AS in_first, p_size < 45 AS in_second,
               p_partkey % 5 = 0 OR p_partkey % 7 = 0 AS differs
        FROM part)"""

# Named inputs. Each may refer to the ones above it.
INPUTS: dict[str, str] = {
    "bronze_orders": """
        SELECT l_orderkey * 8 + l_linenumber AS order_id,
               CASE WHEN l_suppkey % 10 = 9 THEN NULL ELSE l_suppkey END AS store_id,
               CASE WHEN l_orderkey % 83 = 0 THEN NULL ELSE o_custkey END AS customer_id,
               o_orderdate AS order_date,
               (CASE WHEN l_orderkey % 97 = 0 THEN 'BAD-' ELSE 'ELF-' END)
                   || lpad(CAST(l_partkey AS VARCHAR), 5, '0') AS product_sku,
               CAST(CASE WHEN l_orderkey % 89 = 0 THEN -l_quantity ELSE l_quantity END
                    AS BIGINT) AS quantity,
               l_extendedprice / l_quantity * 0.01 AS unit_price,
               l_extendedprice * (1 - l_discount) * 0.01 AS total_amount,
               o_orderstatus AS order_status,
               'SYNTH_ORDERS' AS _source, l_shipdate AS _loaded_at, 'seed42' AS _run_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "bronze_inventory": """
        SELECT p_partkey * 4 + k % 4 AS inventory_id,
               (p_partkey * 7 + k * 13) % (SELECT count(*) FROM supplier) AS store_id,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 'ELF-' || lpad(CAST(
                   CASE WHEN p_partkey % 17 = 0 THEN 90000 + p_partkey % 10000
                        ELSE p_partkey END AS VARCHAR), 5, '0') END AS product_sku,
               CASE WHEN p_partkey % 101 = 0 THEN '  ' ELSE p_name END AS product_name,
               CAST(CASE WHEN p_partkey % 103 = 0 THEN -1
                    ELSE (p_partkey * 31 + k * 17) % 250 END AS BIGINT) AS quantity_on_hand,
               60 + (p_partkey % 5) * 10 AS reorder_point,
               p_retailprice * 0.05 AS unit_cost,
               'SYNTH_INVENTORY' AS _source,
               TIMESTAMP '2001-01-01' + to_days(CAST(k AS INTEGER)) AS _loaded_at,
               'seed42' AS _run_id
        FROM (SELECT part.*, unnest([0, 1, 2, 3, 4]) AS k FROM part)""",
    "bronze_stores": """
        SELECT s_suppkey AS store_id, s_name AS store_name, n_name AS city, n_name AS state,
               CASE r_name WHEN 'AMERICA' THEN 'USA' WHEN 'ASIA' THEN 'CHINA' ELSE r_name END
                   AS country,
               CASE s_suppkey % 4 WHEN 0 THEN 'Flagship' WHEN 1 THEN 'Standard'
                    WHEN 2 THEN 'Premium' ELSE 'Outlet' END AS store_type,
               greatest(s_acctbal, 0) * 50 AS monthly_target,
               CAST(s_acctbal >= 0 AS BIGINT) AS is_active,
               'SYNTH_STORES' AS _source, TIMESTAMP '2001-01-01' AS _loaded_at,
               'seed42' AS _run_id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "product_history": f"""
        WITH {SNAPSHOTS}
        SELECT product_sku, product_name, category, price, stock_quantity,
               TIMESTAMP '2001-01-01' AS valid_from,
               CASE WHEN NOT in_second OR differs THEN TIMESTAMP '2001-02-01' END AS valid_to,
               in_second AND NOT differs AS is_current, 'SYNTH_PARTS' AS _source,
               TIMESTAMP '2001-01-01' AS _loaded_at
        FROM snapshots WHERE in_first
        UNION ALL
        SELECT product_sku, product_name, category, later_price, later_stock,
               TIMESTAMP '2001-02-01', NULL, true, 'SYNTH_PARTS', TIMESTAMP '2001-02-01'
        FROM snapshots WHERE in_second AND (differs OR NOT in_first)""",
    "newest_orders": """
        SELECT * FROM bronze_orders WHERE order_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY order_id
            ORDER BY _loaded_at DESC NULLS FIRST, total_amount DESC NULLS LAST,
            store_id DESC NULLS LAST, customer_id DESC NULLS LAST,
            order_date DESC NULLS LAST, product_sku DESC NULLS LAST,
            quantity DESC NULLS LAST, unit_price DESC NULLS LAST,
            order_status DESC NULLS LAST) = 1""",
    "silver_orders": f"""
        SELECT order_id, store_id, customer_id, order_date, product_sku, quantity, unit_price,
               total_amount, order_status, _source, _loaded_at, _run_id,
               {AS_OF} AS _silver_loaded_at
        FROM newest_orders
        WHERE store_id IS NOT NULL AND customer_id IS NOT NULL AND order_date <= {AS_OF}
          AND least(quantity, unit_price, total_amount) > 0
          AND regexp_full_match(product_sku, 'ELF-[0-9]{{5}}')""",
    "silver_inventory": f"""
        SELECT inventory_id, store_id, product_sku, product_name, quantity_on_hand,
               reorder_point, unit_cost, _source, _loaded_at, _run_id,
               {AS_OF} AS _silver_loaded_at
        FROM (SELECT * FROM bronze_inventory WHERE inventory_id IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY inventory_id
                  ORDER BY _loaded_at DESC NULLS FIRST, store_id DESC NULLS LAST,
                  product_sku DESC NULLS LAST, product_name DESC NULLS LAST,
                  quantity_on_hand DESC NULLS LAST, reorder_point DESC NULLS LAST,
                  unit_cost DESC NULLS LAST) = 1)
        WHERE product_sku IS NOT NULL AND store_id IS NOT NULL
          AND trim(product_name) <> '' AND quantity_on_hand >= 0 AND unit_cost > 0""",
    "silver_stores": f"""
        SELECT store_id, store_name, city, state, country, store_type, monthly_target,
               is_active, _source, _loaded_at, {AS_OF} AS _silver_loaded_at
        FROM bronze_stores WHERE store_id IS NOT NULL AND trim(store_name) <> ''""",
    "sold": """
        SELECT s.*, o.order_id, o.customer_id, o.order_date, o.quantity, o.total_amount
        FROM silver_orders o JOIN silver_stores s USING (store_id)""",
    "store_performance": """
        SELECT store_id, store_name, city, state, store_type, monthly_target,
               count(order_id) AS total_orders,
               round(sum(total_amount), 2) AS total_revenue,
               round(avg(total_amount), 2) AS avg_order_value,
               count(DISTINCT customer_id) AS unique_customers,
               CAST(sum(quantity) AS BIGINT) AS total_units_sold,
               min(order_date) AS first_order_date, max(order_date) AS last_order_date,
               round(sum(total_amount) / nullif(monthly_target, 0) * 100, 1) AS target_pct,
               rank() OVER (ORDER BY sum(total_amount) DESC NULLS FIRST) AS revenue_rank
        FROM sold GROUP BY store_id, store_name, city, state, store_type, monthly_target""",
    "product_analysis": """
        SELECT coalesce(o.product_sku, i.product_sku) AS product_sku, product_name,
               coalesce(n, 0) AS total_orders, coalesce(units, 0) AS total_units_sold,
               round(coalesce(revenue, 0), 2) AS total_revenue,
               round(coalesce(price, 0), 2) AS avg_selling_price,
               coalesce(stock, 0) AS current_stock, round(coalesce(cost, 0), 2) AS avg_unit_cost,
               coalesce(reorder, 0) AS reorder_point,
               round(coalesce(price, 0) - coalesce(cost, 0), 2) AS unit_margin,
               round((price - coalesce(cost, 0)) / nullif(price, 0) * 100, 1) AS margin_pct,
               CASE WHEN coalesce(stock, 0) = 0 THEN 'OUT_OF_STOCK'
                    WHEN stock <= coalesce(reorder, 0) THEN 'LOW_STOCK'
                    ELSE 'IN_STOCK' END AS stock_status,
               rank() OVER (ORDER BY coalesce(revenue, 0) DESC) AS revenue_rank
        FROM (SELECT product_sku, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS units,
                     sum(total_amount) AS revenue, avg(unit_price) AS price
              FROM silver_orders GROUP BY 1) o
        FULL JOIN (SELECT product_sku, max(product_name) AS product_name,
                          CAST(sum(quantity_on_hand) AS BIGINT) AS stock,
                          avg(unit_cost) AS cost, min(reorder_point) AS reorder
                   FROM silver_inventory GROUP BY 1) i ON o.product_sku = i.product_sku""",
    "per_day": """
        SELECT CAST(date_trunc('day', order_date) AS TIMESTAMP) AS order_day,
               count(*) AS n, sum(total_amount) AS revenue, avg(total_amount) AS average,
               count(DISTINCT store_id) AS stores, count(DISTINCT customer_id) AS customers,
               CAST(sum(quantity) AS BIGINT) AS units
        FROM silver_orders GROUP BY 1""",
    "daily_revenue": """
        SELECT order_day, n AS total_orders, round(revenue, 2) AS daily_revenue,
               round(average, 2) AS avg_order_value, stores AS active_stores,
               customers AS unique_customers, units AS total_units,
               round(sum(revenue) OVER (ORDER BY order_day ROWS UNBOUNDED PRECEDING), 2)
                   AS cumulative_revenue,
               round(lag(revenue) OVER (ORDER BY order_day), 2) AS prev_day_revenue,
               round((revenue / lag(revenue) OVER (ORDER BY order_day) - 1) * 100, 1)
                   AS day_over_day_growth_pct
        FROM per_day""",
    "inventory_status": f"""
        SELECT inventory_id, i.store_id, store_name, city, product_sku, product_name,
               quantity_on_hand, reorder_point, unit_cost,
               {half_up('quantity_on_hand * unit_cost', 2)} AS stock_value,
               CASE WHEN quantity_on_hand = 0 THEN 'OUT_OF_STOCK'
                    WHEN quantity_on_hand <= reorder_point THEN 'REORDER_NOW'
                    WHEN quantity_on_hand <= reorder_point * 1.5 THEN 'LOW_STOCK'
                    ELSE 'HEALTHY' END AS stock_alert,
               CASE stock_alert WHEN 'OUT_OF_STOCK' THEN 'CRITICAL' WHEN 'REORDER_NOW'
                    THEN 'HIGH' WHEN 'LOW_STOCK' THEN 'MEDIUM' ELSE 'LOW' END AS alert_severity
        FROM silver_inventory i JOIN silver_stores s ON i.store_id = s.store_id""",
    "revenue_by_channel": """
        SELECT store_type AS channel, count(DISTINCT order_id) AS total_orders,
               round(sum(total_amount), 2) AS total_revenue,
               round(avg(total_amount), 2) AS avg_order_value,
               count(DISTINCT customer_id) AS unique_customers,
               CAST(sum(quantity) AS BIGINT) AS total_units_sold,
               round(sum(total_amount) / (SELECT sum(total_amount) FROM sold) * 100, 2)
                   AS revenue_share_pct
        FROM sold GROUP BY 1""",
    "tariff_impact": """
        SELECT country, store_type, count(DISTINCT order_id) AS total_orders,
               round(sum(total_amount), 2) AS total_revenue,
               round(avg(total_amount), 2) AS avg_order_value,
               round(sum(total_amount) * 0.15, 2) AS estimated_tariff_cost,
               round(sum(total_amount) * 0.85, 2) AS revenue_after_tariff,
               round(sum(total_amount) * 0.60, 2) AS high_tariff_scenario,
               round(sum(total_amount) * 0.40, 2) AS revenue_after_high_tariff,
               CASE country WHEN 'USA' THEN 'HIGH_RISK' WHEN 'CHINA' THEN 'CRITICAL_RISK'
                    ELSE 'LOW_RISK' END AS tariff_risk_level
        FROM sold GROUP BY country, store_type""",
    "store_targets": """
        SELECT store_id, store_name, city, state, country, store_type, monthly_target,
               count(DISTINCT order_id) AS total_orders,
               round(sum(total_amount), 6) AS actual_revenue,
               round(monthly_target - sum(total_amount), 2) AS target_gap,
               round(sum(total_amount) / nullif(monthly_target, 0) * 100, 2)
                   AS target_achievement_pct,
               count(DISTINCT customer_id) AS unique_customers,
               round(avg(total_amount), 2) AS avg_order_value,
               rank() OVER (ORDER BY sum(total_amount) DESC NULLS FIRST) AS revenue_rank,
               CASE WHEN sum(total_amount) >= monthly_target THEN 'ON_TRACK'
                    WHEN sum(total_amount) >= monthly_target * 0.8 THEN 'AT_RISK'
                    ELSE 'BELOW_TARGET' END AS performance_status
        FROM silver_stores s LEFT JOIN silver_orders o USING (store_id)
        GROUP BY store_id, store_name, city, state, country, store_type, monthly_target""",
    "channel_roi": """
        SELECT store_type AS channel, state AS region, country,
               count(DISTINCT customer_id) AS total_customers,
               count(DISTINCT order_id) AS total_orders,
               round(sum(total_amount), 2) AS total_revenue,
               round(avg(total_amount), 2) AS avg_order_value,
               round(count(DISTINCT order_id) / count(DISTINCT customer_id), 2)
                   AS orders_per_customer,
               round(sum(total_amount) / count(DISTINCT customer_id), 2)
                   AS revenue_per_customer,
               CASE WHEN avg(total_amount) >= 100 THEN 'HIGH_VALUE_CHANNEL'
                    WHEN avg(total_amount) >= 50 THEN 'MEDIUM_VALUE_CHANNEL'
                    ELSE 'LOW_VALUE_CHANNEL' END AS channel_tier
        FROM sold GROUP BY store_type, state, country""",
    "product_margins": """
        SELECT o.product_sku, max(product_name) AS product_name,
               count(DISTINCT order_id) AS total_orders,
               CAST(sum(quantity) AS BIGINT) AS total_units_sold,
               round(avg(unit_price), 6) AS avg_selling_price,
               round(avg(unit_cost), 4) AS avg_unit_cost,
               round(sum(total_amount), 6) AS total_revenue,
               round(avg(unit_price) - avg(unit_cost), 2) AS gross_margin_per_unit,
               round((avg(unit_price) - avg(unit_cost)) / nullif(avg(unit_price), 0) * 100, 2)
                   AS gross_margin_pct,
               round(sum(quantity * (unit_price - coalesce(unit_cost, 0))), 4)
                   AS total_gross_profit,
               CASE WHEN sum(total_amount) >= 10000 THEN 'HERO_PRODUCT'
                    WHEN sum(total_amount) >= 5000 THEN 'STRONG_PRODUCT'
                    WHEN sum(total_amount) >= 1000 THEN 'GROWING_PRODUCT'
                    ELSE 'WEAK_PRODUCT' END AS product_tier,
               rank() OVER (ORDER BY sum(total_amount) DESC NULLS FIRST) AS revenue_rank
        FROM silver_orders o LEFT JOIN silver_inventory i ON o.product_sku = i.product_sku
        GROUP BY o.product_sku""",
    "customer_360": f"""
        SELECT customer_id, count(DISTINCT order_id) AS total_orders,
               round(sum(total_amount), 6) AS lifetime_value,
               round(avg(total_amount), 2) AS avg_order_value,
               min(order_date) AS first_order_date, max(order_date) AS last_order_date,
               date_diff('day', min(order_date), max(order_date)) AS customer_age_days,
               count(DISTINCT product_sku) AS unique_products_bought,
               count(DISTINCT store_id) AS stores_visited,
               CAST(sum(quantity) AS BIGINT) AS total_units_purchased,
               CASE WHEN sum(total_amount) >= 10000 THEN 'VIP'
                    WHEN sum(total_amount) >= 5000 THEN 'LOYAL'
                    WHEN sum(total_amount) >= 1000 THEN 'REGULAR' ELSE 'NEW' END
                   AS customer_segment,
               CASE WHEN date_diff('day', max(order_date), {AS_OF}) <= 30 THEN 'ACTIVE'
                    WHEN date_diff('day', max(order_date), {AS_OF}) <= 90 THEN 'AT_RISK'
                    ELSE 'CHURNED' END AS activity_status,
               rank() OVER (ORDER BY sum(total_amount) DESC NULLS FIRST) AS value_rank
        FROM silver_orders GROUP BY customer_id""",
    "run_log": """
        SELECT event_id AS run_id, event_type AS source_name, ts AS start_time,
               CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
               fetched AS records_fetched,
               CASE event_type WHEN 'error' THEN 0 ELSE fetched - fetched // 10 END
                   AS records_loaded,
               CASE event_type WHEN 'error' THEN 0 ELSE fetched // 10 END AS records_quarantined
        FROM (SELECT *, CAST(floor(value * 10) AS BIGINT) AS fetched FROM events)""",
    "text_feed": """
        SELECT o_orderkey AS order_key, o_orderdate AS order_date,
               CASE WHEN o_orderkey % 41 = 0 THEN -o_totalprice ELSE o_totalprice END AS total_price
        FROM orders""",
    "feed": r"""
        SELECT CASE WHEN k % 29 = 0 THEN NULL ELSE CAST(k AS VARCHAR) END AS order_key,
               CASE WHEN k % 29 = 0 OR k % 31 = 0 THEN NULL ELSE CAST(c AS VARCHAR) END
                   AS customer_or_blank,
               CASE WHEN k % 29 = 0 OR k % 31 = 0 OR k % 37 = 0 THEN chr(9) ELSE p END AS priority,
               CASE WHEN k % 29 = 0 THEN 6 WHEN k % 31 = 0 THEN 5 WHEN k % 37 = 0 THEN 4 ELSE 0
                   END AS blanks
        FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders)""",
    "checked_feed": """
        SELECT *, CASE WHEN blanks = 6 THEN 'COMPLETELY_EMPTY_ROW'
                       WHEN blanks / 6 > 0.8 THEN 'TOO_MANY_NULLS_' || blanks || '_of_6_columns'
                  END AS rejection_reason
        FROM feed""",
}


def with_inputs(select: str) -> str:
    """Prefix ``select`` with the named inputs it refers to, directly or not."""
    pending, parts = [select], []
    for name in reversed(INPUTS):
        if any(re.search(rf"(FROM|JOIN) {name}\b", text) for text in pending):
            pending.append(INPUTS[name])
            parts.insert(0, f"{name} AS ({INPUTS[name]})")
    return f"WITH {', '.join(parts)} {select}" if parts else select


# Quality ------------------------------------------------------------------------------

BUSINESS_COLUMNS = {
    "bronze_orders": (
        "order_id", "store_id", "customer_id", "order_date", "product_sku", "quantity",
        "unit_price", "total_amount", "order_status",
    ),
    "bronze_inventory": (
        "inventory_id", "store_id", "product_sku", "product_name", "quantity_on_hand",
        "reorder_point", "unit_cost",
    ),
    "bronze_stores": (
        "store_id", "store_name", "city", "state", "country", "store_type",
        "monthly_target", "is_active",
    ),
}
NEGATIVE_COLUMNS = (
    ("bronze_orders", "quantity"), ("bronze_orders", "unit_price"),
    ("bronze_orders", "total_amount"), ("bronze_inventory", "quantity_on_hand"),
    ("bronze_inventory", "reorder_point"), ("bronze_inventory", "unit_cost"),
)


def _check(table: str, kind: str, column: str, condition: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{kind}' AS issue_type, '{column}' AS column_name, "
        f"count(*) FILTER ({condition}) AS issue_count, count(*) AS total_records FROM {table}"
    )


def _null_checks() -> list[str]:
    return [
        _check(t, "NULL_VALUE", c, f"{c} IS NULL")
        for t, columns in BUSINESS_COLUMNS.items()
        for c in columns
    ]


def _negative_checks() -> list[str]:
    return [_check(t, "NEGATIVE_VALUE", c, f"{c} < 0") for t, c in NEGATIVE_COLUMNS]


def _future_checks(as_of: str) -> list[str]:
    return [_check("bronze_orders", "FUTURE_DATE", "order_date", f"order_date > {as_of}")]


def _duplicate_checks() -> list[str]:
    return [
        f"SELECT '{t}' AS table_name, 'DUPLICATE_RECORDS' AS issue_type, "
        f"'{columns[0]}' AS column_name, "
        f"(SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {columns[0]} HAVING count(*) > 1)) "
        f"AS issue_count, count(*) AS total_records FROM {t}"
        for t, columns in BUSINESS_COLUMNS.items()
    ]


def _sku_checks() -> list[str]:
    bad = "NOT regexp_full_match(product_sku, 'ELF-[0-9]{5}')"
    return [
        _check(t, "INVALID_SKU_FORMAT", "product_sku", bad)
        for t in ("bronze_orders", "bronze_inventory")
    ]


def _all_checks() -> list[str]:
    return [
        *_null_checks(), *_negative_checks(), *_future_checks(AS_OF), *_duplicate_checks(),
        *_sku_checks(),
    ]


def _issues(checks: list[str]) -> str:
    return f"""
        SELECT *, CASE issue_type
                  WHEN 'NULL_VALUE' THEN CASE WHEN percentage > 20 THEN 'HIGH'
                       WHEN percentage > 5 THEN 'MEDIUM' ELSE 'LOW' END
                  WHEN 'FUTURE_DATE' THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
               issue_count || CASE issue_type
                  WHEN 'NULL_VALUE' THEN ' NULL values (' || percentage || '%) in ' || column_name
                  WHEN 'NEGATIVE_VALUE' THEN ' negative values in ' || column_name
                       || ' — business rule violation'
                  WHEN 'FUTURE_DATE' THEN ' future dates in ' || column_name
                       || ' — impossible dates'
                  WHEN 'DUPLICATE_RECORDS' THEN ' duplicate values in ' || column_name
                  ELSE ' SKUs don''t match ELF-XXXXX format' END AS description
        FROM (SELECT *, {half_up('issue_count / total_records * 100', 1)} AS percentage
              FROM ({' UNION ALL '.join(checks)}) WHERE issue_count > 0)"""


HEALTH = f"""
    SELECT *, CASE WHEN health_score >= 90 THEN 'HEALTHY' WHEN health_score >= 70 THEN 'WARNING'
              ELSE 'CRITICAL' END AS quality_status
    FROM (SELECT table_name, max(total_records) AS total_records,
                 count(*) FILTER (issue_count > 0) AS issues_found,
                 CAST(sum(issue_count) AS BIGINT) AS bad_records,
                 round(greatest(0, max(total_records) - sum(issue_count))
                       / max(total_records) * 100, 1) AS health_score
          FROM ({' UNION ALL '.join(_all_checks())}) GROUP BY table_name)"""

OTHERS: dict[str, str] = {
    "quality_nulls": _issues(_null_checks()),
    "quality_negatives": _issues(_negative_checks()),
    "quality_future_dates": _issues(_future_checks("TIMESTAMP '2000-06-01'")),
    "quality_duplicates": _issues(_duplicate_checks()),
    "quality_patterns": _issues(_sku_checks()),
    "quality_text": _issues([
        _check("text_feed", "NEGATIVE_VALUE", "total_price", "total_price < 0"),
        _check("text_feed", "FUTURE_DATE", "order_date", "order_date > TIMESTAMP '1997-01-01'"),
        "SELECT 'text_feed' AS table_name, 'DUPLICATE_RECORDS' AS issue_type, 'order_key' AS column_name, "
        "(SELECT count(*) FROM (SELECT 1 FROM text_feed GROUP BY order_key HAVING count(*) > 1)) "
        "AS issue_count, count(*) AS total_records FROM text_feed",
    ]),
    "load_profiles": _issues([
        *_null_checks(), *_negative_checks(), *_future_checks(AS_OF), *_sku_checks(),
    ]),
    "health_score": HEALTH,
    "alert_log": f"""
        SELECT issue_type AS alert_type, table_name || ': ' || description AS message, severity,
               {AS_OF} AS created_at
        FROM ({_issues(_all_checks())})""",
    "validate_rows": "SELECT order_key, priority, rejection_reason FROM checked_feed",
    "quarantine_reasons": """
        SELECT rejection_reason, count(*) AS rows FROM checked_feed
        WHERE rejection_reason IS NOT NULL GROUP BY 1""",
    "file_ingest": """
        SELECT count(*) AS records_fetched, count(*) FILTER (blanks < 5) AS records_loaded,
               count(*) FILTER (blanks >= 5) AS records_quarantined,
               CAST(sum(length(customer_text)) FILTER (blanks < 5) AS BIGINT)
                   AS kept_customer_characters,
               round(count(*) FILTER (blanks < 5) / count(*) * 100, 1) AS load_health
        FROM (SELECT *, customer_or_blank AS customer_text FROM checked_feed)""",
    "relational_load": """
        SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME, CAST(c_nationkey AS BIGINT) AS C_NATIONKEY,
               c_acctbal AS C_ACCTBAL, c_mktsegment AS C_MKTSEGMENT FROM customer""",
    "bytes_to_number": """
        SELECT o_orderkey, o_orderkey AS from_bytes,
               CAST(o_orderkey + (1::HUGEINT << 63) AS VARCHAR) AS from_2_63,
               CAST(o_orderkey + (1::HUGEINT << 64) - (1::HUGEINT << 48) AS VARCHAR) AS up_to_2_64,
               CAST(o_orderkey + 254 * (1::HUGEINT << 64) AS VARCHAR) AS nine_bytes,
               CAST(o_orderkey + (1::HUGEINT << 120) AS VARCHAR) AS sixteen_bytes FROM orders""",
    "null_profile": """
        SELECT 'store_id' AS column_name, count(*) FILTER (store_id IS NULL) AS null_count
        FROM bronze_orders
        UNION ALL SELECT 'customer_id', count(*) FILTER (customer_id IS NULL)
        FROM bronze_orders""",
    "load_verification": """
        SELECT count(*) >= (SELECT count(*) FROM lineitem) AS verified,
               (SELECT count(*) FROM lineitem) AS expected_count, count(*) AS loaded_count,
               greatest((SELECT count(*) FROM lineitem) - count(*), 0) AS missing_records,
               CAST(12 AS BIGINT) AS column_count,
               count(*) FILTER (store_id IS NULL) AS null_store_ids,
               CAST(bool_or(store_id IS NULL) AS BIGINT)
                   + CAST(bool_or(customer_id IS NULL) AS BIGINT) AS columns_with_nulls
        FROM bronze_orders""",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS record_count FROM {t}" for t in BUSINESS_COLUMNS
    ),
    "stream_ingest": """
        SELECT o_orderstatus, count(*) AS orders, CAST(sum(o_custkey) AS BIGINT) AS customer_keys
        FROM orders GROUP BY 1""",
    "run_statistics": """
        SELECT count(*) AS total_pipeline_runs,
               count(*) FILTER (status = 'SUCCESS') AS successful_runs,
               count(*) FILTER (status = 'FAILED') AS failed_runs,
               CAST(sum(records_loaded) AS BIGINT) AS total_records_loaded FROM run_log""",
    "success_rate": """
        SELECT CAST(round(avg(CASE status WHEN 'SUCCESS' THEN 100.0 ELSE 0 END)) AS BIGINT)
                   AS success_rate
        FROM (SELECT * FROM run_log ORDER BY start_time DESC, run_id LIMIT 20)""",
    "run_series": """
        SELECT 'Run ' || row_number() OVER (ORDER BY start_time, run_id DESC) AS name,
               records_loaded AS loaded, records_quarantined AS quarantined
        FROM (SELECT * FROM run_log ORDER BY start_time DESC, run_id LIMIT 10)""",
    "newest_n": "SELECT * FROM run_log ORDER BY start_time DESC, run_id LIMIT 20",
    **{
        query: f"SELECT ts AS {moment}, event_id AS {key}, {detail} FROM events "
               f"ORDER BY ts DESC, event_id LIMIT {n}"
        for query, moment, key, n, detail in (
            ("newest_quarantine", "quarantined_at", "quarantine_id", 50, "props AS raw_data"),
            ("newest_alerts", "created_at", "alert_id", 50, "event_type AS alert_type"),
            ("newest_queries", "asked_at", "query_id", 20, "user_id AS rows_returned"),
        )
    },
    "chart_series": """
        SELECT left(store_name, 15) AS name, total_revenue AS value FROM store_performance
        ORDER BY revenue_rank, store_id LIMIT 10""",
    "result_text": """
        SELECT product_sku, coalesce(product_name, 'N/A') AS product_name,
               CAST(current_stock AS VARCHAR) AS current_stock,
               coalesce(CAST(margin_pct AS VARCHAR), 'N/A') AS margin_pct FROM product_analysis""",
    "global_rank": """
        SELECT l_orderkey, l_linenumber, l_extendedprice,
               rank() OVER (ORDER BY l_extendedprice DESC) AS price_rank FROM lineitem""",
    "global_rank_ties": """
        SELECT l_orderkey, l_linenumber, l_quantity,
               rank() OVER (ORDER BY l_quantity DESC) AS quantity_rank FROM lineitem""",
    "running_total": """
        SELECT o_orderkey, o_totalprice,
               round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS total_so_far
        FROM orders""",
    "upsert": """
        SELECT * FROM bronze_inventory
        QUALIFY row_number() OVER (PARTITION BY inventory_id ORDER BY _loaded_at DESC) = 1""",
    "scd2_history": "SELECT * FROM product_history",
    "scd2_partitions": """
        SELECT *, is_current AS in_open, left(sha256(
            '["' || product_sku || '","' || strftime(valid_from, '%Y-%m-%d %H:%M:%S') || '"]'), 32)
            AS surrogate_key FROM product_history""",
    "stream_distinct": """
        SELECT order_status, count(*) AS orders, CAST(sum(quantity) AS BIGINT) AS units,
               (SELECT count(*) FROM (SELECT DISTINCT * FROM bronze_orders)) AS rows_stored,
               (SELECT count(*) FROM bronze_orders WHERE order_id % 11 = 0 AND year(_loaded_at)
                    = (SELECT min(year(_loaded_at)) FROM bronze_orders)) AS rows_late
        FROM newest_orders GROUP BY 1""",
    "distinct_sketches": " UNION ALL ".join(
        f"SELECT '{span}' AS span, store_id, count(DISTINCT customer_id) AS customers, "
        "count(DISTINCT product_sku) AS products, true AS customers_near, true AS products_near "
        f"FROM silver_orders WHERE {inside} GROUP BY store_id"
        for span, inside in (("1996", "year(order_date) = 1996"), ("all", "true"))
    ),
    "incremental_gold": " UNION ALL ".join(
        f"SELECT '{model}' AS model, CAST({key} AS VARCHAR) AS key, total_orders AS orders, "
        f"round({revenue}, 2) AS revenue, CAST({detail} AS DOUBLE) AS detail FROM {model}"
        for model, key, revenue, detail in (
            ("store_performance", "store_id", "total_revenue", "unique_customers"),
            ("store_targets", "store_id", "actual_revenue", "revenue_rank"),
            ("revenue_by_channel", "channel", "total_revenue", "unique_customers"),
            ("product_analysis", "product_sku", "total_revenue", "total_units_sold"),
            ("product_margins", "product_sku", "total_revenue", "revenue_rank"),
            ("customer_360", "customer_id", "lifetime_value", "unique_products_bought"),
            ("daily_revenue", "CAST(order_day AS DATE)", "daily_revenue", "unique_customers"),
        )
    ),
    "schema_changes": f"""
        SELECT 'CSV_CUSTOMER' AS source_name, change_type, column_name, old_value, new_value,
               {AS_OF} AS detected_at
        FROM (SELECT unnest([
                  {{'change_type': 'TYPE_CHANGED', 'column_name': 'C_NATIONKEY',
                    'old_value': CASE WHEN count(c_nationkey) = count(*) THEN 'bigint'
                                 ELSE 'double' END,
                    'new_value': CASE WHEN bool_and(c_nationkey <> 0) THEN 'bigint'
                                 ELSE 'double' END}},
                  {{'change_type': 'TYPE_CHANGED', 'column_name': 'C_ACCTBAL',
                    'old_value': 'double',
                    'new_value': CASE WHEN count(c_acctbal) = count(*) THEN 'bigint'
                                 ELSE 'double' END}},
                  {{'change_type': 'REMOVED', 'column_name': 'C_MKTSEGMENT',
                    'old_value': 'string', 'new_value': NULL}},
                  {{'change_type': 'ADDED', 'column_name': 'C_IN_CREDIT', 'old_value': NULL,
                    'new_value': CASE WHEN count(c_acctbal) = count(*) THEN 'boolean'
                                 ELSE 'string' END}}], recursive := true) FROM customer)
        WHERE old_value IS DISTINCT FROM new_value""",
    "volume_history": """
        SELECT source_name, recorded_at, record_count,
               CAST(previous AS DOUBLE) AS previous_count,
               CAST(record_count - previous AS DOUBLE) AS change,
               round((record_count - previous) / previous * 100, 1) AS change_pct
        FROM (SELECT *, lag(record_count) OVER (PARTITION BY source_name ORDER BY recorded_at)
                     AS previous
              FROM (SELECT _source AS source_name, _loaded_at AS recorded_at,
                           count(*) AS record_count
                    FROM (SELECT _source, _loaded_at FROM bronze_orders
                          UNION ALL SELECT _source, _loaded_at FROM bronze_inventory
                          UNION ALL SELECT _source, _loaded_at FROM bronze_stores)
                    GROUP BY 1, 2))""",
    "pivot": """
        SELECT strftime(order_date, '%Y-%m') AS month, """
    + ", ".join(
        f"round(sum(total_amount) FILTER (store_type = '{k}'), 2) AS {k.lower()}"
        for k in ("Flagship", "Standard", "Premium", "Outlet")
    )
    + " FROM sold GROUP BY 1",
    "unpivot": """
        UNPIVOT (SELECT product_sku, total_revenue, avg_selling_price, margin_pct,
                        CAST(revenue_rank AS DOUBLE) AS revenue_rank FROM product_analysis)
        ON total_revenue, avg_selling_price, margin_pct, revenue_rank
        INTO NAME metric VALUE value""",
    "lead_dense_rank": """
        SELECT store_type, month, units,
               row_number() OVER (PARTITION BY store_type ORDER BY month) AS month_number,
               dense_rank() OVER (PARTITION BY store_type ORDER BY units DESC) AS units_rank,
               coalesce(lead(units) OVER (PARTITION BY store_type ORDER BY month), 0)
                   AS next_units,
               avg(units) OVER (PARTITION BY store_type) AS mean_units
        FROM (SELECT store_type, strftime(order_date, '%Y-%m') AS month,
                     CAST(sum(quantity) AS BIGINT) AS units FROM sold GROUP BY 1, 2)""",
    "stddev": """
        SELECT product_sku, round(stddev_samp(unit_price), 6) AS price_stddev,
               count(*) AS orders FROM silver_orders GROUP BY 1""",
    "right_join": """
        SELECT s.store_id, store_name, nullif(count(inventory_id), 0) AS stock_rows,
               CAST(sum(quantity_on_hand) AS BIGINT) AS on_hand
        FROM silver_inventory i RIGHT JOIN silver_stores s ON i.store_id = s.store_id
        GROUP BY s.store_id, store_name""",
    "semi_join": """
        SELECT order_id, product_sku FROM silver_orders
        WHERE product_sku IN (SELECT product_sku FROM silver_inventory)""",
    "anti_join": """
        SELECT order_id, product_sku FROM silver_orders o
        WHERE NOT EXISTS (SELECT 1 FROM silver_inventory i WHERE i.product_sku = o.product_sku)""",
    "date_functions": f"""
        SELECT o_orderkey,
               o_orderdate + to_hours(o_orderkey % 24) + INTERVAL 30 DAY AS due,
               CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day,
               CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month,
               date_diff('day', o_orderdate, {AS_OF}) AS age_days FROM orders""",
    "text_functions": """
        SELECT c_custkey, upper(c_name) AS upper_name, lower(c_mktsegment) AS segment,
               c_name AS trimmed, regexp_full_match(c_name, 'Customer#[0-9]{9}') AS well_formed
        FROM customer""",
    "free_sql": """
        SELECT store_id, month, round(revenue, 2) AS revenue,
               round(revenue - lag(revenue) OVER (PARTITION BY store_id ORDER BY month), 2)
                   AS change,
               revenue > avg(revenue) OVER () AS above_average
        FROM (SELECT store_id, CAST(date_trunc('month', order_date) AS TIMESTAMP) AS month,
                     sum(total_amount) AS revenue
              FROM sold WHERE is_active = 1 GROUP BY 1, 2)""",
    "ask_top_store": """
        SELECT store_id, store_name, total_revenue FROM store_performance
        WHERE total_revenue = (SELECT max(total_revenue) FROM store_performance)""",
    "ask_low_stock": """
        SELECT product_sku, product_name, current_stock, reorder_point, stock_status
        FROM product_analysis WHERE stock_status <> 'IN_STOCK'""",
    "ask_daily_trend": """
        SELECT order_day, daily_revenue, cumulative_revenue, day_over_day_growth_pct
        FROM daily_revenue""",
    "ask_negative_margin": """
        SELECT product_sku, product_name, avg_selling_price, avg_unit_cost, unit_margin
        FROM product_analysis WHERE unit_margin < 0""",
    "ask_store_ranking": """
        SELECT revenue_rank, store_id, store_name, total_revenue FROM store_performance""",
    "ask_targets_by_revenue": """
        SELECT *, row_number() OVER (ORDER BY actual_revenue DESC NULLS LAST, store_id) AS position
        FROM store_targets""",
    "ask_stock_by_alert": """
        SELECT *, row_number() OVER (ORDER BY
                  CASE stock_alert WHEN 'OUT_OF_STOCK' THEN 1 WHEN 'REORDER_NOW' THEN 2 ELSE 3 END,
                  quantity_on_hand, inventory_id, store_id) AS position FROM inventory_status""",
    "ask_reorder_need": """
        SELECT store_id, store_name, count(*) AS items_to_reorder,
               count(*) FILTER (quantity_on_hand = 0) AS items_out_of_stock
        FROM inventory_status WHERE quantity_on_hand <= reorder_point GROUP BY 1, 2""",
    "ask_total_revenue": """
        SELECT round(sum(total_revenue), 2) AS total_revenue,
               CAST(sum(total_orders) AS BIGINT) AS total_orders FROM store_performance""",
    "ask_top_products": """
        SELECT product_sku, product_name, total_units_sold FROM product_analysis
        ORDER BY total_units_sold DESC, product_sku LIMIT 3""",
}

MODELS = (
    "silver_orders", "silver_inventory", "silver_stores", "store_performance",
    "product_analysis", "daily_revenue", "inventory_status", "revenue_by_channel",
    "tariff_impact", "store_targets", "channel_roi", "product_margins", "customer_360",
)

#: Tables of a whole run by model.
RUN_TABLES = {
    "silver_stores": "SLV_ELF_STORES", "silver_orders": "SLV_ELF_ORDERS",
    "silver_inventory": "SLV_ELF_INVENTORY", "store_performance": "GOLD_STORE_PERFORMANCE",
    "product_analysis": "GOLD_PRODUCT_ANALYSIS", "daily_revenue": "GOLD_DAILY_REVENUE",
    "inventory_status": "GOLD_INVENTORY_STATUS",
    "revenue_by_channel": "GOLD_ELF_REVENUE_BY_CHANNEL",
    "tariff_impact": "GOLD_ELF_TARIFF_IMPACT", "store_targets": "GOLD_ELF_STORE_PERFORMANCE",
    "channel_roi": "GOLD_ELF_MARKETING_ROI", "product_margins": "GOLD_ELF_PRODUCT_MARGINS",
    "customer_360": "GOLD_ELF_CUSTOMER_360",
}

RUNS = {
    "pipeline_run": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{'SILVER' if model.startswith('silver') else 'GOLD'}' "
        f'AS layer, true AS "exists", count(*) AS record_count FROM {model}'
        for model, table in RUN_TABLES.items()
    ),
    "pipeline_rerun": " UNION ALL ".join(
        f"SELECT CAST({run} AS BIGINT) AS run, '{table}' AS table_name, '{status}' AS status"
        for run, built in (
            (1, tuple(RUN_TABLES)), (2, ()),
            (3, ("silver_inventory", "product_analysis", "inventory_status", "product_margins")),
        )
        for model, table in RUN_TABLES.items()
        for status in ("SUCCESS" if model in built else "UNCHANGED",)
    ),
    "catalog": " UNION ALL ".join(
        f"SELECT 'BRZ_MYSQL_ELF_{t.removeprefix('bronze_').upper()}' AS table_name, any_value("
        + " || ', ' || ".join(
            f"'{c}(' || CASE typeof({c}) WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
            f"ELSE lower(typeof({c})) END || ')'" for c in columns[:4])
        + f") AS columns FROM {t}"
        for t, columns in BUSINESS_COLUMNS.items()
    ),
    "bucketed_upsert": OTHERS["upsert"],
    "hot_key_join": """
        SELECT c_mktsegment, count(*) AS lines, sum(l_quantity) AS units,
               count(DISTINCT key) AS customers
        FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS key, l_quantity
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        LEFT JOIN customer ON key = c_custkey GROUP BY 1""",
    "check_all": f"""
        SELECT 'BRZ_MYSQL_ELF_' || upper(replace(table_name, 'bronze_', '')) AS table_name,
               total_records, issues_found, bad_records, health_score, quality_status,
               issues_found AS alerts
        FROM ({HEALTH})""",
    "sync_tables": " UNION ALL ".join(
        f"SELECT 'BRZ_MYSQL_{t.upper()}' AS table_name, 2 * count(*) AS record_count, "
        f"CAST(2 AS BIGINT) AS runs, 2 * count(*) AS records_loaded FROM {t}"
        for t in ("customer", "nation", "orders", "part", "region", "supplier")
    ),
    "csv_to_bronze": """
        SELECT 'BRZ_FEED' AS table_name, 'CSV_FEED' AS detail, count(*) AS rows
        FROM checked_feed WHERE rejection_reason IS NULL
        UNION ALL SELECT 'QUARANTINE_RECORDS', rejection_reason, count(*)
        FROM checked_feed WHERE rejection_reason IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'PIPELINE_RUNS', 'SUCCESS', count(*)
        FROM checked_feed WHERE rejection_reason IS NULL
        UNION ALL SELECT 'VOLUME_HISTORY', 'CSV_FEED', count(*)
        FROM checked_feed WHERE rejection_reason IS NULL""",
    "ask_result": """
        SELECT position, product_sku, CAST(total_units_sold AS VARCHAR) AS units, stock_status,
               total_rows, total_rows AS logged_rows, position <= 20 AS charted
        FROM (SELECT *, count(*) OVER () AS total_rows,
                     row_number() OVER (ORDER BY total_units_sold DESC NULLS LAST, product_sku)
                         AS position
              FROM product_analysis)
        WHERE position <= 50""",
}


def statements() -> dict[str, str]:
    models = {name: f"SELECT * FROM {name}" for name in MODELS}
    return {name: with_inputs(text) for name, text in (models | OTHERS | RUNS).items()}
