"""Reports over the operations tables and over query results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind import rules
from tradewind.functions.columns import display_text

REPORTS = {
    "PIPELINE_RUNS": ("start_time", "run_id", rules.RUNS_SHOWN),
    "QUARANTINE_RECORDS": ("quarantined_at", "quarantine_id", rules.QUARANTINE_SHOWN),
    "ALERT_LOG": ("created_at", "alert_id", rules.ALERTS_SHOWN),
    "QUERY_HISTORY": ("asked_at", "query_id", rules.QUERIES_SHOWN),
}
LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def newest(df: DataFrame, moment: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows with the latest ``moment``. Each task keeps ``n`` rows only."""
    return df.orderBy(F.col(moment).desc(), *ties).limit(n)


def recent(log: DataFrame, table: str) -> DataFrame:
    """The newest entries of an operations table, as many as its report shows."""
    moment, key, n = REPORTS[table]
    return newest(log, moment, n, key)


def run_statistics(runs: DataFrame) -> DataFrame:
    """Runs in total, by outcome, and rows loaded. Zeros for an empty log."""
    return runs.agg(
        F.count(F.lit(1)).alias("total_pipeline_runs"),
        F.count_if(F.col("status") == "SUCCESS").alias("successful_runs"),
        F.count_if(F.col("status") == "FAILED").alias("failed_runs"),
        F.coalesce(F.sum("records_loaded"), F.lit(0)).alias("total_records_loaded"),
    )


def success_rate(runs: DataFrame, n: int = rules.RUNS_SHOWN) -> DataFrame:
    """Whole percent of the newest ``n`` runs that succeeded; 0 without runs."""
    share = F.avg(F.when(F.col("status") == "SUCCESS", 1.0).otherwise(0.0))
    return newest(runs, "start_time", n, "run_id").agg(
        F.coalesce(F.round(share * 100), F.lit(0.0)).cast("long").alias("success_rate")
    )


def run_series(runs: DataFrame, n: int = rules.SERIES_ROWS) -> DataFrame:
    """Loaded and quarantined rows of the newest ``n`` runs, numbered oldest first."""
    recent = newest(runs, "start_time", n, "run_id")
    # At most n rows are left for this window.
    oldest_first = Window.orderBy(F.col("start_time"), F.col("run_id").desc())
    return recent.select(
        F.row_number().over(oldest_first).cast("long").alias("position"),
        F.coalesce("records_loaded", F.lit(0)).alias("loaded"),
        F.coalesce("records_quarantined", F.lit(0)).alias("quarantined"),
    ).select(
        F.concat(F.lit("Run "), F.col("position").cast("string")).alias("name"),
        "loaded", "quarantined",
    )


def as_text(df: DataFrame) -> DataFrame:
    """Every value as text, nulls as ``N/A``."""
    return df.select(*(display_text(F.col(f"`{c}`")).alias(c) for c in df.columns))


def chart_series(result: DataFrame, n: int = rules.SERIES_ROWS) -> DataFrame:
    """First ``n`` rows as (label, number): the first column cut short, and the number
    the second one starts with or zero."""
    label, value = (F.col(f"`{c}`").cast("string") for c in result.columns[:2])
    number = F.regexp_extract(value, LEADING_NUMBER, 1)
    return result.limit(n).select(
        F.substring(F.coalesce(label, F.lit("N/A")), 1, rules.SERIES_LABEL_CHARS).alias("name"),
        F.coalesce(number.try_cast("double"), F.lit(0.0)).alias("value"),
    )


def layer_order(table: Column) -> Column:
    """Gold before Silver before Bronze before the rest."""
    name = F.upper(table)
    return (
        F.when(name.startswith("GOLD"), 1)
        .when(name.startswith("SLV"), 2)
        .when(name.startswith("BRZ"), 3)
        .otherwise(4)
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, as one DataFrame whose branches Spark runs side by side."""
    result = None
    for name, df in tables.items():
        counted = df.agg(F.count(F.lit(1)).alias("record_count")).select(
            F.lit(name).alias("table_name"), "record_count"
        )
        result = counted if result is None else result.unionByName(counted)
    if result is None:
        raise ValueError("no tables to count")
    return result
