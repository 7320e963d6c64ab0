"""Operations tables: fixed schemas, created empty, appended to."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tradewind.sources import warehouse

#: Files that a log may have before they are brought together, and rows of a file then.
MOST_FILES, ROWS_PER_FILE = 32, 5_000_000

PIPELINE_RUNS = (
    "run_id string, source_name string, start_time timestamp_ntz, end_time timestamp_ntz, "
    "status string, records_fetched bigint, records_loaded bigint, records_quarantined bigint, "
    "error_message string, duration_seconds bigint"
)
QUARANTINE_RECORDS = (
    "quarantine_id string, run_id string, source_name string, raw_data string, "
    "rejection_reason string, quarantined_at timestamp_ntz"
)
SCHEMA_CHANGES = (
    "change_id string, source_name string, change_type string, column_name string, "
    "old_value string, new_value string, detected_at timestamp_ntz"
)
VOLUME_HISTORY = (
    "history_id string, source_name string, record_count bigint, recorded_at timestamp_ntz"
)
QUERY_HISTORY = (
    "query_id string, question string, generated_sql string, execution_time_ms bigint, "
    "rows_returned bigint, asked_at timestamp_ntz"
)
ALERT_LOG = (
    "alert_id string, alert_type string, message string, severity string, "
    "created_at timestamp_ntz, resolved_at timestamp_ntz"
)
PRODUCT_HISTORY = (
    "surrogate_key string, product_sku string, product_name string, category string, "
    "price double, stock_quantity bigint, valid_from timestamp_ntz, valid_to timestamp_ntz, "
    "is_current boolean, _source string, _loaded_at timestamp_ntz"
)
MODEL_STATE = "table_name string, built_from string, built_at timestamp_ntz"
TABLES = {
    "PIPELINE_RUNS": PIPELINE_RUNS,
    "QUARANTINE_RECORDS": QUARANTINE_RECORDS,
    "SCHEMA_CHANGES": SCHEMA_CHANGES,
    "VOLUME_HISTORY": VOLUME_HISTORY,
    "QUERY_HISTORY": QUERY_HISTORY,
    "ALERT_LOG": ALERT_LOG,
    "MODEL_STATE": MODEL_STATE,
}


def create_if_missing(spark: SparkSession, name: str, schema: str) -> None:
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name)


def create_tables(spark: SparkSession) -> None:
    for name, schema in TABLES.items():
        create_if_missing(spark, name, schema)


def append(df: DataFrame, name: str) -> None:
    create_if_missing(df.sparkSession, name, TABLES[name])
    columns = [field.split()[0] for field in TABLES[name].split(", ")]
    df.select(*columns).write.insertInto(name)


def append_rows(spark: SparkSession, name: str, rows: Iterable[tuple]) -> None:
    """For rows the driver itself makes, such as a run's log line."""
    append(spark.createDataFrame(list(rows), TABLES[name]).coalesce(1), name)


def compact(
    spark: SparkSession, names: Iterable[str] = tuple(TABLES), most_files: int = MOST_FILES
) -> list[str]:
    """Bring the files of logs together that have more than ``most_files``; the logs it touched.

    Every run and query appends a small file. Called once per cycle, a log never has
    many more than ``most_files``. The old log stays if this fails.
    """
    done = []
    for name in names:
        if spark.catalog.tableExists(name) and len(spark.table(name).inputFiles()) > most_files:
            log = spark.table(name)
            warehouse.replace(log.coalesce(max(1, math.ceil(log.count() / ROWS_PER_FILE))), name)
            done.append(name)
    return done
