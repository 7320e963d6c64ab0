"""Load files and relational tables into Bronze, with a log line per run."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.functions.columns import utc_now
from tradewind.functions.columns import as_of_timestamp
from tradewind.operators import history, profiles, validation
from tradewind.sources import files, ops, relational, warehouse


def add_lineage(
    df: DataFrame, source: str, run_id: str, at: dt.datetime, file_name: str | None = None
) -> DataFrame:
    columns = {
        "_SOURCE": F.lit(source), "_LOADED_AT": as_of_timestamp(at), "_RUN_ID": F.lit(run_id),
    }
    if file_name is not None:
        columns["_FILE_NAME"] = F.lit(file_name)
    return df.withColumns(columns)


def health_score(fetched: int, loaded: int) -> float:
    return round(loaded / fetched * 100, 1) if fetched else 0.0


def _logged(
    spark: SparkSession, source: str, run: Callable[[str, dt.datetime], dict | None]
) -> dict:
    """Run a load and write its log line, SUCCESS or FAILED. ``None`` leaves no line."""
    run_id, start = uuid.uuid4().hex[:8], utc_now()
    try:
        report = run(run_id, start)
        error = None
    except Exception as failure:  # a failed load is an outcome to record
        report, error = {}, str(failure)
    if report is None:
        return {"status": "success", "run_id": run_id, "records_fetched": 0,
                "records_loaded": 0, "message": "Table is empty"}
    end = utc_now()
    fetched, loaded, refused = (
        report.get(k, 0) for k in ("records_fetched", "records_loaded", "records_quarantined")
    )
    seconds = int((end - start).total_seconds())
    status = "FAILED" if error else "SUCCESS"
    line = (run_id, source, start, end, status, fetched, loaded, refused,
            error and error[:1000], seconds)
    ops.append_rows(spark, "PIPELINE_RUNS", [line])
    if not error:
        ops.append_rows(spark, "VOLUME_HISTORY", [(f"V-{run_id}", source, loaded, end)])
    if error:
        return {"status": "error", "run_id": run_id, "message": error}
    return {"status": "success", "run_id": run_id, "duration_seconds": seconds,
            "health_score": health_score(fetched, loaded), **report}


def _write_counted(df: DataFrame, keep, table: str) -> tuple[int, int]:
    """Append the rows that pass ``keep``; count all and kept rows on the way."""
    seen, kept = Observation("seen"), Observation("kept")
    rows = F.count(F.lit(1)).alias("rows")
    warehouse.append(keep(df.observe(seen, rows)).observe(kept, rows), table)
    return seen.get["rows"], kept.get["rows"]


def _note_schema(batch: DataFrame, table: str, source: str, at: dt.datetime) -> None:
    """Log how a batch differs from its table, also when the load then fails."""
    spark = batch.sparkSession
    if spark.catalog.tableExists(table):
        stored = [f for f in spark.table(table).schema if not f.name.startswith("_")]
        changes = history.schema_changes(spark, source, T.StructType(stored), batch.schema, at)
        ops.append(changes, "SCHEMA_CHANGES")


def load_batch(
    batch: DataFrame, table: str, source: str, run_id: str, at: dt.datetime, file_name: str
) -> dict:
    """Validate typed rows, append the good ones to Bronze, quarantine the rest.

    The batch is read twice, for good and for bad rows, rather than held in
    memory; without bad rows the second pass is left out.
    """
    _note_schema(batch, table, source, at)
    checked = validation.with_reason(batch)

    def good(df: DataFrame) -> DataFrame:
        return add_lineage(validation.accepted(df), source, run_id, at, file_name)

    fetched, loaded = _write_counted(checked, good, table)
    if fetched > loaded:
        refused = validation.quarantine_rows(checked, run_id, source, as_of_timestamp(at))
        ops.append(refused, "QUARANTINE_RECORDS")
    return {"table_created": table, "records_fetched": fetched, "records_loaded": loaded,
            "records_quarantined": fetched - loaded}


def rows_of_run(spark: SparkSession, table: str, run_id: str) -> DataFrame:
    """What one run added. A file holds one run, so Spark reads the files of this run only."""
    return spark.table(table).filter(F.col("_RUN_ID") == run_id)


def profile_run(
    spark: SparkSession, table: str, run_id: str, as_of=None, profiles_table: str = "QUALITY_PROFILES"
) -> None:
    """Keep the profile of one run, from which ``profiles.merged`` tells the table's health."""
    rows = rows_of_run(spark, table, run_id)
    warehouse.append(profiles.profile(rows, table, run_id, as_of), profiles_table)


def load_csv_to_bronze(
    spark: SparkSession, path: str, table_name: str, multi_line: bool | None = None
) -> dict:
    """One CSV file, or a folder of files under one header, into ``BRZ_<table_name>``."""
    file_name = path.rstrip("/").rsplit("/", 1)[-1]
    if not file_name.endswith(".csv"):
        return {"status": "error", "message": "only .csv files are supported"}
    table, source = f"BRZ_{table_name.upper()}", f"CSV_{table_name.upper()}"

    def run(run_id: str, at: dt.datetime) -> dict:
        batch = files.read_csv(spark, path, multi_line)
        report = load_batch(batch, table, source, run_id, at, file_name)
        found = validation.load_verification(
            rows_of_run(spark, table, run_id), report["records_loaded"]
        )
        return {**report, "file_name": file_name, "verification": found.first().asDict()}

    return _logged(spark, source, run)


def sync_table_to_bronze(spark: SparkSession, origin, table_name: str) -> dict:
    """All rows of a relational table, appended to ``BRZ_MYSQL_<table_name>``.

    Rows of nothing but nulls are counted and dropped. How the source's columns differ from the
    table's goes to SCHEMA_CHANGES. An empty source ends the run without a log line.
    """
    table, source = f"BRZ_MYSQL_{table_name.upper()}", f"MYSQL_{table_name.upper()}"

    def run(run_id: str, at: dt.datetime) -> dict | None:
        rows = origin.read(table_name)
        if rows.isEmpty():
            return None
        typed = relational.map_types(rows, origin.column_types(table_name))
        _note_schema(typed, table, source, at)

        def good(df: DataFrame) -> DataFrame:
            return add_lineage(validation.drop_all_null(df), source, run_id, at)

        fetched, loaded = _write_counted(typed, good, table)
        return {"bronze_table": table, "records_fetched": fetched, "records_loaded": loaded,
                "records_quarantined": fetched - loaded}

    return {**_logged(spark, source, run), "source": source}


def sync_all(spark: SparkSession, origin) -> list[dict]:
    """Every table of a source; a table that fails does not stop the others."""
    return [sync_table_to_bronze(spark, origin, name) for name in origin.tables()]
