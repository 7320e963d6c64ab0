"""Warehouse tables: append under a frozen schema, replace, swap, list."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.operators.audit import layer_order, table_counts
from tradewind.rules import CATALOG_COLUMNS_SHOWN


class SchemaMismatch(ValueError):
    """A batch has columns that the table does not have."""


def _converted(column: Column, have: T.DataType, want: T.DataType) -> Column:
    if isinstance(want, T.LongType) and isinstance(have, (T.DoubleType, T.FloatType)):
        column = F.round(column)
    return column.cast(want)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns, order and types of ``schema``; missing columns are null."""
    have = {c.upper(): c for c in df.columns}
    extra = [c for c in df.columns if c.upper() not in {n.upper() for n in schema.names}]
    if extra:
        raise SchemaMismatch(f"columns not in the table: {extra}")
    return df.select(
        *(
            _converted(
                F.col(f"`{have[f.name.upper()]}`"),
                df.schema[have[f.name.upper()]].dataType,
                f.dataType,
            ).alias(f.name)
            if f.name.upper() in have
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema
        )
    )


def append(df: DataFrame, table: str) -> None:
    """Create ``table`` from the first batch; later batches must fit its schema."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        conform(df, spark.table(table).schema).write.insertInto(table)
    else:
        df.write.format("parquet").saveAsTable(table)


def replace(df: DataFrame, table: str) -> int:
    """Write ``df`` as the whole of ``table`` and return the number of rows written.

    The rows are written aside and the tables renamed once all is written, so the old
    table stays if the job fails, and ``df`` may read ``table``.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex[:8]
    written = Observation(table)
    counted = df.observe(written, F.count(F.lit(1)).alias("rows"))
    try:
        counted.write.format("parquet").saveAsTable(f"{table}_new_{mark}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {table}_new_{mark}")
        raise
    rows = written.get["rows"]
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} RENAME TO {table}_old_{mark}")
    spark.sql(f"ALTER TABLE {table}_new_{mark} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {table}_old_{mark}")
    return rows


swap = replace

#: Between the name of a view and the number of the table it shows.
VERSION = "__v"


def versions(spark: SparkSession, name: str) -> list[int]:
    """Numbers of the tables written for the view ``name``, shown or not, oldest first."""
    mark = f"{name}{VERSION}".lower()
    found = (t.name.lower() for t in spark.catalog.listTables() if not t.isTemporary)
    return sorted(int(n.removeprefix(mark)) for n in found if n.startswith(mark) and n.removeprefix(mark).isdigit())


def switch(df: DataFrame, name: str, keep: int = 2) -> int:
    """Show ``df`` under ``name`` from one moment to the next; the number of rows written.

    Each call writes a table of its own, then turns the view ``name`` to it by one statement of
    the catalog, so there is no moment without a table and readers go on with the version
    they started on. The newest ``keep`` versions stay for them. What a call that failed left
    behind is never shown, and dropped by a later call. ``name`` must not be a table.
    """
    spark = df.sparkSession
    there = versions(spark, name)
    number = there[-1] + 1 if there else 1
    written = Observation(name)
    counted = df.observe(written, F.count(F.lit(1)).alias("rows"))
    counted.write.format("parquet").saveAsTable(f"{name}{VERSION}{number}")
    rows = written.get["rows"]
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {name}{VERSION}{number}")
    for old in there[: max(0, len(there) + 1 - keep)]:
        spark.sql(f"DROP TABLE IF EXISTS {name}{VERSION}{old}")
    return rows


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """Write ``df`` as the whole of ``table`` in sorted buckets by ``keys``, a file each.

    Joins, dedup and upserts on the keys then need no shuffle, as long as the other side of a
    join has as many buckets. A bucket should fill a task: the table's size over 256 MB or so.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def location(spark: SparkSession, table: str) -> str:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    return described.filter("col_name = 'Location'").first()["data_type"]


def overwrite_partitions(df: DataFrame, table: str, by: str) -> None:
    """Replace the partitions that ``df`` has rows for; files of all others stay as they are.

    The new files are written aside and moved once all are written, so ``df`` may read ``table``.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(by).parquet(location(spark, table))
    spark.catalog.recoverPartitions(table)
    spark.catalog.refreshTable(table)


def names(spark: SparkSession, prefix: str = "") -> list[str]:
    found = (t.name for t in spark.catalog.listTables() if not t.isTemporary)
    return sorted(n for n in found if n.upper().startswith(prefix.upper()))


def list_bronze(spark: SparkSession) -> DataFrame:
    """Bronze tables with row count and creation time, newest first."""
    tables = names(spark, "BRZ_")
    made = spark.createDataFrame(
        [(n, _created(spark, n)) for n in tables], "table_name string, created timestamp_ntz"
    )
    if not tables:
        return made.select("table_name", F.lit(0).cast("long").alias("record_count"), "created")
    counts = table_counts({n: spark.table(n) for n in tables})
    return counts.join(made, "table_name").orderBy(F.col("created").desc(), "table_name")


def _created(spark: SparkSession, table: str) -> dt.datetime:
    """The catalog gives the time as text: weekday, month, day, time, zone, year."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    text = described.filter("col_name = 'Created Time'").first()["data_type"]
    _, month, day, clock, _, year = text.split()
    return dt.datetime.strptime(f"{month} {day} {clock} {year}", "%b %d %H:%M:%S %Y")


def catalog_summary(spark: SparkSession, columns_shown: int | None = CATALOG_COLUMNS_SHOWN) -> DataFrame:
    """Tables by layer and name, with their first columns and types; all columns if not limited."""
    rows = [
        (
            name,
            ", ".join(
                f"{f.name}({f.dataType.simpleString()})"
                for f in spark.table(name).schema[:columns_shown]
            ),
        )
        for name in names(spark)
    ]
    described = spark.createDataFrame(rows, "table_name string, columns string")
    return described.orderBy(layer_order(F.col("table_name")), "table_name")


def layer_status(spark: SparkSession, layers: dict[str, str]) -> DataFrame:
    """Per expected table and its layer: does it exist, and how many rows."""
    present = {n: spark.table(n) for n in layers if spark.catalog.tableExists(n)}
    expected = spark.createDataFrame(list(layers.items()), "table_name string, layer string")
    if not present:
        return expected.select(
            "*", F.lit(False).alias("exists"), F.lit(0).cast("long").alias("record_count")
        )
    return expected.join(table_counts(present), "table_name", "left").select(
        "table_name", "layer", F.col("record_count").isNotNull().alias("exists"),
        F.coalesce("record_count", F.lit(0)).alias("record_count"),
    )
