"""Relational sources: a JDBC database, or a folder of Parquet tables in its place."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.functions.columns import bytes_to_digits

# Source column types and the types they load as. Others load as text.
LOAD_TYPES = {
    "int": "bigint", "bigint": "bigint", "smallint": "bigint", "tinyint": "bigint",
    "float": "double", "double": "double", "decimal": "double",
    "varchar": "string", "char": "string", "text": "string", "longtext": "string",
    "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz",
    "date": "date", "boolean": "boolean",
}


def load_type(source_type: str) -> str:
    """``decimal(10,2)`` loads as double; ``int unsigned`` is unknown and loads as text."""
    return LOAD_TYPES.get(source_type.lower().split("(")[0], "string")


def partition_column(keys: list[str], kinds: dict[str, str]) -> str | None:
    """The first column of the primary key where ranges of it can be read apart, else none.

    ``kinds`` are source types: whole numbers, dates and times have ranges that say how many
    rows to expect. Only the first column has them in the order of the key's index.
    """
    if not keys:
        return None
    base = kinds.get(keys[0], "").lower().split("(")[0].split(" ")[0]
    whole = LOAD_TYPES.get(base) in ("bigint", "timestamp_ntz", "date")
    return keys[0] if whole else None


def read_options(
    table: str, column: str | None = None, low=None, high=None, partitions: int = 64
) -> dict[str, str]:
    """What the JDBC reader is told: one task, or ranges of ``column`` between its bounds.

    Rows outside of the bounds and nulls are read by the outermost tasks, so rows that come in
    after the bounds were asked are not lost.
    """
    options = {"dbtable": table}
    if column is None or low is None or high is None:
        return options
    span = int(high) - int(low) + 1 if not hasattr(low, "year") else partitions
    return options | {
        "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
        "numPartitions": str(max(1, min(partitions, span))),
    }


def map_types(df: DataFrame, source_types: dict[str, str]) -> DataFrame:
    """Upper-case names, bytes as numbers, every column in its load type."""
    columns = []
    for name in df.columns:
        column = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, T.BinaryType):
            column = bytes_to_digits(column)
        columns.append(column.cast(load_type(source_types[name])).alias(name.upper()))
    return df.select(*columns)


@dataclass
class JdbcSource:
    """Tables of one database schema, each read in parallel over ranges of its primary key.

    ``partition_columns`` names another column for a table, or none to read it in one task.
    """

    spark: SparkSession
    url: str
    schema: str
    properties: dict[str, str] = field(default_factory=dict)
    partitions: int = 64
    partition_columns: dict[str, str | None] = field(default_factory=dict)

    def _query(self, text: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, f"({text}) q", properties=self.properties)

    def tables(self) -> list[str]:
        found = self._query(
            f"SELECT table_name AS name FROM information_schema.tables "
            f"WHERE table_schema = '{self.schema}'"
        )
        return sorted(r["name"] for r in found.collect())

    def column_types(self, table: str) -> dict[str, str]:
        found = self._query(
            f"SELECT column_name AS name, column_type AS kind FROM information_schema.columns "
            f"WHERE table_schema = '{self.schema}' AND table_name = '{table}'"
        )
        return {r["name"]: r["kind"] for r in found.collect()}

    def keys(self, table: str) -> list[str]:
        """Columns of the primary key, in its order."""
        found = self._query(
            "SELECT k.column_name AS name, k.ordinal_position AS place "
            "FROM information_schema.table_constraints c "
            "JOIN information_schema.key_column_usage k "
            "ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema "
            "AND k.table_name = c.table_name "
            "WHERE c.constraint_type = 'PRIMARY KEY' "
            f"AND c.table_schema = '{self.schema}' AND c.table_name = '{table}'"
        )
        return [r["name"] for r in sorted(found.collect(), key=lambda r: r["place"])]

    def options(self, table: str) -> dict[str, str]:
        if table in self.partition_columns:
            column = self.partition_columns[table]
        else:
            column = partition_column(self.keys(table), self.column_types(table))
        if column is None:
            return read_options(table)
        bounds = self._query(f"SELECT min({column}) AS low, max({column}) AS high FROM {table}")
        return read_options(table, column, *bounds.select("low", "high").first(), self.partitions)

    def read(self, table: str) -> DataFrame:
        options = {"url": self.url, **self.properties, **self.options(table)}
        return self.spark.read.format("jdbc").options(**options).load()


@dataclass
class FolderSource:
    """One Parquet table per name under a folder."""

    spark: SparkSession
    folder: str
    names: tuple[str, ...]

    NATIVE = {
        "bigint": "bigint", "int": "int", "smallint": "smallint", "tinyint": "tinyint",
        "double": "double", "float": "float", "string": "text", "boolean": "boolean",
        "timestamp_ntz": "datetime", "timestamp": "timestamp", "date": "date",
    }

    def tables(self) -> list[str]:
        return sorted(self.names)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def column_types(self, table: str) -> dict[str, str]:
        kinds = {f.name: f.dataType.simpleString() for f in self.read(table).schema}
        return {n: self.NATIVE.get(k, k) for n, k in kinds.items()}
