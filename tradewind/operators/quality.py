"""Data-quality checks: rule violations per column, health score, alerts.

All column checks of a table are one aggregate over one scan. Only the
duplicate-key check needs a shuffle, and its own scan reads the key column alone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind import rules
from tradewind.functions.columns import as_of_timestamp, matches_whole, percent, short_id

NULLS, NEGATIVES, FUTURE_DATES = "NULL_VALUE", "NEGATIVE_VALUE", "FUTURE_DATE"
DUPLICATES, BAD_SKUS = "DUPLICATE_RECORDS", "INVALID_SKU_FORMAT"
ALL_CHECKS = (NULLS, NEGATIVES, FUTURE_DATES, DUPLICATES, BAD_SKUS)
HEALTH_SCHEMA = (
    "table_name string, total_records bigint, issues_found bigint, bad_records bigint, "
    "health_score double, quality_status string"
)
SEVERITIES = {
    NEGATIVES: "HIGH", FUTURE_DATES: "MEDIUM", DUPLICATES: "HIGH", BAD_SKUS: "HIGH",
}


def business_columns(df: DataFrame) -> list[str]:
    """Columns that hold data; a leading underscore marks lineage."""
    return [c for c in df.columns if not c.startswith("_")]


def _named_like(columns: Iterable[str], keywords: Iterable[str]) -> list[str]:
    return [c for c in columns if any(k in c.lower() for k in keywords)]


def _count_unless_uncastable(column: Column, cast: Column, bad: Column) -> Column:
    """Number of bad values, or null (no check) when some text does not convert."""
    failed = F.count_if(column.isNotNull() & cast.isNull())
    return F.when(failed == 0, F.count_if(bad))


def _negatives(df: DataFrame, name: str) -> Column | None:
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.count_if(column < 0)
    if isinstance(kind, T.StringType):
        number = column.try_cast("double")
        return _count_unless_uncastable(column, number, number < 0)
    return None


def _future_dates(df: DataFrame, name: str, now: Column) -> Column | None:
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.count_if(column.cast("timestamp_ntz") > now)
    if isinstance(kind, T.StringType):
        moment = column.try_cast("timestamp_ntz")
        return _count_unless_uncastable(column, moment, moment > now)
    return None


def _column_checks(
    df: DataFrame, as_of, sku: str, only: Iterable[str]
) -> list[tuple[str, str, Column]]:
    columns, now = business_columns(df), as_of_timestamp(as_of)
    found = []
    if NULLS in only:
        found += [(NULLS, c, F.count_if(F.col(f"`{c}`").isNull())) for c in columns]
    if NEGATIVES in only:
        numeric = _named_like(columns, rules.NUMERIC_KEYWORDS)
        found += [(NEGATIVES, c, _negatives(df, c)) for c in numeric]
    if FUTURE_DATES in only:
        dated = _named_like(columns, rules.DATE_KEYWORDS)
        found += [(FUTURE_DATES, c, _future_dates(df, c, now)) for c in dated]
    if BAD_SKUS in only:
        # Null stays null under the pattern test, so null SKUs are not counted.
        found += [
            (BAD_SKUS, c, F.count_if(~matches_whole(F.col(f"`{c}`"), sku)))
            for c in _named_like(columns, [rules.SKU_KEYWORD])
        ]
    return [check for check in found if check[2] is not None]


def check_counts(
    df: DataFrame,
    table: str,
    as_of=None,
    sku: str = rules.sku_pattern(),
    only: Iterable[str] = ALL_CHECKS,
) -> DataFrame:
    """One row per check with its count (null: does not apply) and the table's size."""
    checks = _column_checks(df, as_of, sku, only)
    counted = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        *(count.alias(f"n{i}") for i, (_, _, count) in enumerate(checks)),
    )
    rows = [
        F.struct(
            F.lit(kind).alias("issue_type"),
            F.lit(column).alias("column_name"),
            F.col(f"n{i}").alias("issue_count"),
        )
        for i, (kind, column, _) in enumerate(checks)
    ]
    whole = F.struct(
        F.lit(None).cast("string").alias("issue_type"),
        F.lit(None).cast("string").alias("column_name"),
        F.lit(0).cast("long").alias("issue_count"),
    )
    result = counted.select("total_records", F.inline(F.array(whole, *rows)))
    columns = business_columns(df)
    if DUPLICATES in only and columns:
        key = F.col(f"`{columns[0]}`")
        repeated = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("copies")).agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("total_records"),
            F.lit(DUPLICATES).alias("issue_type"),
            F.lit(columns[0]).alias("column_name"),
            F.count_if(F.col("copies") > 1).alias("issue_count"),
        )
        result = result.unionByName(repeated)
    return result.select(F.lit(table).alias("table_name"), "*")


def issues(counts: DataFrame, code: str = rules.PRODUCT_CODE) -> DataFrame:
    """Checks that found something, with share, severity and a sentence."""
    share = percent(F.col("issue_count"), F.col("total_records"), 1)
    kind, n, column = F.col("issue_type"), F.col("issue_count"), F.col("column_name")
    severity = F.when(
        kind == NULLS,
        F.when(F.col("percentage") > rules.NULL_PCT_HIGH, "HIGH")
        .when(F.col("percentage") > rules.NULL_PCT_MEDIUM, "MEDIUM")
        .otherwise("LOW"),
    )
    for name, level in SEVERITIES.items():
        severity = severity.when(kind == name, level)
    # Fixed message formats.
    text = (
        F.when(kind == NULLS, F.concat(n, F.lit(" NULL values ("), F.col("percentage"),
                                       F.lit("%) in "), column))
        .when(kind == NEGATIVES, F.concat(n, F.lit(" negative values in "), column,
                                          F.lit(" — business rule violation")))
        .when(kind == FUTURE_DATES, F.concat(n, F.lit(" future dates in "), column,
                                             F.lit(" — impossible dates")))
        .when(kind == DUPLICATES, F.concat(n, F.lit(" duplicate values in "), column))
        .when(kind == BAD_SKUS, F.concat(n, F.lit(f" SKUs don't match {code}-XXXXX format")))
    )
    return (
        counts.filter(F.col("issue_count") > 0)
        .withColumn("percentage", share)
        .withColumn("severity", severity)
        .withColumn("description", text)
    )


def health(counts: DataFrame) -> DataFrame:
    """Per table: size, number of issues, bad values, score and status.

    A row that breaks several rules counts several times. An empty table is
    healthy and has no status.
    """
    total, bad = F.col("total_records"), F.col("bad_records")
    good = total - F.least(bad, total)
    return (
        counts.groupBy("table_name")
        .agg(
            F.max("total_records").alias("total_records"),
            F.count_if(F.col("issue_count") > 0).alias("issues_found"),
            F.coalesce(F.sum("issue_count"), F.lit(0)).alias("bad_records"),
        )
        .withColumn(
            "health_score",
            F.when(total == 0, 100.0).otherwise(percent(good, total, 1)),
        )
        .withColumn(
            "quality_status",
            F.when(total > 0,
                   F.when(F.col("health_score") >= rules.HEALTHY_FROM, "HEALTHY")
                   .when(F.col("health_score") >= rules.WARNING_FROM, "WARNING")
                   .otherwise("CRITICAL")),
        )
    )


def alerts(found: DataFrame, created_at=None) -> DataFrame:
    """One open alert per issue, in the layout of the alert log."""
    moment = as_of_timestamp(created_at)
    return found.select(
        short_id(F.col("table_name"), F.col("issue_type"), F.col("column_name"),
                 moment.cast("string")).alias("alert_id"),
        F.col("issue_type").alias("alert_type"),
        F.concat("table_name", F.lit(": "), "description").alias("message"),
        "severity",
        moment.alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
    )


def check_tables(tables: dict[str, DataFrame], as_of=None, **options) -> DataFrame:
    """``check_counts`` of several tables as one DataFrame."""
    result = None
    for name, df in tables.items():
        counts = check_counts(df, name, as_of, **options)
        result = counts if result is None else result.unionByName(counts)
    if result is None:
        raise ValueError("no tables to check")
    return result
