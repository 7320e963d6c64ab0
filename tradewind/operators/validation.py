"""Row validation on load, and verification of what was loaded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind import rules
from tradewind.functions.columns import is_blank
from tradewind.operators.quality import business_columns


def rejection_reason(
    columns: Sequence[str], blank_limit: float = rules.BLANK_SHARE_LIMIT
) -> Column:
    """Why a row is refused, or null for a row to keep."""
    n = len(columns)
    # One reason per possible number of blanks, so a row's blanks are counted once.
    reasons = [
        f"TOO_MANY_NULLS_{blanks}_of_{n}_columns" if blanks / n > blank_limit else None
        for blanks in range(n)
    ]
    by_blanks = F.array(*(F.lit(r).cast("string") for r in [*reasons, "COMPLETELY_EMPTY_ROW"]))
    return by_blanks[sum((is_blank(F.col(f"`{c}`")).cast("int") for c in columns), F.lit(0))]


def with_reason(df: DataFrame, blank_limit: float = rules.BLANK_SHARE_LIMIT) -> DataFrame:
    return df.withColumn(
        "rejection_reason", rejection_reason(business_columns(df), blank_limit)
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("rejection_reason").isNull()).drop("rejection_reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("rejection_reason").isNotNull())


def quarantine_rows(
    checked: DataFrame, run_id: str, source: str, at: Column
) -> DataFrame:
    """Refused rows in the layout of the quarantine table, the row itself as JSON."""
    data = [c for c in checked.columns if c != "rejection_reason"]
    numbered = checked.withColumn("_row", F.monotonically_increasing_id())
    return rejected(numbered).select(
        F.concat(F.lit(f"Q-{run_id}-"), F.col("_row").cast("string")).alias("quarantine_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(source).alias("source_name"),
        F.to_json(F.struct(*(f"`{c}`" for c in data))).alias("raw_data"),
        "rejection_reason",
        at.alias("quarantined_at"),
    )


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop rows of nothing but nulls. Blank text is a value here."""
    return df.dropna(how="all", subset=business_columns(df))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count per column, only where there are some."""
    names = list(columns or business_columns(df))
    counted = df.agg(
        *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(names))
    )
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"))
        for i, c in enumerate(names)
    ]
    return counted.select(F.inline(F.array(*rows))).filter("null_count > 0")


def load_verification(
    df: DataFrame, expected: int | Column, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row: does the table hold at least the expected rows, and where are nulls."""
    names = list(columns or business_columns(df))
    want = expected if isinstance(expected, Column) else F.lit(expected)
    counted = df.agg(
        F.count(F.lit(1)).alias("loaded_count"),
        *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(names)),
    ).withColumn("expected_count", want.cast("long"))
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"))
        for i, c in enumerate(names)
    ]
    return counted.select(
        (F.col("loaded_count") >= F.col("expected_count")).alias("verified"),
        "expected_count",
        "loaded_count",
        F.greatest(F.col("expected_count") - F.col("loaded_count"), F.lit(0))
        .cast("long")
        .alias("missing_records"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.map_filter(
            F.map_from_entries(F.array(*entries)), lambda _, nulls: nulls > 0
        ).alias("null_summary"),
    )


def load_health(fetched: Column, loaded: Column) -> Column:
    """Loaded share of the fetched rows in percent; 0 when nothing was fetched."""
    return F.when(fetched > 0, F.round(loaded / fetched * 100, 1)).otherwise(0.0)
