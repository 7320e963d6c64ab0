"""Rows to columns and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def pivot(
    df: DataFrame, keys: Sequence[str], names: str, values: Sequence[str], measure: Column
) -> DataFrame:
    """One column per entry of ``values``. Naming them spares Spark a pass to find them."""
    return df.groupBy(*keys).pivot(names, list(values)).agg(measure)


def unpivot(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    """One row per key and column; rows with a null value are left out."""
    return df.unpivot(list(keys), list(columns), name, value).dropna(subset=[value])
