"""Newest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame, keys: Sequence[str], newest: str, ties: Sequence[str] = ()
) -> DataFrame:
    """The row with the largest ``newest`` per key; rows with a null key are dropped.

    A null ``newest`` counts as the largest, as in a descending sort with nulls
    first. Among equals the largest ``ties`` win, then the largest remaining
    columns, so the choice does not depend on how the rows arrive.

    The maximum of a struct is a plain aggregate: it sorts by the key only and
    combines before the shuffle, so a key with very many copies sends one row
    per input partition.
    """
    order = [newest, *ties]
    order += [c for c in df.columns if c not in order and c not in keys]
    row = F.struct(F.col(newest).isNull().alias("_undated"), *order)
    keyed = df
    for key in keys:
        keyed = keyed.filter(F.col(key).isNotNull())
    picked = keyed.groupBy(*keys).agg(F.max(row).alias("_row"))
    return picked.select(*(c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns))
