"""Quality checks of a table from what each of its loads wrote down.

A load counts its own rows once and keeps the counts and two sketches of its keys: all keys, and
those that it repeats. Counts of a table are the sums over its loads. A key is repeated in the
table if a load repeats it or two loads have it, so sketches of sets give that number too: the
union of what is repeated and, load by load, the common part of its keys and those before.
No check reads earlier rows again. Key sketches are exact up to their size, beyond it an estimate.

A date is judged by the moment of its load: what lay ahead then is an impossible date.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind import rules
from tradewind.functions.columns import as_of_timestamp
from tradewind.operators import quality

#: Two to this power are the keys that a sketch holds; up to so many it is exact.
LG_KEYS = 17
PROFILE = (
    "table_name string, load_id string, loaded_at timestamp_ntz, total_records bigint, "
    "issue_type string, column_name string, issue_count bigint, keys binary, repeated binary"
)


def relative_error(lg_keys: int = LG_KEYS) -> float:
    """Standard error of an estimated number of keys, as share of all keys."""
    return 1 / math.sqrt(2 ** lg_keys - 1)


def profile(
    rows: DataFrame, table: str, load_id: str, as_of=None, sku: str = rules.sku_pattern(),
    lg_keys: int = LG_KEYS,
) -> DataFrame:
    """What one load writes down: a row per check, and one with the sketches of its keys."""
    exact = [k for k in quality.ALL_CHECKS if k != quality.DUPLICATES]
    counts = quality.check_counts(rows, table, as_of, sku, exact).withColumns({
        "keys": F.lit(None).cast("binary"), "repeated": F.lit(None).cast("binary")
    })
    columns = quality.business_columns(rows)
    if columns:
        key = F.col(f"`{columns[0]}`")
        per_key = rows.groupBy(F.xxhash64(key.isNull(), key).alias("key")).agg(
            F.count(F.lit(1)).alias("copies")
        )
        sketched = per_key.agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("total_records"),
            F.theta_sketch_agg("key", F.lit(lg_keys)).alias("keys"),
            F.theta_sketch_agg(
                F.when(F.col("copies") > 1, F.col("key")), F.lit(lg_keys)
            ).alias("repeated"),
        )
        counts = counts.unionByName(sketched.select(
            F.lit(table).alias("table_name"), "total_records",
            F.lit(quality.DUPLICATES).alias("issue_type"), F.lit(columns[0]).alias("column_name"),
            F.lit(None).cast("bigint").alias("issue_count"), "keys", "repeated",
        ))
    return counts.withColumns({
        "load_id": F.lit(load_id), "loaded_at": as_of_timestamp(as_of)
    }).select(*(c.split()[0] for c in PROFILE.split(", ")))


def merged(profiles: DataFrame, lg_keys: int = LG_KEYS) -> DataFrame:
    """Counts of the tables over all their loads, as ``quality.check_counts`` gives them.

    A load id that comes twice counts once. A check that one load could not make, for a text that
    does not convert, is not made for the table. A column that some loads lack is checked in
    the others.
    """
    once = profiles.dropDuplicates(["table_name", "load_id", "issue_type", "column_name"])
    check = ["table_name", "issue_type", "column_name"]
    counted = once.filter(
        F.col("issue_type").isNull() | (F.col("issue_type") != quality.DUPLICATES)
    ).groupBy(*check).agg(
        F.sum("total_records").alias("total_records"),
        F.when(F.count("issue_count") == F.count(F.lit(1)), F.sum("issue_count")).alias("issue_count"),
    )
    # a row per load: loads are brought together in order, a sketch at a time
    load = F.struct("loaded_at", "load_id", "keys", "repeated")
    loads = once.filter(F.col("issue_type") == quality.DUPLICATES).groupBy(*check).agg(
        F.sum("total_records").alias("total_records"), F.sort_array(F.collect_list(load)).alias("loads")
    )
    first = F.element_at("loads", 1)
    folded = F.aggregate(
        F.slice("loads", 2, F.greatest(F.size("loads") - 1, F.lit(0))),
        F.struct(first["keys"].alias("keys"), first["repeated"].alias("repeated")),
        lambda state, one: F.struct(
            F.theta_union(state["keys"], one["keys"], lg_keys).alias("keys"),
            F.theta_union(
                F.theta_union(state["repeated"], one["repeated"], lg_keys),
                F.theta_intersection(state["keys"], one["keys"]), lg_keys,
            ).alias("repeated"),
        ),
    )
    repeated = loads.select(
        *check, "total_records", F.theta_sketch_estimate(folded["repeated"]).alias("issue_count")
    )
    columns = ("table_name", "total_records", "issue_type", "column_name", "issue_count")
    return counted.select(*columns).unionByName(repeated.select(*columns))
