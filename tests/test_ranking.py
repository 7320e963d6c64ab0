"""Ranges of any size give what one window over all rows gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewind.operators.dedup import latest_per_key
from tradewind.operators.ranking import global_rank, numbered, running_total


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, x double").repartition(4)


def plain_rank(df):
    window = Window.orderBy(F.col("x").desc_nulls_first())
    return {r.id: r.k for r in df.withColumn("k", F.rank().over(window)).collect()}


RANDOM = random.Random(7)
CASES = {
    "distinct": [float(i) for i in range(500)],
    "third is one value": [5.0 if i % 3 == 0 else RANDOM.random() * 10 for i in range(600)],
    "nulls": [None if i % 3 == 0 else float(i % 50) for i in range(600)],
    "all equal": [1.0] * 300,
    "all null": [None] * 50,
    "few values": [float(i % 4) for i in range(400)],
    "third is infinite": [float("inf") if i % 3 == 0 else float(i) for i in range(300)],
    "negative and infinite": [float("-inf"), float("inf"), *range(-100, 100)],
    "empty": [],
    "one": [3.0],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_rank_equals_plain_window(spark, name, ranges):
    df = frame(spark, [None if v is None else float(v) for v in CASES[name]])
    ranked = global_rank(df, "x", "k", ranges)
    assert ranked.columns == ["id", "x", "k"]
    got = {r.id: r.k for r in ranked.collect()}
    assert got == plain_rank(df)


def test_identical_rows_stay_spread(spark):
    """Rows that are all alike are neither sorted nor brought together."""
    df = spark.range(0, 400_000, 1, 8).select(F.lit(1.0).alias("x"))
    ranked = global_rank(df, "x", "k")
    tasks = ranked.groupBy(F.spark_partition_id()).agg(F.count("*"), F.max("k")).collect()
    assert len(tasks) > 1 and sum(t[1] for t in tasks) == 400_000 and {t[2] for t in tasks} == {1}


@pytest.mark.parametrize("ranges", [None, 7])
def test_running_total_equals_plain_window(spark, ranges):
    values = [(i * 3, float(RANDOM.randint(0, 100))) for i in range(300)]
    df = spark.createDataFrame(values, "day bigint, v double").repartition(5)
    got = {r.day: r.t for r in running_total(df, "day", "v", "t", ranges).collect()}
    total, want = 0.0, {}
    for day, value in values:
        total += value
        want[day] = total
    assert got == want


def test_latest_per_key_combines_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as t", "id * 2 as v")
    newest = latest_per_key(df, ["k"], "t")
    assert {(r.k, r.t, r.v) for r in newest.collect()} == {
        (0, 999, 1998), (1, 997, 1994), (2, 998, 1996),
    }
    assert newest.columns == df.columns
    assert "partial_max" in newest._jdf.queryExecution().sparkPlan().toString()


def test_latest_per_key_ties_and_nulls(spark):
    rows = [
        ("a", 1, 5, "x"), ("a", 2, 1, "y"), ("a", 2, None, "z"),  # larger tie wins
        ("b", 9, 9, "x"), ("b", None, 0, "y"),  # no date sorts as the newest
        ("c", 1, None, None), ("c", 1, None, "q"),
        (None, 7, 7, "x"),
    ]
    df = spark.createDataFrame(rows, "k string, t int, v int, w string")
    got = {tuple(r) for r in latest_per_key(df, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 2, 1, "y"), ("b", None, 0, "y"), ("c", 1, None, "q")}


def test_positions(spark):
    df = spark.createDataFrame(
        [(i, None if i % 7 == 0 else i % 5) for i in range(200)], "id long, x long").repartition(6)
    got = numbered(df, "n", F.col("x").desc_nulls_last(), F.col("id"), ranges=4)
    rows = sorted(got.collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(1, 201)) and got.columns == ["id", "x", "n"]
    want = sorted(df.collect(), key=lambda r: (r.x is None, -(r.x or 0), r.id))
    assert [r.id for r in rows] == [r.id for r in want]
