import datetime as dt

from pyspark.sql import functions as F

import pytest

from tradewind.operators import audit, history, reshape
from tradewind.sources import ops


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (2, "b2", 21)], "k int, v string, n int")
    source = spark.createDataFrame([(2, "B", None), (3, "C", 30)], "k int, v string, n int")
    got = sorted(map(tuple, history.upsert(target, source, ["k"]).collect()), key=str)
    assert got == [(1, "a", 10), (2, "B", None), (2, "B", None), (3, "C", 30)]
    got = {tuple(r) for r in history.upsert(target, source, ["k"], ["v"]).collect()}
    assert got == {(1, "a", 10), (2, "B", 20), (2, "B", 21), (3, "C", 30)}


def snapshot(spark, *rows):
    df = spark.createDataFrame(
        list(rows), "product_sku string, product_name string, category string, price double, "
        "stock_quantity bigint"
    )
    return df.selectExpr("*", "'S' as _source", "timestamp_ntz'2026-01-01' as _loaded_at")


def versions(df):
    return sorted(
        (r.product_sku, r.price, r.valid_from.day, r.valid_to and r.valid_to.day, r.is_current)
        for r in df.collect()
    )


def test_product_history(spark):
    empty = spark.createDataFrame([], ops.PRODUCT_HISTORY)
    first = snapshot(spark, ("a", "A", None, 1.0, 5), ("b", "B", "x", 2.0, 5))
    day1 = history.apply_snapshot(empty, first, "2026-01-01")
    assert versions(day1) == [("a", 1.0, 1, None, True), ("b", 2.0, 1, None, True)]
    second = snapshot(spark, ("a", "A", None, 1.5, 5), ("c", "C", "x", 3.0, 5))
    day2 = history.apply_snapshot(day1, second, "2026-01-02")
    assert versions(day2) == [
        ("a", 1.0, 1, 2, False), ("a", 1.5, 2, None, True), ("b", 2.0, 1, None, True),
        ("c", 3.0, 2, None, True),
    ]
    assert versions(history.apply_snapshot(day2, second, "2026-01-03")) == versions(day2)
    day3 = history.apply_snapshot(day2, second, "2026-01-03", close_missing=True)
    assert ("b", 2.0, 1, 3, False) in versions(day3)
    day4 = history.apply_snapshot(day3, snapshot(spark, ("a", "A", "new", 1.5, 5)), "2026-01-04")
    assert ("a", 1.5, 2, 4, False) in versions(day4) and ("a", 1.5, 4, None, True) in versions(day4)
    keys = [r.surrogate_key for r in day4.collect()]
    assert len(set(keys)) == len(keys)


def test_schema_changes(spark):
    old = spark.createDataFrame([], "a int, b string, c double").schema
    new = spark.createDataFrame([], "A bigint, b string, d date").schema
    got = {
        (r.change_type, r.column_name, r.old_value, r.new_value)
        for r in history.schema_changes(spark, "S", old, new, dt.datetime(2026, 1, 1)).collect()
    }
    assert got == {("TYPE_CHANGED", "A", "int", "bigint"), ("REMOVED", "C", "double", None),
                   ("ADDED", "D", None, "date")}
    assert history.schema_changes(spark, "S", old, old).count() == 0


def test_volume_history(spark):
    loads = spark.createDataFrame(
        [("s", i) for i in [1, 1, 2, 2, 2, 4]] + [("t", 1)], "_source string, d int"
    ).selectExpr("_source", "timestamp_ntz'2026-01-01' + make_dt_interval(d) as _loaded_at")
    got = [
        (r.source_name, r.record_count, r.previous_count, r.change, r.change_pct)
        for r in history.volume_history(loads).orderBy("source_name", "recorded_at").collect()
    ]
    assert got == [("s", 2, None, None, None), ("s", 3, 2, 1, 50.0), ("s", 1, 3, -2, -66.7),
                   ("t", 1, None, None, None)]


def runs(spark, *statuses):
    rows = [
        (f"r{i}", "S", dt.datetime(2026, 1, 1, 0, i), None, s, 10, i, None, None, 1)
        for i, s in enumerate(statuses)
    ]
    return spark.createDataFrame(rows, ops.PIPELINE_RUNS)


def test_run_reports(spark):
    log = runs(spark, *(["FAILED"] * 5 + ["SUCCESS"] * 17 + ["FAILED"] * 3))
    assert tuple(audit.run_statistics(log).first()) == (25, 17, 8, sum(range(25)))
    assert audit.success_rate(log).first().success_rate == 85
    series = audit.run_series(log).collect()
    assert sorted(r.loaded for r in series) == list(range(15, 25))
    assert {r.name: r.loaded for r in series}["Run 1"] == 15
    assert {r.quarantined for r in series} == {0}
    assert audit.recent(log, "PIPELINE_RUNS").count() == 20
    assert [r.run_id for r in audit.newest(log, "start_time", 3).collect()] == ["r24", "r23", "r22"]
    none = runs(spark)
    assert tuple(audit.run_statistics(none).first()) == (0, 0, 0, 0)
    assert audit.success_rate(none).first().success_rate == 0


def test_newest_is_a_top_n(spark):
    plan = audit.newest(runs(spark, "SUCCESS"), "start_time", 3)._jdf.queryExecution()
    assert "TakeOrderedAndProject" in plan.sparkPlan().toString()


def test_result_shapes(spark):
    df = spark.createDataFrame(
        [("a label of many letters", "12.5 units", None), (None, "x", 1)],
        "l string, v string, n int",
    )
    assert {tuple(r) for r in audit.chart_series(df).collect()} == {
        ("a label of many", 12.5), ("N/A", 0.0),
    }
    assert {tuple(r) for r in audit.as_text(df).collect()} == {
        ("a label of many letters", "12.5 units", "N/A"), ("N/A", "x", "1"),
    }


def test_pivot_and_unpivot(spark):
    df = spark.createDataFrame([(1, "x", 2), (1, "y", 3), (2, "x", 5)], "k int, c string, v int")
    wide = reshape.pivot(df, ["k"], "c", ["x", "y"], F.sum("v"))
    assert {tuple(r) for r in wide.collect()} == {(1, 2, 3), (2, 5, None)}
    long = reshape.unpivot(wide, ["k"], ["x", "y"], "c", "v")
    assert {tuple(r) for r in long.collect()} == {(1, "x", 2), (1, "y", 3), (2, "x", 5)}


def test_values_that_move_between_columns_are_a_change(spark):
    kind = (
        "product_sku string, product_name string, category string, price double,"
        " stock_quantity bigint, _source string, _loaded_at timestamp_ntz"
    )
    first = spark.createDataFrame([("A", "X", None, 1.0, 1, "s", None)], kind)
    second = spark.createDataFrame([("A", None, "X", 1.0, 1, "s", None)], kind)
    opened = history.open_versions(first, "2001-01-01")
    after = history.apply_snapshot(opened, second, "2001-02-01").collect()
    assert sorted(r.is_current for r in after) == [False, True]


def test_a_repeated_key_fails_the_upsert(spark):
    target = spark.createDataFrame([(1, "a")], "id int, v string")
    source = spark.createDataFrame([(1, "b"), (1, "c")], "id int, v string")
    with pytest.raises(Exception, match="more than one row"):
        history.upsert(target, source, ["id"]).collect()
