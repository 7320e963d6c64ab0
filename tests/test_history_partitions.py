"""Product history in partitions, and repeats dropped from a stream."""

import os

from pyspark.sql import functions as F

from tradewind.plans import pipeline
from tradewind.rules import TableNames
from tradewind.sources import ops, warehouse
from tradewind.streaming import incremental

TABLE = TableNames().product_history


def snapshot(spark, *rows):
    df = spark.createDataFrame(list(rows), "product_sku string, price double")
    return df.selectExpr(
        "product_sku", "'n' AS product_name", "'c' AS category", "price", "5L AS stock_quantity",
        "'S' AS _source", "timestamp_ntz'2026-01-01' AS _loaded_at")


def versions(spark):
    return sorted(
        (r.product_sku, r.price, r.valid_from.day, r.valid_to and r.valid_to.day)
        for r in spark.table(TABLE).collect())


def files(spark):
    folder = warehouse.location(spark, TABLE).removeprefix("file:")
    return {
        os.path.relpath(os.path.join(d, f), folder): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")
    }


def test_closed_versions_are_never_written_again(spark, empty_catalog):
    assert pipeline.record_products(spark, snapshot(spark, ("a", 1.0), ("b", 2.0)), "2026-01-01") == 2
    assert pipeline.record_products(spark, snapshot(spark, ("a", 1.5), ("b", 2.0)), "2026-01-02") == 3
    closed = {f: t for f, t in files(spark).items() if "open" not in f}
    assert len(closed) == 1
    assert pipeline.record_products(spark, snapshot(spark, ("b", 3.0), ("c", 1.0)), "2026-01-03", close_missing=True) == 5
    assert closed.items() <= files(spark).items()
    assert versions(spark) == [
        ("a", 1.0, 1, 2), ("a", 1.5, 2, 3), ("b", 2.0, 1, 3), ("b", 3.0, 3, None), ("c", 1.0, 3, None)]
    # a snapshot without change closes nothing
    before = {f: t for f, t in files(spark).items() if "open" not in f}
    assert pipeline.record_products(spark, snapshot(spark, ("b", 3.0), ("c", 1.0)), "2026-01-04") == 5
    assert {f: t for f, t in files(spark).items() if "open" not in f} == before
    open_rows = spark.table(TABLE).filter(F.col("_period") == pipeline.OPEN)
    assert open_rows.count() == 2 and "PartitionFilters: [isnotnull(_period" in (
        open_rows._jdf.queryExecution().executedPlan().toString())


def test_a_call_that_failed_halfway_is_made_again(spark, empty_catalog, monkeypatch):
    pipeline.record_products(spark, snapshot(spark, ("a", 1.0), ("b", 2.0)), "2026-01-01")
    write, calls = warehouse.overwrite_partitions, []

    def failing(df, table, by):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        write(df, table, by)

    monkeypatch.setattr(warehouse, "overwrite_partitions", failing)
    change = snapshot(spark, ("a", 9.0), ("b", 2.0))
    try:
        pipeline.record_products(spark, change, "2026-01-02")
    except OSError:
        pass
    monkeypatch.setattr(warehouse, "overwrite_partitions", write)
    assert pipeline.record_products(spark, change, "2026-01-02") == 3
    assert versions(spark) == [("a", 1.0, 1, 2), ("a", 9.0, 2, None), ("b", 2.0, 1, None)]


def test_snapshots_at_one_moment_and_an_empty_one(spark, empty_catalog):
    at = "2026-01-02"
    pipeline.record_products(spark, snapshot(spark, ("a", 1.0), ("b", 2.0)), "2026-01-01")
    pipeline.record_products(spark, snapshot(spark, ("a", 1.5)), at)
    pipeline.record_products(spark, snapshot(spark, ("b", 2.5)), at)
    assert [v for v in versions(spark) if v[3]] == [("a", 1.0, 1, 2), ("b", 2.0, 1, 2)]
    assert pipeline.record_products(spark, snapshot(spark, ("a", 1.0)).limit(0), "2026-01-05", close_missing=True) == 4
    assert all(v[3] for v in versions(spark))
    assert pipeline.record_products(spark, snapshot(spark, ("z", 1.0)), "2026-01-06") == 5


def test_a_table_without_partitions_stays_usable(spark, empty_catalog):
    ops.create_if_missing(spark, TABLE, ops.PRODUCT_HISTORY)
    pipeline.record_products(spark, snapshot(spark, ("a", 1.0)), "2026-01-01")
    assert pipeline.record_products(spark, snapshot(spark, ("a", 2.0)), "2026-01-02") == 2


def deliver(spark, folder, *rows):
    """(key, value, day) rows as one more file."""
    spark.createDataFrame(list(rows), "k long, v string, day int").selectExpr(
        "k", "v", "timestamp_ntz'2026-01-01' + make_dt_interval(day) AS moment"
    ).coalesce(1).write.mode("append").parquet(folder)


def test_repeats_in_a_stream(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), str(tmp_path / "out")
    deliver(spark, inbox, (1, "a", 0), (2, "b", 1), (1, "a", 0), (3, None, 1))
    schema = spark.read.parquet(inbox).schema

    def take():
        stream = incremental.arrivals(spark, inbox, schema, maxFilesPerTrigger="1")
        rows, late = incremental.distinct_arrivals(stream, store, ["k", "v", "moment"], "moment", "10 days")
        return sorted((r.k, r.v, r.moment.day) for r in rows.collect()), late

    first = [(1, "a", 1), (2, "b", 2), (3, None, 2)]
    assert take() == (first, 0)
    assert take() == (first, 0)  # no new file
    # repeats of earlier files, another value of a key, then time moves on
    deliver(spark, inbox, (1, "a", 0), (1, "c", 3), (3, None, 1))
    deliver(spark, inbox, (9, "z", 25))
    deliver(spark, inbox, (9, "z", 25), (4, "d", 20))
    deliver(spark, inbox, (2, "b", 1), (9, "z", 25))  # the first is too late
    second = sorted([*first, (1, "c", 4), (9, "z", 26), (4, "d", 21)])
    assert take() == (second, 1)
    assert take() == (second, 0)


def test_repeats_are_found_among_what_is_stored(spark, tmp_path):
    """Keys without the moment: a key counts until time is the delay ahead of its stored row."""
    inbox, store = str(tmp_path / "in"), str(tmp_path / "out")
    for row in ((1, "a", 0), (1, "b", 9), (1, "c", 14), (2, "x", 40), (1, "d", 45), (1, "e", 60)):
        deliver(spark, inbox, row)
    schema = spark.read.parquet(inbox).schema

    def take():
        stream = incremental.arrivals(spark, inbox, schema, maxFilesPerTrigger="1")
        rows, late = incremental.distinct_arrivals(stream, store, ["k"], "moment", "10 days")
        return sorted(r.v for r in rows.collect()), late

    assert take() == (["a", "e", "x"], 0)
    deliver(spark, inbox, (1, "f", 75), (1, "g", 49))
    assert take() == (["a", "e", "x"], 1)
    deliver(spark, inbox, (None, "n", 76), (None, "n", 76), (2, "y", None))
    assert take() == (["a", "e", "n", "x", "y"], 0)
    assert not (tmp_path / "out" / "distinct-progress" / "state").exists()  # no key is held in memory


def test_stored_batches_without_spans_count(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), tmp_path / "out"
    deliver(spark, inbox, (1, "a", 0), (2, "b", 20))
    schema = spark.read.parquet(inbox).schema

    def take():
        stream = incremental.arrivals(spark, inbox, schema)
        rows, late = incremental.distinct_arrivals(stream, str(store), ["k", "v", "moment"], "moment", "10 days")
        return sorted(r.v for r in rows.collect()), late

    assert take() == (["a", "b"], 0)
    (store / "distinct-spans").rename(store / "spans-of-before")
    deliver(spark, inbox, (2, "b", 20), (3, "c", 5))
    assert take() == (["a", "b"], 1)


def test_large_deliveries_are_several_files_and_one_batch_each(spark, tmp_path, monkeypatch):
    from registry import queries

    lines = spark.range(0, 4000, 1, 4).selectExpr(
        "id AS l_orderkey", "id % 50 AS l_partkey", "id % 10 AS l_suppkey", "1 AS l_linenumber",
        "cast(1 + id % 9 AS double) AS l_quantity", "100.0D AS l_extendedprice", "0.0D AS l_discount", "0.0D AS l_tax",
        "'N' AS l_returnflag", "'O' AS l_linestatus",
        "timestamp_ntz'1992-06-01' + make_dt_interval(cast(id % 7 * 365 AS int)) AS l_shipdate")
    heads = lines.selectExpr(
        "l_orderkey AS o_orderkey", "l_orderkey % 90 AS o_custkey", "'O' AS o_orderstatus",
        "100.0D AS o_totalprice", "timestamp_ntz'1992-01-01' AS o_orderdate", "'1' AS o_orderpriority")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    heads.write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        monkeypatch.setattr(queries, "DELIVERY_FILE_ROWS", 150)
        path, schema, files_each = queries.order_deliveries(spark, str(tmp_path))
        got = queries.stream_distinct(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files_each == 4
    assert len(spark.read.schema(schema).parquet(path).inputFiles()) == 7 * files_each
    late = sum(1 for i in range(0, 4000, 7) if (i * 8 + 1) % 11 == 0)
    assert [tuple(r) for r in got] == [("O", 4000, sum(-q if i % 89 == 0 else q for i in range(4000)
                                                       for q in [1 + i % 9]), 4000, late)]
