import pytest
from pyspark.sql import functions as F

from seed import AS_OF, bronze_tables
from tradewind.operators import quality


def found(df, table="T", as_of=AS_OF, **options):
    counts = quality.check_counts(df, table, as_of, **options)
    return {(r.issue_type, r.column_name): r for r in quality.issues(counts).collect()}


def score(df, as_of=AS_OF):
    return quality.health(quality.check_counts(df, "T", as_of)).first()


@pytest.mark.parametrize("table", ["orders", "inventory", "stores"])
def test_seed_tables_are_healthy(spark, table):
    df = bronze_tables(spark)[table]
    assert found(df) == {}
    assert (score(df).health_score, score(df).quality_status) == (100.0, "HEALTHY")


def test_second_sync_gives_duplicates(spark):
    df = bronze_tables(spark, syncs=2)["orders"]
    issues = found(df)
    assert set(issues) == {(quality.DUPLICATES, "order_id")}
    row = issues[quality.DUPLICATES, "order_id"]
    assert (row.issue_count, row.percentage, row.severity) == (10, 50.0, "HIGH")
    assert row.description == "10 duplicate values in order_id"
    health = score(df)
    assert (health.bad_records, health.health_score, health.quality_status) == (
        10, 50.0, "CRITICAL",
    )


def test_every_defect_is_found(spark):
    df = bronze_tables(spark)["orders"].withColumns({
        "store_id": F.expr("case when order_id <= 1003 then null else store_id end"),
        "customer_id": F.expr("case when order_id = 1001 then null else customer_id end"),
        "quantity": F.expr("case when order_id = 1002 then -1 else quantity end"),
        "order_date": F.expr("case when order_id = 1004 then timestamp_ntz'2027-01-01' "
                             "else order_date end"),
        "product_sku": F.expr("case order_id when 1005 then 'BAD' when 1006 then null "
                              "else product_sku end"),
    })
    issues = found(df)
    summary = {k: (r.issue_count, r.percentage, r.severity) for k, r in issues.items()}
    assert summary == {
        (quality.NULLS, "store_id"): (3, 30.0, "HIGH"),
        (quality.NULLS, "customer_id"): (1, 10.0, "MEDIUM"),
        (quality.NULLS, "product_sku"): (1, 10.0, "MEDIUM"),
        (quality.NEGATIVES, "quantity"): (1, 10.0, "HIGH"),
        (quality.FUTURE_DATES, "order_date"): (1, 10.0, "MEDIUM"),
        (quality.BAD_SKUS, "product_sku"): (1, 10.0, "HIGH"),
    }
    assert issues[quality.NULLS, "store_id"].description == "3 NULL values (30.0%) in store_id"
    health = score(df)
    assert (health.bad_records, health.health_score) == (8, 20.0)
    alerts = quality.alerts(
        quality.issues(quality.check_counts(df, "T", AS_OF)), AS_OF
    ).collect()
    assert len(alerts) == 6 and all(len(a.alert_id) == 32 for a in alerts)
    assert "T: 1 SKUs don't match ELF-XXXXX format" in {a.message for a in alerts}


def test_low_null_share(spark):
    df = spark.range(100).selectExpr("id", "if(id = 0, null, id) as v")
    assert found(df)[quality.NULLS, "v"].severity == "LOW"


def test_text_that_does_not_convert_skips_the_check(spark):
    rows = [(1, "-5", "2030-01-01", "-1"), (2, "-3", "2020-01-01", "x"), (3, None, None, "2")]
    df = spark.createDataFrame(rows, "id int, unit_text string, made_date string, price string")
    issues = found(df, only=[quality.NEGATIVES, quality.FUTURE_DATES])
    assert {k: r.issue_count for k, r in issues.items()} == {
        (quality.NEGATIVES, "unit_text"): 2, (quality.FUTURE_DATES, "made_date"): 1,
    }


def test_null_keys_are_one_group_and_lineage_is_skipped(spark):
    df = spark.createDataFrame(
        [(None, None), (None, None), (1, None), (1, None), (2, None)], "k int, _note string"
    )
    issues = found(df)
    assert issues[quality.DUPLICATES, "k"].issue_count == 2
    assert all(not column.startswith("_") for _, column in issues)


def test_empty_table(spark):
    df = spark.createDataFrame([], "k int, total int")
    assert found(df) == {}
    assert (score(df).health_score, score(df).quality_status) == (100.0, None)


def test_warning_band_and_floor(spark):
    df = spark.range(100).selectExpr("id", "if(id < 25, null, id) as v")
    assert (score(df).health_score, score(df).quality_status) == (75.0, "WARNING")
    df = spark.range(10).selectExpr("id", "cast(null as int) a", "cast(null as int) b")
    assert score(df).health_score == 0.0


def test_column_checks_are_one_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    bronze_tables(spark)["orders"].write.parquet(path)
    counts = quality.check_counts(spark.read.parquet(path), "T", AS_OF)
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 2  # all columns once, the key once more
    assert "ReadSchema: struct<order_id:bigint>" in plan
