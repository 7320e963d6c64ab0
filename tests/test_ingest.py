import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradewind.operators import validation
from tradewind.plans import ingest
from tradewind.sources import files, ops, relational, warehouse

HEADER = "Order Id,Store-Name,Price (USD),Qty/Unit,Note,Date"
FULL = "1,North,2.5,3,fine,2026-01-01"


def write(tmp_path, *lines, name="data.csv"):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def test_names_are_cleaned():
    assert files.clean_names(HEADER.split(",")) == [
        "ORDER_ID", "STORE_NAME", "PRICE_USD", "QTY_UNIT", "NOTE", "DATE",
    ]
    with pytest.raises(ValueError, match="not unique"):
        files.clean_names(["a b", "A-B"])
    with pytest.raises(ValueError, match="empty"):
        files.clean_names(["a", None])


@pytest.mark.parametrize("cells, kind", [
    (["1", "-2", "+3"], "bigint"),
    (["1", "", "3"], "double"),
    (["1", "NA", "3"], "double"),
    (["1", "2.5", "1e3"], "double"),
    (["inf", "-Infinity", "1"], "double"),
    (["1", "  ", "3"], "string"),
    (["5d", "1", "2"], "string"),
    (["9223372036854775808", "1", "2"], "string"),
    (["True", "false", "TRUE"], "boolean"),
    (["True", "", "False"], "string"),
    (["2026-01-01", "2026-01-02", "2026-01-03"], "string"),
    (["", "", ""], "double"),
    (["x", "None", "null"], "string"),
])
def test_type_inference(spark, tmp_path, cells, kind):
    path = write(tmp_path, "key,cell", *(f"{i},{c}" for i, c in enumerate(cells)))
    assert types(files.read_csv(spark, path))["CELL"] == kind


def test_null_tokens_and_values(spark, tmp_path):
    path = write(tmp_path, "a,b,c", '1," x ",N/A', '2,"say ""hi""",<NA>', "", "3,,nan")
    rows = [tuple(r) for r in files.read_csv(spark, path).orderBy("A").collect()]
    assert rows == [(1, " x ", None), (2, 'say "hi"', None), (3, None, None)]


def test_header_only_and_empty_and_long_rows(spark, tmp_path):
    assert files.read_csv(spark, write(tmp_path, "a,b", name="h.csv")).count() == 0
    with pytest.raises(ValueError, match="more than 2 fields"):
        files.read_csv(spark, write(tmp_path, "a,b", "1,2", "1,2,3", name="l.csv"))
    short = files.read_csv(spark, write(tmp_path, "a,b", "1,2", "3", name="s.csv"))
    assert {tuple(r) for r in short.collect()} == {(1, 2.0), (3, None)}


def test_line_breaks_in_quotes(spark, tmp_path):
    path = write(tmp_path, "a,b", '1,"two', 'lines"', "2,one")
    rows = {tuple(r) for r in files.read_csv(spark, path).collect()}
    assert rows == {(1, "two\nlines"), (2, "one")}
    assert files.has_quoted_breaks(spark, path)
    plain = write(tmp_path, "a,b", '1,"say ""x"""', name="plain.csv")
    assert not files.has_quoted_breaks(spark, plain)


def test_headers_in_another_order_are_refused(spark, tmp_path):
    write(tmp_path, "a,b", "1,x", name="one.csv")
    write(tmp_path, '"A", b', "2,y", name="two.csv")
    rows = {tuple(r) for r in files.read_csv(spark, str(tmp_path)).collect()}
    assert rows == {(1, "x"), (2, "y")}
    write(tmp_path, "b,a", "z,3", name="three.csv")
    with pytest.raises(ValueError, match="2 different header lines"):
        files.read_csv(spark, str(tmp_path))


@pytest.mark.parametrize("row, reason", [
    (FULL, None),
    ("7,,,,,", "TOO_MANY_NULLS_5_of_6_columns"),
    ("7,South,,,,", None),
    (",,,,,", "COMPLETELY_EMPTY_ROW"),
    ('7,"  ","\t"," ","   "," "', "TOO_MANY_NULLS_5_of_6_columns"),
    ("7,South,1.0,NA,x,y", None),
])
def test_validation_cases(spark, empty_catalog, tmp_path, row, reason):
    path = write(tmp_path, HEADER, FULL, row)
    report = ingest.load_csv_to_bronze(spark, path, "case")
    refused = 0 if reason is None else 1
    assert report["status"] == "success"
    assert (report["records_fetched"], report["records_loaded"],
            report["records_quarantined"]) == (2, 2 - refused, refused)
    assert report["health_score"] == (50.0 if refused else 100.0)
    assert report["verification"]["verified"] and report["verification"]["column_count"] == 10
    table = spark.table("BRZ_CASE")
    assert table.columns[-4:] == ["_SOURCE", "_LOADED_AT", "_RUN_ID", "_FILE_NAME"]
    assert {(r._SOURCE, r._FILE_NAME) for r in table.collect()} == {("CSV_CASE", "data.csv")}
    (run,) = spark.table("PIPELINE_RUNS").collect()
    assert (run.status, run.records_quarantined, run.run_id) == (
        "SUCCESS", refused, report["run_id"],
    )
    if reason:
        (kept,) = spark.table("QUARANTINE_RECORDS").collect()
        assert kept.rejection_reason == reason and kept.source_name == "CSV_CASE"
        assert kept.quarantine_id.startswith(f"Q-{report['run_id']}-")
        assert kept.raw_data.startswith("{")


def test_four_of_five_blank_is_kept(spark):
    df = spark.createDataFrame([(1, None, "", " ", "\n")], "a int, b int, c string, d string, e string")
    assert validation.with_reason(df).first().rejection_reason is None


def test_schema_is_frozen_at_the_first_load(spark, empty_catalog, tmp_path):
    load = ingest.load_csv_to_bronze
    assert load(spark, write(tmp_path, "a,b", "1,2", name="1.csv"), "t")["status"] == "success"
    report = load(spark, write(tmp_path, "a,b,new", "1,2,3", name="2.csv"), "t")
    assert report["status"] == "error" and "NEW" in report["message"]
    assert load(spark, write(tmp_path, "b", "7", name="3.csv"), "t")["status"] == "success"
    assert load(spark, write(tmp_path, "a,b", "1,x", name="4.csv"), "t")["status"] == "error"
    assert load(spark, write(tmp_path, "a,b", "2.6,5", name="5.csv"), "t")["status"] == "success"
    assert {(r.A, r.B) for r in spark.table("BRZ_T").collect()} == {(1, 2), (None, 7), (3, 5)}
    runs = {(r.status, r.records_loaded) for r in spark.table("PIPELINE_RUNS").collect()}
    assert runs == {("SUCCESS", 1), ("FAILED", 0)}
    failed = spark.table("PIPELINE_RUNS").filter("status = 'FAILED'").first()
    assert failed.error_message
    changes = spark.table("SCHEMA_CHANGES").collect()
    assert {(r.change_type, r.column_name) for r in changes} == {
        ("ADDED", "NEW"), ("REMOVED", "A"), ("TYPE_CHANGED", "B"), ("TYPE_CHANGED", "A"),
    }
    assert [r.record_count for r in spark.table("VOLUME_HISTORY").collect()] == [1, 1, 1]


def test_unknown_file_kind_logs_nothing(spark, empty_catalog):
    assert ingest.load_csv_to_bronze(spark, "/x/data.CSV", "t")["status"] == "error"
    assert not spark.catalog.tableExists("PIPELINE_RUNS")


@pytest.mark.parametrize("source, target", [
    ("decimal(10,2)", "double"), ("tinyint(1)", "bigint"), ("int unsigned", "string"),
    ("VARCHAR(20)", "string"), ("datetime", "timestamp_ntz"), ("date", "date"),
    ("json", "string"), ("BIGINT", "bigint"),
])
def test_source_types(source, target):
    assert relational.load_type(source) == target


def test_map_types_and_bytes(spark):
    df = spark.createDataFrame(
        [(bytearray(b"\x01\x00"), "1.50", dt.datetime(2026, 1, 2, 3, 4, 5))],
        "flag binary, price string, at timestamp_ntz",
    )
    mapped = relational.map_types(
        df, {"flag": "bit(16)", "price": "decimal(8,2)", "at": "timestamp"}
    )
    assert types(mapped) == {"FLAG": "string", "PRICE": "double", "AT": "timestamp_ntz"}
    assert tuple(mapped.first()) == ("256", 1.5, dt.datetime(2026, 1, 2, 3, 4, 5))


class Source:
    def __init__(self, frames):
        self.frames = frames

    def tables(self):
        return sorted(self.frames)

    def read(self, name):
        return self.frames[name]

    def column_types(self, name):
        native = relational.FolderSource.NATIVE
        return {f.name: native[f.dataType.simpleString()] for f in self.read(name).schema}


def test_sync_all(spark, empty_catalog):
    frames = {
        "full": spark.createDataFrame([(1, "a"), (None, None), (None, " ")], "k int, v string"),
        "none": spark.createDataFrame([], "k int"),
    }
    reports = {r["source"]: r for r in ingest.sync_all(spark, Source(frames))}
    full = reports["MYSQL_FULL"]
    assert (full["records_fetched"], full["records_loaded"], full["records_quarantined"]) == (
        3, 2, 1,
    )
    assert full["health_score"] == 66.7
    assert reports["MYSQL_NONE"]["message"] == "Table is empty"
    assert spark.table("PIPELINE_RUNS").count() == 1
    assert not spark.catalog.tableExists("BRZ_MYSQL_NONE")
    ingest.sync_all(spark, Source(frames))
    assert spark.table("BRZ_MYSQL_FULL").count() == 4  # a full reload is appended
    assert types(spark.table("BRZ_MYSQL_FULL"))["K"] == "bigint"


def test_sync_logs_how_columns_changed(spark, empty_catalog):
    def sync(df):
        return ingest.sync_table_to_bronze(spark, Source({"t": df}), "t")["status"]

    first = spark.createDataFrame([(1, "a")], "k int, v string")
    assert [sync(first), sync(first)] == ["success", "success"]
    assert spark.table("SCHEMA_CHANGES").count() == 0
    sync(spark.createDataFrame([(1, 2.5, "x")], "k int, v double, w string"))
    found = spark.table("SCHEMA_CHANGES").filter("source_name = 'MYSQL_T'").collect()
    assert {(r.change_type, r.column_name) for r in found} == {("TYPE_CHANGED", "V"), ("ADDED", "W")}


@pytest.mark.parametrize("keys, column", [
    (["id"], "id"), (["day", "id"], "day"), (["code", "id"], None), (["price"], None), ([], None),
    (["gone"], None), (["big"], "big"),
])
def test_key_to_read_by(keys, column):
    kinds = {"id": "int(11) unsigned", "big": "BIGINT", "day": "date", "code": "varchar(8)",
             "price": "decimal(10,2)"}
    assert relational.partition_column(keys, kinds) == column


def test_read_options():
    assert relational.read_options("t") == relational.read_options("t", "id") == {"dbtable": "t"}
    got = relational.read_options("t", "id", 5, 1_000_000)
    assert got == {"dbtable": "t", "partitionColumn": "id", "lowerBound": "5",
                   "upperBound": "1000000", "numPartitions": "64"}
    assert relational.read_options("t", "id", 7, 9)["numPartitions"] == "3"
    day = relational.read_options("t", "day", dt.date(2026, 1, 1), dt.date(2026, 2, 1), 8)
    assert (day["lowerBound"], day["numPartitions"]) == ("2026-01-01", "8")


def test_tables_are_read_by_their_key(spark):
    class Answers(relational.JdbcSource):
        """Answers the catalog's questions from tables in place of a database."""

        def _query(self, text):
            if "key_column_usage" in text:
                return self.spark.createDataFrame(
                    [("line", 2), ("id", 1)] if "'orders'" in text else [], "name string, place int")
            if "information_schema.columns" in text:
                return self.spark.createDataFrame([("id", "bigint"), ("line", "int")], "name string, kind string")
            assert text.endswith(("FROM orders", "FROM empty", "FROM other"))
            none = "FROM empty" in text
            return self.spark.createDataFrame(
                [(None, None) if none else (1, 500)], "low long, high long")

    source = Answers(spark, "jdbc:x", "shop", partition_columns={"empty": "id", "whole": None, "other": "line"})
    assert source.keys("orders") == ["id", "line"]
    assert source.options("orders")["partitionColumn"] == "id"
    assert source.options("other")["partitionColumn"] == "line"
    for one_task in ("empty", "whole", "keyless"):
        assert source.options(one_task) == {"dbtable": one_task}


def test_load_verification(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 3, "y")], "a int, b int, _SOURCE string")
    row = validation.load_verification(df, 3).first()
    assert (row.verified, row.missing_records, row.column_count) == (False, 1, 3)
    assert row.null_summary == {"b": 1}


def test_load_health(spark):
    got = spark.range(1).select(
        validation.load_health(F.lit(0), F.lit(0)).alias("none"),
        validation.load_health(F.lit(3), F.lit(2)).alias("some"),
    ).first()
    assert tuple(got) == (0.0, 66.7)
    assert ingest.health_score(0, 0) == 0.0


def test_list_bronze_and_catalog(spark, empty_catalog):
    warehouse.append(spark.range(3).toDF("A"), "BRZ_ONE")
    warehouse.append(spark.range(5).toDF("A"), "BRZ_TWO")
    warehouse.replace(spark.range(2).toDF("a"), "GOLD_X")
    ops.create_tables(spark)
    listed = {r.table_name: r.record_count for r in warehouse.list_bronze(spark).collect()}
    assert listed == {"brz_one": 3, "brz_two": 5}
    order = [r.table_name for r in warehouse.catalog_summary(spark).collect()]
    assert order[:3] == ["gold_x", "brz_one", "brz_two"] and len(order) == 3 + len(ops.TABLES)


def test_swap_replaces_a_table_by_a_query_on_itself(spark, empty_catalog):
    warehouse.replace(spark.range(3).toDF("a"), "T")
    assert warehouse.swap(spark.table("T").selectExpr("a + 10 as a"), "T") == 3
    assert sorted(r.a for r in spark.table("T").collect()) == [10, 11, 12]
    assert warehouse.names(spark) == ["t"]
