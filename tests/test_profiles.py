"""Checks merged from the profiles of loads against checks of the whole table."""

import datetime as dt

from pyspark.sql import functions as F

from tradewind.operators import profiles, quality

AS_OF = "2026-06-01 00:00:00"
SCHEMA = "order_id long, product_sku string, unit_price string, order_date timestamp_ntz"


def table(spark, rows):
    day = dt.datetime(2026, 5, 30)
    return spark.createDataFrame(
        [(k, s, p, day + dt.timedelta(days=d)) for k, s, p, d in rows], SCHEMA)


def counts(df):
    return sorted((str(r.issue_type), str(r.column_name), r.issue_count, r.total_records) for r in df.collect())


def test_merged_loads_equal_the_whole_table(spark):
    loads = [
        [(1, "ELF-00001", "2.5", 0), (1, None, "-1", 1), (2, "x", None, 9), (None, "ELF-00002", "1", 0)],
        [(2, "ELF-00001", "-3", 7), (3, "ELF-1", "0", 0), (None, None, "5", 2)],
        [(4, "ELF-00001", "1", 0)],
        [(4, "y", "2", 8), (4, "y", "2", 8), (3, "z", "-9", 0)],
    ]
    made = [profiles.profile(table(spark, rows), "T", f"l{n}", AS_OF) for n, rows in enumerate(loads)]
    for upto in range(1, 5):
        kept = made[0]
        for p in made[1:upto]:
            kept = kept.unionByName(p)
        whole = table(spark, [r for rows in loads[:upto] for r in rows])
        want = quality.check_counts(whole, "T", AS_OF)
        assert counts(profiles.merged(kept)) == counts(want)
        assert counts(profiles.merged(kept.unionByName(made[0]))) == counts(want)  # a load twice
        assert quality.health(profiles.merged(kept)).collect() == quality.health(want).collect()


def test_a_check_that_one_load_could_not_make(spark):
    good = profiles.profile(table(spark, [(1, "ELF-00001", "-1", 0)]), "T", "a", AS_OF)
    text = profiles.profile(table(spark, [(2, "ELF-00001", "free", 0)]), "T", "b", AS_OF)
    by_check = {(r.issue_type, r.column_name): r.issue_count for r in profiles.merged(good.unionByName(text)).collect()}
    assert by_check[(quality.NEGATIVES, "unit_price")] is None
    assert by_check[(quality.DUPLICATES, "order_id")] == 0
    empty = profiles.profile(table(spark, [(1, "a", "b", 0)]).limit(0), "T", "c", AS_OF)
    merged = profiles.merged(good.unionByName(empty))
    assert {r.total_records for r in merged.collect()} == {1}


def test_sketched_keys_stay_within_their_error(spark):
    keys = spark.range(40_000)
    parts = [keys.filter("id < 30000"), keys.filter("id >= 20000"), keys.filter("id % 4 = 0 AND id < 10000")]
    kept = None
    for n, part in enumerate(parts):
        one = profiles.profile(part.select(F.col("id").alias("k")), "T", str(n), AS_OF, lg_keys=12)
        kept = one if kept is None else kept.unionByName(one)
    found = profiles.merged(kept, lg_keys=12).filter(F.col("issue_type") == quality.DUPLICATES).first()
    assert abs(found.issue_count - 12_500) <= 4 * profiles.relative_error(12) * 40_000
    assert found.total_records == 52_500


def test_profiles_of_runs(spark, empty_catalog, tmp_path):
    from tradewind.plans import ingest

    path = tmp_path / "a.csv"
    for rows in ("1,-5\n2,3\n", "2,7\n,8\n,9\n"):
        path.write_text(f"id,price\n{rows}")
        report = ingest.load_csv_to_bronze(spark, str(path), "a")
        assert report["verification"]["loaded_count"] == report["records_loaded"]  # this run alone
        ingest.profile_run(spark, "BRZ_A", report["run_id"], AS_OF)
    whole = quality.check_counts(spark.table("BRZ_A"), "BRZ_A", AS_OF)
    assert counts(profiles.merged(spark.table("QUALITY_PROFILES"))) == counts(whole)


def test_quotes_inside_a_field_open_nothing(spark, tmp_path):
    from tradewind.sources import files

    def breaks(*lines):
        path = tmp_path / "q.csv"
        path.write_text("\n".join(("a,b", *lines)) + "\n")
        return files.has_quoted_breaks(spark, str(path))

    assert not breaks('5" pipe,x', '"6"" pipe",y', '"a,""b",z', 'x,7" "', ' "q" ,1')
    assert breaks('"over', 'two lines",x') and breaks('x,"a ""b""', 'c"')
    rows = files.read_csv(spark, str(tmp_path / "q.csv")).collect()
    assert [tuple(r) for r in rows] == [("x", 'a "b"\nc')]
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n")
    (folder / "2.csv").write_text("b,a\n1,2\n")
    import pytest
    with pytest.raises(ValueError, match="different header"):
        files.read_csv(spark, str(folder), multi_line=False)
