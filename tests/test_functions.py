from pyspark.sql import functions as F

from tradewind import rules
from tradewind.functions import columns as fn


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_whole_string_match(spark):
    def matches(text):
        return value(spark, fn.matches_whole(F.lit(text), rules.sku_pattern()))
    assert matches("ELF-12345")
    for text in ("ELF-12345\n", "ELF-123456", " ELF-12345", "elf-12345", ""):
        assert not matches(text)


def test_blank_and_text(spark):
    def blank(text):
        return value(spark, fn.is_blank(F.lit(text)))
    assert all(blank(t) for t in ("", "  ", "\t\n", " ", "\x1f", " "))
    assert not blank(" x ")
    assert value(spark, fn.is_blank(F.lit(None).cast("int")))
    assert not value(spark, fn.has_text(F.lit("   ")))
    assert value(spark, fn.has_text(F.lit("\t")))
    assert not value(spark, fn.has_text(F.lit(None).cast("string")))


def test_days_between_counts_midnights(spark):
    start, end = (
        F.lit(t).cast("timestamp_ntz") for t in ("2026-01-01 23:59:00", "2026-01-02 00:01:00")
    )
    assert value(spark, fn.days_between(start, end)) == 1
    assert value(spark, fn.days_between(end, start)) == -1


def test_ratios(spark):
    assert value(spark, fn.ratio(F.lit(1), F.lit(0))) is None
    assert value(spark, fn.percent(F.lit(1), F.lit(3), 2)) == 33.33


def test_tier(spark):
    def tier(x):
        return value(spark, fn.tier(F.lit(x), ((10, "high"), (5, "mid")), "low"))
    assert [tier(x) for x in (10, 9, 5, 4, None)] == ["high", "mid", "mid", "low", "low"]


def test_day_of_keeps_the_zone_free_type(spark):
    moment = F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")
    day = spark.range(1).select(fn.day_of(moment).alias("d"))
    assert day.schema["d"].dataType.simpleString() == "timestamp_ntz"
    assert str(day.first().d) == "2026-01-02 00:00:00"


def test_ids_and_text(spark):
    one, again = (value(spark, fn.short_id(F.lit("a"), F.lit(1))) for _ in range(2))
    assert one == again and len(one) == 32 and one != value(spark, fn.short_id(F.lit("b"), F.lit(1)))
    assert value(spark, fn.display_text(F.lit(None).cast("int"))) == "N/A"
    assert value(spark, fn.bytes_to_long(F.lit(bytearray(b"\x01\x02")))) == 258


def test_table_names():
    names = rules.TableNames("abc")
    assert names.silver("orders") == "SLV_ABC_ORDERS"
    assert names.bronze("orders") == "BRZ_MYSQL_ABC_ORDERS"
    assert names.brand_gold("customer_360") == "GOLD_ABC_CUSTOMER_360"
