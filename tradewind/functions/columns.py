"""Column expressions the models and checks share. All run inside the JVM."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as whitespace, from all scripts.
WHITESPACE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())

#: Nine decimal digits.
GROUP = 1_000_000_000


def as_of_timestamp(as_of: dt.datetime | str | None = None) -> Column:
    """The moment the run refers to; the time now in UTC when none is given."""
    if as_of is None:
        return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())
    return F.lit(str(as_of)).cast("timestamp_ntz")


def utc_now() -> dt.datetime:
    """The one clock of all logs and load stamps: UTC, without a zone."""
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


def add_days(moment: Column, days: int) -> Column:
    """The moment so many days later; the time of day stays."""
    return moment + F.make_dt_interval(F.lit(days))


def has_text(column: Column) -> Column:
    """True when something is left after trimming spaces; null counts as empty."""
    return F.trim(F.coalesce(column, F.lit(""))) != ""


def is_blank(column: Column) -> Column:
    """Null, not a number, or nothing but whitespace of any kind."""
    no_number = F.typeof(column).isin("double", "float") & (column.cast("string") == "NaN")
    return column.isNull() | no_number | (F.ltrim(column.cast("string"), F.lit(WHITESPACE)) == "")


def matches_whole(column: Column, pattern: str) -> Column:
    """The whole string matches. ``$`` would also accept a trailing newline."""
    return column.cast("string").rlike(rf"\A(?:{pattern})\z")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null for a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0))


def percent(numerator: Column, denominator: Column, digits: int = 1) -> Column:
    return F.round(ratio(numerator, denominator) * 100, digits)


def day_of(moment: Column) -> Column:
    """Midnight of the day, as a zone-free timestamp. Going through the date avoids
    ``date_trunc``, whose result depends on the session's time zone."""
    return F.to_date(moment).cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    """Number of midnights crossed from ``start`` to ``end``."""
    return F.datediff(end, start).cast("long")


def tier(value: Column, limits: Iterable[tuple[float, str]], default: str) -> Column:
    """Label of the first limit that ``value`` reaches; ``default`` also for null."""
    result = F.lit(default)
    for limit, label in reversed(tuple(limits)):
        result = F.when(value >= limit, label).otherwise(result)
    return result


def short_id(*parts: Column) -> Column:
    """32 hex characters that depend only on ``parts``; nulls and their places count."""
    told_apart = F.to_json(F.array(*(p.cast("string") for p in parts)))
    return F.substring(F.sha2(told_apart, 256), 1, 32)


def display_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("N/A"))


def bytes_to_long(column: Column) -> Column:
    """Big-endian unsigned value of up to eight bytes, below 2**63."""
    return bytes_to_digits(column).cast("long")


def bytes_to_digits(column: Column) -> Column:
    """Big-endian unsigned value of any number of bytes, as decimal digits.

    Up to eight bytes Spark converts by itself, and up to sixteen its decimals hold what the two
    halves give. Longer ones are worked out in groups of nine digits.
    """
    length = F.octet_length(column)
    return (
        F.when(length <= 8, F.conv(F.hex(column), 16, 10))
        .when(length <= 16, _digits_of_halves(column))
        .when(column.isNotNull(), _digits_of_words(column))
    )


def _divided(value: Column, by: Column) -> Column:
    """Whole part of the quotient, without going through a double."""
    return F.call_function("div", value, by)


def _digits_of_halves(column: Column) -> Column:
    """Of nine to sixteen bytes. 2**64 is 18 * 10**18 and a rest: what the rest and the low half
    make has at most 37 digits, and the last 18 of them are the last 18 of the value."""
    def half(part: Column) -> Column:
        return F.conv(F.hex(part), 16, 10).cast("decimal(20,0)")

    high = half(F.substring(column, F.lit(1), F.octet_length(column) - 8))
    low = half(F.substring(column, F.lit(-8), F.lit(8)))
    unit = F.lit(10**18).cast("decimal(19,0)")
    rest = high * F.lit(2**64 % 10**18).cast("decimal(18,0)") + low
    front = (high * F.lit(2**64 // 10**18).cast("decimal(2,0)") + _divided(rest, unit)).cast("string")
    back = (rest % unit).cast("long").cast("string")
    return F.when(front != "0", F.concat(front, F.lpad(back, 18, "0"))).otherwise(back)


def _digits_of_words(column: Column) -> Column:
    """Each word of four bytes multiplies the groups of nine digits by 2**32 and carries over."""
    def next_group(state: Column, group: Column) -> Column:
        value = group * 2**32 + state["carry"]
        return F.struct(
            F.concat(state["groups"], F.array(value % GROUP)).alias("groups"),
            _divided(value, F.lit(GROUP)).alias("carry"),
        )

    def carried_out(state: Column) -> Column:
        """The groups, with the one or two that the last carry makes."""
        carry = state["carry"]
        return F.when(carry == 0, state["groups"]).when(
            carry < GROUP, F.concat(state["groups"], F.array(carry))
        ).otherwise(F.concat(state["groups"], F.array(carry % GROUP, _divided(carry, F.lit(GROUP)))))

    no_groups = F.array().cast("array<bigint>")

    def next_word(groups: Column, word: Column) -> Column:
        start = F.struct(no_groups.alias("groups"), word.alias("carry"))
        return F.aggregate(groups, start, next_group, carried_out)

    hexed = F.hex(column)
    words = F.ceil(F.length(hexed) / 8).cast("int")
    padded = F.lpad(hexed, words * 8, "0")
    word = F.transform(
        F.sequence(F.lit(0), words - 1),
        lambda i: F.conv(F.substring(padded, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"),
    )
    groups = F.aggregate(word, no_groups, next_word)
    text = F.array_join(F.reverse(F.transform(groups, lambda g: F.lpad(g.cast("string"), 9, "0"))), "")
    return F.coalesce(F.nullif(F.ltrim(text, F.lit("0")), F.lit("")), F.lit("0"))
