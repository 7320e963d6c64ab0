"""Shared text expressions: byte-exact lower case, keys of rows, staged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the contracts, as regular expression and as characters to strip.
SPACE = r"\x20\x09-\x0D"
STRIPPED = " \t\n\x0b\x0c\r"


def whole(text: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone.

    ``lower`` is fast and does just that for text without other characters;
    ``translate`` goes through the rest character by character.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(text: str = "text") -> Column:
    """With doc_id, tells rows apart that share an id but not the text."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def unused(name: str, df: DataFrame) -> str:
    """A name for a helper column that ``df`` does not have, like ``name``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back."""
    return stage(df, label)[0]


#: What Spark sets where nobody set anything, and what texts are sent to Python in instead.
ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"),
    "spark.sql.execution.arrow.maxBytesPerBatch": (str(1 << 26), str(1 << 22)),
}


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python in small batches, so that a worker never holds many whole texts.

    Sets the session's Arrow batch limits, which hold from then on; a limit that somebody has
    set stays. Results do not depend on them.
    """
    for key, (default, small) in ARROW_BATCH.items():
        now = str(spark.conf.get(key, default)).lower().removesuffix("b")
        if now in (default, "64m", "-1"):
            spark.conf.set(key, small)
