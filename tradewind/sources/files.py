"""CSV files as typed tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Cell texts that mean "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
INTEGER = r"\A\s*[+-]?\d+\s*\z"
NUMBER = r"\A\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)\s*\z"
TRUTH = r"\A(?:True|TRUE|true|False|FALSE|false)\z"
SURPLUS = "_surplus"


def clean_name(name: str) -> str:
    """Upper case; spaces, dashes and slashes to underscores; no parentheses."""
    name = name.upper().strip()
    for character in " -/":
        name = name.replace(character, "_")
    return name.replace("(", "").replace(")", "")


def clean_names(names: Iterable[str | None]) -> list[str]:
    cleaned = [clean_name(n or "") for n in names]
    repeated = [n for n, times in Counter(cleaned).items() if times > 1 or not n]
    if repeated:
        raise ValueError(f"column names empty or not unique after cleaning: {repeated}")
    return cleaned


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


#: A field in quotes that ends on its line; what opens a field otherwise goes on in the next line.
QUOTED_FIELD, OPEN_QUOTE = r'(^|,) *"(?:[^"]|"")*+" *(?=,|$)', r'(^|,) *"'


def has_quoted_breaks(spark: SparkSession, path: str, only_headers: bool = False) -> bool:
    """True when a line break stands inside quotes: some line opens a field and does not close it.

    A quote inside a field without quotes, as in ``5" pipe``, opens nothing. The same pass compares
    the files' first lines: cells are read by position, so files whose headers differ in more
    than quotes, spaces and case raise. ``only_headers`` looks at nothing else.
    """
    opened = F.rlike(F.regexp_replace("value", QUOTED_FIELD, "$1"), F.lit(OPEN_QUOTE))
    lines = spark.read.text(path).filter("value != ''").select(
        "value", (F.lit(False) if only_headers else opened).alias("odd"),
        F.col("_metadata.file_path").alias("file"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
        .alias("place"),
    )
    if only_headers:
        lines = lines.filter("place IS NOT NULL")
    by_file = lines.groupBy("file").agg(
        F.min_by("value", "place").alias("header"), F.bool_or("odd").alias("odd")
    )
    header = F.upper(F.regexp_replace("header", r'["\s\x{FEFF}]', ""))
    seen = by_file.agg(
        F.count_distinct(header).alias("headers"), F.bool_or("odd").alias("odd")
    ).first()
    if seen["headers"] > 1:
        raise ValueError(f"{seen['headers']} different header lines in the files of {path}")
    return bool(seen["odd"])


def read_text_cells(
    spark: SparkSession, path: str, multi_line: bool | None = None
) -> DataFrame:
    """Every cell as text, null tokens as null, columns under their cleaned names.

    Files split at line ends and load in parallel, unless a line break stands
    inside quotes: then a file is one task. With a known ``multi_line`` the pass that looks
    for such breaks compares the headers only.
    """
    found = has_quoted_breaks(spark, path, only_headers=multi_line is not None)
    multi_line = found if multi_line is None else multi_line
    reader = spark.read.options(quote='"', escape='"', multiLine=multi_line)
    header = reader.option("header", False).csv(path).first()
    if header is None:
        raise ValueError(f"no header line in {path}")
    names = clean_names(header)
    # One column more than the header shows rows that are too long, which the
    # reader would otherwise shorten without a word.
    schema = ", ".join(f"`{c}` string" for c in [*names, SURPLUS])
    cells = reader.option("header", True).schema(schema).csv(path)
    return cells.select(
        *(F.when(~_cell(c).isin(*NULL_TOKENS), _cell(c)).alias(c) for c in names), SURPLUS
    )


def _cell(name: str) -> Column:
    return F.col(f"`{name}`")


def infer_types(cells: DataFrame) -> dict[str, str]:
    """Type per text column, from one pass over all rows.

    Whole numbers and truth values need a column without nulls: a null turns
    whole numbers into doubles and truth values into text. Dates stay text.
    """
    names = [c for c in cells.columns if c != SURPLUS]
    measures = [F.count(F.lit(1)).alias("rows")]
    if SURPLUS in cells.columns:
        measures.append(F.count(SURPLUS).alias("too_long"))
    for i, name in enumerate(names):
        cell = _cell(name)
        measures += [
            F.count(cell).alias(f"filled{i}"),
            F.count_if(cell.rlike(INTEGER)).alias(f"integers{i}"),
            F.count(F.when(cell.rlike(INTEGER), cell.try_cast("bigint"))).alias(f"longs{i}"),
            F.count_if(cell.rlike(NUMBER)).alias(f"numbers{i}"),
            F.count_if(cell.rlike(TRUTH)).alias(f"truths{i}"),
        ]
    seen = cells.agg(*measures).first().asDict()
    if seen.get("too_long"):
        raise ValueError(f"{seen['too_long']} rows have more than {len(names)} fields")

    def kind(i: int) -> str:
        filled, complete = seen[f"filled{i}"], seen[f"filled{i}"] == seen["rows"]
        if seen["rows"] == 0:
            return "string"
        if complete and seen[f"integers{i}"] == filled:
            return "bigint" if seen[f"longs{i}"] == filled else "string"
        if seen[f"numbers{i}"] == filled:
            return "double"
        if complete and seen[f"truths{i}"] == filled:
            return "boolean"
        return "string"

    return {name: kind(i) for i, name in enumerate(names)}


def typed(cells: DataFrame, types: dict[str, str]) -> DataFrame:
    return cells.select(
        *(
            (_cell(n) if t == "string" else F.trim(_cell(n)).cast(t)).alias(n)
            for n, t in types.items()
        )
    )


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """A CSV file, or a folder of files with one header, as a typed table."""
    cells = read_text_cells(spark, path, multi_line)
    return typed(cells, infer_types(cells))
