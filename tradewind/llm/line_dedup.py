"""Lines that repeat across documents, dropped by run-length bitmaps.

Each line is reduced to a 128-bit hash of its key (stripped, A-Z lower-cased). The
hashes are range-partitioned and sorted by document and position within a hash, so
the first occurrence and the number of documents come from one pass over sorted
rows. A hash is cut into ``SALTS`` ranges of its own, so a line that a third of all
documents share fills many small ranges instead of one task; what the ranges of a hash
say is added up afterwards, one row per range.

What comes back per document is a bitmap of kept lines in run lengths, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.text import STRIPPED, lower_ascii, row_key, staged, unused, whole

SALTS = 64
#: A table of repeated lines up to this size is sent to all executors, beyond it joined.
BROADCAST_ROWS = 100_000

REPEATED, LATER = "repeated", "later"
#: Names of the columns that tell what goes.
N_LINES, DROPPED = "_n_lines", "_dropped"


def lines_of(text: Column | str) -> Column:
    return F.split(whole(text), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(STRIPPED)))


def _hashed(docs: DataFrame, min_length: int) -> DataFrame:
    """(h1, h2, salt, doc_id, text_key, position) of each line long enough to count."""
    lines = docs.select(
        "doc_id", row_key().alias("text_key"),
        F.posexplode(lines_of("text")).alias("position", "line"),
    ).select("doc_id", "text_key", "position", line_key(F.col("line")).alias("key"))
    return lines.filter(F.char_length("key") >= min_length).select(
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), F.col("key")).alias("h2"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("byte").alias("salt"),
        "doc_id", "text_key", "position",
    )


def repeated_lines(hashed: DataFrame, min_documents: int) -> DataFrame:
    """(h1, h2, first) of keys found in at least ``min_documents`` different doc_ids.

    ``first`` is the (null id last, doc_id, text_key, position) of the first occurrence.
    """
    ranged = hashed.repartitionByRange("h1", "h2", "salt")
    in_order = Window.partitionBy("h1", "h2", "salt").orderBy(
        F.col("doc_id").asc_nulls_last(), "text_key", "position"
    )
    here = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"), F.col("position"))
    streamed = ranged.select(
        "h1", "h2", "salt",
        F.when(F.row_number().over(in_order) == 1, here).alias("first"),
        F.coalesce(
            ~F.struct("doc_id").eqNullSafe(F.lag(F.struct("doc_id")).over(in_order)), F.lit(True)
        ).cast("long").alias("new_document"),
    )
    by_range = streamed.groupBy("h1", "h2", "salt").agg(
        F.min("first").alias("first"), F.sum("new_document").alias("documents")
    )
    return by_range.groupBy("h1", "h2").agg(
        F.min("first").alias("first"), F.sum("documents").alias("documents")
    ).filter(F.col("documents") >= min_documents).drop("documents")


def _runs(positions: Column) -> Column:
    """Sorted positions as (first, last) of each run of neighbours."""
    starts = F.filter(
        positions,
        lambda x, i: (i == 0) | (F.get(positions, i - 1) != x - 1),
    )
    ends = F.filter(
        positions,
        lambda x, i: (i == F.size(positions) - 1) | (F.get(positions, i + 1) != x + 1),
    )
    return F.zip_with(
        starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    )


def with_dropped_runs(
    docs: DataFrame, min_documents: int = 10, min_length: int = 1, drop: str = REPEATED,
    n_lines: str = N_LINES, dropped: str = DROPPED,
) -> DataFrame:
    """``docs`` with ``n_lines`` and ``dropped``, the runs of lines to drop (null: none).

    ``drop=REPEATED`` drops every line of a repeated key, ``LATER`` all but its first
    occurrence. Documents are told apart by doc_id; rows without id count as one
    document. A null or empty text is one empty line. Rows that repeat get the same
    runs; other columns stay as they are, but for those named like the two new ones, which
    are replaced; an empty table stays empty.
    """
    if drop not in (REPEATED, LATER):
        raise ValueError(f"drop is {REPEATED!r} or {LATER!r}")
    hashed = staged(_hashed(docs, min_length), "line-hashes")
    repeated = staged(repeated_lines(hashed, min_documents), "repeated-lines")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    hits = hashed.join(repeated, ["h1", "h2"])
    if drop == LATER:
        here = F.struct(
            F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"), F.col("position")
        )
        hits = hits.filter(~here.eqNullSafe(F.col("first")))
    rows = docs.drop(n_lines, dropped)
    key, its_id, its_key = (unused(c, docs) for c in ("text_key", "line_doc_id", "line_text_key"))
    runs = (
        hits.groupBy(F.col("doc_id").alias(its_id), F.col("text_key").alias(its_key))
        .agg(F.array_sort(F.collect_set("position")).alias("positions"))
        .select(its_id, its_key, _runs(F.col("positions")).alias(dropped))
    )
    return rows.withColumn(key, row_key()).join(
        runs, F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.col(key) == F.col(its_key)), "left",
    ).withColumn(n_lines, F.size(lines_of("text"))).drop(its_id, its_key, key)


def _kept_runs(n_lines: Column, dropped: Column) -> Column:
    """Runs of kept lines (start from zero, length) between the dropped ones."""
    edges = F.concat(
        dropped, F.array(F.struct(n_lines.alias("first"), n_lines.alias("last")))
    )
    kept = F.transform(
        edges,
        lambda run, i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(edges, i - 1)["last"] + 1).alias("start"),
            run["first"].alias("end"),
        ),
    )
    return F.filter(kept, lambda run: run["end"] > run["start"])


def n_dropped(dropped: str = DROPPED) -> Column:
    total = F.aggregate(
        F.col(dropped), F.lit(0), lambda n, run: n + run["last"] - run["first"] + 1
    )
    return F.coalesce(total, F.lit(0)).cast("long")


def kept_text(n_lines: str = N_LINES, dropped: str = DROPPED) -> Column:
    """The kept lines joined by line breaks; the whole text if nothing is dropped."""
    lines = lines_of("text")
    kept = F.flatten(F.transform(
        _kept_runs(F.col(n_lines), F.col(dropped)),
        lambda run: F.slice(lines, run["start"] + 1, run["end"] - run["start"]),
    ))
    return F.when(F.col(dropped).isNull(), whole("text")).otherwise(F.array_join(kept, "\n"))


def keep_bitmap(n_lines: str = N_LINES, dropped: str = DROPPED) -> Column:
    """Lengths of alternating runs of lines, kept ones first, e.g. ``[2, 1, 4]``: two lines kept,
    one dropped, four kept."""
    runs = F.coalesce(F.col(dropped), F.expr("cast(array() AS array<struct<first:int,last:int>>)"))
    edges = F.concat(
        runs, F.array(F.struct(F.col(n_lines).alias("first"), F.col(n_lines).alias("last")))
    )
    keep = F.flatten(F.transform(
        edges,
        lambda run, i: F.array(
            run["first"] - F.when(i == 0, 0).otherwise(F.get(edges, i - 1)["last"] + 1),
            run["last"] - run["first"] + 1,
        ),
    ))
    return F.slice(keep, 1, F.size(keep) - 1)


def keep_bitmaps(
    docs: DataFrame, min_documents: int = 10, min_length: int = 1, drop: str = REPEATED
) -> DataFrame:
    """(doc_id, n_lines, keep) per row, ``keep`` as from ``keep_bitmap``."""
    marked = with_dropped_runs(docs, min_documents, min_length, drop)
    return marked.select(
        "doc_id", F.col(N_LINES).cast("long").alias("n_lines"), keep_bitmap().alias("keep"),
    )


def without_repeated_lines(docs: DataFrame, min_documents: int = 10, min_length: int = 1) -> DataFrame:
    """The documents with the repeated lines gone from ``text``; ``n_chars`` follows, if
    there is such a column. A null text stays null if it loses nothing."""
    n_lines, dropped = unused("n_lines", docs), unused("dropped", docs)
    marked = with_dropped_runs(
        docs, min_documents, min_length, n_lines=n_lines, dropped=dropped
    )
    untouched = F.col(dropped).isNull()
    new = F.when(untouched, F.col("text")).otherwise(kept_text(n_lines, dropped))
    marked = marked.withColumn("text", new)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        marked = marked.withColumn("n_chars", F.when(untouched, F.col("n_chars")).otherwise(length))
    return marked.select(*docs.columns)
