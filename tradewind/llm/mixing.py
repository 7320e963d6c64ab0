"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is cut into slots of equally many words. Slot ``i`` takes the golden-ratio point
``i * PHI mod 2**32``; the source whose stretch of the cumulative target weights holds the
point fills the slot. These points fall into every stretch almost in proportion to its length,
so each source gets its target to within a few slots, and any part of the mix is mixed alike.
Then each source is settled: slots beyond its target go, blocks that it lacks go into slots
chosen by hash, and its last block ends at the target, so sources get their targets to the word.

Each source's documents are put in a fixed random order and their words, laid end to end
twice, are cut into blocks of a slot's length. The n-th slot of a source takes its n-th
block. All of it is exact integers, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.prefix import sum_before
from tradewind.llm.text import row_key, staged, unused, whole

WEIGHTS = (3, 1, 2)
EXPAND, MOST = 1.5, 2
#: 2**32 over the golden ratio, odd, so the points of 2**32 slots all differ.
PHI = 2654435769
POINTS = 1 << 32
#: Slots a mix has at most; a slot is the mix over this many, and a word at least.
SLOTS = 1 << 20
CELLS = 1 << 10
CHUNK = 1 << 12


def sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, place): words of each row, and its place in the random order."""
    return docs.select(
        *keep, "doc_id", "source",
        F.regexp_count(whole("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.md5(F.concat_ws(
            ":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(whole("text"))
        )).alias("place"),
        row_key().alias("text_key"),
    )


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, expand: float = EXPAND, most: int = MOST
) -> DataFrame:
    """(source, source_no, source_size, weight, target) of each source, null last.

    Sources in code point order take the weights in turn. A target stops at ``most`` times
    the source's size; what that leaves is shared out again by weight until none is above.
    Sources may be many: they are numbered by ranges, and the driver sees sums only.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = totals.repartitionByRange(F.col("source").asc_nulls_last())
    ranged = staged(ranged.withColumn("part", F.spark_partition_id()), "sources")
    one = ranged.withColumns({"one": F.lit(1), "all": F.lit(0)})
    numbered = sum_before(
        one, "all", "part", [F.col("source").asc_nulls_last()], "one", "source_no"
    )
    turn = F.element_at(
        F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")
    )
    sources = staged(numbered.select("source", "source_no", "source_size", turn.alias("weight")),
                     "source-weights")
    cap = F.col("source_size") * most
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * expand
    level = None
    while True:
        above = F.lit(False) if level is None else cap <= F.col("weight") * level
        capped, rest = sources.agg(
            F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if not rest:
            break
        now = (total - capped) / rest
        if now == level:
            break
        level = now
    shared = F.lit(0.0) if level is None else F.col("weight") * F.lit(float(level))
    return sources.withColumn("target", F.least(cap.cast("double"), shared))


def schedule(sources: DataFrame, total: float, slots: int = SLOTS) -> tuple[DataFrame, int]:
    """((slot, source_no, block) of each slot, words a slot holds).

    ``block`` is the rank of the slot among those of its source.
    """
    spark = sources.sparkSession
    words = max(1, math.ceil(total / slots))
    count = -(-math.ceil(total) // words)
    one = sources.withColumns({
        "all": F.lit(0), "part": F.floor(F.col("source_no") / CHUNK),
    })
    # whole points, so that the sums do not depend on their order
    one = one.withColumn(
        "width", F.round(F.col("target") / F.lit(float(max(total, 1.0))) * POINTS).cast("long")
    )
    ends = sum_before(one, "all", "part", ["source_no"], "width", "low")
    stretches = ends.select(
        "source_no", "low", (F.col("low") + F.col("width")).alias("high")
    ).filter("high > low").withColumn(
        "cell", F.explode(F.expr(f"sequence(low div {POINTS // CELLS}, (high - 1) div {POINTS // CELLS})"))
    )
    at = spark.range(count).withColumn("point", F.col("id") * PHI % POINTS)
    at = at.withColumn("cell", F.expr(f"point div {POINTS // CELLS}"))
    # slots are many even where the corpus is small, and their files are small: never broadcast
    filled = at.hint("merge").join(stretches, "cell").filter("point >= low AND point < high").select(
        F.col("id").alias("slot"), "source_no", F.floor(F.col("id") / CHUNK).alias("chunk"),
        F.lit(1).alias("one"),
    )
    ranked = sum_before(filled, "source_no", "chunk", ["slot"], "one", "block")
    return ranked.select("slot", "source_no", "block"), words


def settled(slots_of: DataFrame, sources: DataFrame, words: int) -> DataFrame:
    """The slots such that each source's blocks hold its target, to the word; with it as ``want``."""
    count = slots_of.count()
    have = slots_of.groupBy(F.col("source_no").alias("_no")).agg(F.count(F.lit(1)).alias("have"))
    wanted = sources.join(have, F.col("source_no") == F.col("_no"), "left").select(
        "source_no", F.round("target").cast("long").alias("want"),
        F.coalesce("have", F.lit(0)).alias("have"),
    ).withColumn("need", F.ceil(F.col("want") / words))
    kept = slots_of.join(wanted, "source_no").filter("block < need").select(
        "slot", "source_no", "block", "want"
    )
    lacking = wanted.filter("have < need").withColumn(
        "block", F.explode(F.expr("sequence(have, need - 1)"))
    )
    at = F.pmod(F.xxhash64("source_no", "block"), F.lit(max(count, 1)))
    return kept.union(lacking.select(at.alias("slot"), "source_no", "block", "want"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, expand: float = EXPAND,
    most: int = MOST, slots: int = SLOTS, keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: every row's ``keep``, doc_id, source, size, source_size, target, ``row`` and the words
    ``taken``. pieces: (slot, row, start, end), the words of a row that a slot takes. Sources that
    are smaller than a slot share one. Rows that repeat are rows of their own; null ids come first in the random order; a null
    source is a source; null and empty texts have no words and are never taken. An
    empty table gives an empty mix.
    """
    sized = staged(sizes(docs, keep), "sizes")
    sources = staged(source_targets(sized, weights, expand, most), "targets")
    # not the sum of the targets, whose last bits depend on the order of the sum
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * min(expand, most)
    slots_of, words = schedule(sources, total, slots)
    slots_of = settled(staged(slots_of, "slots"), sources, words)
    known = sized.join(
        sources, sized["source"].eqNullSafe(sources["source"])
    ).select(
        *keep, "doc_id", sized["source"], "size", "place", "text_key", "source_no", "source_size",
        "target", F.conv(F.substring("place", 1, 3), 16, 10).cast("int").alias("bucket"),
    )
    placed = sum_before(
        known, "source_no", "bucket", ["place", "doc_id", "text_key"], "size", "before"
    ).withColumn("row", F.struct("source_no", "before", "place", "doc_id", "text_key"))
    placed = staged(placed, "placed")
    lap = F.explode(F.array(*(F.lit(n).cast("long") for n in range(most))))
    pieces = (
        placed.filter("size > 0")
        .withColumn("lap", lap)
        .withColumn("from", F.col("before") + F.col("lap") * F.col("source_size"))
        .withColumn("to", F.col("from") + F.col("size"))
        .withColumn("block", F.explode(F.expr(f"sequence(from div {words}, (to - 1) div {words})")))
        .join(slots_of.hint("merge"), ["source_no", "block"])
        .select(
            "slot", "row", "source_no", "before",
            (F.greatest(F.col("from"), F.col("block") * words) - F.col("from")).alias("start"),
            (F.least("to", (F.col("block") + 1) * words, "want") - F.col("from")).alias("end"),
        )
        .filter("end > start")
    )
    taken = pieces.groupBy(
        F.col("source_no").alias("_no"), F.col("before").alias("_before")
    ).agg(F.sum(F.col("end") - F.col("start")).alias("taken"))
    documents = placed.join(
        taken,
        (F.col("source_no") == F.col("_no")) & (F.col("before") == F.col("_before"))
        & (F.col("size") > 0),
        "left",
    ).select(
        *keep, "doc_id", "source", "size", "source_size", "target", "row",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )
    return documents, pieces.select("slot", "row", "start", "end")


def mixed_corpus(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, expand: float = EXPAND,
    most: int = MOST, slots: int = SLOTS,
) -> DataFrame:
    """The mix as a corpus: every row of ``docs`` with its counts and its ``pieces``.

    Adds size, source_size, target, taken and pieces, an array of (slot, start, end): words ``start``
    to ``end`` of the text are what the slot takes. Slots in their order are the mix. Columns of
    these names in ``docs`` are replaced.
    """
    added = ("size", "source_size", "target", "taken", "pieces")
    columns = [c for c in docs.columns if c not in added]
    number = unused("mix_row", docs)
    numbered = staged(
        docs.select(*columns, F.monotonically_increasing_id().alias(number)), "numbered"
    )
    counted, pieces = mix(numbered, weights, expand, most, slots, keep=(number,))
    of_row = pieces.groupBy(
        F.col("row.source_no").alias("_no"), F.col("row.before").alias("_before")
    ).agg(F.sort_array(F.collect_list(F.struct("slot", "start", "end"))).alias("pieces"))
    none = F.array().cast("array<struct<slot:bigint,start:bigint,end:bigint>>")
    described = counted.join(
        of_row,
        (F.col("row.source_no") == F.col("_no")) & (F.col("row.before") == F.col("_before"))
        & (F.col("size") > 0),
        "left",
    ).select(number, "size", "source_size", "target", "taken", F.coalesce("pieces", none).alias("pieces"))
    return numbered.join(described, number).drop(number)
