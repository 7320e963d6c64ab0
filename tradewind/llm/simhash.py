"""SimHash near-duplicates over an inverted index of byte positions.

A fingerprint of 64 bits has eight positional bytes. Two fingerprints that differ
in at most four bits share at least ``8 - 4`` of them, so the index lists
fingerprints by the bytes they have at given positions; for a pair that meets in a
list, the shared positional bytes are tallied, pairs below the guaranteed minimum
are dropped, and the rest is verified by the exact distance.

A list for a single byte would hold one in 256 of all fingerprints, and its pairs
grow with the square of the input. A list is therefore kept per *three* positions:
``position_triples`` picks triples such that any four positions contain one of
them, so each pair with four shared bytes still meets, in lists 65,536 times shorter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.components import components
from tradewind.llm.text import row_key, small_batches, staged, unused

BYTES = 8
SEED = 42
#: Lists up to this length are paired in SQL, longer ones block by block.
LONG_LIST = 256
BLOCK = 1024

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_OFFSETS = np.arange(BYTES, dtype=np.int64) * 256
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The SimHash of one text, as signed 64-bit number; zero if it has no word."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths).tolist(), ends[words - 1:].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(last)
    )
    counts = np.bincount(
        (hashes.view(np.uint8).reshape(-1, BYTES) + _OFFSETS).ravel(), minlength=BYTES * 256
    ).reshape(BYTES, 256) @ _BITS
    return int(_POWERS[counts.ravel() * 2 > len(last)].sum().astype(np.int64))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, text_key, fingerprint) of every row; a null text has no words."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(2).cast(pa.binary())
            values = (fingerprint(t.as_py(), words) for t in texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array(np.fromiter(values, np.int64, batch.num_rows))],
                ["doc_id", "text_key", "fingerprint"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", row_key().alias("text_key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, text_key long, fingerprint long")


def position_triples(positions: int = BYTES) -> list[tuple[int, ...]]:
    """Triples of byte positions such that any four positions contain one of them.

    Turán's construction: three groups in a ring; a triple lies in one group, or
    two of it in one group and the third in the next.
    """
    group = [i * 3 // positions for i in range(positions)]

    def chosen(triple: tuple[int, ...]) -> bool:
        a, b, c = sorted(group[i] for i in triple)
        return a == c or (a == b and c == (a + 1) % 3) or (b == c and a == (b + 1) % 3)

    return [t for t in combinations(range(positions), 3) if chosen(t)]


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(F.lit(255))


def _index(prints: DataFrame) -> DataFrame:
    """(list, fingerprint): each fingerprint under its bytes at each triple of positions."""
    value = F.col("fingerprint")
    keys = [
        F.lit(n).cast("long") * F.lit(1 << 24)
        + _byte(value, a) * 65536 + _byte(value, b) * 256 + _byte(value, c)
        for n, (a, b, c) in enumerate(position_triples())
    ]
    return prints.select(F.explode(F.array(*keys)).alias("list"), "fingerprint")


def _shared_bytes(x: Column) -> Column:
    """How many positional bytes two fingerprints share; ``x`` is their exclusive or."""
    return sum((_byte(x, i) == 0).cast("int") for i in range(BYTES))


def _forest(distance: int):
    """Links of a spanning forest among the fingerprints of two blocks of a list."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        left = np.unique(pdf["fingerprint"].to_numpy()).view(np.uint64)
        found: list[tuple[int, int]] = []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                one = queue.pop()
                x = left ^ one
                shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
                near = (shared >= BYTES - distance) & (np.bitwise_count(x) <= distance)
                found += [(int(one), int(other)) for other in left[near]]
                queue += list(left[near])
                left = left[~near]
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame(pairs, columns=["u", "v"])

    return links


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints within ``distance`` bits (at most four).

    All pairs of short lists; of long lists a spanning forest for any two of
    their blocks, which links what the pairs would link. A list is never in one task as
    a whole: blocks are pairs of at most about ``2 * BLOCK`` fingerprints.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the triples guarantee a meeting only up to four differing bits")
    index = staged(_index(prints), "simhash-index")
    long_lists = index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > LONG_LIST
    )
    long_lists = staged(long_lists, "simhash-long")
    short = index.join(long_lists, "list", "left_anti")
    x = F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))
    pairs = short.alias("a").join(
        short.alias("b"),
        (F.col("a.list") == F.col("b.list"))
        & (F.col("a.fingerprint") < F.col("b.fingerprint"))
        & (_shared_bytes(x) >= BYTES - distance)
        & (F.bit_count(x) <= distance),
    ).select(F.col("a.fingerprint").alias("u"), F.col("b.fingerprint").alias("v"))

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), blocks).cast("int")
    crowded = (
        index.join(long_lists, "list")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "list", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
            "fingerprint",
        )
    )
    forests = crowded.groupBy("list", "p", "q").applyInPandas(_forest(distance), "u long, v long")
    return pairs.union(forests)


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id, keep) of every row of ``docs``.

    component_id is the smallest doc_id reachable over links, itself included;
    ``keep`` marks one (doc_id, text_key) of each component, the smallest.
    Exact copies share a fingerprint and are never paired. Texts that are null,
    empty or blank have fingerprint zero and are linked like any other. Null ids
    count as larger than all others. Rows that repeat are returned as often;
    an empty table gives an empty result. Other columns are not looked at.
    """
    prints = staged(fingerprints(docs, words), "fingerprints")
    by_print = staged(
        prints.groupBy("fingerprint").agg(
            F.min("doc_id").alias("doc_id"),
            F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key")))
            .alias("first"),
        ),
        "by-fingerprint",
    )
    roots = components(links(by_print.select("fingerprint"), distance))
    rooted = by_print.join(
        roots, by_print["fingerprint"] == roots["node"], "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    merged = rooted.groupBy("root").agg(
        F.min("doc_id").alias("component_id"), F.min("first").alias("first")
    )
    classes = staged(
        rooted.select("fingerprint", "root").join(merged, "root").drop("root"), "classes"
    )
    here = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    return prints.join(classes, "fingerprint").select(
        "doc_id", "text_key", "fingerprint", "component_id",
        (here == F.col("first")).alias("keep"),
    )


def one_of_each(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """The documents, one of each group of near-duplicates; the columns stay."""
    key, its_id, its_key = (unused(c, docs) for c in ("text_key", "kept_id", "kept_key"))
    kept = near_duplicates(docs, words, distance).filter("keep").select(
        F.col("doc_id").alias(its_id), F.col("text_key").alias(its_key)
    ).distinct()
    keyed = docs.withColumn(key, row_key())
    return keyed.join(
        kept, F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.col(key) == F.col(its_key)), "left_semi",
    ).dropDuplicates(["doc_id", key]).select(*docs.columns)
