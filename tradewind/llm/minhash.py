"""MinHash near-duplicates from minima and maxima of each permutation.

A text's set is its different five-word runs. Each permutation of the hashes gives two
values of the signature, its minimum and its maximum, so a signature needs half as many
hash evaluations. Two sets agree in either with the chance of their similarity (Jaccard), and
the two errors partly cancel out. Bands of five values, each from five permutations, list the
sets; a pair at the similarity asked for meets in no band with a chance of 1e-8.

Bands only propose; links are confirmed on the full sets. In a first round each set is
compared with one other, the one of its bands that meets most sets, which lies in the middle
of its like. In most bands all sets are linked then. The sets of the other bands meet again by
their rarest runs: sets that are alike have one early in both, so a set with many runs of its
own meets nobody (prefix and position filter, Xiao et al., 2008). Only sets that still meet
are compared block by block, across the groups known so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.components import components
from tradewind.llm.text import row_key, small_batches, staged

WORDS, PERCENT = 5, 85
SEED = 42
BANDS, ROWS = 32, 5
#: A task compares two blocks; a block is so many sets, or so many runs, whichever is less.
BLOCK, BLOCK_RUNS = 64, 1 << 18
#: Rows that one copy of a set meets in the first round.
SHARE = 1000
#: Hashes that meet the permutations at once.
PIECE = 1 << 12

_RANDOM = np.random.default_rng(SEED)
PERMUTATIONS = BANDS * ROWS // 2
_XOR, _TIMES = (
    _RANDOM.integers(0, 1 << 64, (PERMUTATIONS, 1), dtype=np.uint64) | np.uint64(1) for _ in "xt"
)
_MIX = _RANDOM.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted different hashes of the runs of ``words`` words; of a shorter text, the whole."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(tokens))
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths).tolist(), ends[words - 1:].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(last)
    ))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of every permutation."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    most = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(hashes), PIECE):
        permuted = (hashes[at:at + PIECE] ^ _XOR) * _TIMES
        np.minimum(least, permuted.min(axis=1), out=least)
        np.maximum(most, permuted.max(axis=1), out=most)
    return np.concatenate((least, most))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One number for each band of the signature; none without a hash."""
    if not len(hashes):
        return np.empty(0, np.int64)
    values = signature(hashes).reshape(BANDS, ROWS)
    mixed = (values ^ (values >> np.uint64(31))) * _MIX
    return mixed.sum(axis=1, dtype=np.uint64).view(np.int64)


def _print(hashes: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; nothing for the empty one."""
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _keyed(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", row_key().alias("text_key"), "text")


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, print, n_shingles, bands) of every row."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            prints, sizes, found = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                hashes = shingles(text.as_py(), words)
                prints.append(_print(hashes))
                sizes.append(len(hashes))
                found.append(bands(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "print", "n_shingles", "bands"],
            )

    rows = _keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        batches, f"doc_id {kind}, text_key long, print binary, n_shingles long, bands array<long>"
    )


def sets_of(docs: DataFrame, chosen: DataFrame, words: int = WORDS) -> DataFrame:
    """(print, n, runs): the full sets of ``chosen``, (print, first), each once."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sets = [shingles(t.as_py(), words) for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_print(s) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["print", "n", "runs"],
            )

    keys = chosen.select(
        F.col("first.doc_id").alias("_doc_id"), F.col("first.text_key").alias("_key")
    )
    texts = _keyed(docs).join(
        keys, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_key")),
        "left_semi",
    ).dropDuplicates(["doc_id", "text_key"])
    return texts.select("text").mapInArrow(batches, "print binary, n long, runs array<long>")


def _alike(a: str, b: str, percent: int):
    common = F.size(F.array_intersect(f"{a}.runs", f"{b}.runs"))
    return 100 * common >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are alike; a set ``v`` with many pairs is dealt out."""
    copies = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("copies"))
    dealt = pairs.join(copies, "v").select(
        "u", "v", F.pmod(F.xxhash64("u"), F.col("copies")).cast("int").alias("copy")
    )
    heads = sets.join(copies, sets["print"] == copies["v"]).select(
        "v", "n", "runs", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    )
    own = dealt.join(sets, dealt["u"] == sets["print"]).select("u", "v", "copy", "n", "runs")
    return own.alias("a").join(
        heads.alias("b"), (F.col("a.v") == F.col("b.v")) & (F.col("a.copy") == F.col("b.copy"))
        & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
    ).filter(_alike("a", "b", percent)).select(F.col("a.u").alias("u"), F.col("a.v").alias("v"))


def _across(percent: int):
    """Links between groups, among the sets of two blocks; a forest of them is enough."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["n"].to_numpy()
        block = pdf["own"].to_numpy()
        within = pdf["p"].iat[0] == pdf["q"].iat[0]
        names, group = np.unique(pdf["root"].to_numpy(), return_inverse=True)
        label = group.copy()
        runs, place = np.unique(np.concatenate(list(pdf["runs"])), return_inverse=True)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        marked = np.zeros(len(runs), np.int64)
        found: list[tuple[bytes, bytes]] = []
        for one in range(len(sizes) - 1):
            rest = np.arange(one + 1, len(sizes))
            near = rest[
                (label[rest] != label[one])
                & (100 * np.minimum(sizes[rest], sizes[one])
                   >= percent * np.maximum(sizes[rest], sizes[one]))
                & (within | (block[rest] != block[one]))
            ]
            if not len(near):
                continue
            marked[place[starts[one]:ends[one]]] = 1
            common = np.add.reduceat(marked[place], starts)[near]
            marked[place[starts[one]:ends[one]]] = 0
            near = near[100 * common >= percent * (sizes[one] + sizes[near] - common)]
            found += [(names[group[one]], names[group[i]]) for i in near]
            label[np.isin(label, label[near])] = label[one]
        return pd.DataFrame(found, columns=["u", "v"])

    return links


def _left_over(met: DataFrame, rooted: DataFrame, tried: DataFrame) -> DataFrame:
    """Bands that still hold several groups: (band, root, main_blocks, blocks), members counted.

    Bands with the same sets count once, and a band of two sets not at all if the two have been
    compared. ``main`` is the band's largest group: its sets are not compared with each other.
    """
    known = met.join(rooted, "print")
    pair = F.when(
        F.col("centre") != F.col("head"),
        F.struct(F.col("print").alias("u"), F.col("head.print").alias("v")),
    )
    bands_of = known.groupBy("band").agg(
        F.count(F.lit(1)).alias("members"), F.sum(F.hash("print").cast("long")).alias("sum"),
        F.bit_xor(F.xxhash64("print")).alias("mixed"), F.min("root").alias("least"),
        F.max("root").alias("most"), F.max(pair).alias("pair"),
    ).filter("least != most")
    compared = tried.select(F.struct("u", "v").alias("pair"))
    open_pairs = bands_of.filter("members = 2").join(compared, "pair", "left_anti")
    larger = bands_of.filter("members > 2")
    columns = ["members", "sum", "mixed"]
    once = open_pairs.select("band", *columns).union(larger.select("band", *columns)).groupBy(
        *columns).agg(F.min("band").alias("band")).select("band")
    groups = known.join(once, "band").groupBy("band", "root").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("runs")
    )
    main = F.max_by(F.struct("root", "members", "runs"), "members")
    counted = groups.groupBy("band").agg(
        main.alias("main"), F.sum("members").alias("members"), F.sum("runs").alias("runs")
    )

    def blocks(members, runs):
        return F.ceil(F.greatest(members / BLOCK, runs / BLOCK_RUNS, F.lit(1.0))).cast("int")

    return counted.select(
        "band", F.col("main.root").alias("main"),
        blocks(F.col("main.members"), F.col("main.runs")).alias("main_blocks"),
        blocks(F.col("members") - F.col("main.members"),
               F.col("runs") - F.col("main.runs")).alias("blocks"),
    )


def _dealt(met: DataFrame, rooted: DataFrame, left_over: DataFrame) -> DataFrame:
    """(band, p, q, own, print, root): members of each band under every pair of blocks to compare.

    The largest group's blocks meet the others' blocks, and the others' meet each other.
    """
    members = met.join(left_over, "band").join(rooted, "print")
    of_main = F.col("root") == F.col("main")
    last = F.col("main_blocks") + F.col("blocks") - 1
    salt = F.xxhash64("print")
    return members.withColumn(
        "own", F.when(of_main, F.pmod(salt, F.col("main_blocks")))
        .otherwise(F.col("main_blocks") + F.pmod(salt, F.col("blocks"))).cast("int"),
    ).withColumn(
        "other",
        F.explode(F.sequence(F.when(of_main, F.col("main_blocks")).otherwise(F.lit(0)), last)),
    ).select(
        "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own",
        "print", "root",
    )


def _headed(met: DataFrame, centres: DataFrame) -> DataFrame:
    """``met`` with ``head``, the first of ``centres`` in each band; both as (rank, print)."""
    ranked = met.join(centres, "print")
    heads = ranked.groupBy("band").agg(F.min("centre").alias("head"))
    return ranked.join(heads, "band")


def _by_rare_runs(sets: DataFrame, percent: int) -> DataFrame:
    """(band, print, n_shingles): sets listed by their rarest runs, as bands that lose no link.

    With a set's runs in the order of how many sets hold them, the first run that two sets have
    in common leaves at most the rest of either as their intersection. That must do for a
    set of ``percent`` of its size, and with the smallest set that holds the run.
    """
    runs = sets.select("print", "n", F.explode("runs").alias("band"))
    shared = runs.groupBy("band").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    order = Window.partitionBy("print").orderBy(F.col("holders").desc(), F.col("band").desc())
    # counted from the end, as runs that no other set holds come first
    early = runs.join(shared, "band").withColumn("rest", F.row_number().over(order)).filter(
        100 * F.col("rest") >= percent * F.col("n")
    )
    least = early.groupBy("band").agg(
        F.min("n").alias("least"), F.count(F.lit(1)).alias("holders")
    ).filter("holders > 1").select("band", "least")
    return early.join(least, "band").filter(
        (100 + percent) * F.col("rest") >= percent * (F.col("n") + F.col("least"))
    ).select("band", "print", F.col("n").alias("n_shingles"))


def groups(
    docs: DataFrame, by_print: DataFrame, words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(print, root) of every linked print; a root stands for a group."""
    listed = by_print.select("print", "n_shingles", F.explode("bands").alias("band"))
    shared = listed.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = staged(listed.join(shared, "band"), "bands")
    centres = staged(
        met.groupBy("print").agg((-F.sum("members")).alias("rank")).select(
            "print", F.struct("rank", "print").alias("centre")
        ),
        "centres",
    )
    met = staged(_headed(met.drop("members"), centres), "headed")
    tried = staged(
        met.filter("centre != head").groupBy(F.col("print").alias("u")).agg(
            F.min("head").getField("print").alias("v")
        ),
        "first-pairs",
    )
    chosen = by_print.join(met.select("print").distinct(), "print", "left_semi")
    sets = staged(sets_of(docs, chosen, words), "sets")
    roots = components(_confirmed(tried, sets, percent))
    rooted = staged(
        chosen.select("print").join(roots, chosen["print"] == roots["node"], "left").select(
            "print", F.coalesce("root", "print").alias("root")
        ),
        "first-groups",
    )
    open_sets = met.join(_left_over(met, rooted, tried), "band", "left_semi").select("print")
    rare = staged(
        _by_rare_runs(sets.join(open_sets.distinct(), "print", "left_semi"), percent), "rare-runs"
    )
    left_over = staged(_left_over(_headed(rare, centres), rooted, tried), "left-over")
    dealt = _dealt(rare.select("band", "print"), rooted, left_over)
    found = dealt.join(sets, "print").groupBy("band", "p", "q").applyInPandas(
        _across(percent), "u binary, v binary"
    )
    merged = components(found)
    return rooted.join(merged, rooted["root"] == merged["node"], "left").select(
        "print", F.coalesce(merged["root"], rooted["root"]).alias("root")
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of every row of ``docs``.

    component_id is the smallest doc_id reachable over pairs of texts whose sets have at least
    ``percent`` of their union in common. Texts with equal sets are one; texts without
    words are linked with nothing. Null ids count as larger than all others. Rows that
    repeat are returned as often; an empty table gives an empty result. Very long texts are
    taken whole. Other columns are not looked at.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the bands find pairs from 80 percent")
    prints = staged(sketches(docs, words), "sketches")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    by_print = staged(
        prints.filter("print IS NOT NULL").groupBy("print").agg(
            F.min("doc_id").alias("doc_id"), F.min(first).alias("first"),
            F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"),
        ),
        "by-print",
    )
    linked = staged(groups(docs, by_print, words, percent), "groups")
    rooted = by_print.select("print", "doc_id").join(linked, "print", "left").withColumn(
        "root", F.coalesce("root", "print")
    )
    merged = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = staged(rooted.select("print", "root").join(merged, "root").drop("root"), "classes")
    own = prints.select("doc_id", "text_key", "print", "n_shingles")
    alone = own.filter("print IS NULL").select(
        "doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return own.join(classes, "print").select(
        "doc_id", "text_key", "n_shingles", "component_id"
    ).union(alone)

