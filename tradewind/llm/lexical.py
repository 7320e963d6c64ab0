"""Ranked lexical search by dual trees over items and documents.

A document is a sparse vector of what each term would add to a score, an item the set of its
terms, so a score is an inner product without negative terms. A node of the document
tree holds the maximum of each coordinate over its documents, a node of the item tree all
terms of its items. The sum of the one over the other bounds the score of any
pair below; it is compared with the weakest k-th score among the items, and whole batches
are left out that cannot reach it. Equal scores still can, so they are never left out.

Items are taken in groups of bounded size, whose terms go to all tasks. For each group the
documents are counted once, which gives the document frequencies; then each task builds
trees over batches of its documents, walks them, and returns its best ``k`` per item.
All scores are whole numbers, so results do not depend on how the documents are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.prefix import sum_before
from tradewind.llm.text import lower_ascii, small_batches, staged

K = 10
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of the items of one group, each item's counted for itself; a longer item is a group alone.
TERMS = 20_000
#: Documents of a tree and of a leaf, items of a leaf, children of a node.
BATCH, DOCUMENT_LEAF, ITEM_LEAF, FAN = 4096, 32, 8, 4
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53
#: A-Z lower-cased; everything else in ASCII but digits and letters becomes a space.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def item_groups(benchmark: DataFrame, most: int = TERMS) -> DataFrame:
    """(group, item, item_id, terms): the different terms of each item_id, items numbered by group.

    An item_id that repeats is one item with the terms of all its texts. Items without terms
    are left out.
    """
    found = benchmark.select(
        "item_id", F.explode(F.array_distinct(
            F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TOKEN), F.lit(0)))).alias("term")
    )
    items = found.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    place = F.xxhash64("item_id")
    placed = staged(items.select(
        "item_id", "terms", F.size("terms").cast("long").alias("size"), place.alias("place"),
        F.shiftright(place, 54).alias("bucket"), F.lit(0).alias("all"),
    ), "items")
    ordered = sum_before(
        placed, "all", "bucket", ["place", F.col("item_id").asc_nulls_last()], "size", "before"
    )
    return staged(ordered.select(
        F.floor(F.col("before") / most).alias("group"), "item_id", "terms"
    ), "item-groups")


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, size, terms, counts): all terms of a document, and which of ``terms`` how often."""
    number = {t.encode(): i for i, t in enumerate(terms)}

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sizes, found, counts = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = (text.as_py() or b"").translate(_TABLE).split()
                codes = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                kinds, times = np.unique(codes[codes >= 0], return_counts=True)
                sizes.append(len(words))
                found.append(kinds)
                counts.append(times)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "size", "terms", "counts"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(batches, "doc_id long, size long, terms array<int>, counts array<long>")


@dataclass
class Node:
    """Some items and all their terms, as sorted positions."""

    items: np.ndarray
    terms: np.ndarray
    children: list[Node] = field(default_factory=list)
    #: Of a leaf: one column per item, one row per term of the node.
    holds: np.ndarray | None = None


def item_tree(items: list[np.ndarray], weights: np.ndarray, kind=np.float64) -> Node:
    """Items that share their weightiest terms side by side, then node over node."""
    order = sorted(
        range(len(items)),
        key=lambda i: sorted(items[i].tolist(), key=lambda t: (-weights[t], t))[:8],
    )
    nodes = []
    for at in range(0, len(order), ITEM_LEAF):
        rows = np.array(order[at:at + ITEM_LEAF])
        terms = np.unique(np.concatenate([items[i] for i in rows]))
        holds = np.stack([np.isin(terms, items[i]) for i in rows], axis=1).astype(kind)
        nodes.append(Node(rows, terms, holds=holds))
    while len(nodes) > 1:
        parts = [nodes[at:at + FAN] for at in range(0, len(nodes), FAN)]
        nodes = [
            Node(np.concatenate([n.items for n in part]),
                 np.unique(np.concatenate([n.terms for n in part])), part)
            for part in parts
        ]
    return nodes[0]


class Best:
    """The ``k`` best documents of each item so far; ties go to the smaller id, nulls last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = np.zeros((items, k), np.int64)
        self.ids = np.zeros((items, k), np.int64)
        self.null = np.ones((items, k), bool)

    def worst(self, items: np.ndarray) -> int:
        return int(self.scores[items, -1].min())

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        take = np.flatnonzero((scores > 0) & (scores >= self.scores[item, -1]))
        if not len(take):
            return
        s = np.concatenate((self.scores[item], scores[take].astype(np.int64)))
        i = np.concatenate((self.ids[item], ids[take]))
        n = np.concatenate((self.null[item], null[take]))
        order = np.lexsort((i, n, -s))[: self.k]
        self.scores[item], self.ids[item], self.null[item] = s[order], i[order], n[order]


@dataclass
class Documents:
    """Sparse rows: entries ``starts[d]`` to ``starts[d + 1]`` are what terms add to a score."""

    ids: np.ndarray
    null: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    adds: np.ndarray

    def side_by_side(self) -> Documents:
        """Documents with the same weightiest terms next to each other."""
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        order = np.lexsort((self.terms, -self.adds, owner))
        first = np.full((3, len(self.ids)), -1)
        for at in range(3):
            there = np.flatnonzero(np.diff(self.starts) > at)
            first[at, there] = self.terms[order[self.starts[there] + at]]
        rows = np.lexsort(first[::-1])
        length = np.diff(self.starts)[rows]
        starts = np.concatenate(([0], np.cumsum(length)))
        entries = np.repeat(self.starts[rows] - starts[:-1], length) + np.arange(starts[-1])
        return Documents(
            self.ids[rows], self.null[rows], starts, self.terms[entries], self.adds[entries]
        )

    def maxima(self, width: int) -> list[np.ndarray]:
        """Coordinate maxima of the nodes, level by level, the leaves first."""
        leaves = -(-len(self.ids) // DOCUMENT_LEAF)
        owner = np.repeat(np.arange(len(self.ids)) // DOCUMENT_LEAF, np.diff(self.starts))
        level = np.zeros((leaves, width), self.adds.dtype)
        np.maximum.at(level, (owner, self.terms), self.adds)
        levels = [level]
        while len(level) > 1:
            level = np.maximum.reduceat(level, np.arange(0, len(level), FAN), axis=0)
            levels.append(level)
        return levels

    def leaf(self, at: int, width: int) -> np.ndarray:
        first, last = at * DOCUMENT_LEAF, min((at + 1) * DOCUMENT_LEAF, len(self.ids))
        entries = slice(self.starts[first], self.starts[last])
        dense = np.zeros((last - first, width), self.adds.dtype)
        owner = np.repeat(np.arange(last - first), np.diff(self.starts[first:last + 1]))
        dense[owner, self.terms[entries]] = self.adds[entries]
        return dense


def search(docs: Documents, tree: Node, width: int, best: Best) -> int:
    """Walk both trees and fill ``best``; the number of pairs of leaves that were scored."""
    docs = docs.side_by_side()
    levels = docs.maxima(width)
    scored = 0

    def reached(maxima: np.ndarray, nodes: list[Node]) -> list[Node]:
        return [
            n for n in nodes if 0 < (bound := maxima[n.terms].sum()) and bound >= best.worst(n.items)
        ]

    def walk(level: int, at: int, nodes: list[Node]) -> None:
        nonlocal scored
        maxima = levels[level][at]
        # both sides go down one level at a time; over a leaf of documents, items go to their leaves
        nodes = reached(maxima, nodes)
        while nodes and (level == 0 and any(n.children for n in nodes)):
            nodes = reached(maxima, list(chain.from_iterable(n.children or [n] for n in nodes)))
        if not nodes:
            return
        if level:
            below = list(chain.from_iterable(n.children or [n] for n in nodes))
            last = min((at + 1) * FAN, len(levels[level - 1]))
            children = np.arange(at * FAN, last)
            terms = np.unique(np.concatenate([n.terms for n in nodes]))
            promise = levels[level - 1][children][:, terms].sum(axis=1)
            for child in children[np.argsort(-promise, kind="stable")]:
                walk(level - 1, int(child), below)
            return
        dense = docs.leaf(at, width)
        rows = slice(at * DOCUMENT_LEAF, at * DOCUMENT_LEAF + len(dense))
        for node in nodes:
            bounds = maxima[node.terms] @ node.holds
            alive = np.flatnonzero((bounds > 0) & (bounds >= best.scores[node.items, -1]))
            if not len(alive):
                continue
            scored += 1
            scores = dense[:, node.terms] @ node.holds[:, alive]
            for column, item in enumerate(node.items[alive]):
                best.add(item, scores[:, column], docs.ids[rows], docs.null[rows])

    if len(docs.ids):
        walk(len(levels) - 1, 0, [tree])
    return scored


def adds(sizes: np.ndarray, counts: np.ndarray, weights: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds: its weight times the saturated count, in whole numbers."""
    if 90 * int(sizes.max(initial=0)) * n >= 1 << 63:
        sizes = sizes.astype(object)
    m = (100 - 90 + (90 * sizes * n) // total).astype(np.int64)
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


def _found(
    counted: DataFrame, items: list[np.ndarray], weights: np.ndarray, n: int, total: int, k: int
) -> DataFrame:
    """(item, doc_id, score): each task's best ``k`` documents of every item."""
    # no count adds more than a million times the weight
    most = max(int(weights[i].sum()) for i in items) * 1_000_000
    kind = np.float64 if most < EXACT else np.int64
    tree, width, batch = item_tree(items, weights, kind), len(weights), BATCH

    def documents(part: pa.RecordBatch) -> Documents:
        terms, counts = part.column(2), part.column(3)
        lengths = terms.value_lengths().to_numpy(zero_copy_only=False)
        flat = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.repeat(part.column(1).to_numpy(zero_copy_only=False), lengths)
        value = adds(size, counts.flatten().to_numpy(zero_copy_only=False), weights[flat], n, total)
        ids = part.column(0)
        return Documents(
            ids.fill_null(0).to_numpy(zero_copy_only=False),
            ids.is_null().to_numpy(zero_copy_only=False),
            np.concatenate(([0], np.cumsum(lengths))), flat, value.astype(kind),
        )

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items), k)
        held: list[pa.RecordBatch] = []
        for part in chain(parts, [None]):
            if part is not None:
                held.append(part)
            rows = sum(p.num_rows for p in held)
            if rows and (part is None or rows >= batch):
                merged = pa.Table.from_batches(held).combine_chunks().to_batches()
                for one in merged:
                    search(documents(one), tree, width, best)
                held = []
        item, rank = np.nonzero(best.scores)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)),
             pa.array(best.ids[item, rank], mask=best.null[item, rank]),
             pa.array(best.scores[item, rank])],
            ["item", "doc_id", "score"],
        )

    return counted.filter(F.size("terms") > 0).mapInArrow(
        batches, "item int, doc_id long, score long"
    )


def _ranked_group(docs: DataFrame, group: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of the items of one group."""
    rows = group.select("item_id", "terms").collect()  # TERMS terms, or one item
    terms = sorted({t for r in rows for t in r["terms"]})
    counted = staged(term_counts(docs, terms), "term-counts")
    n, total = counted.filter("size > 0").agg(
        F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))
    ).first()
    frequency = dict(
        counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    )
    weight = np.array([
        math.floor(1000 * math.log((2 * n + 2) / (2 * frequency.get(i, 0) + 1))) for i in range(len(terms))
    ], np.int64)
    known = np.array([i in frequency for i in range(len(terms))]) & (weight > 0)
    weight[~known] = 0
    number = {t: i for i, t in enumerate(terms)}
    items = [np.array(sorted(number[t] for t in r["terms"]), np.int64) for r in rows]
    items = [i[known[i]] for i in items]
    named = docs.sparkSession.createDataFrame(
        [(i, r["item_id"]) for i, r in enumerate(rows)],
        f"item int, item_id {group.schema['item_id'].dataType.simpleString()}",
    )
    found = _found(counted, items, weight, n, max(total, 1), k)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(named, "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = K, most: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above zero.

    Equal scores go by ascending doc_id, null ids last. Rows that repeat are documents of their
    own. Null, empty and blank texts have no terms: as documents they do not count, as items
    they have no rows. An item_id that repeats is one item. Very long texts are taken whole;
    an empty table on either side gives an empty result. Other columns are not looked at.
    """
    groups = item_groups(benchmark, most)
    numbers = sorted(r[0] for r in groups.select("group").distinct().collect())
    result = None
    for number in numbers:
        part = _ranked_group(docs, groups.filter(F.col("group") == number), k)
        if len(numbers) > 1:
            part = staged(part, "ranked")
        result = part if result is None else result.unionByName(part)
    if result is None:
        kind = benchmark.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"item_id {kind}, rank int, doc_id long, score long"
        )
    return result
