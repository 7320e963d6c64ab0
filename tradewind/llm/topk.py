"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are grouped around pivots, the top level of one tree for queries and data alike; a
group is cut into blocks of bounded size. A block of queries meets a block of data only if
the bound from both covering radii can reach what the queries' own group already gives
them as k-th score. Where two blocks meet, each is indexed by a cover tree and both trees are
walked together: a pair of nodes is left out once its bound is below the worst k-th score
among the queries of the node.

The inner product of members of two balls is at most <p, q> + r_p |q| + r_q |p| + r_p r_q.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.text import staged

K = 20
#: Pivots, drawn from a sample of so many vectors; every vector is indexed by them.
PIVOTS, SAMPLE = 32, 2_000
BLOCK, QUERY_BLOCK = 4096, 1024
LEAF = 256
#: So many centres in a row that cover only themselves end a node's search for centres.
LONE = 32
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53
#: Score of what is no candidate; its negative still fits 64 bits.
NONE = -(1 << 63) + 1


@dataclass
class Node:
    rows: np.ndarray
    center: np.ndarray
    radius: float
    children: list[Node]


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """A cover tree: the children of a node are centred at members of it that are further apart
    than half its radius, and every member goes to the first centre within that distance.

    Members that cover nobody but themselves get no node of their own: they share leaves, by their
    distance from the centre. Once ``LONE`` centres in a row were such, all that is left is
    taken for such too, so data without clusters do not cost the square of their number.
    """
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    center = own[0]
    away = np.sqrt(((own - center) ** 2).sum(axis=1))
    radius = float(away.max(initial=0.0))
    node = Node(rows, center, radius, [])
    if len(rows) <= leaf or radius == 0:
        return node
    left, lone, in_a_row = np.arange(len(rows)), [], 0
    while len(left) and in_a_row < LONE:
        near = ((own[left] - own[left[0]]) ** 2).sum(axis=1) <= (radius / 2) ** 2
        if near.sum() == 1:
            lone.append(left[0])
            in_a_row += 1
        else:
            node.children.append(cover_tree(points, rows[left[near]], leaf))
            in_a_row = 0
        left = left[~near]
    apart = np.concatenate((np.array(lone, np.int64), left))
    apart = rows[apart[np.argsort(away[apart], kind="stable")]]
    for start in range(0, len(apart), leaf):
        part = apart[start:start + leaf]
        distance = np.sqrt(((points[part] - points[part[0]]) ** 2).sum(axis=1))
        node.children.append(Node(part, points[part[0]], float(distance.max()), []))
    return node


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.scores = np.full((queries, k), NONE)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = np.full(queries, NONE) if floor is None else floor

    def worst(self, rows: np.ndarray) -> int:
        return int(np.maximum(self.scores[rows, -1], self.floor[rows]).min())

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of all ``ids`` for each of the query ``rows``."""
        limit = np.maximum(self.scores[rows, -1], self.floor[rows])
        for at in np.flatnonzero((scores >= limit[:, None]).any(axis=1)):
            row = rows[at]
            take = scores[at] >= limit[at]
            s = np.concatenate((self.scores[row], scores[at][take]))
            i = np.concatenate((self.ids[row], ids[take]))
            order = np.lexsort((i, -s))[: self.k]
            self.scores[row], self.ids[row] = s[order], i[order]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact in 64 bits; larger ones raise."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a @ b.T).astype(np.int64)

    def whole(matrix: np.ndarray) -> np.ndarray:
        return np.array([[int(x) for x in row] for row in matrix], object).reshape(matrix.shape)

    scores = whole(a) @ whole(b).T
    if max(abs(scores.max(initial=0)), abs(scores.min(initial=0))) >= -NONE:
        raise OverflowError("an inner product does not fit 64 bits")
    return scores.astype(np.int64)


def bound(q: Node, p: Node) -> float:
    nq, np_ = np.sqrt((q.center ** 2).sum()), np.sqrt((p.center ** 2).sum())
    exact = float(q.center @ p.center) + q.radius * np_ + p.radius * nq + q.radius * p.radius
    return exact + 1e-9 * abs(exact) + 1e-6  # rounding must never prune


def search(
    queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, best: Best
) -> None:
    """Fill ``best`` by walking both trees, most promising pairs of nodes first."""
    if not len(queries) or not len(points):
        return
    tops = cover_tree(queries), cover_tree(points)
    queue = [(-bound(*tops), 0, *tops)]
    pushed = 0
    while queue:
        minus, _, q, p = heapq.heappop(queue)
        if -minus < best.worst(q.rows):
            continue
        if not q.children and not p.children:
            scores = _product(queries[q.rows], points[p.rows])
            scores[query_ids[q.rows][:, None] == ids[p.rows][None, :]] = NONE
            best.add(q.rows, scores, ids[p.rows])
            continue
        split_q = bool(q.children) and (not p.children or q.radius >= p.radius)
        for a in q.children if split_q else [q]:
            worst = best.worst(a.rows)
            for b in [p] if split_q else p.children:
                reach = bound(a, b)
                if reach >= worst:
                    pushed += 1
                    heapq.heappush(queue, (-reach, pushed, a, b))


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector): floor(64 x) of each component as double.

    Vectors that are null, empty, or hold a null or non-finite component are left out, as are
    null ids. A vec_id that repeats counts once, with the smallest of its vectors.
    """
    raw = F.col("embedding")
    fine = raw.isNotNull() & (F.size(raw) > 0) & ~F.exists(
        raw,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    vector = F.transform(raw, lambda x: F.floor(x.cast("double") * 64).cast("double"))
    rows = embeddings.filter(fine & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")
    )
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def pivots(vectors: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Centres far apart from each other, out of ``sample`` vectors that come first by hash."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    width = max((len(r["vector"]) for r in rows), default=1)
    points = np.array([r["vector"] + [0.0] * (width - len(r["vector"])) for r in rows])
    if not len(points):
        return np.zeros((1, width))
    chosen = [0]
    away = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _matrix(vectors, width: int) -> np.ndarray:
    if all(len(v) == width for v in vectors):
        return np.array(list(vectors), dtype=np.float64).reshape(-1, width)
    return np.array([np.pad(v, (0, width - len(v))) for v in vectors]).reshape(-1, width)


def _near(vectors: DataFrame, centers: np.ndarray, width: int) -> DataFrame:
    """(vec_id, vector, pivot, away): the nearest centre of each vector and the distance."""
    centers = np.pad(centers, ((0, 0), (0, width - centers.shape[1])))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            points = _matrix(part.column(1).to_numpy(zero_copy_only=False), width)
            square = (
                (points ** 2).sum(axis=1)[:, None] - 2 * points @ centers.T
                + (centers ** 2).sum(axis=1)
            )
            nearest = square.argmin(axis=1)
            away = np.sqrt(((points - centers[nearest]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(nearest.astype(np.int32)), pa.array(away)],
                ["vec_id", "vector", "pivot", "away"],
            )

    return vectors.mapInArrow(batches, "vec_id long, vector array<double>, pivot int, away double")


def _blocked(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``block``: each pivot's rows spread over blocks of about ``size``."""
    counts = rows.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    salt = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    return rows.join(F.broadcast(counts), "pivot").withColumn(
        "block", F.col("pivot").cast("long") * F.lit(1 << 32) + salt
    ).drop("blocks")


def _searching(width: int, k: int, floors: bool):
    """Group function: the queries and the data of one pair of blocks to their best k."""

    def run(key, queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        q, p = _matrix(queries["vector"], width), _matrix(points["vector"], width)
        floor = queries["floor"].to_numpy(np.int64) if floors else None
        best = Best(len(q), k, floor)
        search(q, queries["vec_id"].to_numpy(), p, points["vec_id"].to_numpy(), best)
        at, rank = np.nonzero(best.scores != NONE)
        return pd.DataFrame({
            "query_id": queries["vec_id"].to_numpy()[at],
            "vec_id": best.ids[at, rank],
            "score": best.scores[at, rank],
        })

    return run


RESULT = "query_id long, vec_id long, score long"


def _met(queries: DataFrame, data: DataFrame, width: int, k: int, floors: bool) -> DataFrame:
    """Best k per query and pair of blocks; both sides carry ``q`` and ``p``, the pair."""
    data = data.withColumnsRenamed({"q": "dq", "p": "dp"})
    return queries.groupBy("q", "p").cogroup(data.groupBy("dq", "dp")).applyInPandas(
        _searching(width, k, floors), RESULT
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(embeddings: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest scores among all other rows.

    Ties go to the smaller vec_id; a query has fewer rows if there are fewer vectors.
    Vectors of unequal length are taken as if filled up with zeros. Scores are exact; one that does
    not fit 64 bits raises. Other columns are not looked at; an empty table, or one without queries, gives an empty result.
    """
    vectors = staged(whole_vectors(embeddings), "vectors")
    width = vectors.agg(F.max(F.size("vector"))).first()[0] or 1
    centers = pivots(vectors)
    near = staged(_near(vectors, centers, width), "near")
    data = staged(_blocked(near, BLOCK), "data-blocks")
    queries = staged(_blocked(near.filter(is_query), QUERY_BLOCK), "query-blocks")

    # first the data block with the same centre and the same salt: a floor for each query
    own = data.select("pivot", "block").distinct().groupBy("pivot").agg(F.max("block").alias("own"))
    at_home = queries.join(F.broadcast(own), "pivot").select(
        F.col("block").alias("q"), F.least("block", "own").alias("p"), "vec_id", "vector"
    )
    home = staged(at_home.select("q", "p").distinct(), "home-pairs")
    there = data.join(home, data["block"] == home["p"]).select("q", "p", "vec_id", "vector")
    first = staged(_met(at_home, there, width, k, False), "home")
    floors = _best(first, k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor")
    )
    floored = staged(
        queries.join(floors, queries["vec_id"] == floors["query_id"], "left").withColumn(
            "floor", F.coalesce("floor", F.lit(NONE))
        ).drop("query_id"),
        "floors",
    )

    # then every pair of blocks that the bound on their balls does not rule out
    def balls(rows: DataFrame, *more: Column) -> DataFrame:
        return rows.groupBy("block").agg(
            F.max("pivot").alias("pivot"), F.max("away").alias("radius"), *more
        )

    reached = staged(
        _reachable(balls(floored, F.min("floor").alias("floor")), balls(data), centers, width),
        "reached",
    )
    met = staged(reached.join(home, ["q", "p"], "left_anti"), "met")
    asked = floored.join(met, floored["block"] == met["q"]).select(
        "q", "p", "vec_id", "vector", "floor"
    )
    answered = data.join(met, data["block"] == met["p"]).select("q", "p", "vec_id", "vector")
    rest = _met(asked, answered, width, k, True)
    return _best(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


def _reachable(queries: DataFrame, data: DataFrame, centers: np.ndarray, width: int) -> DataFrame:
    """Pairs (q, p) of blocks whose bound reaches the worst floor among the queries.

    Works on one row per block. The queries' balls are the stated query set; they meet all data
    balls of a pivot by the pivot's bound, computed per pair of pivots.
    """
    spark = queries.sparkSession
    centers = np.pad(centers, ((0, 0), (0, width - centers.shape[1])))
    norms = np.sqrt((centers ** 2).sum(axis=1))
    dots = centers @ centers.T
    pairs = spark.createDataFrame(
        [
            (i, j, float(dots[i, j]), float(norms[i]), float(norms[j]))
            for i in range(len(centers)) for j in range(len(centers))
        ],
        "pivot int, other int, dot double, q_norm double, p_norm double",
    )
    data = data.select(
        F.col("block").alias("p"), F.col("pivot").alias("other"), F.col("radius").alias("p_radius")
    )
    bounds = queries.join(F.broadcast(pairs), "pivot").join(data, "other")
    reach = (
        F.col("dot") + F.col("radius") * F.col("p_norm") + F.col("p_radius") * F.col("q_norm")
        + F.col("radius") * F.col("p_radius")
    )
    slack = F.abs(reach) * 1e-9 + 1e-6
    return bounds.filter(reach + slack >= F.col("floor")).select(F.col("block").alias("q"), "p")
