"""MinHash groups, lexical search and whitening against brute-force versions."""

import math
import os
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import lexical, minhash, whitening

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(params=["edge cases", "dataset"])
def corpus(request, spark, docs):
    if request.param == "edge cases":
        return docs
    if not os.path.isdir(FOLDER):
        pytest.skip("dataset not present")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# MinHash ---------------------------------------------------------------------------

def runs(text, n=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def grouped(rows, percent=85):
    """(doc_id, size of the set, smallest doc_id reachable) of each (doc_id, text), sorted."""
    sets, group = [runs(t) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            group = [group[i] if g == group[j] else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        least[g] = min((x for x in (doc, least.get(g)) if x is not None), default=None)
    return sorted((str(d), len(s), str(least[g])) for (d, _), s, g in zip(rows, sets, group))


def found(df, percent=85):
    return sorted(
        (str(r.doc_id), r.n_shingles, str(r.component_id))
        for r in minhash.near_duplicates(df, percent=percent).collect()
    )


def test_minhash_groups(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    assert found(corpus) == grouped(rows)


def near_copies(random, base, copies, most):
    for _ in range(copies):
        copy = list(base)
        for at in random.integers(0, len(base), random.integers(1, most)):
            copy[at] = f"new{random.integers(0, 10**9)}"
        yield " ".join(copy)


def test_minhash_links_of_all_strengths(spark, monkeypatch):
    """Near copies from 0.6 to 0.98, most of them not alike to the first of their band."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "SHARE", 2)
    random = np.random.default_rng(5)
    texts = [
        t for _ in range(12)
        for t in near_copies(random, [f"v{x}" for x in random.integers(0, 9000, 200)], 14, 9)
    ]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for percent in (80, 85, 95):
        assert found(df, percent) == grouped(rows, percent)


def test_minhash_deals_out_few_rows_of_a_large_group(spark, monkeypatch):
    """Copies that are not alike share most bands; they must not meet in the square of their number."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    dealt, deal = [], minhash._dealt

    def counted(*tables):
        dealt.append(deal(*tables))
        return dealt[-1]

    monkeypatch.setattr(minhash, "_dealt", counted)
    random = np.random.default_rng(8)
    rows = list(enumerate(near_copies(random, [f"v{x}" for x in range(150)], 300, 16)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == grouped(rows)
    assert dealt[0].count() < 30 * len(rows)


def test_minhash_of_odd_tables(spark, docs, nothing):
    assert minhash.near_duplicates(nothing).collect() == []
    assert found(docs.select("*", F.lit(1).alias("band"), F.lit(2).alias("print"))) == found(docs)
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, percent=70)


def test_minima_and_maxima_estimate_the_similarity():
    random = np.random.default_rng(1)
    shared = random.integers(0, 1 << 63, 800).astype(np.uint64)
    own = random.integers(0, 1 << 63, (2, 100)).astype(np.uint64)
    a, b = (minhash.signature(np.concatenate((shared, o))) for o in own)
    assert len(a) == 2 * minhash.PERMUTATIONS
    assert abs((a == b).mean() - 0.8) < 0.1
    assert minhash.bands(np.empty(0, np.uint64)).size == 0


# Lexical search ----------------------------------------------------------------------

def terms_of(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def ranked(docs, items, k=10):
    cut = [(d, terms_of(t)) for d, t in docs]
    cut = [(d, t) for d, t in cut if t]
    n, total = len(cut), sum(len(t) for _, t in cut)
    of = {}
    for item, text in items:
        of.setdefault(item, set()).update(terms_of(text))
    frequency = {}
    for _, terms in cut:
        for t in set(terms):
            frequency[t] = frequency.get(t, 0) + 1
    out = []
    for item, wanted in of.items():
        scores = []
        for doc, terms in cut:
            m = 100 - 90 + 90 * len(terms) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * frequency[t] + 1)))
                * (10**9 * terms.count(t) // (1000 * terms.count(t) + 8 * m))
                for t in wanted if t in terms
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [
            (item, rank, None if null else doc, -s)
            for rank, (s, null, doc) in enumerate(sorted(scores)[:k], 1)
        ]
    return sorted(out, key=str)


def searched(docs, items, **options):
    return sorted(map(tuple, lexical.ranked(docs, items, **options).collect()), key=str)


ITEMS = [
    (1, "one TWO three"), (2, "same line, end"), (3, None), (4, " .,! "), (5, "nowhere"),
    (6, "text text 7 9"), (6, "unique"), (7, "Été à la x w17 w18"), (8, "one TWO three"), (None, "id"),
]


def test_search_of_odd_rows(spark, docs, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = ranked([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert searched(docs, items) == want
    # groups of a few terms, items longer than a group, clashing names
    clash = items.select("*", *(F.lit(1).alias(c) for c in ("group", "term", "rank", "score")))
    assert searched(docs.withColumn("terms", F.lit(1)), clash, most=3) == want
    assert searched(docs, items, k=2) == [r for r in want if r[1] <= 2]
    assert searched(nothing, items) == [] and searched(docs, items.limit(0)) == []


def test_search_prunes_and_stays_exact(spark, monkeypatch):
    for name, value in (("BATCH", 64), ("DOCUMENT_LEAF", 4), ("ITEM_LEAF", 2), ("FAN", 2)):
        monkeypatch.setattr(lexical, name, value)
    random = np.random.default_rng(3)

    def text(language, length):
        return " ".join(f"{language}{min(x, 400)}" for x in random.zipf(1.3, length))

    rows = [(i, text("abc"[i % 3], random.integers(1, 80))) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    items = [(i, text("abcd"[i % 4], 25)) for i in range(24)] + [(99, rows[7][1])]
    got = searched(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    assert got == ranked(rows, items)


def test_whole_batches_are_left_out():
    random = np.random.default_rng(2)
    weights = np.full(90, 1000, np.int64)

    def documents(kind, n):
        terms = np.concatenate([np.sort(random.choice(30, 10, replace=False)) + 30 * kind for _ in range(n)])
        return lexical.Documents(
            np.arange(n), np.zeros(n, bool), np.arange(0, 10 * n + 1, 10), terms, np.full(10 * n, 5.0)
        )

    tree = lexical.item_tree([np.arange(3), np.arange(5, 9)], weights)
    best = lexical.Best(2, 3)
    assert lexical.search(documents(1, 500), tree, 90, best) == 0  # nothing in common
    full = lexical.search(documents(0, 500), tree, 90, best)
    assert 0 < full <= 16
    weak = documents(0, 500)
    weak.adds[:] = 0.5
    assert lexical.search(weak, tree, 90, best) == 0  # cannot reach the weakest of the best


def test_whole_numbers_beyond_doubles(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b " * i) for i in range(1, 9)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    want = searched(docs, items)
    monkeypatch.setattr(lexical, "EXACT", 1)
    assert searched(docs, items) == want


# Whitening -----------------------------------------------------------------------------

def whitened(spark, vectors, count=16):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    return whitening.whiten(df, count).toPandas()


def check_whitening(spark, vectors, count=16):
    got = whitened(spark, vectors, count)
    x = np.array([[math.floor(64 * c) + 10**6 for c in v] for _, v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:count]
    assert got.n.eq(n).all() and len(got) == len(vectors) * min(count, len(order))
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    deviation = {i: int(((n * r - sums) ** 2).sum()) for (i, _), r in zip(vectors, x)}
    assert {(r.vec_id, r.deviation) for r in got.itertuples()} == set(deviation.items())
    for component, at in enumerate(order, 1):
        part = got[got.component == component].sort_values(["vec_id", "whitened"])
        np.testing.assert_allclose(part.explained, values[at] / values.sum(), rtol=1e-9)
        want = ((n * x - sums) / n).astype(float) @ axes[:, at] / np.sqrt(values[at])
        want = {i: w for (i, _), w in zip(vectors, want)}
        signs = {np.sign(r.whitened * want[r.vec_id]) for r in part.itertuples() if abs(r.whitened) > 1e-6}
        assert len(signs) == 1  # one sign for all rows
        np.testing.assert_allclose(
            np.abs(part.whitened), [abs(want[i]) for i in part.vec_id], atol=1e-8
        )


def test_whitening_of_spread_and_repeated_vectors(spark):
    random = np.random.default_rng(4)
    base = random.normal(size=(200, 24)) * np.geomspace(3, 0.05, 24) + 7
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    check_whitening(spark, vectors + [(1000 + i, base[3].tolist()) for i in range(300)])
    check_whitening(spark, vectors, 3)


def test_whitening_of_large_numbers(spark):
    random = np.random.default_rng(6)
    vectors = [(i, (random.normal(size=3) * 2.0**14 + 2.0**44).tolist()) for i in range(20)]
    check_whitening(spark, vectors)
    with pytest.raises(Exception, match="too large"):
        whitened(spark, [(1, [1e30]), (2, [0.0])])


def test_whitening_below_full_rank(spark):
    random = np.random.default_rng(8)
    flat = random.normal(size=(50, 2)) @ random.integers(-3, 4, (2, 6))
    exact = np.floor(flat * 8)  # whole, so that the third direction has no spread at all
    exact[:, 2:] = exact[:, :1] + exact[:, 1:2]
    got = whitened(spark, [(i, v.tolist()) for i, v in enumerate(exact)])
    assert sorted(got.component.unique()) == [1, 2] and got.identity_error.max() < 1e-9
    assert abs(got.groupby("component").explained.first().sum() - 1) < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(7, None), (8, [1.0, None]), (9, [nan, 1.0]), (10, [1.0, -inf])]
    fine = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, 0.0]), (3, [1.0]), (4, [])]
    got = whitened(spark, odd + fine)
    assert sorted(got.vec_id.fillna(-1)) == [-1, -1, 1, 1, 1, 1, 3, 3, 4, 4]
    assert (got.n == 4).all()  # what is missing counts as zero
    assert whitened(spark, odd).empty and whitened(spark, [(1, [1.0]), (2, [1.0])]).empty
    names = ("x", "n", "component", "deviation", "place")
    df = spark.createDataFrame(fine, "vec_id long, embedding array<double>")
    clash = df.select("*", *(F.lit("k").alias(c) for c in names))
    assert whitening.whiten(clash).count() == 10


def test_cholesky_and_jacobi():
    random = np.random.default_rng(9)
    for size, rank in ((1, 1), (2, 2), (7, 7), (9, 4)):
        half = random.normal(size=(size, rank))
        matrix = half @ half.T
        factor = whitening.pivoted_cholesky(matrix)
        assert factor.shape == (size, rank)
        np.testing.assert_allclose(factor @ factor.T, matrix, atol=1e-12)
        values, vectors = whitening.jacobi(factor)
        np.testing.assert_allclose(values, np.linalg.eigvalsh(matrix)[::-1][:rank], rtol=1e-9)
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(rank), atol=1e-13)
        np.testing.assert_allclose(vectors * values @ vectors.T, matrix, atol=1e-12)
