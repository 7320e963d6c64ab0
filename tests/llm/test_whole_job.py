"""Operators on what their first versions left out."""

import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tradewind.llm import decontaminate, line_dedup, mixing, pii, secrets, simhash, topk


def test_pipeline_keeps_one_of_each_simhash_group(spark):
    random = np.random.default_rng(11)
    made = []
    for _ in range(60):
        base = [f"v{x}" for x in random.integers(0, 5000, 300)]
        made += [" ".join(base)] * 2
        for changes in random.integers(1, 9, 3):
            copy = list(base)
            for at in random.integers(0, 300, changes):
                copy[at] = f"new{random.integers(0, 10**6)}"
            made.append(" ".join(copy))
    prints = [simhash.fingerprint(t.encode()) for t in made]
    group = list(range(len(made)))
    for i, j in combinations(range(len(made)), 2):
        if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 4:
            group = [group[i] if g == group[j] else g for g in group]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {min(i for i, g in enumerate(group) if g == one) for one in set(group)}
    assert 60 <= len(kept) < 200


def test_stage_drops_by_the_threshold_of_the_language(spark, monkeypatch):
    from tradewind.llm import toxicity

    scores = {"low": 0.3, "mid": 0.6, "high": 0.8}
    network = toxicity.train([], np.array([], np.int64))
    network.thresholds = {"en": 0.7, "de": 0.2}
    monkeypatch.setattr(toxicity, "learn", lambda *_: network)
    score = F.element_at(F.create_map(*(F.lit(x) for pair in scores.items() for x in pair)), F.col("text"))
    monkeypatch.setattr(toxicity, "with_scores", lambda docs, _, name: docs.withColumn(name, score))
    rows = [(lang, text) for lang in ("en", "de", "fr", None) for text in scores]
    docs = spark.createDataFrame(rows, "lang string, text string")
    kept = {tuple(r) for r in toxicity.without_toxic(docs, None).collect()}
    assert kept == {("en", "low"), ("en", "mid"), ("fr", "low"), (None, "low")}
    assert toxicity.without_toxic(docs.drop("lang"), None).count() == 4  # 0.5 for all


def test_sources_smaller_than_a_slot_get_their_target(spark):
    from tradewind.llm import mixing

    rows = [(i, f"s{i}", " ".join(["w"] * (5 + i % 30))) for i in range(3000)]
    rows += [(5000 + i, "large", "w " * 200) for i in range(300)] + [(9000, None, "null source"), (9001, "none", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    documents, pieces = mixing.mix(docs, slots=500)
    got = documents.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 3003 and all(abs(r.taken - r.target) <= 0.5 for r in got)
    assert documents.filter("taken > 2 * size").count() == 0
    cut = pieces.agg(F.sum(F.col("end") - F.col("start")), F.min(F.col("end") - F.col("start")), F.max("slot")).first()
    assert cut[0] == sum(r.taken for r in got) and cut[1] > 0 and cut[2] < 500


def test_notices_name_their_own_license_also_when_wrapped(spark):
    from tradewind.llm import licenses

    texts = {
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "apache": "x\n# Licensed under the\n#\n# Apache License, Version 2.0.\ny",
        "mit": "it is released under\nthe MIT\nLicense. " + "more words " * 40,
        "mpl": "This Source Code Form is subject to the terms of the\n * Mozilla Public License.",
        "proprietary": "w " * 50 + "All rights reserved.\nDo not distribute\nwithout permission. " + "w " * 50,
        "bsd": "Use of this source code is governed by a BSD-style license.",
        "": "Licensed under the Other License, Version 2.0.\nmit " + "w " * 90 + "\nunder the License",
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert got == dict(enumerate(texts))


def test_scores_beyond_doubles_are_exact(spark):
    """Scores around 2**60 that differ by one only."""
    big = float(1 << 24)
    rows = [(20, [big, big, 1 / 64]), *((i, [big, big, i / 64.0]) for i in (1, 2, 3, 4, 5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    base = 2 * (64 << 24) ** 2
    assert [(r.rank, r.vec_id, r.score) for r in got] == [
        (n, i, base + i) for n, i in enumerate((5, 4, 3, 2, 1), 1)]
    negative = df.withColumn("embedding", F.when(F.col("vec_id") == 20, F.array(
        F.lit(-big), F.lit(-big), F.lit(-1 / 64))).otherwise(F.col("embedding")))
    got = topk.top_k(negative, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, -base - i) for i in (1, 2, 3, 4, 5)]
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df.withColumn("embedding", F.array(F.lit(2.0**40))), F.col("vec_id") == 20).collect()


def test_every_slot_length_gives_each_source_its_target(spark):
    rows = [(i, f"s{i % 3}", "w " * (1 + i % 11)) for i in range(200)]
    rows += [(None, "s1", "w w w")] * 40 + [(5, "s2", "w w")] * 30 + [(900 + i, None, "w " * 9) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = []
    for slots in (10, 300, 1 << 20):
        documents, pieces = mixing.mix(docs, slots=slots)
        got = documents.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
        assert all(abs(r.taken - r.target) <= 0.5 for r in got)
        taken.append(sorted(map(str, documents.select("doc_id", "source", "size", "taken").collect())))
    assert taken[0] == taken[1] == taken[2]  # what is taken does not depend on the slots


def test_the_mix_is_a_corpus(spark, docs):
    clash = docs.select("*", F.lit("kept").alias("mix_row"), F.lit("old").alias("taken"))
    got = mixing.mixed_corpus(clash, slots=50)
    assert set(got.columns) == {*clash.columns, "size", "source_size", "target", "pieces"}
    rows = got.collect()
    assert len(rows) == docs.count() and {r.mix_row for r in rows} == {"kept"}
    for r in rows:
        assert r.size == len((r.text or "").split())
        assert sum(p.end - p.start for p in r.pieces) == r.taken <= 2 * r.size
        assert all(0 <= p.start < p.end <= r.size for p in r.pieces)
    assert mixing.mixed_corpus(docs.limit(0)).count() == 0


NAMES = (
    "text_key", "kept_id", "kept_key", "contamination", "spans", "toxicity", "n_lines", "dropped",
    "line_doc_id", "line_text_key", "mix_row", "_text_key", "_doc_id", "_key", "_n_lines", "_dropped",
    "print", "bands", "band", "root", "size", "place", "row", "list", "fingerprint", "score", "positions",
)


def test_columns_of_any_name_stay(spark, docs, monkeypatch):
    """Every operator and stage over a table that has all helper names as columns of its own."""
    from tradewind.llm import lexical, licenses, minhash, toxicity

    named = docs.select("*", *(F.lit(n).alias(n) for n in NAMES if n not in docs.columns))
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    network = toxicity.train([], np.array([], np.int64))
    monkeypatch.setattr(toxicity, "learn", lambda *_: network)
    stages = (
        line_dedup.without_repeated_lines, simhash.one_of_each,
        lambda d: decontaminate.decontaminated(d, benchmark),
        lambda d: toxicity.without_toxic(d, None), lambda d: mixing.mixed_corpus(d).select(*d.columns),
    )
    for stage in stages:
        got, plain = stage(named), stage(docs)
        assert got.columns == named.columns
        own = [c for c in docs.columns if c not in ("size", "taken", "target")]
        assert sorted(map(str, got.select(*own).collect())) == sorted(map(str, plain.select(*own).collect()))
        names = [n for n in NAMES if n not in (*docs.columns, "size")]
        assert {tuple(r) for r in got.select(*names).distinct().collect()} in ({tuple(names)}, set())
    others = (
        simhash.near_duplicates, minhash.near_duplicates, line_dedup.keep_bitmaps,
        lambda d: pii.summary(pii.scan(d)), lambda d: secrets.summary(secrets.scan(d)), licenses.scan,
        lambda d: lexical.ranked(d, benchmark), lambda d: mixing.mix(d)[0].drop("row"),
    )
    for operator in others:
        assert sorted(map(str, operator(named).collect())) == sorted(map(str, operator(docs).collect()))


def test_automata_of_any_size_find_the_same(spark):
    """Repeated items count once, long ones are cut so that no window is lost, parts are bounded."""
    random = np.random.default_rng(3)
    words = [f"w{x}" for x in random.integers(0, 400, 900)]
    items = [(1, " ".join(words[:300])), (2, " ".join(words[200:240])), (3, "Tiny item"), (4, " "), (5, None)]
    items += [(1, " ".join(words[:300]))] * 50 + [(3, "tiny, ITEM")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(words[a:a + n]) for a, n in ((0, 900), (5, 10), (5, 9), (195, 60), (290, 30), (295, 14))]
    docs = spark.createDataFrame(list(enumerate([*texts, "a tiny item.", None, ""])), "doc_id long, text string")

    def marked(most):
        return sorted(map(str, decontaminate.contamination(docs, benchmark, max_words=most).collect()))

    want = marked(200_000)
    for most in (10, 17, 64):
        parts = decontaminate.item_parts(benchmark, max_words=most).collect()
        size = {}
        for r in parts:
            size[r.part] = size.get(r.part, 0) + len(r.text.split())
        assert len(size) > 3 and max(size.values()) <= 2 * most
        assert len(parts) == len({(r.item_id, r.text) for r in parts})
    assert marked(17) == want
    found = {r.doc_id: r.contamination for r in decontaminate.contamination(docs, benchmark, max_words=64).collect()}
    assert [(s.start, s.end) for s in found[0].spans] == [(0, 300)] and found[0]["items"] == ["1", "2"]
    assert found[1]["items"] == ["1"] and found[2]["items"] == [] and found[6]["items"] == ["3"]
    with pytest.raises(ValueError):
        decontaminate.item_parts(benchmark, max_words=9)


def test_slots_are_never_broadcast(spark):
    """A small corpus has as many slots as words; the driver must not hold a table of them."""
    words = " ".join(["w"] * 2_000)
    docs = spark.range(10).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(words).alias("text")
    )
    sources = mixing.source_targets(mixing.sizes(docs))
    filled, length = mixing.schedule(sources, 30_000)
    _, pieces = mixing.mix(docs)
    assert length == 1 and pieces.select("slot").distinct().count() > 20_000

    def plan(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    assert re.search(r"SortMergeJoin\(?[^\n]* \[cell#\d+L\]", plan(filled))
    assert re.search(r"SortMergeJoin\(?[^\n]* \[source_no#\d+L, block#\d+L\]", plan(pieces))
