"""License notices in texts, by an exact set-similarity join, and license names.

A block is a run of consecutive words, as long as a notice; line ends do not matter, so a
wrapped notice is a block like any other. A block meets a notice if at least
``containment`` of the notice's different words are in it. The notices' words are ordered
by how many texts of the corpus have them, rarest first. A text with such a block must

- hold one of the first ``size - needed + 1`` words of the notice (prefix),
- have at least ``needed`` different words of the notices (length), and
- have enough words of the notice from the first shared one on (position).

What passes is verified, first by the shared words of the whole text, then block by block.

A name is an exact phrase. One that stands inside a longer name is part of that name alone:
"Creative Commons Attribution-ShareAlike" is no "Creative Commons Attribution".

Every text is normalised and split once; what later steps need is staged. Notices are a
fixed list, so the index of their prefixes is small by construction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.text import row_key, staged, whole

CONTAINMENT = 0.8

# The notices that licenses ask for, by label.
NOTICES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
        "more details.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    "cc0": (
        "To the extent possible under law, the author has dedicated all copyright and related and "
        "neighboring rights to this software to the public domain worldwide. This software is "
        "distributed without any warranty.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
        "any means.",
    ),
    "proprietary": ("All rights reserved. Do not distribute without written permission.",),
}
# Names of licenses as words, by label.
NAMES: dict[str, tuple[str, ...]] = {
    "lgpl": ("lesser general public license",),
    "agpl": ("affero general public license",),
    "mpl": ("mozilla public license",),
    "epl": ("eclipse public license",),
    "bsd": ("bsd license", "bsd style license", "bsd 2 clause", "bsd 3 clause"),
    "isc": ("isc license",),
    "boost": ("boost software license",),
    "cc0": ("cc0 1 0",),
    "cc-by": ("cc by 2 0", "cc by 3 0", "cc by 4 0", "creative commons attribution"),
    "cc-by-sa": ("cc by sa", "creative commons attribution sharealike"),
    "cc-by-nd": ("cc by nd", "creative commons attribution noderivatives"),
    "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial"),
    "cc-by-nc-sa": ("cc by nc sa", "creative commons attribution noncommercial sharealike"),
    "cc-by-nc-nd": ("cc by nc nd", "creative commons attribution noncommercial noderivatives"),
}
# Phrases of the base search and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    """Lower case; equal to lower-casing A-Z for what is compared here, words of ASCII.

    The Kelvin sign, the one other character that ``lower`` turns into an ASCII
    letter by itself, is replaced by a letter that stays.
    """
    return F.lower(F.replace(text, F.lit("K"), F.lit("ķ")))


def normal(text: Column) -> Column:
    """The words, one space before and after each."""
    return F.concat(
        F.lit(" "), F.btrim(F.regexp_replace(_lower(text), _SEPARATORS, " ")), F.lit(" ")
    )


def notice_words(text: str) -> list[str]:
    """All words of a notice in order, repeats included."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def needed_words(size: int, containment: float) -> int:
    return math.ceil(containment * size - 1e-9)


def longer_names(name: str, names: dict[str, tuple[str, ...]] = NAMES) -> list[str]:
    """Names that contain ``name``, longest first."""
    found = {p for phrases in names.values() for p in phrases if p != name and f" {name} " in f" {p} "}
    return sorted(found, key=lambda p: (-len(p), p))


def _named(text: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """The labels of the names in the normal form ``text``."""
    found = []
    for label, phrases in names.items():
        for phrase in phrases:
            rest = text
            for longer in longer_names(phrase, names):
                for _ in range(2):  # names side by side share a space: every other one at a time
                    rest = F.replace(rest, F.lit(f" {longer} "), F.lit(" | "))
            found.append(F.when(F.contains(rest, F.lit(f" {phrase} ")), label))
    return F.array_distinct(F.array_compact(F.array(*found)))


def prepared(
    docs: DataFrame, notices: dict[str, tuple[str, ...]] = NOTICES,
    containment: float = CONTAINMENT, names: dict[str, tuple[str, ...]] = NAMES,
) -> DataFrame:
    """One staged row per document, from one pass over the texts.

    ``row``, doc_id and text_key, the base columns, ``named`` (labels of names), and for texts
    with enough different words of the notices ``word`` and ``at``: those words and their
    places, in order; null for other texts.
    """
    words = [notice_words(t) for texts in notices.values() for t in texts]
    vocabulary = sorted({w for each in words for w in each})
    least = min((needed_words(len(set(each)), containment) for each in words), default=0)
    # the longest word of each name: texts without one have no name
    keys = sorted({max(p.split(), key=len) for phrases in names.values() for p in phrases})
    cut = docs.select("doc_id", row_key().alias("text_key"), normal(whole("text")).alias("normal"))
    cut = cut.withColumn("words", F.split(F.btrim("normal"), " "))
    none = F.array().cast("array<string>")
    base = {n: c for n, c in base_phrases(F.col("normal")).items()}
    cut = cut.select(
        "doc_id", "text_key", "words", *(c.alias(n) for n, c in base.items()),
        F.when(F.exists("words", lambda w: w.isin(keys)), _named(F.col("normal"), names))
        .otherwise(none).alias("named") if keys else none.alias("named"),
        F.array_compact(
            F.transform("words", lambda w, i: F.when(w.isin(vocabulary), i))
        ).alias("at") if vocabulary else F.array().cast("array<int>").alias("at"),
    )
    cut = cut.withColumn("word", F.transform("at", lambda i: F.get("words", i))).drop("words")
    enough = F.size(F.array_distinct("word")) >= least
    return staged(
        cut.withColumns({"at": F.when(enough, F.col("at")), "word": F.when(enough, F.col("word")),
                         "row": F.monotonically_increasing_id()}),
        "licenses",
    )


def word_order(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The notices' words, rarest in the corpus first (by texts), ties by the word.

    The result has a row per word of the notices, whatever the size of the corpus.
    """
    counted = (
        rows.select(F.explode(F.array_distinct("word")).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    count = {r["word"]: r["n"] for r in counted}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def _best_block(words: Column, length: Column) -> Column:
    """Most different words in one block, and minus the place of the first such block.

    ``words`` are places and words of one notice, in order. The best block may be moved on to
    the first of its words, so only blocks that begin with one are looked at.
    """
    def different(here: Column, i: Column) -> Column:
        inside = F.filter(F.slice(words, i + 1, length), lambda s: s["at"] < here["at"] + length)
        return F.struct(
            F.size(F.array_distinct(F.transform(inside, lambda s: s["word"]))).alias("n"),
            (-here["at"]).alias("back"),
        )

    return F.array_max(F.transform(words, different))


def matched(
    rows: DataFrame, notices: dict[str, tuple[str, ...]] = NOTICES, containment: float = CONTAINMENT,
) -> DataFrame:
    """(row, doc_id, text_key, label, containment, first_word) of rows from ``prepared``."""
    texts = [(label, notice_words(t)) for label, each in notices.items() for t in each]
    order = word_order(rows, sorted({w for _, words in texts for w in words}))
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for label, in_order in texts:
        words = sorted(set(in_order), key=rank.__getitem__)
        needed = needed_words(len(words), containment)
        prefixes += [
            (label, len(in_order), words, needed, word, place)
            for place, word in enumerate(words[: len(words) - needed + 1])
        ]
    index = rows.sparkSession.createDataFrame(
        prefixes, "label string, length int, notice array<string>, needed int, rare string, place int"
    )
    rare = F.array(*map(F.lit, sorted({p[4] for p in prefixes}))).cast("array<string>")
    blocks = (
        rows.filter(F.col("word").isNotNull())
        .select("row", "doc_id", "text_key", "at", "word", F.array_distinct("word").alias("shared"))
        .withColumn("rare", F.explode(F.array_intersect("shared", rare)))
    )
    size = F.size("notice")
    # the first shared word of the notice: earlier ones are not in the text
    first = F.size(F.array_intersect(F.slice("notice", 1, F.col("place")), "shared")) == 0
    of_notice = F.filter(
        F.arrays_zip("at", "word"), lambda s: F.array_contains(F.col("notice"), s["word"])
    )
    return (
        blocks.join(F.broadcast(index), "rare")
        .filter(F.size("shared") >= F.col("needed"))
        .filter(size - F.col("place") >= F.col("needed"))
        .filter(first)
        .filter(F.size(F.array_intersect("shared", "notice")) >= F.col("needed"))
        .withColumn("spots", of_notice)
        .withColumn("best", _best_block(F.col("spots"), F.col("length")))
        .filter(F.col("best.n") >= F.col("needed"))
        .select("row", "doc_id", "text_key", "label", (F.col("best.n") / size).alias("containment"),
                (-F.col("best.back")).cast("long").alias("first_word"))
    )


def matches(
    docs: DataFrame, notices: dict[str, tuple[str, ...]] = NOTICES, containment: float = CONTAINMENT,
) -> DataFrame:
    """(doc_id, text_key, label, containment, first_word) of each text and notice that meet.

    ``first_word`` is where the best block starts, words from 0, the first of equally good ones.
    Null and empty texts meet none; rows that repeat are returned each by itself.
    """
    return matched(prepared(docs, notices, containment, {}), notices, containment).drop("row")


def base_phrases(text: Column) -> dict[str, Column]:
    """Columns on the normal form ``text``: n_words, n_base, first_word, last_word, base_labels."""
    has = F.contains(text, F.lit(" license "))
    # cut at the phrases' common last word; what precedes each cut ends in the phrase's start
    pieces = F.when(has, F.split(text, "(?<= (?:mit|apache|general public) )license(?= )", -1))
    n = F.coalesce(F.size(pieces) - 1, F.lit(0))

    def words(part: Column) -> Column:
        # each word stands behind one space; the part ends with the space before the cut
        return F.char_length(part) - F.char_length(F.replace(part, F.lit(" "), F.lit("")))

    def begin(part: Column, before: Column) -> Column:
        back = F.when(F.endswith(part, F.lit(" general public ")), 2).otherwise(1)
        return before + words(part) - 1 - back

    head = F.get(pieces, F.lit(0))
    last = F.get(pieces, n - 1)
    all_words = words(text) - 1
    tail = F.get(pieces, n)
    return {
        "n_words": F.when(text == "  ", 0).otherwise(all_words).cast("long"),
        "n_base": n.cast("long"),
        "first_word": F.when(n > 0, begin(head, F.lit(0))).cast("long"),
        "last_word": F.when(
            n > 0,
            all_words - words(tail) - F.when(F.endswith(last, F.lit(" general public ")), 2).otherwise(1),
        ).cast("long"),
        "base_labels": F.array_compact(F.array(*(
            F.when(F.contains(text, F.lit(f" {p} ")), label) for p, label in sorted(PHRASES.items(), key=lambda x: x[1])
        ))),
    }


def scan(
    docs: DataFrame, notices: dict[str, tuple[str, ...]] = NOTICES,
    containment: float = CONTAINMENT, names: dict[str, tuple[str, ...]] = NAMES,
) -> DataFrame:
    """One row per document: the base columns, all labels and a score.

    The score is 1 with a base phrase or a name, else the highest containment of a notice in
    a block, else 0. Null and empty texts have no word and no label. Rows that repeat get equal
    results, each by itself; other columns are not looked at; an empty table stays empty.
    """
    rows = prepared(docs, notices, containment, names)
    found = matched(rows, notices, containment).groupBy(F.col("row").alias("_row")).agg(
        F.collect_set("label").alias("_labels"), F.max("containment").alias("_best")
    )
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union(
        F.array_union("base_labels", "named"), F.coalesce("_labels", none)
    ))
    certain = (F.col("n_base") > 0) | (F.size("named") > 0)
    score = F.when(certain, 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))
    return rows.join(found, F.col("row") == F.col("_row"), "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
