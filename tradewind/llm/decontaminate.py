"""Benchmark passages in documents, by a generalised suffix automaton of the test items.

The items' words become numbers and one automaton holds all items, so that a match
never runs from one item into the next. A document's words stream through it while the
length of the longest match that ends at each word is kept. Where that length reaches the
window, the last ``window`` words are a passage of some item.

Different items are dealt to automata of about ``MAX_WORDS`` words, longer ones in pieces that
overlap by all but one word of a window, so what is collected, built and sent has a fixed bound. One
automaton lives at a time: the documents pass the first, are written, pass the next.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.prefix import sum_before
from tradewind.llm.text import lower_ascii, small_batches, staged, unused

WINDOW = 10
#: Words of items in one automaton; an automaton is some 100 bytes a word.
MAX_WORDS = 200_000

#: Everything but digits, letters and characters beyond ASCII becomes a space.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words; all characters beyond ASCII are parts of words."""
    return text.translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, over numbered words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            codes = [self.number.setdefault(w, len(self.number)) for w in words]
            coded.append((item, codes))
            last = 0
            for code in codes:
                last = self._extend(last, code)
        #: By state and length: items with that passage, of ``window`` words or a whole item.
        self.items: dict[tuple[int, int], set[str]] = {}
        #: By state: lengths of whole short items that are suffixes there.
        self.short: dict[int, set[int]] = {}
        self.least = min((min(len(c), window) for _, c in coded if c), default=window)
        for item, codes in coded:
            if not codes:
                continue
            wanted, state, length = min(len(codes), window), 0, 0
            for code in codes:
                state, length = self.next[state][code], length + 1
                if length >= wanted:
                    self.items.setdefault((self.at(state, wanted), wanted), set()).add(item)
            if wanted < window:
                self.short.setdefault(self.at(state, wanted), set()).add(wanted)

    def _extend(self, last: int, code: int) -> int:
        there = self.next[last].get(code)
        if there is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            return self._clone(last, code, there)
        state = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and code not in self.next[at]:
            self.next[at][code] = state
            at = self.link[at]
        if at >= 0:
            there = self.next[at][code]
            exact = self.length[there] == self.length[at] + 1
            self.link[state] = there if exact else self._clone(at, code, there)
        return state

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, at: int, code: int, there: int) -> int:
        clone = self._state(dict(self.next[there]), self.length[at] + 1, self.link[there])
        self.link[there] = clone
        while at >= 0 and self.next[at].get(code) == there:
            self.next[at][code] = clone
            at = self.link[at]
        return clone

    def at(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` words of what ``state`` stands for."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans (start, end) covered by windows, merged, and the items that occur."""
        codes = np.fromiter(
            map(self.number.get, words, iter(lambda: -1, 0)), np.int64, len(words)
        )
        known = np.concatenate(([False], codes >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= self.least:
                self._stream(codes[start:end].tolist(), start, spans, items)
        return spans, items

    def _stream(self, codes, offset, spans, items) -> None:
        state = length = 0
        for i, code in enumerate(codes, offset + 1):
            while state and code not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if code in self.next[state]:
                state, length = self.next[state][code], length + 1
            for reached in self._reached(state, length):
                items |= self.items[reached]
                self._cover(spans, i - reached[1], i)

    def _reached(self, state: int, length: int) -> list[tuple[int, int]]:
        """(state, length) of the window and the whole short items that end here."""
        found = []
        if length >= self.window:
            found.append((self.at(state, self.window), self.window))
        if self.short:
            while state > 0:
                found += [(state, w) for w in self.short.get(state, ()) if w <= length]
                state = self.link[state]
                length = min(length, self.length[state])
        return found

    @staticmethod
    def _cover(spans: list[tuple[int, int]], start: int, end: int) -> None:
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append((start, end))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_parts(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """(part, item_id, text): different items, or pieces of them, at most ``2 * max_words`` words a part.

    Items without words, and null texts, take no part. Items that share an id count as
    one in the list of items; each of their texts is matched by itself.
    """
    if max_words < window:
        raise ValueError("an automaton holds a window at least")
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(_WORD.pattern), F.lit(0))
    items = benchmark.filter("text IS NOT NULL").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("words")
    ).filter(F.size("words") > 0).distinct()
    last = F.greatest(F.size("words") - window, F.lit(0))
    pieces = items.select(
        "item_id", "words", F.explode(F.sequence(F.lit(0), last, F.lit(max_words - window + 1))).alias("at")
    ).select("item_id", F.slice("words", F.col("at") + 1, max_words).alias("words"))
    place = F.xxhash64("item_id", "words")
    placed = staged(pieces.select(
        "item_id", F.array_join("words", " ").alias("text"), F.size("words").cast("long").alias("size"),
        place.alias("place"), F.shiftright(place, 54).alias("bucket"), F.lit(0).alias("all"),
    ), "benchmark")
    ordered = sum_before(placed, "all", "bucket", ["place", "item_id", "text"], "size", "before")
    return staged(ordered.select(
        F.floor(F.col("before") / max_words).alias("part"), "item_id", "text"
    ), "benchmark-parts")


FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _pass(docs: DataFrame, automaton, found: str) -> DataFrame:
    """One automaton over the rows: adds to the spans and items found so far."""
    schema = docs.select("*").schema
    names = docs.columns
    text, column = names.index("text"), names.index(found)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            values = []
            before = batch.column(column).to_pylist()
            for cell, old in zip(batch.column(text).cast(pa.binary()), before):
                words = words_of(cell.as_py())
                spans, items = automaton.value.hits(words) if words else ([], set())
                if old["spans"]:
                    spans = merged(spans + [(s["start"], s["end"]) for s in old["spans"]])
                values.append({
                    "n_words": len(words),
                    "spans": [{"start": a, "end": b} for a, b in spans],
                    "items": sorted(items | set(old["items"])),
                })
            arrays = list(batch.columns)
            arrays[column] = pa.array(values, batch.schema.field(column).type)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(batches, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    found: str = "contamination", max_words: int = MAX_WORDS,
) -> DataFrame:
    """``docs`` with a struct ``found``: n_words, merged word spans hit, item ids (sorted).

    A window is ``window`` consecutive words of one item, or a shorter item as a whole.
    A null or empty text has no words and no hit. Rows that repeat and ties are
    treated each by themselves; without items nothing is hit; an empty table stays empty.
    """
    empty = F.expr(
        "named_struct('n_words', 0L, 'spans', cast(array() AS array<struct<start:int,end:int>>),"
        " 'items', cast(array() AS array<string>))"
    )
    small_batches(docs.sparkSession)
    marked = docs.withColumn(found, empty)
    parts = item_parts(benchmark, window, max_words)
    numbers = sorted(r[0] for r in parts.select("part").distinct().collect())
    for turn, number in enumerate(numbers or [None]):
        rows = parts.filter(F.col("part") == number).collect() if numbers else []
        items = [(r["item_id"], words_of(r["text"].encode())) for r in rows]
        sent = docs.sparkSession.sparkContext.broadcast(Automaton(items, window))
        marked = _pass(marked, sent, found)
        if turn < len(numbers) - 1:
            marked = staged(marked, "decontamination")
            sent.destroy()
    return marked


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; each span leaves one space."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:places[start][0]])
        at = places[end - 1][1]
    return " ".join([*(k.rstrip() for k in kept), text[at:].lstrip()]).strip()


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    max_span: int = 0, max_coverage: float = 0.5,
) -> DataFrame:
    """The documents without benchmark passages; the columns stay, ``n_chars`` follows.

    A span of more than ``max_span`` words is removed from its text; a document of
    whose words more than ``max_coverage`` are in such spans goes altogether. Texts are taken
    whole; null texts stay; columns of any name stay as they are.
    """
    found, spans = unused("contamination", docs), unused("spans", docs)
    marked = contamination(docs, benchmark, window, found)
    long_spans = F.filter(
        F.col(found)["spans"], lambda s: s["end"] - s["start"] > max_span
    )
    marked = marked.withColumn(spans, long_spans)
    hit = F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"])
    marked = marked.filter(hit <= F.col(found)["n_words"] * max_coverage)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else cut(t, [(x["start"], x["end"]) for x in s])
            for t, s in zip(texts, places)
        ], dtype=object)

    touched = F.size(spans) > 0  # only those texts go to Python once more
    cleaned = clean(F.when(touched, F.col("text")), F.when(touched, F.col(spans)))
    marked = marked.withColumn("text", F.when(touched, cleaned).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        marked = marked.withColumn("n_chars", F.when(touched, length).otherwise(F.col("n_chars")))
    return marked.select(*docs.columns)
