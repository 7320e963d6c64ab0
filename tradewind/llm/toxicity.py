"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several
widths, max pooling, trained in numpy.

Words are hashed into buckets, each with a small vector. Filters of one, two and
three words slide over a text; the strongest answer of each filter goes into a logistic
layer. The first coordinate of a vector starts at the bucket's shrunken log-odds
in toxic texts, the others at random; training moves all of them.

Training takes a bounded sample of labelled texts to the driver; scoring is row by row on
the executors. Neither language nor source is an input of the score. ``flagged`` compares the
score to a threshold per language, chosen on held-back training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.text import small_batches, unused

#: Labelled texts that training takes at most, and their size in characters altogether.
SAMPLE = 6_000
SAMPLE_CHARACTERS = 40_000_000
BUCKETS = 1 << 16
#: Words whose bucket a scoring task remembers.
REMEMBERED = 1 << 16
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 3
#: Word positions that are convolved at once; texts of any length pass in such pieces.
PIECE = 1 << 15

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)
)


class Hasher(dict):
    """Bucket of a word; remembers words, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self[word] = xxhash.xxh64_intdigest(word) % BUCKETS
        return bucket

    def codes(self, text: bytes | None) -> np.ndarray:
        words = text.translate(_TABLE).split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class Network:
    embedding: np.ndarray  # buckets x dimensions
    filters: dict[int, np.ndarray]  # width -> (width, dimensions, filters)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def tables(self) -> dict[int, np.ndarray]:
        """Answers of each filter row to each bucket, so that scoring only adds."""
        return {
            w: np.einsum("bd,wdf->wbf", self.embedding, k).astype(np.float32)
            for w, k in self.filters.items()
        }

    def pooled(self, codes: np.ndarray, tables: dict[int, np.ndarray]) -> tuple[np.ndarray, list]:
        """Strongest answer of each filter in the whole text, and where it is."""
        values, places = [], []
        for width in self.filters:
            best = np.zeros(FILTERS, np.float32)
            where = np.full(FILTERS, -1)
            for start in range(0, len(codes) - width + 1, PIECE):
                stop = min(start + PIECE, len(codes) - width + 1)
                answer = tables[width][0][codes[start:stop]]
                for j in range(1, width):
                    answer = answer + tables[width][j][codes[start + j:stop + j]]
                answer = answer + self.bias[width]
                top = answer.argmax(axis=0)
                value = answer[top, np.arange(FILTERS)]
                better = value > best
                best[better], where[better] = value[better], top[better] + start
            values.append(best)
            places.append(where)
        return np.concatenate(values), places

    def score(self, codes: np.ndarray, tables: dict[int, np.ndarray]) -> float:
        z = float(self.pooled(codes, tables)[0] @ self.out + self.out_bias)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def log_odds(codes: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """How much likelier a bucket is in toxic texts, by texts, in standard errors."""
    seen = np.zeros((2, BUCKETS))
    for c, y in zip(codes, labels):
        seen[int(y), np.unique(c)] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None]
    p = (seen + 0.5) / (n + 1)
    odds = np.log(p[1] / (1 - p[1])) - np.log(p[0] / (1 - p[0]))
    error = np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    return np.clip(odds / error / 3, -2, 2)


def train(
    codes: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 7
) -> Network:
    """Adagrad on the log loss, one text at a time; only the strongest places get a gradient."""
    random = np.random.default_rng(seed)
    labels = np.asarray(labels)
    embedding = random.normal(0, 0.02, (BUCKETS, DIMENSIONS))
    if len(codes):
        embedding[:, 0] = log_odds(codes, labels)
    filters = {w: random.normal(0, 0.1, (w, DIMENSIONS, FILTERS)) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][:, 0, :] = 1.0 / w  # every filter starts by weighing the log-odds
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.99))
    network = Network(
        embedding, filters, {w: np.full(FILTERS, -0.5) for w in WIDTHS},
        np.full(FILTERS * len(WIDTHS), 4.0 / (FILTERS * len(WIDTHS))), float(np.log(share / (1 - share))),
    )
    if len(set(labels.tolist())) < 2:
        network.out[:] = 0  # nothing to tell apart: the share of toxic texts for all
        return network
    past = {id(a): np.full_like(a, 1e-2) for a in (
        network.embedding, network.out, *network.filters.values(), *network.bias.values())}
    past_bias = 1e-2

    def step(array: np.ndarray, at, gradient: np.ndarray) -> None:
        memory = past[id(array)]
        memory[at] += gradient ** 2
        array[at] -= rate * gradient / np.sqrt(memory[at])

    every = slice(None)
    for _ in range(epochs):
        for i in random.permutation(len(codes)):
            text = codes[i]
            near = np.unique(text)
            place = np.searchsorted(near, text)
            small = {w: np.einsum("bd,wdf->wbf", network.embedding[near], k)
                     for w, k in network.filters.items()}
            values, places = network.pooled(place, small)
            z = float(values @ network.out + network.out_bias)
            wrong = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            back = wrong * network.out
            step(network.out, every, wrong * values + 1e-4 * network.out)
            past_bias += wrong ** 2
            network.out_bias -= rate * wrong / np.sqrt(past_bias)
            for n, (width, kernel) in enumerate(network.filters.items()):
                where = places[n]
                live = np.flatnonzero(where >= 0)
                if not len(live):
                    continue
                gradient = back[n * FILTERS + live]
                at = where[live]
                kernel_step = np.zeros_like(kernel)
                for j in range(width):
                    bucket = text[at + j]
                    kernel_step[j][:, live] += network.embedding[bucket].T * gradient
                    for b, g, f in zip(bucket, gradient, live):
                        step(network.embedding, b, g * kernel[j][:, f])
                step(kernel, every, kernel_step)
                bias_step = np.zeros(FILTERS)
                bias_step[live] = gradient
                step(network.bias[width], every, bias_step)
    return network


def calibrated(
    scores: np.ndarray, labels: np.ndarray, languages: list[str | None], least: int = 20
) -> dict[str | None, float]:
    """Per language the threshold with the best F1; 0.5 where few toxic texts are known."""
    out: dict[str | None, float] = {}
    for language in sorted(set(languages), key=str):
        chosen = np.array([x == language for x in languages])
        s, y = scores[chosen], labels[chosen]
        if y.sum() < least:
            continue
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
        best = int(f1.argmax())
        after = s[order][best + 1] if best + 1 < len(s) else 0.0
        out[language] = float((s[order][best] + after) / 2)
    return out


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network trained on labelled rows that are not held out.

    At most ``sample`` of them and SAMPLE_CHARACTERS of text, first by hash of the id,
    come to the driver. One in five of these is kept back for the thresholds. Null
    labels and texts are left out; a doc_id labelled twice counts once, as toxic if either is,
    and of several texts under one doc_id the first in order is taken.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    has_lang = "lang" in docs.columns
    rows = docs.select(
        "doc_id", "text", (F.col("lang") if has_lang else F.lit(None).cast("string")).alias("lang")
    ).filter("text IS NOT NULL").join(F.broadcast(first), "doc_id")
    share = max(SAMPLE_CHARACTERS // max(sample, 1), 1)
    # a text over its share is left out, so that the sample has a bound; scoring takes all texts
    picked = rows.filter(F.char_length("text") <= 4 * share).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min(F.struct("text", "lang")).alias("one")
    ).select("doc_id", "toxic", "one.text", "one.lang").collect()
    picked.sort(key=lambda r: r["doc_id"])
    hasher = Hasher()
    codes = [hasher.codes(r["text"].encode()) for r in picked]
    y = np.array([r["toxic"] for r in picked], dtype=np.int64)
    back = np.array([r["doc_id"] % 5 == 1 for r in picked], dtype=bool)
    network = train([c for c, b in zip(codes, back) if not b], y[~back])
    tables = network.tables()
    scores = np.array([network.score(c, tables) for c, b in zip(codes, back) if b])
    if len(scores):
        network.thresholds = calibrated(
            scores, y[back], [r["lang"] for r, b in zip(picked, back) if b]
        )
    return network


def score_column(spark, network: Network):
    """A column function: text to score, piece by piece of any length, row by row."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, tables = Hasher(), sent.value.tables()
        for texts in batches:
            yield pa.array(
                [sent.value.score(hasher.codes(t.as_py()), tables) for t in texts.cast(pa.binary())],
                pa.float64(),
            )

    return scored


def with_scores(docs: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 by the text alone; null and empty texts get one too.

    Every row is scored by itself: rows that repeat get equal scores, no row moves, an empty
    table stays empty.
    """
    return docs.withColumn(name, score_column(docs.sparkSession, network)("text"))


def flagged(network: Network, score: str = "score", language: str | None = "lang") -> F.Column:
    """Whether the score reaches the threshold of the row's language, or else 0.5."""
    threshold = F.lit(0.5)
    for name, value in network.thresholds.items():
        if name is not None and language is not None:
            threshold = F.when(F.col(language) == name, value).otherwise(threshold)
    return F.col(score) >= threshold


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that score under the threshold of their language; the columns stay.

    0.5 holds for languages without a threshold, and for all documents without ``lang``.
    """
    network = learn(docs, labels, sample)
    language = "lang" if "lang" in docs.columns else None
    score = unused("toxicity", docs)
    scored = with_scores(docs, network, score)
    return scored.filter(~flagged(network, score, language)).drop(score)
