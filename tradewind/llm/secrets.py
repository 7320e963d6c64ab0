"""Secrets in texts: keywords first, anchored patterns where one is, checksums last.

One Aho-Corasick automaton finds all keywords of a text in one pass. Only there is a
pattern tried, anchored at the keyword. Tokens that carry a checksum of themselves are
kept only if it holds. Hexadecimal runs have no keyword; they are found by their own pattern.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
#: Base kinds, then the kinds that the method adds.
KINDS = (*BASE, "github", "npm", "xprv")

# The patterns of the base kinds and the shapes of public token formats.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_GITHUB = re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
_XPRV = re.compile(r"[xt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_holds(token: str) -> bool:
    """The last six characters are the CRC-32 of the random part, in base 62."""
    body, check = token[4:-6], token[-6:]
    value = 0
    for c in check:
        value = value * 62 + _BASE62.index(c)
    return value == zlib.crc32(body.encode())


def base58_holds(token: str) -> bool:
    """The last four bytes are the start of the double SHA-256 of the others."""
    value = 0
    for c in token:
        value = value * 58 + _BASE58.index(c)
    raw = value.to_bytes(82, "big") if value < 1 << 656 else b""
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:] != b""


@dataclass(frozen=True)
class Rule:
    kind: str
    keywords: tuple[str, ...]  # lower case
    pattern: re.Pattern
    accept: Callable[[re.Match], bool]


RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"), _ASSIGN,
         lambda m: len(m[2]) >= 8),
    Rule("access", ("akia",), _ACCESS, lambda m: len(m[0]) >= 16),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _GITHUB, lambda m: crc_holds(m[0])),
    Rule("npm", ("npm_",), _NPM, lambda m: crc_holds(m[0])),
    Rule("xprv", ("xprv", "tprv"), _XPRV, lambda m: base58_holds(m[0])),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.keywords = ahocorasick.Automaton()
        for number, rule in enumerate(rules):
            for word in rule.keywords:
                self.keywords.add_word(word, (number, len(word)))
        self.keywords.make_automaton()

    def spans(self, raw: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by kind as listed, then by start."""
        text = raw.decode()
        hits: dict[int, list[int]] = {}
        for last, (number, length) in self.keywords.iter(raw.lower().decode()):
            hits.setdefault(number, []).append(last - length + 1)
        found = []
        for number, starts in hits.items():
            rule, end = self.rules[number], 0
            for start in sorted(starts):
                if start >= end and (m := rule.pattern.match(text, start)):
                    end = m.end()
                    if rule.accept(m):
                        found.append((rule.kind, start, end))
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row: structs of kind, start, end, by start, then by kind.

    A null or empty text has no span. Rows that repeat are scanned each by itself, other
    columns are not looked at, an empty table stays empty. Rows are independent,
    so no row moves.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int>>"

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        type_ = pa.list_(pa.struct(
            [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
        ))
        for part in parts:
            values = [
                [dict(zip(("kind", "start", "end"), s)) for s in scanner.spans(t.as_py() or b"")]
                for t in part.column(1).cast(pa.binary())
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(values, type_)], ["doc_id", "spans"]
            )

    return rows.mapInArrow(batches, f"doc_id {kind}, spans {spans}")


def summary(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""

    def written(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *(
            F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE
        ),
        F.sha2(written(of(*BASE)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
