"""Personal data: fixed patterns, then contextual patterns learnt from what those find.

Whole spans found by the fixed patterns are the seed entities. The words beside them are lexical
patterns: the word to the left, the two words to the left, the words on both sides. A pattern says
nothing of what stands between, so it also meets identifiers of a form that no fixed pattern
knows: runs of one to four words with digits or an at sign. Entities and patterns form a
graph. Rounds of scoring go back and forth: a pattern is trusted by the share of its
entities that are seeds or trusted themselves, an entity by the best pattern it occurs with.
What patterns trusted in the end stand beside is personal data of the kind that the seeds of
its patterns have; the form of the entity (signs and numbers of digits, compared with the
forms of seeds) only weighs in where a pattern has seeds of several kinds.

Everything is built from DataFrame functions. The fixed patterns work inside a row; only
entities and their patterns are shuffled, and counted before they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.text import row_key, staged, whole

KINDS = ("email", "ip", "card", "phone")

# The patterns of the four kinds. Possessive repeats find the same spans as
# plain ones here, since what follows cannot begin inside them; they need no stack. A local
# part starts at its first character or behind the last match, never inside itself; an
# address never starts inside a number, so long runs of digits are passed once.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
IP_IN_RANGE = rf"\A{_PART}(?:\.{_PART}){{3}}\z"
#: Cheap signs without which a pattern cannot match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

_SPACE = r"\x20\x09-\x0D"
#: One to four words in a row, each with a digit or an at sign, which may be spelt out.
AT = r"@|[\[(]at[\])]"
_WORD = rf"(?=[^{_SPACE}]*?(?:[0-9]|{AT}))[^{_SPACE}]++"
RUN = rf"(?<![^{_SPACE}]){_WORD}(?:\x20{_WORD}){{0,3}}+"
#: Signs around a run that are not part of it; brackets are if their other half is.
EDGE = "\"'{}<>,;:.!?=#*&%$|"
#: What a learnt entity has at least: so many characters, and an at sign or so many digits.
LENGTH, DIGITS = 5, 3

ROUNDS = 3
#: A pattern is trusted at this share of known entities, with at least so many different seeds.
TRUST, SUPPORT = 0.6, 5
#: How much a kind counts whose seeds never have the form of the entity, against one whose all do.
FORM_FLOOR = 0.25
#: Characters beside a span that are looked at.
CONTEXT = 80

SPANS = "array<struct<start:int,end:int,value:string>>"
CHUNK = 512


def _placed(pair: str) -> Column:
    """Spans (start, end, value) in code points, from a column of matches and gaps.

    The text between matches gives their places, inside the row. Places add up in chunks,
    so a text with very many matches stays fast.
    """
    return F.expr(f"""
        CASE WHEN {pair}.g IS NULL THEN cast(array() AS {SPANS}) ELSE
        aggregate(
          sequence(0, (size({pair}.f) - 1) div {CHUNK}),
          named_struct('at', 0, 'out', cast(array() AS array<{SPANS}>)),
          (a, c) -> aggregate(
            sequence(c * {CHUNK} + 1, least(size({pair}.f), (c + 1) * {CHUNK})),
            named_struct('at', a.at, 'one', cast(array() AS {SPANS})),
            (b, i) -> named_struct(
              'at', b.at + char_length({pair}.g[i - 1]) + char_length({pair}.f[i - 1]),
              'one', concat(b.one, array(named_struct(
                'start', b.at + char_length({pair}.g[i - 1]),
                'end', b.at + char_length({pair}.g[i - 1]) + char_length({pair}.f[i - 1]),
                'value', {pair}.f[i - 1])))),
            b -> named_struct('at', b.at, 'out', concat(a.out, array(b.one)))),
          a -> flatten(a.out)) END""")


def _pair(text: str, pattern: str, hint: Column, name: str, df: DataFrame) -> DataFrame:
    """``df`` with ``name``: the matches and the gaps between them, nulls without a match."""
    found = F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(f"{name}_f", found)
    gaps = F.when(F.size(f"{name}_f") > 0, F.split(text, pattern, -1))
    return df.withColumn(
        name, F.struct(F.col(f"{name}_f").alias("f"), gaps.alias("g"))
    ).drop(f"{name}_f")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    n = F.char_length(number)

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def _accept(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(IP_IN_RANGE))
    number = digits(value)
    if kind == "card":
        return F.when(F.char_length(number).between(13, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.char_length(number).between(9, 15)
    return F.lit(True)


def _patterns(gaps: Column, i: Column) -> Column:
    """Lexical patterns of the span between the gaps ``i`` and ``i + 1``; numbers count as zero."""
    def words(text: Column) -> Column:
        return F.regexp_replace(F.lower(text), "[0-9]+", "0")

    left = words(F.right(F.get(gaps, i), F.lit(CONTEXT)))
    right = words(F.left(F.get(gaps, i + 1), F.lit(CONTEXT)))
    one = F.regexp_extract(left, rf"([^{_SPACE}]+)[{_SPACE}]*\z", 1)
    two = F.regexp_extract(left, rf"([^{_SPACE}]+[{_SPACE}]+[^{_SPACE}]+)[{_SPACE}]*\z", 1)
    after = F.regexp_extract(right, rf"\A[{_SPACE}]*([^{_SPACE}]+)", 1)
    return F.array_compact(F.array(
        F.when(one != "", F.concat(F.lit("1 "), one)),
        F.when(two != "", F.concat(F.lit("2 "), F.regexp_replace(two, rf"[{_SPACE}]+", " "))),
        F.when(one != "", F.concat(F.lit("b "), one, F.lit(" _ "), after)),
    ))


def _spans(pair: str) -> Column:
    """The spans of ``pair``, each with its patterns."""
    gaps = F.col(pair)["g"]
    return F.transform(_placed(pair), lambda s, i: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        _patterns(gaps, i).alias("patterns"),
    ))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text, email, ip, card, phone): accepted spans of each kind."""
    rows = docs.select("doc_id", row_key().alias("text_key"), whole("text").alias("text"))
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    for kind, pattern in patterns.items():
        hint = (
            F.contains("text", F.lit("@")) if kind == "email"
            else F.rlike("text", F.lit(HINTS[kind]))
        )
        rows = _pair("text", pattern, hint, f"_{kind}", rows)
    return rows.select("doc_id", "text_key", "text", *(
        _accepted(kind).alias(kind) for kind in KINDS
    ))


def _accepted(kind: str) -> Column:
    return F.filter(_spans(f"_{kind}"), lambda s: _accept(kind, s["value"]))


def _overlaps(spans: str, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (s["end"] > start))


def _candidates(rows: DataFrame) -> DataFrame:
    """``rows`` with ``runs``: what looks like an identifier and touches no fixed span."""
    rows = _pair("text", RUN, F.rlike("text", F.lit(rf"[0-9]|{AT}")), "_run", rows)

    def trimmed(s: Column) -> Column:
        def edge(opening: str, closing: str) -> Column:
            other = F.concat(*(
                F.when(F.contains(s["value"], F.lit(there)), "").otherwise(sign)
                for sign, there in ((opening[0], closing[0]), (opening[1], closing[1]))
            ))
            return F.concat(F.lit(EDGE), other)

        inner = F.ltrim(s["value"], edge("([", ")]"))
        start = s["start"] + F.char_length(s["value"]) - F.char_length(inner)
        value = F.rtrim(inner, edge(")]", "(["))
        wrapped = F.rlike(value, F.lit(r"\A[(\[][^()\[\]]*[)\]]\z")).cast("int")
        value = F.substring(value, wrapped + 1, F.char_length(value) - 2 * wrapped)
        start = start + wrapped
        return F.struct(
            start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"),
            s["patterns"].alias("patterns"),
        )

    def wanted(s: Column) -> Column:
        marked = F.rlike(s["value"], F.lit(AT)) | (F.char_length(digits(s["value"])) >= DIGITS)
        known = (_overlaps(k, s["start"], s["end"]) for k in KINDS)
        return (F.char_length(s["value"]) >= LENGTH) & marked & ~reduce(Column.__or__, known)

    return rows.withColumn("runs", F.filter(F.transform(_spans("_run"), trimmed), wanted))


def form(value: Column) -> Column:
    """The form of an entity: an at sign, or groups of digits up to five and about how many digits."""
    count = F.char_length(digits(value))
    groups = F.least(F.regexp_count(value, F.lit("[0-9]+")), F.lit(5))
    size = F.when(count < 7, "few").when(count < 13, "some").otherwise("many")
    return F.when(F.rlike(value, F.lit(AT)), "@").otherwise(F.concat(groups.cast("string"), size))


def _shares(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Per ``key``: the share of each kind among its seeds."""
    seeds = F.count("seed")
    return rows.groupBy(key).agg(*(
        F.coalesce(F.round(F.count_if(F.col("seed") == k) / F.nullif(seeds, F.lit(0)), 6), F.lit(0.0))
        .alias(f"{prefix}_{k}") for k in KINDS
    ))


def trusted_patterns(
    edges: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT
) -> DataFrame:
    """(pattern, trust, kind_email, ...) of the patterns that are trusted after ``rounds`` rounds.

    ``edges`` has a row per pattern and value, with its kind as ``seed`` or null.
    """
    seeded = edges.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("entities"), F.count("seed").alias("seeds")
    ).filter(F.col("seeds") >= support)
    seeded = staged(seeded, "pii-seeded")
    open_edges = edges.filter("seed IS NULL").join(seeded.select("pattern"), "pattern")
    open_edges = staged(open_edges.select("pattern", "value"), "pii-open")
    known = seeded.withColumn("known", F.col("seeds").cast("double"))
    patterns = None
    for _ in range(rounds):
        patterns = staged(known.select(
            "pattern", "entities", "seeds", F.round(F.col("known") / F.col("entities"), 6).alias("trust")
        ), "pii-patterns")
        scores = open_edges.join(patterns, "pattern").groupBy("value").agg(
            F.max("trust").alias("score")
        ).filter(F.col("score") >= trust)
        gained = open_edges.join(scores, "value").groupBy("pattern").agg(
            F.round(F.sum("score"), 6).alias("gained")
        )
        known = patterns.join(gained, "pattern", "left").withColumn(
            "known", F.col("seeds") + F.coalesce("gained", F.lit(0.0))
        )
    good = patterns.filter(F.col("trust") >= trust).select("pattern", "trust")
    kinds = _shares(edges.filter("seed IS NOT NULL").join(good, "pattern", "left_semi"), "pattern", "kind")
    return good.join(kinds, "pattern")


def discovered(rows: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """(doc_id, text_key, learnt): spans beside a trusted pattern, by row."""
    def entities(column: str, seed: Column) -> DataFrame:
        found = rows.select("doc_id", "text_key", F.explode(column).alias("s"))
        return found.select("doc_id", "text_key", seed.alias("seed"), "s.*")

    seeds = reduce(DataFrame.unionByName, (entities(k, F.lit(k)) for k in KINDS))
    runs = entities("runs", F.lit(None).cast("string"))
    of_pattern = seeds.unionByName(runs).select(
        F.explode("patterns").alias("pattern"), "value", "seed"
    )
    edges = staged(
        of_pattern.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges"
    )
    patterns = staged(trusted_patterns(edges, rounds, trust, support), "pii-trusted")
    forms = _shares(seeds.select(form(F.col("value")).alias("form"), "seed"), "form", "form")
    place = ("doc_id", "text_key", "start", "end", "value")
    beside = runs.select(*place, F.explode("patterns").alias("pattern")).join(patterns, "pattern")
    weighed = beside.groupBy(*place).agg(*(
        F.round(F.sum(F.col("trust") * F.col(f"kind_{k}")), 6).alias(f"kind_{k}") for k in KINDS
    )).withColumn("form", form(F.col("value"))).join(forms, "form", "left")
    best = F.greatest(*(
        F.struct(
            (F.col(f"kind_{k}") * (F.lit(FORM_FLOOR) + F.coalesce(f"form_{k}", F.lit(0.0)))).alias("score"),
            F.lit(k).alias("kind"),
        ) for k in KINDS
    ))
    return weighed.select(
        F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_key"), best["kind"].alias("kind"),
        "start", "end",
    ).groupBy("_doc_id", "_key").agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("learnt")
    )


def scan(docs: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """(doc_id, email, ip, card, phone, learnt) of every row; spans in code points.

    Null and empty texts have no span. A learnt span never touches a fixed one. Rows that
    repeat get equal spans; documents are told apart by id and text; other columns are not
    looked at; an empty table stays empty.
    """
    rows = _candidates(base_spans(docs)).select("doc_id", "text_key", *KINDS, "runs")
    rows = staged(rows, "pii-rows")
    learnt = discovered(rows, rounds, trust, support)
    joined = rows.join(
        learnt,
        F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_key")), "left",
    )
    none = F.expr("cast(array() AS array<struct<kind:string,start:int,end:int>>)")
    return joined.select("doc_id", *KINDS, F.coalesce("learnt", none).alias("learnt"))


def summary(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the fixed spans, and all spans as text."""

    def written(kind: str, spans) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    def all_of(kind: str) -> Column:
        fixed = F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        new = F.transform(
            F.filter("learnt", lambda s: s["kind"] == kind),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
        )
        return F.array_sort(F.concat(fixed, new))

    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.concat(*(written(k, F.col(k)) for k in KINDS)), ","), 256)
        .alias("base_sha256"),
        F.array_join(F.concat(*(written(k, all_of(k)) for k in KINDS)), ",").alias("spans"),
    )
