"""Allow or block URLs: rules first, boosted trees on lexical features for the rest.

URLs that a rule decides are the labelled ones. Gradient-boosted trees learn from a
bounded sample of them how allowed and blocked URLs look, and judge the others. All
features are built-in expressions on the URL; suffix statistics are counted over all pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.text import lower_ascii, staged, whole

ALLOW, BLOCK = "allow", "block"
#: Labelled URLs that the trees learn from, at most.
SAMPLE = 20_000
TREES, DEPTH = 20, 4


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


RULES = (
    Rule("org", "/", ALLOW),
    Rule("example.org", "/es/", BLOCK),
    Rule("example.org", "/en/1", BLOCK),
    Rule("com", "/fr/", ALLOW),
    Rule("com", "/de/", BLOCK),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.char_length(url))
    authority = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(
        F.substring(rest, F.char_length(authority) + 1, F.char_length(rest)), r"\A[^?#]*", 0
    )
    known = F.coalesce(at > 0, F.lit(False))
    return (
        F.when(known, lower_ascii(authority)).otherwise(""),
        F.when(known, path).otherwise(""),
    )


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = (
            (host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))
        ) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, rule.host + rule.path).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.char_length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    characters = F.split(text, "")
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    each = F.transform(
        F.array_distinct(characters),
        lambda c: (F.size(characters) - F.size(F.array_remove(characters, c))) / n,
    )
    return F.when(F.char_length(text) == 0, 0.0).otherwise(
        F.aggregate(each, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    )


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def features() -> dict[str, Column]:
    """Lexical features of the columns url, host and path."""
    return {
        "url_length": F.char_length("url"),
        "host_length": F.char_length("host"),
        "path_length": F.char_length("path"),
        "labels": F.size(F.split("host", r"\.")),
        "depth": F.regexp_count("path", F.lit("/[^/]")),
        "digit_share": _share(F.col("url"), "[0-9]"),
        "host_digit_share": _share(F.col("host"), "[0-9]"),
        "symbol_share": _share(F.col("url"), "[^A-Za-z0-9/.:]"),
        "hyphens": F.regexp_count("host", F.lit("-")),
        "host_entropy": _entropy(F.col("host")),
        "path_entropy": _entropy(F.col("path")),
        "parameters": F.regexp_count("url", F.lit("[?&][^=&#]*=")),
        "fragment": F.contains("url", F.lit("#")).cast("int"),
        "secure": F.startswith("url", F.lit("https://")).cast("int"),
        "longest_label": F.coalesce(
            F.array_max(F.transform(F.split("host", r"\."), lambda x: F.char_length(x))), F.lit(0)
        ),
        "vowel_share": _share(F.col("host"), "[aeiou]"),
        # the first segment of the path often names a language or section
        "segment_length": F.char_length(F.regexp_extract("path", r"\A/([^/]*)", 1)),
        "segment_first": F.ascii(F.regexp_extract("path", r"\A/([^/]*)", 1)),
        "segment_last": F.ascii(F.reverse(F.regexp_extract("path", r"\A/([^/]*)", 1))),
    }


SUFFIX_FEATURES = ("suffix_share", "suffix_mean_length")


def with_features(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, ruled (its verdict) and the features of every row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").alias("raw"), host.alias("host"), path.alias("path"))
    rule, ruled = matching_rule(F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"),
                       whole("raw").alias("url"))
    rows = staged(rows.select(
        "page_id", "host", "path", "rule", "ruled", "url", _suffix(F.col("host")).alias("suffix"),
        *(c.cast("double").alias(n) for n, c in features().items()),
    ), "url-features")
    # one row per suffix; combined before the shuffle, so a hot suffix is one row a task
    by_suffix = rows.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("url")).alias("characters")
    )
    total = rows.count()
    by_suffix = by_suffix.select(
        "suffix", (F.col("n") / F.lit(float(max(total, 1)))).alias("suffix_share"),
        (F.col("characters") / F.col("n")).alias("suffix_mean_length"),
    )
    return rows.join(by_suffix, "suffix").drop("suffix")


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH):
    """Boosted trees on the ``sample`` different labelled URLs that come first by hash, or a constant.

    A URL counts once, so one that fills a third of all rows leaves room for the others. Fewer than two kinds of labels leave nothing to learn: then the model is the
    one verdict there is, or allow.
    """
    # the URLs alone are made different first; equal URLs have equal features
    first = labelled.select("url").distinct().orderBy(F.xxhash64("url"), "url").limit(sample)
    chosen = labelled.join(first, "url", "left_semi").dropDuplicates(["url"])
    chosen = staged(
        chosen.withColumn("label", (F.col("ruled") == BLOCK).cast("double"))
        .orderBy(F.xxhash64("url"), "url"), "url-sample"
    )
    kinds = [r["ruled"] for r in chosen.select("ruled").distinct().collect()]
    if len(kinds) < 2:
        return kinds[0] if kinds else ALLOW
    classifier = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth,
        maxBins=64, stepSize=0.2, seed=7, cacheNodeIds=False,
    )
    return classifier.fit(_assembled(chosen))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(
        inputCols=[*features(), *SUFFIX_FEATURES], outputCol="features", handleInvalid="keep"
    ).transform(rows)


def block_score(rows: DataFrame, model) -> DataFrame:
    """``rows`` with ``score``, how likely the trees would block the URL."""
    if isinstance(model, str):
        return rows.withColumn("score", F.lit(float(model == BLOCK)))
    scored = model.transform(_assembled(rows))
    return scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))


def held_out_quality(pages: DataFrame, sample: int = SAMPLE, folds: int = 5) -> DataFrame:
    """(ruled, urls, right): what the trees make of URLs that rules decide but they never saw.

    One fold of the different URLs, by hash, is kept from the training; it is counted by the
    verdict of its rules, ``right`` are those to which the trees give the same one.
    """
    rows = with_features(pages).filter("ruled IS NOT NULL")
    held = F.pmod(F.xxhash64("url"), F.lit(folds)) == 0
    model = train(rows.filter(~held), sample)
    scored = block_score(rows.filter(held).dropDuplicates(["url"]), model)
    right = (F.col("score") >= 0.5) == (F.col("ruled") == BLOCK)
    return scored.groupBy("ruled").agg(
        F.count(F.lit(1)).alias("urls"), F.count_if(right).alias("right")
    )


def judge(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    A URL that no rule fits is blocked if the trees find that likelier than not. Null URLs
    are judged as empty ones. Equal URLs get equal verdicts, rows that repeat stay, other
    columns are not looked at, an empty table stays empty.
    """
    rows = with_features(pages)
    model = train(rows.filter("ruled IS NOT NULL"), sample)
    scored = block_score(rows, model)
    learnt = F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", learnt).alias("verdict"), "score"
    )
