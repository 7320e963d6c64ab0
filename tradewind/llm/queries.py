"""The registered queries of this subpackage: each applies an operator to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.llm import (
    decontaminate,
    lexical,
    licenses,
    line_dedup,
    minhash,
    mixing,
    pii,
    secrets,
    simhash,
    topk,
    toxicity,
    url_filter,
    whitening,
)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op2_pii(spark, folder):
    return pii.summary(pii.scan(table(spark, folder, "documents")))


def op3_line_dedup(spark, folder):
    marked = line_dedup.with_dropped_runs(table(spark, folder, "documents"))
    return marked.select(
        "doc_id", F.col("_n_lines").cast("long").alias("n_lines"),
        line_dedup.n_dropped().alias("n_dropped"),
        F.sha2(line_dedup.kept_text(), 256).alias("kept_sha256"),
        F.array_join(line_dedup.keep_bitmap().cast("array<string>"), ",").alias("keep"),
    )


def op4_url_filter(spark, folder):
    return url_filter.judge(table(spark, folder, "pages")).drop("score")


def op5_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    network = toxicity.learn(docs, table(spark, folder, "labels"))
    return toxicity.with_scores(docs, network).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        toxicity.flagged(network).alias("flagged"),
    )


def op6_licenses(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


def op7_secrets(spark, folder):
    return secrets.summary(secrets.scan(table(spark, folder, "documents")))


def op8_topk(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_mixing(spark, folder):
    documents, _ = mixing.mix(table(spark, folder, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark, folder):
    marked = decontaminate.contamination(
        table(spark, folder, "documents").select("doc_id", "text"),
        table(spark, folder, "benchmark"),
    )
    found = F.col("contamination")
    hit = F.aggregate(found["spans"], F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        "doc_id", found["n_words"].alias("n_words"), hit.cast("long").alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op11_lexical(spark, folder):
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_minhash(spark, folder):
    found = minhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_licenses": op6_licenses,
    "op7_secrets": op7_secrets,
    "op8_topk": op8_topk,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_lexical": op11_lexical,
    "op12_whitening": op12_whitening,
    "op13_minhash": op13_minhash,
}
