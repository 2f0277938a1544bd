"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm import chat, decontamination, html, interactions, mixing, neardup, ngrams, pii, quality, repair, rules, suffixes, warc
from outlay.llm.frames import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs)
    counts = [F.size(f"spans_{k.name}").cast("long").alias(f"n_{k.name}") for k in pii.BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.joined_spans(pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.joined_spans((*pii.BASE_KINDS, *pii.MORE_KINDS)).alias("spans"),
    )


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    return chat.digests(chat.formatted(given.unionByName(probe)))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted"
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judged(docs, report=rules.STATISTICS).drop("text", "rejected_by")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return suffixes.without_repeats(docs).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extracted(pages).withColumn("n_chars", F.length("text").cast("long"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontamination.contained_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return pairs.groupBy("doc_id", "item_id").agg(
        F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared")
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.classes(docs).drop("row_key", "first_of_class")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.verdicts(repair.damaged(given), given)


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {
        "op1_pii": op1_pii,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_source_mixing": op4_source_mixing,
        "op5_quality_rules": op5_quality_rules,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_html_extraction": op8_html_extraction,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_filter_interactions": op12_filter_interactions,
        "op13_warc": op13_warc,
    }
