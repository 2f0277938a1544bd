"""A training corpus from raw documents: five stages, each written before the next reads it.

Every stage but the last returns the columns of documents; its decisions take effect in what it
returns. The last returns what the mix takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm import decontamination, mixing, neardup, pii, quality
from outlay.llm.frames import kept, row_key, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels."""
    texts = docs.select("doc_id", row_key().alias("row_key"), "text")
    found = quality.scored(texts, table(spark, sf_dir, "labels"))
    # equal rows have equal scores, so rejecting by key rejects each of them
    rejected = found.where("predicted = 0").select(F.col("row_key").alias("_row")).distinct()
    keyed = docs.withColumn("_row", row_key())
    return keyed.join(rejected, "_row", "left_anti").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.deduplicated(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with how often it takes each; those it does not take are left out."""
    taken = mixing.mixed(docs)
    return taken.where("copies > 0").select(
        "doc_id", F.col("sources")[0].alias("source"), "size", "source_size", "target", "copies", "taken"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_copies", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("mixing", mixed_sources),
]

#: The classifier and the redaction's context rules have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
