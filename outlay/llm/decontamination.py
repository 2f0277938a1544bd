"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are put into classes of doubling size (distinct five-word shingles). A class keeps of each
item its k smallest shingle hashes, k = floor((1 - threshold) * largest size of the class) + 1. A
document that contains a share of `threshold` of an item misses at most k - 1 of its shingles,
so it meets one of these minima for sure, however long it is; a fixed banded signature of a whole
long document would miss short items. Documents are read once and give only shingles that pass
a bit set of the item shingles; items shorter than a shingle make them give windows of those few
widths too. Documents are joined with the minima alone; the pairs that meet are
verified by counting the item's shingles, as text, in the document.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlay.llm.frames import has_bit, hash_bits, kept, text_key
from outlay.llm.words import WordHasher, chunks, shingles, windows

WIDTH = 5
THRESHOLD = 0.8


def _shingled(df: DataFrame, width: int, bits=None, short: Sequence[int] = ()) -> DataFrame:
    """Distinct shingles, hash and text, of every row (row_id, text_key, text), and its windows of the
    widths in `short`; with `bits`, only those in that bit set."""

    def rows(batches):
        hasher = WordHasher()
        wanted = None if bits is None else np.frombuffer(bits.value, dtype=np.uint64)
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                words = hasher.words(chunk)
                found = [shingles(words, width), *[windows(words, w) for w in short]]
                hashed, owner, at, length = map(np.concatenate, zip(*found))
                if wanted is not None:
                    hit = has_bit(wanted, hashed)
                    hashed, owner, at, length = hashed[hit], owner[hit], at[hit], length[hit]
                order = np.lexsort((hashed, owner))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (np.diff(owner[order]) != 0) | (np.diff(hashed[order]) != 0)
                pick = order[new]
                spelled = [
                    b" ".join(
                        chunk.data[words.start[a + j] : words.end[a + j]].tobytes()
                        for j in range(n)
                    )
                    for a, n in zip(at[pick].tolist(), length[pick].tolist())
                ]
                row = pa.array(chunk.lo + owner[pick])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        pa.array(hashed[pick].view(np.int64)),
                        pa.array(spelled, type=pa.binary()),
                    ],
                    names=["row_id", "text_key", "hash", "shingle"],
                )

    kind = df.schema["row_id"].dataType.simpleString()
    return df.mapInArrow(rows, f"row_id {kind}, text_key binary, hash long, shingle binary")


def item_minima(items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Distinct shingles of each item: (item_id, hash, shingle, n_item, minimum)."""
    found = _shingled(
        items.select(F.col("item_id").alias("row_id"), text_key(F.col("text")).alias("text_key"), "text"),
        width,
    )
    found = found.select(F.col("row_id").alias("item_id"), "hash", "shingle").distinct()
    per_item = Window.partitionBy("item_id")
    sized = found.withColumn("n_item", F.count("*").over(per_item))
    largest = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    minima = F.floor((1 - threshold) * largest + 1e-9) + 1
    rank = F.row_number().over(per_item.orderBy("hash"))
    return sized.withColumn("minimum", rank <= minima)


def candidates(hits: DataFrame, minima: DataFrame) -> DataFrame:
    """Pairs (doc_id, text_key, item_id) of a document and an item of which it has a minimum."""
    least = minima.where("minimum").select("item_id", "shingle")
    return hits.join(least, "shingle").select("doc_id", "text_key", "item_id").distinct()


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH
) -> DataFrame:
    """Pairs (doc_id, text_key, item_id, n_item, n_shared, containment) with a containment of the
    item's distinct shingles in the document of at least the threshold.

    docs has doc_id and text, items has item_id and text; other columns are ignored. Words are
    case-sensitive. An item of fewer than five words has one shingle of all its words, and is found in
    every document that has these words in a row. Null and empty texts have no shingle and no pair. Null ids are kept as ids. Repeated rows give one pair, as do rows of one id and text;
    rows of one item id form one item. Empty tables give no pair.
    """
    spark = docs.sparkSession
    minima = kept(item_minima(items, threshold, width), "items")
    bits = spark.sparkContext.broadcast(hash_bits(minima.select("hash").distinct(), "hash"))
    n_words = F.size(F.split(F.col("shingle").cast("string"), " "))
    short = [r[0] for r in minima.select(n_words.alias("n")).where(F.col("n") < width).distinct().collect()]
    hits = _shingled(
        docs.select(F.col("doc_id").alias("row_id"), text_key(F.col("text")).alias("text_key"), "text"),
        width,
        bits,
        short,
    )
    hits = kept(hits.select(F.col("row_id").alias("doc_id"), "text_key", "shingle").distinct(), "hits")
    asked, spelled, given = candidates(hits, minima).alias("c"), minima.alias("i"), hits.alias("h")
    sought = asked.join(spelled, F.col("c.item_id").eqNullSafe(F.col("i.item_id"))).select(
        "c.doc_id", "c.text_key", "c.item_id", "n_item", "shingle"
    )
    same = (
        F.col("s.doc_id").eqNullSafe(F.col("h.doc_id"))
        & (F.col("s.text_key") == F.col("h.text_key"))
        & (F.col("s.shingle") == F.col("h.shingle"))
    )
    shared = (
        sought.alias("s")
        .join(given, same, "left_semi")
        .groupBy("doc_id", "text_key", "item_id", "n_item")
        .agg(F.count("*").alias("n_shared"))
    )
    return shared.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(
        F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH
) -> DataFrame:
    """The documents, all columns and repeated rows kept, that contain no item."""
    pairs = contained_items(docs, items, threshold, width)
    found = pairs.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_doc")) & (text_key(docs["text"]) == F.col("_key"))
    return docs.join(found, same, "left_anti")
