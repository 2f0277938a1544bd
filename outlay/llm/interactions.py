"""Interaction of filters: what each removes, wherever it stands in the order of the cascade.

A document is a mask, one bit for each filter it fails. In an order of the filters it goes at the
step of the earliest filter it fails. For all masks and all orders at once that is a min-plus product:
the mask matrix (0 where a mask fails a filter, infinite elsewhere) times the position matrix (the
inverse of each order: the step at which a filter stands). Documents enter the product as weights of
their mask only, so it costs the same for a thousand documents and for a trillion.

Null texts count as empty, a null language is the part with the empty name, an empty table has no
parts. Columns other than doc_id, text and lang are not read. Labels may repeat an id: a document is
good or toxic if any of its labels says so.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.relations import lookup
from outlay.llm.frames import kept, text_key

BLANKS = r"[\x20\x09-\x0D]+"
WEIGHTS = ("docs", "good", "toxic")
#: Orders grow with the factorial of the filters.
MOST_FILTERS = 7

SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_filters() -> dict[str, Column]:
    """Failure conditions that look at one text: `text` without nulls and its `words`."""
    text, words = F.col("text"), F.col("words")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bits(conditions: Mapping[str, Column]) -> Column:
    """The mask of the conditions, the first as lowest bit; a null condition does not fail."""
    total = F.lit(0)
    for nr, condition in enumerate(conditions.values()):
        total = total + F.when(condition, 1 << nr).otherwise(0)
    return total


def masked(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """One narrow row per document: doc_id, part, key of the text, mask, good, toxic."""
    filters = text_filters() if filters is None else filters
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    worded = text.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    narrow = worded.select("doc_id", "part", text_key(F.col("text")).alias("key"), _bits(filters).alias("mask"))
    flags = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    marked = lookup(narrow, flags.where("good or toxic"), {"labelled": F.col("doc_id")})
    return marked.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def weights(masks: DataFrame, copy_bit: int) -> DataFrame:
    """Documents, good and toxic ones per part and mask, `copy_bit` set for every text that a
    smaller doc_id has as well.

    The documents at the least id of their text are found by a join on text and id together, which
    no text can make hot, and moved out of the copies; all others are copies. A null id has no smaller
    one and is none. Several rows at the least id are none either.
    """
    cells = ["part", "mask", "good", "toxic"]
    least = masks.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    known = masks.where("doc_id is not null").groupBy("key", "doc_id", *cells).agg(F.count("*").alias("n"))
    firsts = known.join(least, ["key", "doc_id"], "left_semi").select(*cells, "n")
    unknown = masks.where("doc_id is null").groupBy(*cells).agg(F.count("*").alias("n"))
    single = firsts.unionByName(unknown)
    every = masks.groupBy(*cells).agg(F.count("*").alias("n"))
    as_copy = F.col("mask").bitwiseOR(F.lit(1 << copy_bit))
    moved = (
        every.withColumn("mask", as_copy)
        .unionByName(single.withColumn("mask", as_copy).withColumn("n", -F.col("n")))
        .unionByName(single)
    )
    return (
        moved.groupBy("part", "mask")
        .agg(
            F.sum("n").alias("docs"),
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        )
        .where("docs > 0")
    )


def removal_steps(n_filters: int, orders: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Steps [mask, order] at which a mask goes (n_filters + 1: never), and the positions
    [filter, order], both from 1: the min-plus product of the mask matrix and the positions."""
    never = n_filters + 1
    positions = np.argsort(np.asarray(orders), axis=1).T + 1
    fails = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1
    costs = np.where(fails == 1, 0, never)
    steps = np.full((1 << n_filters, len(orders)), never)
    for f in range(n_filters):
        np.minimum(steps, costs[:, f, None] + positions[f], out=steps)
    return steps, positions


def _rows_of_part(part: str, held: np.ndarray, steps: np.ndarray, positions: np.ndarray, orders, names) -> dict:
    """All rows of one part from its weights [weight, mask]."""
    n = len(names)
    at = np.broadcast_to(np.arange(len(orders)), steps.shape)
    removed = np.zeros((len(WEIGHTS), len(orders), n + 2), dtype=np.int64)
    for w in range(len(WEIGHTS)):
        np.add.at(removed[w], (at, steps), held[w][:, None])
    gone = removed[:, :, 1 : n + 1]
    docs = held[0]
    fails = (np.arange(len(docs))[:, None] >> np.arange(n)) & 1
    late = np.stack([(docs * fails[:, f]) @ (steps < positions[f]).astype(np.int64) for f in range(n)])
    order = np.asarray(orders)
    rank = np.arange(len(orders))
    taken = gone[0][rank[:, None], positions.T - 1]
    shapley = taken.sum(axis=0)
    alone = docs[1 << np.arange(n)]
    flat = order.ravel()
    return {
        "part": [part] * flat.size,
        "filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], n),
        "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)),
        "kept": (docs.sum() - gone[0].cumsum(axis=1)).ravel(),
        "removed": gone[0].ravel(),
        "redundant": late[order, rank[:, None]].ravel(),
        "unique_fails": alone[flat],
        "good_lost": gone[1].ravel(),
        "toxic_lost": gone[2].ravel(),
        "shapley": shapley[flat],
    }


def ranked(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    """The audit of every part, order and step from weights per part and mask.

    A part has at most one row per mask, so its rows make one short list; parts are spread over tasks.
    """
    names = list(names)
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders; at most {MOST_FILTERS}")
    fields = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = list(permutations(range(len(names))))
        steps, positions = removal_steps(len(names), orders)
        for batch in batches:
            for row in batch.to_pylist():
                held = np.zeros((len(WEIGHTS), 1 << len(names)), dtype=np.int64)
                for cell in row["cells"]:
                    held[:, cell["mask"]] += [cell[w] for w in WEIGHTS]
                found = _rows_of_part(row["part"], held, steps, positions, orders, names)
                yield pa.RecordBatch.from_pydict({f: pa.array(found[f]) for f in fields})

    cells = F.collect_list(F.struct("mask", *WEIGHTS)).alias("cells")
    return counted.groupBy("part").agg(cells).mapInArrow(audit, SCHEMA)


def audited(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, copies: str = "E") -> DataFrame:
    """The audit of `filters` and, as last one, the filter `copies` of texts that a smaller id has."""
    filters = text_filters() if filters is None else dict(filters)
    masks = kept(masked(docs, labels, filters), "filter-masks")
    return ranked(weights(masks, len(filters)), [*filters, copies])
