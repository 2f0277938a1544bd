"""Language-model scoring by deleted interpolation of n-grams.

P(w | context) mixes the maximum-likelihood estimates of all orders with the uniform one. The
weights depend on how often the longest context was seen, by buckets of that frequency, one per power
of two up to the size of the corpus, and are learned by expectation-maximisation on texts whose
n-grams are left out of the estimates. A bucket with few such tokens leans on the one below it.

Texts are dealt into blocks of about `BLOCK_BYTES`. A block asks for the counts of its distinct
n-grams with sorted 64-bit hashes, packed per range of hashes; a range's task adds up what all
blocks hold and answers every block with the totals in the order of its question. So n-grams
are counted once per block before they are shuffled, a frequent one is at most one entry per block,
and neither a model nor a vocabulary is ever held in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.llm.frames import crc_fold, kept
from outlay.llm.words import WordHasher, chunks, mixed

ORDER = 2
BLOCK_BYTES = 4 << 20
#: Blocks whose questions a hash range answers: messages are order * blocks ** 2 / RANGE_BLOCKS.
RANGE_BLOCKS = 8
TUNING = 10
#: Half bits that an estimate is rounded to for the weights; 2 ** -63 is the least count over a context.
CELLS = 128
EM_ROUNDS = 60
#: Tokens of the bucket below that a bucket's weights start from.
PRIOR = 100
#: Copies of a row that one task writes out again.
PIECE = 1000
END = 0x5851F42D4C957F2D
COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _planes(values: np.ndarray) -> bytes:
    """64-bit values as byte planes, compressed: planes of zeros vanish."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def _values(data: bytes, count: int) -> np.ndarray:
    planes = pa.decompress(data, decompressed_size=8 * count, codec="zstd", asbytes=True)
    out = np.frombuffer(planes, dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(out.T).view(np.uint64).ravel()


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values, as their differences."""
    return _planes(np.diff(values, prepend=np.uint64(0)))


def unpacked(data: bytes, count: int) -> np.ndarray:
    return np.cumsum(_values(data, count), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return _planes(np.ascontiguousarray(counts, dtype=np.uint64))


def unpacked_counts(data: bytes, count: int) -> np.ndarray:
    return _values(data, count).view(np.int64)


def token_grams(texts: pa.Array, order: int, hasher: WordHasher):
    """(grams, first): for each order an array of hashes, one per token, of the n-gram that ends
    there, and each text's first token. A text is its words, A-Z lower-cased, and an end token.

    Before the first token the context is a start mark; a shorter text has shorter n-grams.
    """
    hashes, sizes = [], []
    for chunk in chunks(texts):
        words = hasher.words(chunk)
        n = np.diff(words.first)
        out = np.full(int(n.sum()) + len(n), END, dtype=np.uint64)
        out[np.arange(len(words.hash)) + words.text_of()] = words.hash
        hashes.append(out)
        sizes.append(n + 1)
    if not hashes:
        return [np.zeros(0, np.uint64)] * order, np.zeros(1, np.int64)
    token = np.concatenate(hashes)
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    starts = np.zeros(len(token), dtype=bool)
    starts[first[:-1]] = True
    grams = [token]
    for n in range(1, order):
        before = np.empty_like(token)
        before[1:] = grams[-1][:-1]
        before[starts] = np.uint64(n)  # the start mark of this order
        grams.append(mixed(before * np.uint64(0x9E3779B97F4A7C15) + token))
    return grams, first


def _merged(table: pa.Table) -> pa.Table:
    """Equal rows as one row with the sum of their copies."""
    keys = ["block", "doc_id", "text", "use"]
    summed = table.group_by(keys).aggregate([("copies", "sum")])
    return summed.select([*keys, "copies_sum"]).rename_columns([*keys, "copies"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one, before they are shuffled."""
    for batch in batches:
        yield from _merged(pa.Table.from_batches([batch])).to_batches()


def blocks(docs: DataFrame, folds: int, test_fold: int, block_bytes: int) -> tuple[DataFrame, int]:
    """(block, doc_id, text, use, copies), and the number of blocks. use: 0 for counting, 1 for the
    mixture weights, 2 for test. Every `TUNING`-th block is for the weights; blocks are random texts.

    Equal rows share a block, and reach it once per batch of the scan with the number of copies.
    """
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(TUNING, -(-size // block_bytes))
    fold = F.coalesce(crc_fold(F.col("doc_id"), folds), F.lit(test_fold))
    block = F.pmod(F.xxhash64("doc_id", text), F.lit(count)).cast("int")
    dealt = docs.select(block.alias("block"), "doc_id", text.alias("text"), fold.alias("fold"))
    use = F.when(F.col("fold") == test_fold, 2).when(F.col("block") % TUNING == 0, 1).otherwise(0)
    rows = dealt.select("block", "doc_id", "text", use.alias("use"), F.lit(1).cast("long").alias("copies"))
    return rows.mapInArrow(_folded, rows.schema), count


def _asked(order: int, ranges: int):
    """A block's questions: per order and hash range its distinct n-grams and how often its
    training texts hold them. All training texts of a block count, or all are for tuning."""

    def ask(table: pa.Table) -> pa.Table:
        table = _merged(table)
        block = table["block"][0].as_py()
        grams, first = token_grams(table["text"], order, WordHasher(fold_case=True))
        copies = np.where(table["use"].to_numpy() < 2, table["copies"].to_numpy(), 0)
        copies = np.repeat(copies, np.diff(first))
        rows = []
        for n in range(1, order + 1):
            values, where = np.unique(grams[n - 1], return_inverse=True)
            held = np.bincount(where, copies, minlength=len(values)).astype(np.int64)
            part = (values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            cut = np.searchsorted(part, np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(cut)).tolist():
                s = slice(cut[r], cut[r + 1])
                size = int(cut[r + 1] - cut[r])
                rows.append((n, r, block, size, packed(values[s]), packed_counts(held[s])))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table(
            [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
            names=["n", "part", "block", "size", "asked", "held"],
        )

    return ask


def _answered(table: pa.Table) -> pa.Table:
    """Totals of a hash range for every block that asked, without and with the tuning blocks, and
    the range's own sums."""
    sizes = table["size"].to_pylist()
    asked = [unpacked(a, k) for a, k in zip(table["asked"].to_pylist(), sizes)]
    held = [unpacked_counts(h, k) for h, k in zip(table["held"].to_pylist(), sizes)]
    counting = np.repeat(table["block"].to_numpy() % TUNING != 0, sizes)
    values, where = np.unique(np.concatenate(asked), return_inverse=True)
    held = np.concatenate(held)
    totals = [
        np.bincount(where, w, len(values)).astype(np.int64) for w in (held * counting, held)
    ]
    at, replies = 0, []
    for k in sizes:
        mine = where[at : at + k]
        replies.append([packed_counts(t[mine]) for t in totals])
        at += k
    sums = [int(totals[0].sum()), int(totals[1].sum()), int((totals[0] > 0).sum()), int((totals[1] > 0).sum())]
    own = [[s] + [0] * (len(sizes) - 1) for s in sums]
    return pa.table(
        [
            *(table[c] for c in ("n", "part", "block", "size")),
            pa.array([r[0] for r in replies], pa.binary()),
            pa.array([r[1] for r in replies], pa.binary()),
            *[pa.array(o, pa.int64()) for o in own],
        ],
        names=["n", "part", "block", "size", "counting", "all", "tokens_a", "tokens_b", "types_a", "types_b"],
    )


def _counted(order: int, text: pa.ChunkedArray, replies: pa.Table, column: str):
    """Per order the counts of every token's n-gram, and each text's first token."""
    grams, first = token_grams(text, order, WordHasher(fold_case=True))
    replies = replies.sort_by([("n", "ascending"), ("part", "ascending")])
    of, sizes, data = (replies[c].to_pylist() for c in ("n", "size", column))
    counts = []
    for n in range(1, order + 1):
        known = [unpacked_counts(d, k) for o, k, d in zip(of, sizes, data) if o == n]
        _, where = np.unique(grams[n - 1], return_inverse=True)
        grams[n - 1] = None
        counts.append(np.concatenate(known)[where])
    return counts, first


def _bucket(context: np.ndarray) -> np.ndarray:
    """One bucket per power of two of a context's count."""
    return np.log2(context + 1).astype(np.int64)


def _estimates(counts: list[np.ndarray], first: np.ndarray, total: int, types: int):
    """Estimates by order (uniform first), whether each exists, and the context bucket.

    The count of an n-gram's context is that of the (n-1)-gram one token before, and the number of
    texts, which is the count of the end token, for the first token.
    """
    n = len(counts[0])
    estimates, exists = [np.full(n, 1.0 / (types + 1))], [np.ones(n, dtype=bool)]
    context = np.full(n, total)
    texts = counts[0][first[1:] - 1]
    for k, c in enumerate(counts):
        if k:
            context = np.empty(n, dtype=np.int64)
            context[1:] = counts[k - 1][:-1]
            context[first[:-1]] = texts
        exists.append(context > 0)
        estimates.append(c / np.maximum(context, 1))
    return np.stack(estimates), np.stack(exists), _bucket(context)


def _cells(order: int, total: int, types: int):
    """Tuning tokens of a block by context bucket and half bits of each estimate."""

    def cells(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = _merged(table)
        counts, first = _counted(order, table["text"], replies, "counting")
        estimates, _, cell = _estimates(counts, first, total, types)
        for e in estimates[1:]:
            bits = np.where(e > 0, 1 + np.floor(-2 * np.log2(np.maximum(e, 2.0**-63))), 0)
            cell = cell * CELLS + np.minimum(bits, CELLS - 1).astype(np.int64)
        tuning = np.repeat(table["use"].to_numpy(), np.diff(first)) == 1
        copies = np.repeat(table["copies"].to_numpy(), np.diff(first))
        values, where = np.unique(cell[tuning], return_inverse=True)
        many = np.bincount(where, copies[tuning], len(values)).astype(np.int64)
        return pa.table([pa.array(values), pa.array(many)], names=["cell", "tokens"])

    return cells


def mixture_weights(
    cells: np.ndarray, tokens: np.ndarray, order: int, types: int, buckets: int
) -> np.ndarray:
    """Weights (bucket, order + 1) by expectation-maximisation on the tuning cells.

    The weights of all buckets together are learned from equal ones. Each bucket then takes those of
    the bucket below, the first one those of all, as `PRIOR` further tokens; without tuning tokens it has
    just these.
    """
    estimates = np.empty((order + 1, len(cells)))
    estimates[0] = 1.0 / (types + 1)
    rest = cells.copy()
    for k in range(order, 0, -1):
        bits = rest % CELLS
        estimates[k] = np.where(bits > 0, 2.0 ** (-(bits - 0.5) / 2), 0.0)
        rest //= CELLS

    def learned(mine: np.ndarray, start: np.ndarray, prior: float) -> np.ndarray:
        weight, many = start, tokens[mine]
        if not many.sum():
            return weight
        for _ in range(EM_ROUNDS):
            parts = weight[:, None] * estimates[:, mine]
            parts *= many / parts.sum(axis=0)
            weight = (parts.sum(axis=1) + prior * start) / (many.sum() + prior)
        return np.maximum(weight, 1e-9) / np.maximum(weight, 1e-9).sum()

    below = learned(np.ones(len(cells), dtype=bool), np.full(order + 1, 1.0 / (order + 1)), 0)
    weights = []
    for bucket in range(buckets):
        below = learned(rest == bucket, below, PRIOR)
        weights.append(below)
    return np.stack(weights)


def _scores(order: int, total: int, types: int, weights: np.ndarray):
    def scores(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = _merged(table)
        counts, first = _counted(order, table["text"], replies, "all")
        estimates, exists, bucket = _estimates(counts, first, total, types)
        mine = weights.T[:, bucket] * exists
        chance = (mine * estimates).sum(axis=0) / mine.sum(axis=0)
        once = counts[0]
        base = np.log10((once + 1) / (total + types + 1))
        starts = first[:-1]
        return pa.table(
            [
                table["doc_id"],
                pa.array(table["use"].to_numpy() == 2),
                pa.array(np.diff(first)),
                pa.array(np.add.reduceat((once > 0).astype(np.int64), starts)),
                pa.array(np.full(len(starts), total)),
                pa.array(np.add.reduceat(base, starts)),
                pa.array(np.add.reduceat(np.log10(chance), starts)),
                table["copies"],
            ],
            names=[*COLUMNS, "copies"],
        )

    return scores


def _written_out(rows: DataFrame) -> DataFrame:
    """Each row as often as it has copies. Many copies are cut into pieces for other tasks."""
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PIECE))
    many = F.least(F.lit(PIECE), F.col("copies") - F.col("piece") * PIECE)
    return (
        rows.withColumn("piece", F.explode(pieces))
        .repartition("doc_id", "n_tokens", "score", "piece")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), many)))
        .select(*COLUMNS)
    )


def scored(
    docs: DataFrame,
    order: int = ORDER,
    folds: int = 7,
    test_fold: int = 2,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the texts whose crc32(doc_id) modulo `folds` is not `test_fold`; a null id is
    held out. Null and empty texts are one end token. Repeated rows count each time; they are scored
    once and returned each time.
    Without training texts every probability is 1. Extra columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt, count = blocks(docs, folds, test_fold, block_bytes)
    questions = dealt.groupBy("block").applyInArrow(
        _asked(order, -(-count // RANGE_BLOCKS)), "n int, part int, block int, size int, asked binary, held binary"
    )
    replies = kept(
        questions.groupBy("n", "part").applyInArrow(
            _answered,
            "n int, part int, block int, size int, counting binary, all binary, tokens_a long, "
            "tokens_b long, types_a long, types_b long",
        ),
        "replies",
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_a", "tokens_b", "types_a", "types_b")]
    known = replies.where("n = 1").agg(*sums).first()
    tuning = F.col("block") % TUNING == 0
    once, both = (replies.select("n", "part", "block", "size", c) for c in ("counting", "all"))
    cells = (
        dealt.where(tuning)
        .groupBy("block")
        .cogroup(once.where(tuning).groupBy("block"))
        .applyInArrow(_cells(order, known["tokens_a"], known["types_a"]), "cell long, tokens long")
        .groupBy("cell")
        .agg(F.sum("tokens").alias("tokens"))
        .toArrow()  # at most 64 * CELLS ** order rows, of which few thousand occur
    )
    weights = mixture_weights(
        cells["cell"].to_numpy(),
        cells["tokens"].to_numpy(),
        order,
        known["types_a"],
        int(_bucket(np.array([known["tokens_b"]]))[0]) + 1,
    )
    return _written_out(
        dealt.groupBy("block")
        .cogroup(both.groupBy("block"))
        .applyInArrow(
            _scores(order, known["tokens_b"], known["types_b"], weights),
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double, copies long",
        )
    )
