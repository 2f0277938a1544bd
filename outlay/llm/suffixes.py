"""Exact substring deduplication with a distributed, sparse suffix array over bytes.

Every byte covered by a `LENGTH`-byte string that also starts elsewhere is removed. Suffixes are
taken at anchors only: the place of the least 8-byte hash in each window of `LENGTH` bytes. Equal
windows have equal anchors, so a repeated string always meets its copies at the anchors it shares
with them, and one anchor in about a hundred bytes is enough.

1. Every anchor gives a fingerprint of the bytes to its left and one of those to its right; one
   of the two lies inside any window of the anchor. Fingerprints seen at one place only are out.
2. The others give their context, `LENGTH` bytes to either side. Equal contexts become one.
3. Sampled splitters range-partition the contexts by the first bytes of their suffix, and those
   of a lead with more than `BUCKET` contexts by the whole suffix. Each bucket sorts its suffixes and the
   reversed prefixes by multikey quicksort, eight bytes at a time, and common prefixes of
   neighbours tell which windows two contexts share. Where splitters cut through such a lead, windows
   whose classes may go on beyond the bucket are compared across buckets by 128 bits.
4. The widest shared windows of an anchor are removed around every place that has its context.

A third of all texts may be copies of one, or share one passage: copies fold into one context before
anything is sorted, and splitters cut anywhere inside a group of equal leads.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.llm.frames import has_bit, hash_bits, kept, text_key
from outlay.llm.words import BASE, byte_values, chunks, mixed, powers

LENGTH = 200
GRAM = 8
BUCKET = 50_000


class Anchors:
    """Anchors and hashes of a chunk of texts."""

    def __init__(self, length: int):
        self.length = length
        self.values = byte_values(False)
        self.inverse = pow(BASE, -1, 1 << 64)
        self.up = self.down = powers(1, BASE)

    def at(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Places of anchors, in order."""
        n, width = len(data), self.length - GRAM + 1
        if n < self.length:
            return np.zeros(0, dtype=np.int64)
        grams = np.zeros(n - GRAM + 1, dtype=np.uint64)
        for i in range(GRAM):
            grams |= data[i : n - GRAM + 1 + i].astype(np.uint64) << np.uint64(8 * i)
        # the upper bits order the grams, the place in the lower bits makes the leftmost win
        bits = np.uint64(32)
        low = mixed(grams) >> bits << bits | np.arange(len(grams), dtype=np.uint64)
        have = 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        room = np.zeros(n, dtype=bool)
        lengths = np.diff(bounds)
        long = lengths >= self.length
        edges = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edges, bounds[:-1][long], 1)
        np.add.at(edges, bounds[1:][long] - self.length + 1, -1)
        room = np.cumsum(edges[:n])[: len(low)] > 0
        place = (low & ((np.uint64(1) << bits) - np.uint64(1)))[room]
        if not len(place):
            return np.zeros(0, dtype=np.int64)
        change = np.ones(len(place), dtype=bool)
        change[1:] = place[1:] != place[:-1]
        return place[change].astype(np.int64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = powers(n + 1, BASE), powers(n + 1, self.inverse)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=out[1:])
        return out

    def prints(self, sums, at, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of half a window to the left (with the anchor's gram) and to the right; cut
        at the text's bounds, where no window of another length can be equal to it."""
        half = (self.length - GRAM) // 2
        out = []
        for salt, a, b in ((1, at - half, at + GRAM), (2, at, at + half + GRAM)):
            fits = (a >= lo) & (b <= hi)
            a, b = np.where(fits, a, at), np.where(fits, b, at)
            hashed = mixed((sums[b] - sums[a]) * self.down[a] + np.uint64(salt))
            out.append((hashed, fits))
        return out


def _fingerprints(docs: DataFrame, length: int) -> DataFrame:
    """(print, place): both fingerprints of every anchor, and a hash of its text and place."""

    def rows(batches):
        anchors = Anchors(length)
        for batch in batches:
            keys = np.frombuffer(b"".join(k[:8] for k in batch.column(0).to_pylist()), np.uint64)
            for chunk in chunks(batch.column(1)):
                at = anchors.at(chunk.data, chunk.bounds)
                owner = np.searchsorted(chunk.bounds, at, side="right") - 1
                lo, hi = chunk.bounds[owner], chunk.bounds[owner + 1]
                place = mixed(keys[chunk.lo + owner] + (at - lo).astype(np.uint64) * np.uint64(BASE))
                prints = anchors.prints(anchors.sums(chunk.data), at, lo, hi)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([h[ok] for h, ok in prints]).view(np.int64)),
                        pa.array(np.concatenate([place[ok] for _, ok in prints]).view(np.int64)),
                    ],
                    names=["print", "place"],
                )

    return docs.select("text_key", "text").mapInArrow(rows, "print long, place long")


def _contexts(docs: DataFrame, bits, length: int) -> DataFrame:
    """(text_key, at, context, left): anchors with a fingerprint in the bit set; context is the
    bytes around the anchor, `left` of them before it."""

    def rows(batches):
        anchors = Anchors(length)
        wanted = np.frombuffer(bits.value, dtype=np.uint64)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                at = anchors.at(chunk.data, chunk.bounds)
                owner = np.searchsorted(chunk.bounds, at, side="right") - 1
                lo, hi = chunk.bounds[owner], chunk.bounds[owner + 1]
                hit = np.zeros(len(at), dtype=bool)
                for hashed, fits in anchors.prints(anchors.sums(chunk.data), at, lo, hi):
                    hit |= fits & has_bit(wanted, hashed)
                at, owner, lo, hi = at[hit], owner[hit], lo[hit], hi[hit]
                a, b = np.maximum(at - length, lo), np.minimum(at + length, hi)
                whole = chunk.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(chunk.lo + owner)),
                        pa.array((at - lo).astype(np.int32)),
                        pa.array([whole[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary()),
                        pa.array((at - a).astype(np.int32)),
                    ],
                    names=["text_key", "at", "context", "left"],
                )

    return docs.select("text_key", "text").mapInArrow(
        rows, "text_key binary, at int, context binary, left int"
    )


def multikey_order(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Order of byte rows, ties by length: multikey quicksort with eight bytes as a key. Every
    round sorts only rows that are still equal to a neighbour."""
    n = len(rows)
    keys = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.arange(n)
    group = np.zeros(n, dtype=np.int64)
    for k in range(keys.shape[1] + 1):
        sizes = np.bincount(group, minlength=n)
        open_ = np.flatnonzero(sizes[group] > 1)
        if not len(open_):
            break
        mine = order[open_]
        key = keys[mine, k] if k < keys.shape[1] else length[mine].astype(np.uint64)
        sorted_ = np.lexsort((key, group[open_]))
        order[open_] = mine[sorted_]
        key, old = key[sorted_], group[open_]
        fresh = np.ones(len(open_), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1])
        # a group is named by the place of its first row
        group[open_] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
    return order


def common_prefixes(rows: np.ndarray, length: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes each row of the order shares with the one before it; 0 for the first."""
    out = np.zeros(len(order), dtype=np.int64)
    for lo in range(1, len(order), 1 << 14):
        hi = min(lo + (1 << 14), len(order))
        a, b = order[lo - 1 : hi - 1], order[lo:hi]
        differs = rows[a] != rows[b]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        out[lo:hi] = np.minimum(first, np.minimum(length[a], length[b]))
    return out


def _matrix(contexts: list[bytes], left: np.ndarray, length: int):
    """Reversed prefixes and suffixes of contexts as zero-padded byte rows, with their lengths."""
    n = len(contexts)
    pad = -(-length // 8) * 8
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    flat = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    right = sizes - left
    places = np.arange(pad)
    forward, backward = np.zeros((n, pad), np.uint8), np.zeros((n, pad), np.uint8)
    for lo in range(0, n, 1 << 14):
        s = slice(lo, min(lo + (1 << 14), n))
        anchor = (starts[s] + left[s])[:, None]
        ok = places[None, :] < right[s][:, None]
        forward[s][ok] = flat[(anchor + places)[ok]]
        ok = places[None, :] < left[s][:, None]
        backward[s][ok] = flat[(anchor - 1 - places)[ok]]
    return backward, forward, right


def _shared(length: int):
    """A bucket of distinct contexts (id, context, left, wide): the widest window shared inside it, as
    (id, before, after), and window keys for classes that may reach beyond the bucket."""

    def shared(batches):
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        n = len(table)
        ids = table["id"].to_pylist()
        contexts = table["context"].to_pylist()
        left = table["left"].to_numpy().astype(np.int64)
        backward, forward, right = _matrix(contexts, left, length)
        by_suffix = multikey_order(forward, right)
        by_prefix = multikey_order(backward, left)
        suffix_lcp = common_prefixes(forward, right, by_suffix)
        prefix_lcp = common_prefixes(backward, left, by_prefix)
        # common prefix of each suffix with the bucket's first and last suffix
        edge = np.zeros(n, dtype=np.int64)
        edge[by_suffix[0]] = right[by_suffix[0]]
        edge[by_suffix[1:]] = np.minimum.accumulate(suffix_lcp[1:])
        last = np.zeros(n, dtype=np.int64)
        last[by_suffix[-1]] = right[by_suffix[-1]]
        last[by_suffix[:-1]] = np.minimum.accumulate(suffix_lcp[:0:-1])[::-1]
        # only a wide lead is cut by a splitter
        edge = np.maximum(edge, last) * table["wide"].to_numpy()
        most, least = np.full(n, -1, dtype=np.int64), np.full(n, length + 1, dtype=np.int64)
        for r in range(GRAM, length + 1):
            fits = (right >= r) & (left >= length - r)
            suffix_class, prefix_class = np.empty(n, np.int64), np.empty(n, np.int64)
            suffix_class[by_suffix] = np.cumsum(suffix_lcp < r)
            prefix_class[by_prefix] = np.cumsum(prefix_lcp < length - r)
            mine = np.flatnonzero(fits)
            both = suffix_class[mine] * np.int64(n + 1) + prefix_class[mine]
            _, one, where, uses = np.unique(
                both, return_index=True, return_inverse=True, return_counts=True
            )
            again = mine[uses[where] > 1]
            most[again] = r
            least[again] = np.minimum(least[again], r)
            # one of each class of equal windows stands for it in other buckets
            open_ = mine[one]
            open_ = open_[edge[open_] >= r]
            if len(open_):
                at = (left[open_] - (length - r)).tolist()
                keys = [
                    hashlib.blake2b(contexts[i][a : a + length], digest_size=16, salt=b"%d" % r).digest()
                    for i, a in zip(open_.tolist(), at)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in open_.tolist()], pa.binary()),
                        pa.array(np.full(len(open_), r, np.int32)),
                        pa.array(np.full(len(open_), r, np.int32)),
                        pa.array(keys, pa.binary()),
                    ],
                    names=["id", "before", "after", "window"],
                )
        found = np.flatnonzero(most >= 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in found.tolist()], pa.binary()),
                pa.array((length - least[found]).astype(np.int32)),
                pa.array(most[found].astype(np.int32)),
                pa.nulls(len(found), pa.binary()),
            ],
            names=["id", "before", "after", "window"],
        )

    return shared


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(text_key, spans): for every distinct text the ranges [start, end) of bytes around anchors
    that are repeated at another place of another or the same text. Ranges may overlap.

    docs has text and text_key. Whole-text copies count as one text here.
    """
    spark = docs.sparkSession
    seen = _fingerprints(docs, length).groupBy("print").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    again = kept(seen.where("a <> b").select("print"), "prints")
    bits = spark.sparkContext.broadcast(hash_bits(again, "print"))
    places = kept(
        _contexts(docs, bits, length)
        .withColumn("id", F.unhex(F.md5(F.concat(F.concat("left", F.lit(":")).cast("binary"), "context")))),
        "contexts",
    )
    distinct = kept(
        places.groupBy("id").agg(
            F.any_value("context").alias("context"),
            F.any_value("left").alias("left"),
            F.min(F.struct("text_key", "at")).alias("a"),
            F.max(F.struct("text_key", "at")).alias("b"),
        ).select("id", "context", "left", (F.col("a") != F.col("b")).alias("copied")),
        "distinct",
    )
    size = distinct.count()
    parts = max(1, -(-size // BUCKET))
    lead, suffix = (F.expr(f"substring(context, left + 1{n})") for n in (f", {GRAM}", ""))
    wide = kept(
        distinct.groupBy(lead.alias("lead")).agg(F.count("*").alias("n")).where(F.col("n") > BUCKET),
        "wide-leads",
    )
    dealt = (
        distinct.select("id", "context", "left", lead.alias("lead"))
        .join(wide.withColumn("wide", F.lit(True)).drop("n"), "lead", "left")
        .withColumn("wide", F.coalesce("wide", F.lit(False)))
        .repartitionByRange(parts, "lead", F.when(F.col("wide"), suffix), F.when(F.col("wide"), F.col("id")))
        .select("id", "context", "left", "wide")
    )
    shared = kept(
        dealt.mapInArrow(_shared(length), "id binary, before int, after int, window binary"), "shared"
    )
    across = shared.where("window is not null")
    reached = across.groupBy("window").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    reached = kept(reached.where("a <> b").select("window"), "reached")
    beyond = across.join(reached, "window").select(
        "id", (F.lit(length) - F.col("after")).alias("before"), "after"
    )
    inside = shared.where("window is null").select("id", "before", "after")
    whole = distinct.where("copied").select(
        "id",
        F.col("left").alias("before"),
        (F.octet_length("context") - F.col("left")).alias("after"),
    )
    # stored, so that the join below can split a context that stands at a third of all places
    widest = kept(
        inside.unionByName(beyond)
        .unionByName(whole)
        .groupBy("id")
        .agg(F.max("before").alias("before"), F.max("after").alias("after")),
        "widest",
    )
    return (
        places.select("text_key", "at", "id")
        .join(widest, "id")
        .select("text_key", F.struct((F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end")).alias("span"))
        .groupBy("text_key")
        .agg(F.collect_set("span").alias("spans"))
    )


def _cut(names: list[str], fields: list[str], length: int):
    def cut(batches):
        for batch in (b.slice(lo, 512) for b in batches for lo in range(0, len(b), 512)):
            texts = batch.column(len(names)).to_pylist()
            spans = batch.column(len(names) + 1).to_pylist()
            copied = batch.column(len(names) + 2).to_pylist()
            out: list[tuple] = []
            for text, found, twice in zip(texts, spans, copied):
                raw = (text or "").encode()
                if twice and len(raw) >= length:
                    found = [{"start": 0, "end": len(raw)}]
                runs: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in found or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                left, at = [], 0
                for a, b in runs:
                    left.append(raw[at:a])
                    at = b
                left.append(raw[at:])
                out.append((runs, b"".join(left), len(raw)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))]]
                + [
                    pa.array([o[2] for o in out], pa.int64()),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in o[0]] for o in out],
                        pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
                    ),
                    pa.array([o[1] for o in out], pa.binary()),
                ],
                names=[*names, "n_bytes", "removed", "kept_bytes"],
            )

    return cut


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs' columns but text, with n_bytes, removed (maximal runs of bytes) and kept_bytes.

    Every byte covered by a `length`-byte string that also starts at another place of any text, the
    same included, is removed from every text that has it. Null texts are empty; texts shorter than `length`
    stay whole. Repeated rows are copies of each other, so from `length` bytes on nothing of them is left.
    kept_bytes may end inside a character. Columns of docs with the added names are replaced.
    """
    names = [c for c in docs.columns if c not in ("text", "n_bytes", "removed", "kept_bytes")]
    # inside, the given columns go by their place, so none can be taken for one of ours
    given = [F.col(f"`{c}`").alias(f"given_{i}") for i, c in enumerate(names)]
    keyed = docs.select(*given, "text", text_key(F.col("text")).alias("key"))
    texts = docs.select(text_key(F.col("text")).alias("text_key"), "text")
    spans = repeated_spans(texts, length)
    copies = texts.groupBy("text_key").agg((F.count("*") > 1).alias("copied"))
    known = copies.where("copied").join(spans, "text_key", "full_outer").withColumnRenamed("text_key", "known")
    joined = keyed.join(known, keyed["key"] == known["known"], "left").select(
        *[f"given_{i}" for i in range(len(names))], "text", "spans", F.coalesce("copied", F.lit(False)).alias("copied")
    )
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    return joined.mapInArrow(
        _cut(names, fields, length),
        ", ".join([*fields, "n_bytes long, removed array<struct<start:int,end:int>>, kept_bytes binary"]),
    )
