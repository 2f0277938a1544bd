"""N-gram Jaccard join by banded MinHash LSH, verified exactly.

Texts become sets of five-word shingles; equal sets form one class at once. Every distinct set has
in each of `TREES` bands one key of its minhash values, and sets with equal keys meet. This is not an LSH
forest: the number of values in a key is one constant of the parameters, the most up to `DEPTH` at which
a pair at the threshold meets in some band with the target probability, and does not follow what the data
match. A bucket is known by its least set, and a set is at home with the least of its buckets. Sets of one
home are dealt by hash into blocks of about `BLOCK`. Two blocks are compared, all sets of the one with all of the
other, if they have one home or meet in a bucket; so a pair is counted once, in the one pair of blocks that
holds it, and a chain of buckets costs what its buckets cost, not the square of the chain. A block meets its
partners one after the other in one task, which holds two blocks at a time, and no pair leaves the task: a block returns
the number of links of each of its sets once, and of the links only the edges that connect what is apart.

The least of n sets in a bucket is low among all N, and homes are lower still: a bucket of n sets has about
N / n homes at most, so the blocks that meet in it stay near n / BLOCK + N / n, whatever n is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.frames import has_bit, hash_bits, kept, row_key
from outlay.llm.words import WordHasher, chunks, mixed, shingles

WIDTH = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.99999
BLOCK = 100


def meeting_probability(similarity: float, trees: int, depth: int) -> float:
    return 1 - (1 - similarity**depth) ** trees


def matched_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The most values in a key at which pairs at the threshold meet with the target recall."""
    while depth > 1 and meeting_probability(threshold, trees, depth) < recall:
        depth -= 1
    return depth


def _sets(owner: np.ndarray, hashed: np.ndarray, n: int):
    """Distinct hashes per text, sorted within it, and the bounds of each text."""
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(hashed) != 0)
    hashed, owner = hashed[new], owner[new]
    return hashed, np.searchsorted(owner, np.arange(n + 1))


def _set_ids(hashed: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits per set: wrapping sums of two scramblings of its members; None for no member."""
    out = []
    for salt in (0x1B873593, 0x5BD1E995):
        sums = np.zeros(len(hashed) + 1, dtype=np.uint64)
        np.cumsum(mixed(hashed + np.uint64(salt)), out=sums[1:])
        out.append(mixed(sums[bounds[1:]] - sums[bounds[:-1]]))
    both = np.stack(out, axis=1).tobytes()
    some = np.diff(bounds) > 0
    return [both[16 * i : 16 * i + 16] if s else None for i, s in enumerate(some.tolist())]


def _signatures(hashed: np.ndarray, bounds: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Keys of the bands: one 64-bit value per nonempty set and band."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    keys = np.zeros((len(starts), trees), dtype=np.uint64)
    for tree in range(trees):
        for level in range(depth):
            seed = mixed(np.array([tree * 1000 + level + 1], dtype=np.uint64))[0]
            # multiply-xor-multiply of an already scrambled value: a fresh order for each seed
            values = (hashed ^ seed) * (seed | np.uint64(1))
            values ^= values >> np.uint64(31)
            values *= np.uint64(0x94D049BB133111EB)
            least = np.minimum.reduceat(values, starts)
            keys[:, tree] = mixed(keys[:, tree] * np.uint64(31) + least)
    return keys


def signed(docs: DataFrame, trees: int, depth: int, width: int = WIDTH) -> DataFrame:
    """(doc_id, row_key, set_id, labels) of every row; the last two are null for a text without
    words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        hasher = WordHasher()
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                n = chunk.hi - chunk.lo
                hashed, owner, _, _ = shingles(hasher.words(chunk), width)
                hashed, bounds = _sets(owner, hashed, n)
                some = np.diff(bounds) > 0
                keys = _signatures(hashed, bounds, trees, depth) if some.any() else None
                offsets = np.concatenate([[0], np.cumsum(some) * trees]).astype(np.int32)
                values = pa.array((keys if keys is not None else np.zeros(0, np.uint64)).ravel().view(np.int64))
                labels = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.lo, n),
                        batch.column(1).slice(chunk.lo, n),
                        pa.array(_set_ids(hashed, bounds), type=pa.binary()),
                        labels,
                    ],
                    names=["doc_id", "row_key", "set_id", "labels"],
                )

    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(
        rows, f"doc_id {kind}, row_key binary, set_id binary, labels array<long>"
    )


def _members(docs: DataFrame, bits, width: int) -> DataFrame:
    """(set_id, shingles) of the sets whose first eight bytes may be in the bit set."""

    def rows(batches):
        hasher = WordHasher()
        wanted = np.frombuffer(bits.value, dtype=np.uint64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                hashed, owner, _, _ = shingles(hasher.words(chunk), width)
                hashed, bounds = _sets(owner, hashed, chunk.hi - chunk.lo)
                ids = _set_ids(hashed, bounds)
                heads = np.array([int.from_bytes(i[:8], "big") if i else 0 for i in ids], np.uint64)
                pick = [i for i in np.flatnonzero(has_bit(wanted, heads)).tolist() if ids[i]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in pick], type=pa.binary()),
                        pa.array([hashed[bounds[i] : bounds[i + 1]].tobytes() for i in pick], type=pa.binary()),
                    ],
                    names=["set_id", "shingles"],
                )

    return docs.select("text").mapInArrow(rows, "set_id binary, shingles binary")


def components(edges: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """(node, root): the least node of each node's component; edges are (a, b).

    In a round every end of an edge hangs on its least neighbour, chains are followed to their
    end by repeated jumps, and edges are drawn between what their ends hang on; those inside one
    tree are gone. So only the first round sees all edges, and a star is done in one. Every step is
    written to the shared folder.
    """
    labels = nodes.select("node", F.col("node").alias("root"))
    left = kept(edges.where("a <> b").select("a", "b"), label)
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = kept(
            ends.groupBy(F.col("a").alias("node"))
            .agg(F.min("b").alias("low"))
            .select("node", F.least("node", "low").alias("to")),
            label,
        )
        moved = True
        while moved:
            above = hung.select(F.col("node").alias("to"), F.col("to").alias("top"))
            jumped = kept(hung.join(above, "to"), label)
            moved = not jumped.where("top <> to").isEmpty()
            hung = jumped.select("node", F.col("top").alias("to"))
        roots = hung.withColumnRenamed("node", "root")
        labels = kept(
            labels.join(roots, "root", "left").select("node", F.coalesce("to", "root").alias("root")),
            label,
        )
        for end in ("a", "b"):
            left = left.join(hung.withColumnRenamed("node", end), end).drop(end)
            left = left.withColumnRenamed("to", end)
        left = kept(
            left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            label,
        )
    return labels


def _compare(threshold: float):
    """Rows (first, block, set_id, copies, shingles), sorted so that each block `first` is followed by the
    blocks it is compared with: the links of each of its sets, and edges that connect what is linked.

    A block sees all its partners, so a set leaves one row of links. Links inside a block connect it
    first, so a pair of blocks adds only the edges that join what is still apart; the lower block adds them.
    """

    class Block:
        def __init__(self, ids, copies, shingles):
            self.ids, self.copies = ids, np.array(copies, dtype=np.int64)
            members = [np.frombuffer(s, dtype=np.uint64) for s in shingles]
            self.size = np.array([len(m) for m in members], dtype=np.int64)
            self.hashed = np.concatenate(members)
            self.owner = np.repeat(np.arange(len(ids)), self.size)
            self.known = np.unique(self.hashed)

        def places(self, known):
            """(owner, place) of the members that are among the known hashes, by place."""
            place = np.searchsorted(known, self.hashed)
            place[place == len(known)] = 0
            found = known[place] == self.hashed
            owner, place = self.owner[found], place[found]
            order = np.argsort(place, kind="stable")
            return owner[order], place[order]

    def matched(one: Block, two: Block) -> np.ndarray:
        """Which sets of the one are linked with which sets of the other."""
        known = np.intersect1d(one.known, two.known, assume_unique=True)
        common = np.zeros((len(one.ids), len(two.ids)), dtype=np.float32)
        if len(known):
            step = max(1, (1 << 22) // max(len(one.ids), len(two.ids)))
            sides = [(b.places(known), len(b.ids)) for b in (one, two)]
            for lo in range(0, len(known), step):
                width = min(step, len(known) - lo)
                has = []
                for (owner, place), n in sides:
                    a, b = np.searchsorted(place, [lo, lo + width])
                    has.append(np.zeros((n, width), dtype=np.float32))
                    has[-1][owner[a:b], place[a:b] - lo] = 1
                common += has[0] @ has[1].T
        inside = np.rint(common).astype(np.int64)
        linked = inside >= np.ceil(threshold * (one.size[:, None] + two.size[None, :] - inside) - 1e-9)
        if one is two:
            np.fill_diagonal(linked, False)
        return linked

    def find(root, x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def joined(root, left, right):
        """The edges that connect what is apart so far."""
        keep = []
        for a, b in zip(left, right):
            x, y = find(root, a), find(root, b)
            if x != y:
                root[max(x, y)] = min(x, y)
                keep.append((a, b))
        return keep

    def inner(block: Block):
        """Which of its sets are linked, their roots, and the edges that connect them."""
        linked = matched(block, block)
        root = list(range(len(block.ids)))
        return linked, root, joined(root, *[x.tolist() for x in np.nonzero(np.triu(linked))])

    def runs(batches):
        """(first, block, rows) for each run of equal first and block."""
        name, rows = None, ([], [], [])
        for batch in batches:
            firsts, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            columns = [batch.column(i).to_pylist() for i in (2, 3, 4)]
            lo = 0
            while lo < len(firsts):
                hi = lo + 1
                while hi < len(firsts) and firsts[hi] == firsts[lo] and blocks[hi] == blocks[lo]:
                    hi += 1
                if name != (firsts[lo], blocks[lo]):
                    if name:
                        yield *name, rows
                    name, rows = (firsts[lo], blocks[lo]), ([], [], [])
                for held, column in zip(rows, columns):
                    held.extend(column[lo:hi])
                lo = hi
        if name:
            yield *name, rows

    def result(ids, links, edges):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids + [a for a, _ in edges], type=pa.binary()),
                pa.array(links + [None] * len(edges), type=pa.int64()),
                pa.array([None] * len(ids) + [b for _, b in edges], type=pa.binary()),
            ],
            names=["set_id", "links", "other"],
        )

    def compare(batches):
        own = home = None
        for first, block, rows in runs(batches):
            if first == block:
                if own is not None:
                    yield result(own.ids, links.tolist(), [])
                own, home = Block(*rows), first
                linked, root, edges = inner(own)
                links = linked @ own.copies
                yield result([], [], [(own.ids[a], own.ids[b]) for a, b in edges])
            elif first == home:
                other = Block(*rows)
                linked = matched(own, other)
                if not linked.any():
                    continue
                links += linked @ other.copies
                if first < block:
                    n = len(own.ids)
                    both = root + [n + x for x in inner(other)[1]]
                    left, right = np.nonzero(linked)
                    edges = joined(both, left.tolist(), (right + n).tolist())
                    # a root is the least of its tree, so roots of own sets stay among them
                    root = [find(both, x) for x in range(n)]
                    yield result([], [], [(own.ids[a], other.ids[b - n]) for a, b in edges])
        if own is not None:
            yield result(own.ids, links.tolist(), [])

    return compare


def met_blocks(members: DataFrame, placed: DataFrame, homes: DataFrame) -> DataFrame:
    """(first, second): pairs of blocks of one home, each block with itself, and pairs that meet in a bucket.

    members: (set_id, tree, b) of all buckets, placed: (set_id, block, home), homes: (home, parts).
    """
    inside = homes.select(
        "home", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    ).select(
        _block("home", F.col("part")).alias("first"),
        F.explode(
            F.transform(F.sequence(F.col("part"), F.col("parts") - 1), lambda q: _block("home", q))
        ).alias("second"),
    )
    touched = members.join(placed.select("set_id", "home", "block"), "set_id").select(
        "tree", "b", "home", "block"
    )
    # one home in a bucket: its blocks are compared anyway. Buckets of other trees often hold the same blocks
    lists = (
        touched.distinct()
        .groupBy("tree", "b")
        .agg(F.sort_array(F.collect_list("block")).alias("blocks"), F.min("home").alias("lo"), F.max("home").alias("hi"))
        .where("lo <> hi")
        .select("blocks")
        .distinct()
    )
    across = lists.select("blocks", F.posexplode("blocks").alias("at", "first")).select(
        "first", F.explode(F.expr("slice(blocks, at + 2, size(blocks))")).alias("second")
    )
    return inside.unionByName(across).distinct()


def _block(home: str, part: Column) -> Column:
    return F.concat(F.col(home), F.unhex(F.lpad(F.hex(part.cast("long")), 16, "0")))


def classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    width: int = WIDTH,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, row_key, first_of_class.

    n_links counts the other rows whose shingle sets have a Jaccard similarity of at least the
    threshold with this row's; class_id is the least doc_id of the rows connected by such links,
    itself for a row without link. A text of one to four words has one shingle of all its
    words. Null and empty texts have no link and are a class each, of their own id. Repeated rows are copies of
    each other. Null ids are kept; a class of null ids only has a null class_id. Extra columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = kept(signed(docs, trees, matched_depth(threshold, trees, depth, recall), width), "signed")
    sets = kept(
        rows.where("set_id is not null")
        .groupBy("set_id")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("least"),
            F.count("*").alias("copies"),
            F.any_value("labels").alias("labels"),
        ),
        "sets",
    )
    met = sets.select("set_id", F.posexplode("labels").alias("tree", "prefix"))
    buckets = met.groupBy("tree", "prefix").agg(F.min("set_id").alias("b"), F.count("*").alias("n"))
    # sides of joins are stored where a hot key must be split: that needs an exchange of their own
    buckets = kept(buckets.where("n > 1").drop("n"), "buckets")
    members = kept(
        met.join(buckets, ["tree", "prefix"]).select("set_id", "tree", "b"), "members"
    )
    at_home = kept(members.groupBy("set_id").agg(F.min("b").alias("home")), "homes")
    homes = kept(
        at_home.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts")), "home-sizes"
    )
    # parts by hash, so that a home of any size is dealt out evenly without ranking it
    placed = at_home.join(homes, "home").select(
        "set_id", "home", _block("home", F.pmod(F.xxhash64("set_id"), F.col("parts"))).alias("block")
    )
    head = F.expr("cast(conv(hex(substring(set_id, 1, 8)), 16, -10) as long)")
    placed = kept(placed.join(sets.select("set_id", "copies"), "set_id"), "placed")
    bits = spark.sparkContext.broadcast(
        hash_bits(placed.select(head.alias("head")), "head")
    )
    content = _members(docs, bits, width).groupBy("set_id").agg(F.any_value("shingles").alias("shingles"))
    compared_blocks = kept(met_blocks(members, placed, homes), "met-blocks")
    met = compared_blocks.where("first <> second")
    wanted = compared_blocks.select("first", F.col("second").alias("block")).unionByName(
        met.select(F.col("second").alias("first"), F.col("first").alias("block"))
    )
    pairs = (
        placed.join(content, "set_id")
        .join(wanted, "block")
        .select("first", "block", "set_id", "copies", "shingles")
    )
    # a block comes before its partners, and its rows and theirs lie in one task
    in_turn = pairs.repartition("first").sortWithinPartitions("first", F.col("first") != F.col("block"), "block")
    compared = kept(
        in_turn.mapInArrow(_compare(threshold), "set_id binary, links long, other binary"), "compared"
    )
    links = compared.where("links is not null").select("set_id", "links")
    forest = compared.where("other is not null").select(
        F.col("set_id").alias("a"), F.col("other").alias("b")
    )
    linked = kept(forest.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "linked")
    joined = components(forest, linked, "classes")
    classed = kept(
        sets.join(joined, sets["set_id"] == joined["node"], "left")
        .select("set_id", "least", "copies", F.coalesce("root", "set_id").alias("root"))
        .join(links, "set_id", "left")
        .withColumn("links", F.coalesce("links", F.lit(0))),
        "classed",
    )
    least = kept(classed.groupBy("root").agg(F.min("least").alias("first")), "least")
    classed = classed.join(least, "root").select("set_id", "first", "copies", "links")
    alone = F.col("set_id").isNull()
    return rows.drop("labels").join(classed, "set_id", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        "row_key",
        (alone | (F.col("row_key") == F.col("first.row_key"))).alias("first_of_class"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: that of the least doc_id (a null id only if there is no
    other), of rows that share it one by a hash of the text. Texts without words stay, once for each id.
    Of rows equal in id and text one stays.
    """
    name = "_row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    found = classes(docs, **options)
    first = found.where("first_of_class").select(F.col("row_key").alias(name)).distinct()
    keyed = docs.withColumn(name, row_key())
    return keyed.join(first, name, "left_semi").dropDuplicates([name]).drop(name)
