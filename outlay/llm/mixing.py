"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents that belong to the same set of sources are one pattern; its capacity is the sum of their
words. Flow runs from patterns to the quotas of their sources. Using a pattern's words for the n-th
time costs n - 1, a convex cost, so nothing is repeated while unused words could serve. The
flow is solved on the patterns alone; documents are then picked in a seeded order until
each pattern's share of each pass is met.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.llm.frames import kept

WEIGHTS = (5, 2, 1)
VOLUME = Fraction(3, 2)
REPEATS = 2
MAX_PATTERNS = 100_000


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    blanks = r"[\x20\x09-\x0D]+"
    packed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(packed, blanks, "")).cast("long")


def targets(
    sizes: Sequence[int],
    weights: Sequence[int] = WEIGHTS,
    volume: Fraction = VOLUME,
    repeats: int = REPEATS,
) -> list[Fraction]:
    """Words wanted from each source, in the order of the sources.

    The sources share volume * all words by weight; a target stops at repeats * its source's words and
    what is over goes to the others by weight, until none is above.
    """
    left, out = Fraction(volume) * sum(sizes), [Fraction(0)] * len(sizes)
    open_ = {i: weights[i % len(weights)] for i in range(len(sizes))}
    while open_:
        unit = left / sum(open_.values())
        full = [i for i, w in open_.items() if unit * w > repeats * sizes[i]]
        if not full:
            for i, w in open_.items():
                out[i] = unit * w
            break
        for i in full:
            out[i] = Fraction(repeats * sizes[i])
            left -= out[i]
            del open_[i]
    return out


def min_cost_flow(
    capacity: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int
) -> list[list[int]]:
    """Words of each pattern taken in each pass: a flow of greatest volume at least cost.

    Successive shortest paths on source - (pattern, pass) - pattern - quota - sink, where pass p
    costs p. Only patterns and sources are nodes. A path may take words of a pattern back from one
    quota for another.
    """
    n, m = len(capacity), len(quotas)
    used = [[0] * repeats for _ in range(n)]
    flow: dict[tuple[int, int], int] = {}
    of_source: dict[int, list[int]] = {}
    for i, sources in enumerate(members):
        for s in sources:
            of_source.setdefault(s, []).append(i)
    left = list(quotas)

    def path() -> tuple[list[int], int] | None:
        """Cheapest way from the unused pass of a pattern to a source with quota left."""
        start = []
        for i in range(n):
            p = next((p for p in range(repeats) if used[i][p] < capacity[i]), None)
            if p is not None:
                start.append((p, i))
        heap, came, seen = start, {}, set()
        heapq.heapify(heap)
        while heap:
            cost, i = heapq.heappop(heap)
            if i in seen:
                continue
            seen.add(i)
            for s in members[i]:
                if ("s", s) in came:
                    continue
                came["s", s] = i
                if left[s]:
                    way = [s]
                    while True:
                        at = came["s", way[-1]]
                        way.append(at)
                        if ("p", at) not in came:
                            return way, cost
                        way.append(came["p", at])
                for j in of_source[s]:
                    if j not in seen and flow.get((j, s)):
                        came.setdefault(("p", j), s)
                        heapq.heappush(heap, (cost, j))
        return None

    while (found := path()) is not None:
        way, cost = found
        first = way[-1]
        amount = min(left[way[0]], capacity[first] - used[first][cost])
        for k in range(2, len(way) - 1, 2):
            amount = min(amount, flow[way[k - 1], way[k]])
        used[first][cost] += amount
        left[way[0]] -= amount
        for k in range(0, len(way), 2):
            pattern = way[k + 1]
            flow[pattern, way[k]] = flow.get((pattern, way[k]), 0) + amount
            if k + 2 < len(way):
                flow[pattern, way[k + 2]] -= amount
    return used


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    volume: Fraction = VOLUME,
    repeats: int = REPEATS,
    seed: str = "mix",
    membership: Column | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, sources, size, source_size, target, copies, taken.

    `membership` is the array of sources a document belongs to; without it, its one source, where
    null is a source too. Sources are ordered by code point, null last, and weigh `weights` in
    turn. size counts the words of the whole text, 0 for null; source_size and target are sums
    over a document's sources. Each source's flow ends at most half a document from its target
    per pattern; copies is at most `repeats`. Documents are ordered by md5 of seed and id, then id and
    size, so that reruns agree and rows equal in these are alike. Extra columns are ignored.

    The number of membership patterns must be at most MAX_PATTERNS, since the flow is solved on the
    driver; more raise an error.
    """
    own = F.array("source") if membership is None else F.array_sort(F.array_distinct(membership))
    sized = kept(
        docs.select(
            "doc_id",
            own.alias("sources"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias(
                "draw"
            ),
        ),
        "sized",
    ).withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int"))
    patterns = (
        sized.groupBy("sources").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    )
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    plan = _planned(patterns, weights, volume, repeats)
    plan = docs.sparkSession.createDataFrame(
        plan,
        "sources array<string>, source_size long, target double, full int, rest long",
    )
    running = Window.partitionBy("_p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        sized.groupBy(F.col("sources").alias("_p"), "bucket")
        .agg(F.sum("size").alias("own"))
        .withColumn("upto", F.sum("own").over(running))
        .join(F.broadcast(plan.select(F.col("sources").alias("_p"), "rest")), "_p")
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("own") <= F.col("rest")))
        .select("_p", F.col("bucket").alias("cut"), (F.col("upto") - F.col("own")).alias("before"))
    )
    # one row per pattern, so at most MAX_PATTERNS rows are broadcast
    plan = plan.join(cuts, plan["sources"] == cuts["_p"], "left").drop("_p")
    # only a pattern without words has no bucket that goes beyond the rest
    plan = plan.withColumn("cut", F.coalesce("cut", F.lit(-1)))
    placed = sized.join(F.broadcast(plan), "sources")
    sure = placed.where("bucket <> cut").withColumn("extra", (F.col("bucket") < F.col("cut")).cast("int"))
    near = _in_cut_bucket(placed.where("bucket = cut"))
    sure = sure.select(*near.columns)
    return (
        sure.unionByName(near)
        .withColumn("copies", F.col("full") + F.col("extra"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "sources", "size", "source_size", "target", "copies", "taken")
    )


def _in_cut_bucket(placed: DataFrame) -> DataFrame:
    """Rows of the buckets in which a pattern's rest ends, with `extra`.

    Rows equal in id and size are one row with their number, so an id that repeats without end is one
    row of the order. A second cut by the next digits of the draw leaves one in 16 million rows to it.
    """
    rows = ("sources", "draw", "doc_id", "size")
    known = ("full", "source_size", "target", "rest", "before")
    folded = placed.groupBy(*rows, *known).agg(F.count("*").alias("n"))
    folded = folded.withColumn("part", F.conv(F.substring("draw", 4, 3), 16, 10).cast("int"))
    words = F.col("size") * F.col("n")
    running = Window.partitionBy("sources").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        folded.groupBy("sources", "part", "rest", "before")
        .agg(F.sum(words).alias("own"))
        .withColumn("upto", F.col("before") + F.sum("own").over(running))
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("own") <= F.col("rest")))
        .select(F.col("sources").alias("_p"), F.col("part").alias("end"), (F.col("upto") - F.col("own")).alias("start"))
    )
    # one row per pattern again
    dealt = folded.join(F.broadcast(ends), F.col("sources") == F.col("_p")).drop("_p")
    ahead = Window.partitionBy("sources").orderBy("draw", "doc_id", "size")
    so_far = F.col("start") + F.coalesce(F.sum(words).over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = 2 * F.col("rest") - 2 * so_far - F.col("size")
    fits = F.when(room < 0, 0).when(F.col("size") == 0, F.col("n")).otherwise(
        F.least(F.col("n"), F.floor(room / (2 * F.nullif("size", F.lit(0)))) + 1)
    )
    inside = dealt.where(F.col("part") == F.col("end")).withColumn("fits", fits.cast("long"))
    around = dealt.where(F.col("part") != F.col("end")).withColumn(
        "fits", F.when(F.col("part") < F.col("end"), F.col("n")).otherwise(F.lit(0).cast("long"))
    )
    each = inside.unionByName(around).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select(
        "doc_id", "sources", "size", "source_size", "target", "full", (F.col("copy") <= F.col("fits")).cast("int").alias("extra")
    )


def _planned(patterns, weights, volume, repeats) -> list[tuple]:
    """Solve targets and flow for collected (sources, words) patterns."""
    names = {s for p in patterns for s in p["sources"]}
    ordered = sorted(names, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(ordered)}
    sizes = [0] * len(ordered)
    for p in patterns:
        for s in p["sources"]:
            sizes[place[s]] += p["words"]
    wanted = targets(sizes, weights, volume, repeats)
    used = min_cost_flow(
        [p["words"] for p in patterns],
        [[place[s] for s in p["sources"]] for p in patterns],
        [int(t) for t in wanted],
        repeats,
    )
    out = []
    for p, passes in zip(patterns, used):
        full, rest = divmod(sum(passes), p["words"]) if p["words"] else (0, 0)
        mine = [place[s] for s in p["sources"]]
        size, target = sum(sizes[i] for i in mine), float(sum(wanted[i] for i in mine))
        out.append((p["sources"], size, target, full, rest))
    return out
