"""Targets, flow and selection against plain versions."""

import itertools
from fractions import Fraction

from pyspark.sql import functions as F

from outlay.llm import mixing


def test_targets_share_the_excess_until_none_is_above():
    assert mixing.targets([10, 10, 10]) == [20, Fraction(50, 3), Fraction(25, 3)]
    assert mixing.targets([0, 5]) == [0, Fraction(15, 2)]
    assert mixing.targets([]) == []
    wanted = mixing.targets([100, 1, 7, 40, 3, 900])
    assert sum(wanted) == Fraction(3, 2) * 1051
    assert all(t <= 2 * s for t, s in zip(wanted, [100, 1, 7, 40, 3, 900]))


def best_cost(capacity, members, quotas, repeats):
    """Greatest volume, then least cost, by trying every split of every pattern."""
    best = (-1, 0)
    options = []
    for c, m in zip(capacity, members):
        options.append(
            [x for x in itertools.product(range(repeats * c + 1), repeat=len(m)) if sum(x) <= repeats * c]
        )
    for pick in itertools.product(*options):
        into = [0] * len(quotas)
        for x, m in zip(pick, members):
            for v, s in zip(x, m):
                into[s] += v
        if any(a > q for a, q in zip(into, quotas)):
            continue
        cost = sum(sum(p * min(c, max(0, sum(x) - p * c)) for p in range(repeats)) for x, c in zip(pick, capacity))
        best = max(best, (sum(into), -cost))
    return best


def test_flow_is_greatest_and_cheapest():
    cases = [
        ([2, 2, 1], [[0], [0, 1], [1]], [3, 3], 2),
        ([1, 3], [[0, 1], [1]], [2, 2], 2),
        ([2, 2], [[0, 1], [0]], [2, 2], 2),
        ([1, 1, 1], [[0, 1], [1, 2], [0, 2]], [2, 1, 3], 2),
        ([3], [[0, 1]], [1, 1], 1),
    ]
    for capacity, members, quotas, repeats in cases:
        used = mixing.min_cost_flow(capacity, members, quotas, repeats)
        assert all(u <= c for passes, c in zip(used, capacity) for u in passes)
        volume = sum(map(sum, used))
        cost = sum(p * u for passes in used for p, u in enumerate(passes))
        assert (volume, -cost) == best_cost(capacity, members, quotas, repeats)


def test_selection_meets_targets(spark):
    rows = [(i, "w " * (i % 13), f"s{i % 3}" if i % 7 else None, i) for i in range(400)] + [
        (None, None, "s0", 1),
        (5, "a b", "s0", 1),
        (5, "a b", "s0", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, size int")
    got = mixing.mixed(docs)
    assert got.count() == len(rows)
    per = got.groupBy("sources").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum("size").alias("size"),
        F.max("source_size").alias("source_size"),
    ).collect()
    for r in per:
        assert r["size"] == r["source_size"]
        assert abs(r["taken"] - r["target"]) <= 7
    assert got.where("taken > 2 * size").count() == 0
    again = mixing.mixed(docs.repartition(3))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_overlapping_sources(spark):
    rows = [(i, "w " * 5, ["a", "b"] if i % 2 else ["a"]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, tags array<string>")
    got = mixing.mixed(docs, weights=(1, 1), volume=Fraction(1, 3), membership=F.col("tags"))
    # a: 500 words, b: 250; each quota is a sixth of their 750, so no document repeats
    assert abs(got.agg(F.sum("taken")).first()[0] - 250) <= 5
    assert got.agg(F.max("copies")).first()[0] == 1


def test_empty_table_and_empty_texts(spark):
    schema = "doc_id int, text string, source string"
    assert mixing.mixed(spark.createDataFrame([], schema)).collect() == []
    row = mixing.mixed(spark.createDataFrame([(1, "", None)], schema)).first()
    assert (row["size"], row["target"], row["taken"]) == (0, 0.0, 0)


def test_one_id_in_all_rows(spark):
    """Rows of one id share a draw; folded ones take as many copies as an order of all rows would."""
    rows = [(None if i % 3 else 7, "w " * (i % 4), "s" if i % 5 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(docs).select("doc_id", "sources", "size", "target", "taken").collect()
    assert len(out) == 600
    for name in ("s", None):
        mine = [r for r in out if r["sources"] == [name]]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3
        assert sorted((r["doc_id"] or 0, r["size"]) for r in mine) == sorted((i or 0, len(t.split())) for i, t, s in rows if s == name)
