"""The audit against following every document through every order."""

import random
import re
from itertools import permutations

import pytest

from outlay.llm import interactions

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failing(row, rows):
    text = row[1] or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if row[0] is not None and any(r[0] is not None and r[0] < row[0] and (r[1] or "") == text for r in rows):
        out.add("E")
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails = [failing(r, rows) for r in rows]
    found = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [i for i, f in left if letter in f]
                before = [f for _, f in mine if letter in f and any(x in f for x in order[: step - 1])]
                left = [(i, f) for i, f in left if letter not in f]
                shares[letter] += len(gone)
                found[part, "".join(order), step] = [
                    len(left), len(gone), len(before), sum(f == {letter} for _, f in mine),
                    sum(i is not None and i in good for i in gone), sum(i is not None and i in toxic for i in gone),
                ]
        for (p, order, step), row in found.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return {k: tuple(v) for k, v in found.items()}


def audit(spark, rows, labels):
    docs = spark.createDataFrame(
        [(*r, "x", 1, True) for r in rows], "doc_id long, text string, lang string, part string, mask int, good boolean"
    )
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = interactions.audited(docs, marks).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[f] for f in FIELDS) for r in rows}
    assert len(found) == len(rows)
    return found


def long_text(n, vocabulary, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def test_audit_of_odd_rows(spark):
    varied = [f"w{i}" for i in range(1000)]
    big = long_text(50_000, varied, 1)
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "", ""), (None, "", "en"), (None, None, "de"),
        (5, long_text(300, varied, 2), "en"), (6, long_text(300, varied, 2), "de"), (6, long_text(300, varied, 2), "de"),
        (7, long_text(300, ["a", "b"], 3) + " #", "en"), (8, "ABC " * 250, "en"), (9, big, "fr"), (10, big, "fr"),
        (10, big, "en"), (11, "É" * 300, "fr"), (12, "one\x1ctwo\x85three", "fr"), (-3, "|", "en"), (13, "|", "en"),
    ]
    labels = [(5, 1, 0), (5, 0, 1), (5, 1, 1), (8, 1, None), (6, None, 1), (None, 1, 1), (99, 1, 1), (13, 1, 0)]
    assert audit(spark, rows, labels) == brute(rows, labels)


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_of_random_rows(spark, seed):
    rng = random.Random(seed)
    texts = [long_text(rng.choice([3, 220, 400]), ["a", "B", "cc", "D|"] + [f"v{i}" for i in range(rng.choice([2, 300]))], s) for s in range(25)]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "en", "de", "x"])) for _ in range(120)]
    labels = [(rng.randrange(40), rng.randint(0, 1), rng.randint(0, 1)) for _ in range(30)]
    assert audit(spark, rows, labels) == brute(rows, labels)


def test_empty_table(spark):
    assert audit(spark, [], [(1, 1, 1)]) == {}


def test_steps_are_the_least_positions():
    orders = list(permutations(range(4)))
    steps, positions = interactions.removal_steps(4, orders)
    for mask in range(16):
        for nr, order in enumerate(orders):
            want = next((s for s, f in enumerate(order, 1) if mask >> f & 1), 5)
            assert steps[mask, nr] == want
    assert all(positions[f, nr] == o.index(f) + 1 for nr, o in enumerate(orders) for f in range(4))


def test_too_many_filters_are_refused(spark):
    with pytest.raises(ValueError, match="orders"):
        interactions.ranked(spark.range(0), "ABCDEFGH")
