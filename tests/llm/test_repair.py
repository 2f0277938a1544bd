"""Repairs against trying all edits of short conversations, long ones against one search over all rows."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from outlay.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, real boolean, later int, audit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, False, 1, "x") for r in rows], SCHEMA)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(place.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def results(rows, kinds, letters):
    """Repaired rows and cost of an audit, or None where it is no repair."""
    out, cost, at = [], 0, 0
    for letter in letters:
        if letter == "I":
            out.append((None, ""))
            cost += 5
            continue
        (_, role, text), kind = rows[at], kinds[at]
        at += 1
        if letter == "D":
            cost += 2
        elif kind in ("blank", "duplicate"):
            return None
        else:
            cost += (letter == "R") + 5 * (kind == "truncated")
            out.append((role if letter == "K" else None, text))
    start = 1 if out and out[0][0] is not None and out[0][0][:1] == "s" else 0
    named = [r if r is not None else ("user", "assistant")[(i - start) % 2] for i, (r, _) in enumerate(out)]
    if any(not r for r in named) or not re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in named)):
        return None
    return cost, "".join(letters), "\n".join(f"{r}:{t}" for r, (_, t) in zip(named, out))


def brute(rows):
    """rows: (turn, role, text) in order."""
    kinds, best = faults(rows), None
    for gaps in product(range(3), repeat=len(rows) + 1):
        if sum(gaps) > 2:
            continue
        for edits in product("KRD", repeat=len(rows)):
            letters = ["I"] * gaps[0]
            for e, g in zip(edits, gaps[1:]):
                letters += [e] + ["I"] * g
            found = results(rows, kinds, letters)
            if found and (best is None or found[:2] < best[:2]):
                best = found
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest(),
    )


def in_order(rows, conv):
    mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
    return sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def got(df):
    found = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in (*repair.COUNTS, "audit", "repaired_sha256")) for r in found}
    assert len(out) == len(found)
    return out


ROLES = ["user", "assistant", "system", "tool", "", None, "Sys"]
TEXTS = ["Yes.", "no", "", None, " \t\n\x0b\x0c\r", "Ja! \n", "é\x85", "Yes.", "a?b"]


def random_rows(seed, convs):
    rng = random.Random(seed)
    rows = []
    for conv in convs:
        for _ in range(rng.randrange(6)):
            rows.append((conv, rng.choice([None, 0, 1, 1, 2, 3, 9]), rng.choice(ROLES[:3] * 3 + ROLES), rng.choice(TEXTS)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_short_conversations(spark, seed):
    convs = [None, *range(40)]
    rows = random_rows(seed, convs)
    found = got(repair.verdicts(frame(spark, rows), spark.createDataFrame([(c,) for c in convs], "conv_id long")))
    assert found == {c: brute(in_order(rows, c)) for c in convs}


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}. More!") for c in range(60) for t in range(c % 4)]
    rows += [(None, None, None, None), (100, None, "user", "x")]
    hurt = plain_damage(rows)
    assert sorted(map(tuple, repair.damaged(frame(spark, rows)).collect()), key=repr) == sorted(hurt, key=repr)
    found = got(repair.verdicts(repair.damaged(frame(spark, rows)), frame(spark, rows)))
    assert found == {c: brute(in_order(hurt, c)) for c in {r[0] for r in rows}}


def test_empty_table(spark):
    assert got(repair.verdicts(frame(spark, []), frame(spark, []))) == {}


@pytest.mark.parametrize("n", [300, 1500])
def test_blocks_equal_one_search(n, monkeypatch):
    rng = random.Random(n)
    rows = [(rng.choice("suuaatx"), rng.random() < 0.1, rng.choice([0, 0, 0, 5])) for _ in range(n)]
    in_blocks = repair.derivation(rows)
    monkeypatch.setattr(repair, "BLOCK", n)
    assert in_blocks == repair.derivation(rows)
    monkeypatch.setattr(repair, "BLOCK", 7)
    assert in_blocks == repair.derivation(rows)


def test_a_conversation_over_many_ranges(spark, monkeypatch):
    """A third of all rows is one conversation; its pieces give what one pass over it gives."""
    rng = random.Random(9)
    hot = [(7, rng.choice([None, *range(300)]), rng.choice(ROLES), rng.choice(TEXTS + [f"t{i}." for i in range(200)])) for i in range(3000)]
    rows = hot + [(100 + i % 900, i // 900, rng.choice(["user", "assistant"]), "Fine.") for i in range(6000)]
    df = frame(spark, rows).repartition(4)
    monkeypatch.setattr(repair, "BLOCK", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    given = repair._prepared(df).withColumn("real", F.lit(True)).select(*repair.ORDER)
    assert repair._ranged(given).where("conv_id = 7").select(F.spark_partition_id()).distinct().count() > 1
    want = repair._one(7, in_order(rows, 7))
    try:
        found = got(repair.verdicts(df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found[7] == tuple(want[c] for c in (*repair.COUNTS, "audit", "repaired_sha256"))
    assert len(found) == 901 and found[100] == brute(in_order(rows, 100))


def test_long_texts(spark):
    rows = [(1, 0, "user", "word. " * 400_000), (1, 1, "assistant", "x" * 3_000_000), (2, 0, "u", "!")]
    found = got(repair.verdicts(frame(spark, rows)))
    assert found == {c: brute(in_order(rows, c)) for c in (1, 2)}


def test_repaired_rows(spark):
    rows = random_rows(5, range(30))
    df = frame(spark, rows)
    found = repair.verdicts(df)
    texts = {}
    for r in repair.repaired(df, found).orderBy("conv_id", "nr").collect():
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, verdict in got(found).items():
        assert hashlib.sha256("\n".join(texts.get(conv, [])).encode()).hexdigest() == verdict[-1]
