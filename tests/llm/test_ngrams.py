"""Counts, base scores and mixture probabilities against plain dictionaries."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from outlay.llm import ngrams, queries
from outlay.llm.words import WordHasher


def test_packing_is_exact():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    assert (ngrams.unpacked(ngrams.packed(values), len(values)) == values).all()
    counts = rng.integers(0, 1 << 40, 300)
    assert (ngrams.unpacked_counts(ngrams.packed_counts(counts), 300) == counts).all()
    assert len(ngrams.unpacked(ngrams.packed(values[:0]), 0)) == 0


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.replace("\x0b", " ").replace("\x0c", " ").split(" ") for w in w.split()] + [None]


def test_grams_are_those_of_the_tokens():
    texts = ["A b É a B", "", "x", None, "a b"]
    grams, first = ngrams.token_grams(pa.array(texts), 3, WordHasher(fold_case=True))
    seen = {}
    for n in range(1, 4):
        at = 0
        for t in texts:
            ts = ["^"] * 2 + tokens(t)
            for i in range(2, len(ts)):
                gram = tuple(ts[max(i - n + 1, 0) : i + 1])
                gram = (n, *gram[max(0, sum(g == "^" for g in gram) - 1) :])
                assert seen.setdefault(gram, grams[n - 1][at]) == grams[n - 1][at]
                at += 1
    assert len({v for k, v in seen.items() if k[0] == 2}) == len([k for k in seen if k[0] == 2])
    assert first.tolist() == [0, 6, 7, 9, 10, 13]


def base_rows(rows):
    train = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        ts = tokens(t)
        held = i is None or zlib.crc32(str(i).encode()) % 7 == 2
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in ts)
        out.append((i, held, len(ts), sum(train[x] > 0 for x in ts), n, base))
    return out


def compare(got, rows):
    key = lambda r: (-1 if r[0] is None else r[0], r[2], r[5])
    want = sorted(base_rows(rows), key=key)
    got = sorted((tuple(r) for r in got), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
    return got


def corpus():
    rng = random.Random(2)
    words = [f"W{i}" for i in range(40)]
    rows = []
    for i in range(300):
        w = [rng.choice(words[:8])]
        for _ in range(rng.randrange(60)):
            w.append(words[(int(w[-1][1:]) * 7 + rng.choice([1, 1, 1, 2, 9])) % 40])
        rows.append((i, " ".join(w)))
    return rows + [(300, None), (301, ""), (None, "W1 w2"), (5, rows[5][1]), (5, "new words é here")]


def test_base_and_mixture_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int")
    got = compare(ngrams.scored(docs, block_bytes=2000).collect(), rows)
    held = [g for g in got if g[1]]
    # successors are predictable here: a held-out text is likelier than by single words
    assert sum(g[6] for g in held) > sum(g[5] for g in held) + 0.1 * sum(g[2] for g in held)
    one = ngrams.scored(docs, order=1, block_bytes=2000).collect()
    compare(one, rows)


def plain_scores(dealt, rounded):
    """Deleted interpolation of words and word pairs with dictionaries, one token at a time.

    dealt: (doc_id, text, use, copies). rounded: estimates in half bits while weights are learned.
    """

    def counts(uses):
        once, pairs = Counter(), Counter()
        for _, t, use, copies in dealt:
            if use in uses:
                ts = tokens(t)
                for before, x in zip(["^", *ts], ts):
                    once[x] += copies
                    pairs[before, x] += copies
        return once, pairs, sum(once.values()), len(once)

    def parts(t, once, pairs, total, types):
        for before, x in zip(["^", *tokens(t)], tokens(t)):
            context = once[None] if before == "^" else once[before]
            e = [1 / (types + 1), once[x] / max(total, 1), pairs[before, x] / max(context, 1)]
            yield e, [True, total > 0, context > 0], int(math.log2(context + 1))

    def half_bits(e):
        return 2.0 ** (-(1 + math.floor(-2 * math.log2(e)) - 0.5) / 2) if e and rounded else e

    tuning = [
        (copies, bucket, [e[0], half_bits(e[1]), half_bits(e[2])])
        for _, t, use, copies in dealt
        if use == 1
        for e, _, bucket in parts(t, *counts({0}))
    ]

    def learned(mine, start, prior):
        weight = start
        for _ in range(ngrams.EM_ROUNDS if mine else 0):
            new = [prior * s for s in start]
            for copies, _, e in mine:
                whole = sum(w * x for w, x in zip(weight, e))
                new = [a + copies * w * x / whole for a, w, x in zip(new, weight, e)]
            weight = [max(a / sum(new), 1e-9) for a in new]
        return [w / sum(weight) for w in weight]

    final = counts({0, 1})
    below, weights = learned(tuning, [1 / 3] * 3, 0), []
    for bucket in range(int(math.log2(final[2] + 1)) + 1):
        below = learned([c for c in tuning if c[1] == bucket], below, ngrams.PRIOR)
        weights.append(below)
    out = {}
    for i, t, _, _ in dealt:
        score = 0.0
        for e, exists, bucket in parts(t, *final):
            mine = [w * x for w, x in zip(weights[bucket], exists)]
            score += math.log10(sum(w * x for w, x in zip(mine, e)) / sum(mine))
        out[i, t] = score
    return out


def test_scores_against_plain_interpolation(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, _ = ngrams.blocks(docs, 7, 2, 2000)
    dealt = [(r["doc_id"], r["text"], r["use"], r["copies"]) for r in dealt.collect()]
    assert {0, 1, 2} == {use for _, _, use, _ in dealt}
    scores = ngrams.scored(docs, block_bytes=2000).collect()
    want, exact = plain_scores(dealt, True), plain_scores(dealt, False)
    near = lambda values: sorted(round(v, 6) for v in values)
    times = Counter((i, t or "") for i, t in rows)
    assert near(r["score"] for r in scores) == near(v for k, v in want.items() for _ in range(times[k]))
    # rounding to half bits moves the weights little: under one per cent of the whole log probability
    assert abs(sum(want.values()) - sum(exact.values())) < 0.01 * abs(sum(exact.values()))


def test_repeated_rows_are_folded(spark):
    """A row with most of all copies reaches its block once a batch, and is returned each time."""
    rows = corpus() + [(7000, "W1 W8 w15")] * 2500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt, _ = ngrams.blocks(docs, 7, 2, 2000)
    assert dealt.where("doc_id = 7000").count() == 3
    compare(ngrams.scored(docs, block_bytes=2000).collect(), rows)


def test_buckets_follow_the_corpus():
    """Frequent contexts have weights of their own, and a bucket without tokens those below it."""
    cell = lambda b, one, two: (b * ngrams.CELLS + one) * ngrams.CELLS + two
    cells = np.array([cell(3, 30, 2), cell(20, 2, 30)])
    weights = ngrams.mixture_weights(cells, np.array([100000, 100000]), 2, 1000, 25)
    assert len(weights) == 25 and np.allclose(weights.sum(axis=1), 1)
    assert weights[3][2] > 0.9 and weights[20][1] > 0.9
    assert (weights[24] == weights[20]).all() and (weights[10] == weights[3]).all()


def test_probabilities_sum_to_one():
    """Over all known tokens and the unknown one, after any context."""
    weights = np.array([[0.2, 0.3, 0.5]] * 5)
    train = [["a", "b", None], ["a", "a", "b", None], ["b", None]]
    once, pairs = Counter(), Counter()
    for t in train:
        once.update(t)
        pairs.update(zip(["^", *t], t))
    total, types = sum(once.values()), len(once)
    for context in ("^", "a", "b", "never"):
        chance = 0.0
        for token in ["a", "b", None, "unknown"]:
            first_text = [token] if context == "^" else [context, token]
            c1 = np.array([once[x] for x in first_text[:-1]] + [once[token], len(train)])
            c2 = np.array([0] * (len(first_text) - 1) + [pairs[context, token], 0])
            e, ok, b = ngrams._estimates([c1, c2], np.array([0, len(c1)]), total, types)
            i = len(first_text) - 1
            mine = weights.T[:, b] * ok
            chance += ((mine * e).sum(axis=0) / mine.sum(axis=0))[i]
        assert math.isclose(chance, 1.0, rel_tol=1e-9)


def test_empty_table_and_no_training_text(spark):
    schema = "doc_id long, text string"
    assert ngrams.scored(spark.createDataFrame([], schema)).collect() == []
    row = ngrams.scored(spark.createDataFrame([(None, "a b")], schema)).first()
    assert tuple(row) == (None, True, 3, 0, 0, 0.0, 0.0)


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = compare(queries.op7_lm_scoring(spark, small).collect(), rows)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)
