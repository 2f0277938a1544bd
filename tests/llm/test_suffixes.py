"""Removed bytes against a search for every substring."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from outlay.llm import queries, suffixes


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) per text."""
    raws = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for i, raw in enumerate(raws):
        for p in range(len(raw) - length + 1):
            places[hash(raw[p : p + length])].append((i, p))
    gone = [bytearray(len(r)) for r in raws]
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                gone[i][p : p + length] = b"\x01" * length
    out = []
    for raw, g in zip(raws, gone):
        kept = bytes(b for b, x in zip(raw, g) if not x)
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((len(raw), sum(g), spans, kept))
    return out


def check(spark, texts, length):
    docs = spark.createDataFrame(
        [(i, t, "x", i) for i, t in enumerate(texts)], "doc_id int, text string, text_key string, id int"
    )
    got = {
        r["id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), bytes(r["kept_bytes"]))
        for r in suffixes.without_repeats(docs, length).collect()
    }
    want = brute(texts, length)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i])


def random_texts(seed, n, alphabet, length):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    parts = [word(rng.randrange(5, 3 * length)) for _ in range(8)]
    texts = []
    for _ in range(n):
        t = "".join(
            rng.choice(parts)[rng.randrange(length) :] if rng.random() < 0.6 else word(rng.randrange(2 * length))
            for _ in range(rng.randrange(6))
        )
        t = list(t)
        for _ in range(rng.randrange(3)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(alphabet)
        texts.append("".join(t))
    return texts


def test_multikey_order_is_that_of_bytes():
    rng = np.random.default_rng(2)
    rows = [bytes(rng.integers(0, 3, rng.integers(0, 24)).astype(np.uint8)) for _ in range(500)]
    size = np.array([len(r) for r in rows])
    padded = np.zeros((500, 24), np.uint8)
    for i, r in enumerate(rows):
        padded[i, : len(r)] = np.frombuffer(r, np.uint8)
    order = suffixes.multikey_order(padded, size)
    assert [rows[i] for i in order] == sorted(rows)
    lcp = suffixes.common_prefixes(padded, size, order)
    for k in range(1, 500):
        a, b = rows[order[k - 1]], rows[order[k]]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == same


def test_random_texts(spark):
    check(spark, random_texts(1, 60, "abcdefghij é", 40), 40)
    # few letters, zero bytes and runs: anchors tie and repeat
    check(spark, [*random_texts(2, 40, "ab\x00", 24), "a" * 500, "ab" * 200, None, "", "a" * 23, "b" * 24], 24)


def test_across_buckets_and_copies(spark, monkeypatch):
    texts = random_texts(3, 60, "abcdefgh", 40)
    monkeypatch.setattr(suffixes, "BUCKET", 7)
    check(spark, texts + texts[:5] + [texts[7]] * 4, 40)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert suffixes.without_repeats(docs).collect() == []


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = brute([d["text"] for d in docs], 200)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op6_suffix_array_dedup(spark, small).collect()}
    for d, (n, removed, spans, kept) in zip(docs, want):
        assert got[d["doc_id"]] == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_columns_named_like_the_operators_own(spark):
    shared = "".join(chr(97 + i * i % 23) for i in range(260))
    rows = [(1, "k1", "s1", True, "x" * 50 + shared), (2, "k2", "s2", False, shared + "y" * 70), (3, None, "s3", None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, _key string, spans string, copied boolean, text string")
    out = {r["doc_id"]: r for r in suffixes.without_repeats(docs).collect()}
    assert out[1].asDict().keys() == {"doc_id", "_key", "spans", "copied", "n_bytes", "removed", "kept_bytes"}
    assert [(out[i]["_key"], out[i]["spans"], out[i]["copied"]) for i in (1, 2, 3)] == [("k1", "s1", True), ("k2", "s2", False), (None, "s3", None)]
    assert bytes(out[1]["kept_bytes"]) == b"x" * 50 and bytes(out[2]["kept_bytes"]) == b"y" * 70 and out[3]["n_bytes"] == 0
