"""Pairs against every item compared with every document."""

import random

from outlay.llm import decontamination as D


def shingle_set(text):
    w = (text or "").split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = set()
    for i, text in items:
        s = shingle_set(text)
        for d, t in docs:
            n = len(s & shingle_set(t))
            if s and len(text.split()) < 5:
                run, w = text.split(), (t or "").split()
                n = int(any(w[p : p + len(run)] == run for p in range(len(w))))
            if s and n >= 0.8 * len(s) - 1e-9:
                out.add((d, i, len(s), n))
    return out


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, hash string, n_item int"),
        spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, shingle int"),
    )


def found(spark, docs, items):
    pairs = D.contained_items(*frames(spark, docs, items)).collect()
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in pairs}
    assert len(got) == len(pairs)
    return got


def test_items_whole_partly_and_short(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 70)))) for i in range(30)]
    items += [(100, "just four words here"), (101, None), (102, ""), (103, "one"), (None, items[3][1])]
    docs = [(0, None), (1, ""), (2, "just four words here"), (3, "not just four words here"), (4, "one")]
    for d in range(5, 120):
        w = [rng.choice(words) for _ in range(rng.randrange(400))]
        item = rng.choice(items[:30])[1].split()
        keep = item[: rng.randrange(len(item) // 2, len(item) + 1)] if rng.random() < 0.5 else item
        at = rng.randrange(len(w) + 1)
        docs.append((d, " ".join(w[:at] + keep + w[at:])))
    long = [rng.choice(words) for _ in range(30000)]
    docs += [(500, " ".join(long + items[0][1].split() + long)), (None, items[1][1]), (7, docs[7][1])]
    want = brute(docs, items)
    assert len({p[1] for p in want}) > 20
    assert found(spark, docs, items) == want


def test_short_items_are_found_in_long_documents(spark):
    items = [(1, "alpha beta gamma"), (2, "one"), (3, "a b c d"), (4, " \n"), (5, "p q r s t u"), (6, "beta gamma")]
    filler = " ".join(f"f{i}" for i in range(9000))
    docs = [(1, f"{filler} alpha beta gamma {filler}"), (2, "alpha beta x gamma"), (3, "one"), (4, f"x\tone\n{filler}"), (5, "a b c d e"),
            (6, "b c d a"), (7, "a b c"), (8, None), (9, "p q r s t u"), (10, "gamma alpha beta gamma"), (None, "beta gamma")]
    want = brute(docs, items)
    assert {(1, 1), (10, 1), (4, 2), (5, 3), (9, 5), (None, 6)} <= {p[:2] for p in want}
    assert found(spark, docs, items) == want


def test_only_minima_make_candidates(spark):
    rng = random.Random(9)
    common = "the end of the text"  # its hash is no minimum of most items
    items = [(i, common + "".join(f" w{rng.randrange(10**6)}" for _ in range(40))) for i in range(40)]
    docs = [(d, f"x{d} {common} y{d}") for d in range(20)] + [(99, items[7][1])]
    frame, given = frames(spark, docs, items)
    minima = D.item_minima(given)
    said = [(d, bytes(16), " ".join(s).encode()) for d, t in docs for s in shingle_set(t)]
    hits = spark.createDataFrame(said, "doc_id long, text_key binary, shingle binary")
    of_common = minima.where("minimum and shingle = cast('the end of the text' as binary)").count()
    got = {(r["doc_id"], r["item_id"]) for r in D.candidates(hits, minima).collect()}
    assert (99, 7) in got and len(got) <= 1 + 21 * of_common and of_common < 40
    assert found(spark, docs, items) == brute(docs, items) == {(99, 7, 41, 41)}


def test_clean_documents_keep_all_columns_and_rows(spark):
    item = "a b c d e f g h"
    docs = [(1, "x " + item), (1, "x y z"), (1, "x y z"), (None, item), (None, "fine"), (2, None)]
    kept = D.decontaminate(*frames(spark, docs, [(1, item)])).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, "fine"), (1, "x y z"), (1, "x y z"), (2, "")]
    assert kept[0].asDict().keys() == {"doc_id", "text", "hash", "n_item"}


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b c d e f")], [(1, "a b c d e f")])
    assert D.contained_items(docs.limit(0), items).collect() == []
    assert D.contained_items(docs, items.limit(0)).collect() == []
    assert D.decontaminate(docs, items.limit(0)).count() == 1
