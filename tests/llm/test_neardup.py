"""Classes and link counts against all pairs compared one by one."""

import random

from outlay.llm import neardup, queries


def shingle_set(text):
    w = (text or "").split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """(doc_id, class_id, n_links) per row, by comparing every pair that shares a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    links = [set() for _ in rows]
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x]} - {i}:
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both) - 1e-9:
                links[i].add(j)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            out[j] = (rows[j][0], min(ids) if ids else None, len(links[j]))
    return out


def key(r):
    return tuple(-1 if x is None else x for x in r)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, class_id long")
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in neardup.classes(docs, **options).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_depth_shortens_until_the_recall_is_met():
    depth = neardup.matched_depth(0.8, 32, 8, 0.99999)
    assert neardup.meeting_probability(0.8, 32, depth) >= 0.99999
    assert neardup.meeting_probability(0.8, 32, depth + 1) < 0.99999


def test_small_cases(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (2, " ".join(base)), (None, " ".join(base))]
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((10 + i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "a b"), (104, "a  b"), (105, "b a"), (None, "z z z z z")]
    rows += [(110, "a b " * 3000), (111, "a b " * 3001), (112, "a b a b a b a b")]
    check(spark, rows)


def test_clusters_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_components_of_stars_chains_and_loops(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (300, 301), (301, 300)]
    edges += [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    nodes = sorted({x for e in edges for x in e} | {999})
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = neardup.components(
        spark.createDataFrame(edges, "a long, b long"),
        spark.createDataFrame([(n,) for n in nodes], "node long"),
        "test",
    )
    assert {r["node"]: r["root"] for r in got.collect()} == root


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(docs).collect() == []
    assert neardup.deduplicated(docs).collect() == []


def test_query_equals_all_pairs(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op10_ngram_jaccard_join(spark, small).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_a_chain_of_homes(spark, monkeypatch):
    """Texts that drift: neighbours are linked, the ends are not alike, and homes differ along the way."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    w = [rng.choice(words) for _ in range(100)]
    rows = []
    for i in range(120):
        w = w[3:] + [rng.choice(words) for _ in range(3)]
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_a_column_named_like_the_row_key(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (2, "a  b c", 6)], "doc_id long, text string, _ROW int")
    got = neardup.deduplicated(docs)
    assert [tuple(r) for r in got.collect()] == [(1, "a b c", 5)] and got.columns == docs.columns


def test_what_blocks_return_grows_with_the_sets(spark, monkeypatch):
    """One large group of near copies: a row of links per set, and few edges per pair of blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for i in range(100):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    stored, kept = {}, neardup.kept

    def counted(df, label):
        out = kept(df, label)
        stored[label] = out.count()
        return out

    monkeypatch.setattr(neardup, "kept", counted)
    check(spark, rows)
    pairs = stored["met-blocks"]
    assert stored["placed"] == 100 and pairs > 100
    assert stored["compared"] <= 2 * 100 + 2 * pairs
