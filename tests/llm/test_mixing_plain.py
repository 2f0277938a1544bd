"""The mix of single sources, computed in plain Python."""

import hashlib

from outlay.llm import mixing


def plain_mix(rows):
    """(doc_id, taken, copies) of documents with one source each."""
    sized = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in rows]
    names = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    size = [sum(n for _, s, n in sized if s == name) for name in names]
    out = []
    for name, words, target in zip(names, size, mixing.targets(size)):
        full, rest = divmod(int(target), words) if words else (0, 0)
        mine = [(hashlib.md5(f"mix{'' if i is None else i}".encode()).hexdigest(), i, n) for i, s, n in sized if s == name]
        before = 0
        for _, i, n in sorted(mine, key=lambda m: (m[0], m[1] is not None, m[1], m[2])):
            copies = full + (2 * before + n <= 2 * rest)
            out.append((i, n * copies, copies))
            before += n
    return out


def test_mix_equals_plain(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted((r["doc_id"], r["taken"]) for r in mixing.mixed(docs).collect())
    assert got == sorted((i, t) for i, t, _ in plain_mix(docs.collect()))
