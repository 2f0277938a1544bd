"""The fitted densities against numpy, held-out accuracy, and odd rows."""

import zlib

import numpy as np

from outlay.llm import quality, queries


def test_log_densities_equal_numpy(spark):
    rng = np.random.default_rng(3)
    d = len(quality.FEATURES)
    rows = [(int(i % 3 == 0), *map(float, rng.normal(i % 3, 1 + i % 2, d))) for i in range(400)]
    frame = spark.createDataFrame(rows, ["label", *quality.FEATURES])
    model = quality.fit(frame)
    x, label = np.array([r[1:] for r in rows]), np.array([r[0] for r in rows])
    covs = {c: np.cov(x[label == c].T, bias=True) for c in (0, 1)}
    share = {c: (label == c).mean() for c in (0, 1)}
    pooled = sum(share[c] * covs[c] for c in (0, 1))
    log = {}
    for c in (0, 1):
        n = (label == c).sum()
        w = max(quality.SHRINKAGE, d / (d + n))
        shrunk = (1 - w) * covs[c] + w * np.diag(np.diag(pooled))
        delta = x - x[label == c].mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", delta, np.linalg.inv(shrunk), delta)
        log[c] = np.log(share[c]) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * distance
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))
    got = np.array([r[0] for r in frame.select(quality.score(model)).collect()])
    assert np.allclose(got, want, atol=1e-9)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op3_quality_classifier(spark, sf_dir).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    right = [rows[x["doc_id"]]["predicted"] == x["quality"] for x in labels if rows[x["doc_id"]]["held_out"]]
    assert len(right) > 50 and sum(right) / len(right) >= 0.95


def frames(spark, texts, labels):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in texts], "doc_id long, text string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, lang string")


def test_odd_rows(spark):
    texts = [(i, "good words stand here " * (i % 5 + 1)) for i in range(40)]
    texts += [(100 + i, "### $$$ %%% " * (i % 5 + 1)) for i in range(40)]
    texts += [(None, "x"), (1, None), (2, ""), (2, ""), (3, "w " * 30000)]
    labels = [(i, 1, None) for i in range(40)] + [(100 + i, 0, None) for i in range(40)]
    labels += [(1, None, "a"), (None, 1, "a"), (5, 7, "a"), (6, 1, "a"), (6, 1, "b")]
    got = quality.scored(*frames(spark, texts, labels)).collect()
    assert len(got) == len(texts)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[None][0]["held_out"] is True
    assert by[2][0]["score"] == by[2][1]["score"] or len({r["score"] for r in by[2]}) == 2
    assert sum(by[i][-1]["predicted"] for i in range(10, 40)) >= 28
    assert sum(by[100 + i][0]["predicted"] for i in range(40)) <= 2
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)


def test_without_labels_everything_is_kept(spark):
    docs, labels = frames(spark, [(1, "a b"), (2, None)], [(1, 1, "x")])
    assert [r["predicted"] for r in quality.scored(docs, labels.limit(0)).collect()] == [1, 1]
    assert quality.scored(docs.limit(0), labels).collect() == []
