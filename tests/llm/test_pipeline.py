"""Stages against plain versions of what they decide."""

import corpus_pipeline
from outlay.llm import quality

from test_mixing_plain import plain_mix
from test_neardup import brute, shingle_set
from test_pii import base_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_dedup(rows):
    """Of each class of (id, text) rows the one with the least id."""
    firsts = {}
    for (i, text), (_, c, _) in zip(rows, brute(rows)):
        key = ("class", c) if shingle_set(text) else ("alone", i)
        if i == c and key not in firsts:
            firsts[key] = i
    return set(firsts.values())


def test_every_stage_on_the_small_tables(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "decontamination", "personal_data", "mixing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns

    good = stages["quality"](spark, docs, small)
    assert good.columns == columns
    scores = quality.scored(docs.select("doc_id", "text"), spark.read.parquet(f"{small}/labels.parquet"))
    want = {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    good = spark.createDataFrame(good.collect(), SCHEMA)
    assert {r["doc_id"] for r in good.collect()} == want

    single = spark.createDataFrame(stages["near_copies"](spark, good, small).collect(), SCHEMA)
    assert single.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(plain_dedup(rows))

    clean = spark.createDataFrame(stages["decontamination"](spark, single, small).collect(), SCHEMA)
    items = [shingle_set(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = {
        r["doc_id"]
        for r in single.collect()
        if not any(s and len(s & shingle_set(r["text"])) >= 0.8 * len(s) - 1e-9 for s in items)
    }
    assert clean.columns == columns
    assert {r["doc_id"] for r in clean.collect()} == kept
    assert len(kept) < single.count()

    safe = spark.createDataFrame(stages["personal_data"](spark, clean, small).collect(), SCHEMA)
    assert safe.columns == columns
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    after = {r["doc_id"]: r for r in safe.collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert (after[i]["text"] == text) == (not base_spans(text)) or not base_spans(text)
        assert not base_spans(after[i]["text"])
        assert after[i]["n_chars"] == len(after[i]["text"])

    mix = stages["mixing"](spark, safe, small).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in mix if r["size"]) == sorted(
        (i, taken) for i, taken, copies in plain_mix(after.values()) if copies and taken
    )


def test_run_equals_its_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = corpus_pipeline.run(spark, small)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_odd_rows_pass_all_stages(spark, small):
    rows = [
        (1, None, None, None, None),
        (1, None, None, None, None),
        (None, "", "en", "a", 0),
        (2, "w " * 30000, "en", None, 5),
        (3, "Short but fine text here.", "en", "a", 1),
        (3, "Short but fine text here.", "en", "a", 1),
    ]
    docs = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", score int")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, small)
            if name != "mixing":
                assert out.columns == docs.columns
            frame = spark.createDataFrame(out.collect(), out.schema)
