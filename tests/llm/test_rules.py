"""Statistics against plain counting; the cascade's order changes cost, not verdicts."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from outlay.llm import queries, rules


def plain(text):
    text = text or ""
    words = [w for w in text.replace("\x0b", " ").replace("\x0c", " ").translate({0x1C: "x", 0x85: "x"}).split(" ")]
    words = [w for part in words for w in part.split("\n") for w in w.split("\t") for w in w.split("\r") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {
        i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)
    }
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words),
        sum(c not in " \t\n\x0b\x0c\r" for c in text),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id int, text string, n_words int")
    for r in rules.statistics(docs).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == plain(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_statistics(spark):
    check(
        spark,
        [
            None, "", " \n\t", "a", "a a a", "a a a a", "a b c a b c", "a b c d\na b c d\n\n \na b c d",
            "é#ü$ <x> |\x0b\x0cy\r\n", "a b " * 20000, "one " * 3 + "two three four " * 2,
        ],
    )


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \n#é", max_size=60), min_size=20, max_size=20))
def test_statistics_of_random_texts(spark, texts):
    check(spark, texts)


def test_order_and_short_circuit(spark):
    docs = spark.range(1000).select("id", F.lit("t").alias("text"))
    cheap = rules.Rule("cheap", F.col("id") % 2 == 0)
    rare = rules.Rule("rare", F.col("id") % 100 == 0)
    measured = [rules.Measured(rare, 1.0, 10), rules.Measured(cheap, 0.5, 500), rules.Measured(rare, 0.0, 0)]
    assert [r.name for r in rules.ordered(measured)] == ["cheap", "rare", "rare"]
    # a later rule is not evaluated where an earlier one rejects: it would fail there
    guarded = rules.Rule("guarded", F.raise_error("evaluated").cast("boolean"))
    all_gone = rules.Rule("all", F.lit(True) & (F.col("id") >= 0))
    got = docs.select(rules.cascade([all_gone, guarded]).alias("by")).distinct().collect()
    assert [r["by"] for r in got] == ["all"]
    one, two = (docs.where(rules.cascade(o).isNull()).count() for o in ([cheap, rare], [rare, cheap]))
    assert one == two == 500


def test_verdicts(spark):
    good = " ".join(f"word{i} stands" for i in range(60))
    texts = [good, "few words", "same three words " * 40, good + "".join(f" ##w{i}#" for i in range(60)), good.replace(" ", "x"), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rules.judged(docs, report=rules.STATISTICS).collect()}
    assert got == {0: (False, True), 1: (True, False), 2: (True, False), 3: (False, False), 4: (True, False), 5: (True, False)}
    assert rules.judged(docs.limit(0)).collect() == []


def test_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op5_quality_rules(spark, small).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == plain(docs[r["doc_id"]])
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r["kept"] and r["base_failed"])


def test_lazy_statistics_give_the_same_verdicts(spark):
    line = " ".join(f"word{chr(97 + i % 26)} is no{i}" for i in range(60))
    texts = {
        "": line, "few_words": "a b", "repeated_words": "same three words " * 40,
        "mean_word_length": line.replace(" word", "word" * 30), "symbols": line + " #%$" * 40,
        "duplicate_lines": "x one\n" * 4 + line, "letters": line + " 12-34" * 400,
        "capitals": line.upper(), "ellipsis_lines": line + "...", "bullet_lines": " - " + line,
    }
    docs = spark.createDataFrame([(k, t, 7) for k, t in texts.items()], "name string, text string, _Words int")
    lazy = rules.judged(docs)
    assert lazy.columns == ["name", "text", "_Words", "rejected_by", "kept"]
    got = {r["name"]: r["kept"] for r in lazy.collect()}
    full = {r["name"]: r["kept"] for r in rules.judged(docs, report=rules.STATISTICS).collect()}
    assert got == full and [k for k, v in got.items() if v] == [""]
    # each rule by itself rejects the text that bears its name
    words = docs.withColumn("w", rules.words_of(F.col("text")))
    stat = rules.expressions(F.col("text"), F.col("w"))
    for rule in rules.default_rules(stat, F.col("w")):
        if rule.name in texts and rule.name:
            assert words.where(F.col("name") == rule.name).where(rule.fails).count() == 1, rule.name


def test_a_rule_is_timed_with_its_statistic(spark):
    docs = spark.range(400).select("id", F.repeat(F.lit("some words here "), 300).alias("text"))
    stat = rules.expressions(F.col("text"), rules.words_of(F.col("text")))
    slow, fast = rules.Rule("slow", stat["n_repeat_words"] > 5), rules.Rule("fast", F.col("id") >= 0)
    measured = {m.rule.name: m for m in rules.measure(docs, [slow, fast])}
    assert measured["slow"].rejected == measured["fast"].rejected == 400
    assert measured["slow"].seconds > measured["fast"].seconds
