"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a text by a condition that holds the statistic it needs. The cascade times every rule, its
statistic included, and counts its rejections on a sample, orders the rules by rejections per second and
evaluates them one after the other, each only for texts that all before it have passed: a statistic is
computed where its rule is reached, and never for texts that are rejected before. Statistics that the
caller wants for every row are computed once for all rows, and cost their rules nothing more. The order
changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.llm.frames import kept

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SAMPLE_ROWS = 2000


def words_of(text: Column) -> Column:
    """Words of a text without the blanks around them; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def word_chars(text: Column) -> Column:
    rest = F.coalesce(text, F.lit(""))
    for blank in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        rest = F.replace(rest, F.lit(blank), F.lit(""))
    return F.length(rest).cast("long")


def symbol_count(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    )
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words in windows of `width` words found twice or more in the text, the first included."""
    # the words are bound once, so that an inlined split is not run again for every window
    return F.transform(F.array(words), lambda held: _repeated(held, width))[0]


def _repeated(words: Column, width: int) -> Column:
    """As repeated_words, of words that cost nothing to name again.

    Windows are sorted as (hash, place); those with an equal neighbour are found again. Their places,
    sorted, cover min(width, distance to the one before) new words each.
    """
    places = F.sequence(F.lit(0), F.size(words) - width)
    windows = F.sort_array(
        F.transform(
            places,
            lambda p: F.struct(
                F.xxhash64(*[F.get(words, p + i) for i in range(width)]).alias("h"), p.alias("p")
            ),
        )
    )

    def again(windows: Column) -> Column:
        hit = F.filter(
            windows,
            lambda x, i: (x["h"] == F.get(windows, i - 1)["h"])
            | (x["h"] == F.get(windows, i + 1)["h"]),
        )
        return F.sort_array(F.transform(hit, lambda x: x["p"]))

    covered = F.aggregate(
        F.transform(F.array(windows), again)[0],
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
        lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(width), p - acc["last"])).cast("long").alias("n"),
            p.alias("last"),
        ),
        lambda acc: acc["n"],
    )
    return F.when(F.size(words) > width, covered).otherwise(F.lit(0).cast("long"))


@dataclass(frozen=True)
class Rule:
    """Rejects where `fails` is true; a null counts as passed."""

    name: str
    fails: Column


def unused(docs: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of docs has it."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def expressions(text: Column, words: Column) -> dict[str, Column]:
    """The statistics of a text by name."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": word_chars(text),
        "n_symbols": symbol_count(text),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(words),
    }


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, names: Sequence[str] = STATISTICS) -> DataFrame:
    """docs with the named ones of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the text.

    Columns of docs with these names are replaced. Null and empty texts count no words.
    """
    words = unused(docs, "_words")
    found = expressions(F.col("text"), F.col(words))
    return (
        docs.withColumn(words, words_of(F.col("text")))
        .withColumns({name: found[name] for name in names})
        .drop(words)
    )


def base_rules(stat: Mapping[str, Column]) -> list[Rule]:
    n = stat["n_words"]
    return [Rule("few_words", n < 50), Rule("repeated_words", stat["n_repeat_words"] * 100 > n * 50)]


def default_rules(stat: Mapping[str, Column], words: Column) -> list[Rule]:
    """The base rules and those beside them; each names its costly statistic once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n, lines = stat["n_words"], F.split(text, "\n")

    def without(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    return [
        *base_rules(stat),
        # under 2 or over 20 characters a word
        Rule("mean_word_length", F.abs(stat["word_chars"] - n * 11) > n * 9),
        Rule("symbols", stat["n_symbols"] * 5 > n * 2),
        Rule("duplicate_lines", stat["n_dup_lines"] * 2 > F.size(lines)),
        Rule("letters", without(r"\p{L}+") * 2 > F.length(text)),
        # more than 30 per cent digits
        Rule("digits", without("[0-9]+") * 10 < F.length(text) * 7),
        # more than half capitals
        Rule("capitals", without("[A-Z]+") * 2 < F.length(text)),
        Rule("words_without_letter", F.size(F.filter(words, lambda w: ~w.rlike(r"\p{L}"))) * 2 > n),
        # more than 30 per cent of the lines break off
        Rule("ellipsis_lines", F.size(F.filter(lines, lambda x: F.endswith(x, F.lit("...")))) * 10 > F.size(lines) * 3),
        # more than 90 per cent of the lines are items
        Rule("bullet_lines", F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\t]*[-*\x{2022}]"))) * 10 > F.size(lines) * 9),
    ]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def measure(
    docs: DataFrame,
    rules: Sequence[Rule],
    sample_rows: int = SAMPLE_ROWS,
    repeats: int = 2,
    prepared: Callable[[DataFrame], DataFrame] = lambda sample: sample,
) -> list[Measured]:
    """Cost and rejections of each rule on a sample of about `sample_rows` rows of docs.

    The sample is written once, with the columns that `prepared` adds to its rows alone. A rule's cost is the least time of a job that evaluates it on every sampled
    row, statistic included, less that of a job without a rule, and a millisecond at least. It only decides
    the order of the rules.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = kept(prepared(docs.sample(fraction=share, seed=7)), "rule-sample")

    def timed(fails: Column) -> tuple[float, int]:
        times, rejected = [], 0
        for _ in range(repeats):
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(fails)).first()[0]
            times.append(time.perf_counter() - began)
        return min(times), rejected

    # the row's own text is read without a rule too
    empty, _ = timed(F.octet_length("text") < 0)
    found = []
    for rule in rules:
        seconds, rejected = timed(rule.fails)
        found.append(Measured(rule, max(seconds - empty, 1e-3), rejected))
    return found


def ordered(measured: Sequence[Measured]) -> list[Rule]:
    return [m.rule for m in sorted(measured, key=lambda m: (-m.worth, m.rule.name))]


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated then."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.fails, F.lit(rule.name)).otherwise(verdict)
    return verdict


def judged(
    docs: DataFrame,
    rules: Sequence[Rule] | None = None,
    report: Sequence[str] = (),
) -> DataFrame:
    """docs with the reported statistics, rejected_by and kept; given both base statistics, also base_failed.

    rules: conditions over columns of docs; by default `default_rules`, whose first two are the base
    (under 50 words, or more than half of the words in repeated windows). report: names of statistics that
    are computed for every row. rejected_by names the first rule of the measured order that rejects. Every row
    is judged by itself, so repeated rows, ties and null ids need no rule. Columns of docs with the added
    names are replaced.
    """
    words = unused(docs, "_words")
    reported = [name for name in STATISTICS if name in report]

    def cascade_rules() -> list[Rule]:
        """The rules over a frame whose words and reported statistics are columns."""
        if rules is not None:
            return list(rules)
        stat = expressions(F.col("text"), F.col(words))
        return default_rules(stat | {name: F.col(name) for name in reported}, F.col(words))

    def prepared(frame: DataFrame) -> DataFrame:
        found = expressions(F.col("text"), F.col(words))
        frame = frame.withColumn(words, words_of(F.col("text")))
        return frame.withColumns({name: found[name] for name in reported})

    order = ordered(measure(docs, cascade_rules(), prepared=prepared))
    out = prepared(docs).withColumn("rejected_by", cascade(order)).withColumn("kept", F.col("rejected_by").isNull())
    if {"n_words", "n_repeat_words"} <= set(reported):
        base = base_rules({name: F.col(name) for name in reported})
        out = out.withColumn("base_failed", base[0].fails | base[1].fails)
    return out.drop(words)
