"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only. A pattern's matches and the gaps between them give code point offsets.
Every kind has a score; a checksum that holds and a word of the kind's context within
`NEARBY` characters before or after the match add to it, and a match counts at `ACCEPT`. Account
numbers have the length of their country and short cards end where Luhn holds, so what stands behind
them does not matter; both are proposed at every place, since a wrong stretch may begin before the number. The four base
kinds (email, ip, card, phone) are accepted by their own checks whatever is nearby. Possessive
patterns and \\G keep matching linear and free of recursion on long texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEARBY = 40
ACCEPT = 0.8
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    digits = F.reverse(digits_of(match))
    places = F.sequence(F.lit(1), F.length(digits))

    def term(i: Column) -> Column:
        d = F.substring(digits, i, 1).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + term(i))
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(match: Column) -> Column:
    """Whether an account number, its first four characters moved last and letters read as 10 to
    35, leaves 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    places = F.sequence(F.lit(1), F.length(moved))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, 1))
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(places, F.lit(0), step) == 1


def small_parts(match: Column) -> Column:
    """Whether every dotted part is at most 255."""
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(
        parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p.cast("int") <= 255))
    )


def digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda match: F.length(digits_of(match)).between(low, high)


def both(*checks: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def check(match: Column) -> Column:
        out = checks[0](match)
        for c in checks[1:]:
            out = out & c(match)
        return out

    return check


@dataclass(frozen=True)
class Kind:
    """A pattern with the hint a text needs to have any match, its checks and its context words."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    base_score: float
    checked_score: float = 0.0
    checksum: Callable[[Column], Column] | None = None
    context: str = ""
    context_score: float = 0.3
    #: The pattern takes one character and holds the match, which may reach over the next, in group 1.
    ahead: bool = False
    #: Patterns of what else a match may be, from its start; the first with a valid checksum counts.
    shorter: tuple[str, ...] = ()


BASE_KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: F.contains(t, F.lit("@")),
        lambda m: F.lit(True),
        1.0,
    ),
    Kind(
        "ip",
        r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
        small_parts,
        1.0,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda t: t.rlike(r"[0-9]"),
        both(digit_count(16, 19), luhn),
        1.0,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: F.contains(t, F.lit("+")),
        digit_count(8, 15),
        1.0,
    ),
)

#: Lengths of account numbers by country: the ISO 13616 registry and countries that use the form without it.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
IBAN = "|".join(
    rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}"
    for length, countries in IBAN_LENGTHS.items()
)

#: Kinds beyond the base: a checksum or a context word must carry them over ACCEPT.
MORE_KINDS = (
    Kind(
        "iban",
        rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=({IBAN})(?![A-Za-z0-9]))[A-Z]",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
        lambda m: F.lit(True),
        0.4,
        0.5,
        mod97,
        r"(?i)\b(iban|account|konto|cuenta|compte)\b",
        ahead=True,
    ),
    Kind(
        "short_card",
        r"(?<![0-9])(?=([0-9](?:[\x20-]?[0-9]){12,14})(?![0-9]))[0-9]",
        lambda t: t.rlike(r"[0-9]"),
        lambda m: F.lit(True),
        0.2,
        0.4,
        luhn,
        r"(?i)\b(card|visa|amex|credit|karte|tarjeta|carte)\b",
        ahead=True,
        shorter=tuple(rf"^[0-9](?:[\x20-]?[0-9]){{{n}}}(?![0-9])" for n in (13, 12)),
    ),
    Kind(
        "social_number",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda t: t.rlike(r"[0-9]-[0-9]"),
        lambda m: F.lit(True),
        0.5,
        context=r"(?i)\b(ssn|social|security|taxpayer)\b",
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
        lambda t: t.rlike(r"[0-9][\x20.-][0-9]"),
        lambda m: F.lit(True),
        0.5,
        context=r"(?i)\b(phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
    ),
)


def spans_of(text: Column, kind: Kind) -> Column:
    """Accepted spans of one kind, in order of their start."""
    match = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1 if kind.ahead else 0))
    gaps = F.split(text, kind.pattern, -1)
    # only what may be accepted is kept on the way: a table of numbers has a match in every cell
    def possible(hit: Column) -> Column:
        score = F.lit(kind.base_score + (kind.context_score if kind.context else 0.0))
        if kind.checksum:
            ends = F.array(hit, *[F.regexp_extract(hit, p, 0) for p in kind.shorter])
            sound = F.exists(ends, lambda e: (F.length(e) > 0) & kind.checksum(e))
            score = score + F.when(sound, kind.checked_score).otherwise(0.0)
        return (score >= ACCEPT - 1e-9) & (F.lit(True) if kind.shorter else kind.valid(hit))

    placed = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), match.alias("hit")),
        F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<hit:string,start:int,end:int>>").alias("found"),
        ),
        lambda acc, x: F.when(x["hit"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + F.length(x["gap"]) + (1 if kind.ahead else F.length(x["hit"]))).alias("at"),
                F.when(
                    possible(x["hit"]),
                    F.concat(
                        acc["found"],
                        F.array(
                            F.struct(
                                x["hit"].alias("hit"),
                                (acc["at"] + F.length(x["gap"])).alias("start"),
                                (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
                            )
                        ),
                    ),
                )
                .otherwise(acc["found"])
                .alias("found"),
            )
        ),
        lambda acc: acc["found"],
    )

    def cut(x: Column) -> Column:
        ends = F.array(x["hit"], *[F.regexp_extract(x["hit"], p, 0) for p in kind.shorter])
        sound = F.filter(ends, lambda e: (F.length(e) > 0) & kind.checksum(e))
        hit = F.coalesce(F.get(sound, F.lit(0)), x["hit"])
        return F.struct(hit.alias("hit"), x["start"], (x["start"] + F.length(hit)).alias("end"))

    def scored(x: Column) -> Column:
        score = F.lit(kind.base_score)
        if kind.checksum:
            score = score + F.when(kind.checksum(x["hit"]), kind.checked_score).otherwise(0.0)
        if kind.context:
            low = F.greatest(x["start"] - NEARBY, F.lit(0))
            before = F.substring(text, low + 1, x["start"] - low)
            near = F.concat(before, F.lit("\n"), F.substring(text, x["end"] + 1, F.lit(NEARBY)))
            score = score + F.when(near.rlike(kind.context), kind.context_score).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"), x["start"], x["end"], score.alias("score")
        )

    if kind.shorter:
        placed = F.transform(placed, cut)
    valid = F.filter(placed, lambda x: kind.valid(x["hit"]))
    accepted = F.filter(F.transform(valid, scored), lambda s: s["score"] >= ACCEPT - 1e-9)
    nothing = F.array().cast(SPAN)
    if kind.ahead:  # of spans that overlap the first counts
        accepted = F.aggregate(
            accepted.cast(SPAN),
            nothing,
            lambda acc, s: F.when(
                (F.size(acc) == 0) | (s["start"] >= F.element_at(acc, -1)["end"]),
                F.concat(acc, F.array(s)),
            ).otherwise(acc),
        )
    return F.when(kind.hint(text), accepted.cast(SPAN)).otherwise(nothing)


def with_spans(docs: DataFrame, kinds=(*BASE_KINDS, *MORE_KINDS), prefix: str = "spans_") -> DataFrame:
    """docs with a column of spans, prefix and kind, for each kind, in whole texts; null texts have none.

    Rows are judged one by one: repeated rows give repeated results, an empty table an empty one. Columns of
    docs with these names are replaced. The time for a text grows with its length and its accepted spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({f"{prefix}{k.name}": spans_of(text, k) for k in kinds})


def joined_spans(kinds) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, comma-joined."""
    every = F.concat(*[F.col(f"spans_{k.name}") for k in kinds])
    return F.array_join(
        F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redacted(docs: DataFrame, kinds=(*BASE_KINDS, *MORE_KINDS)) -> DataFrame:
    """docs with each span in the text replaced by [KIND]; overlapping spans become one, named
    by the span that starts first (the longer of two that start together). Null stays null, and all
    other columns of docs stay."""
    prefix = "spans_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    names = [f"{prefix}{k.name}" for k in kinds]
    every = F.sort_array(
        F.flatten(
            F.array(
                *[
                    F.transform(
                        n, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))
                    )
                    for n in names
                ]
            )
        )
    )
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["end"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(
            end.alias("at"),
            F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"),
        )
        longer = F.struct(F.greatest(acc["at"], end).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(longer)

    rest = F.aggregate(
        every, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    )
    clean = F.when(F.size(every) > 0, rest).otherwise(text)
    return with_spans(docs, kinds, prefix).withColumn("text", clean).drop(*names)
