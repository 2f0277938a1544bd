"""Spans against Python's regular expressions and plain checks."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from outlay.llm import pii, queries


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        lambda m: all(int(p) <= 255 for p in m.split(".")),
    ),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m)),
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
}


def base_spans(text):
    out = []
    for kind, (pattern, ok) in BASE.items():
        for m in re.finditer(pattern, text or ""):
            if ok(m.group()):
                out.append((kind, m.start(), m.end()))
    return out


def spans_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    rows = pii.with_spans(docs).select(
        "doc_id",
        pii.joined_spans(pii.BASE_KINDS).alias("base"),
        pii.joined_spans(pii.MORE_KINDS).alias("more"),
    )
    return {r["doc_id"]: (r["base"], r["more"]) for r in rows.collect()}


CASES = [
    None,
    "",
    "a@b@c.d a@b.com_x@y.z a@b..c @x.y x@y.z.",
    "é😀 me@site.org und +49 (0)30 1234-567 +1(2)3 +12345678 1.2.3.4.5.6.7.8 256.1.1.1 007.0000255.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5",
    "1 " * 9000 + "9" * 9000 + "." * 50 + "a" * 9000 + "@" + "+1" + "(" * 900,
    "1.2.3 4.5.6.7 4.4.4.4.4 1..2.3.4",
]


def test_base_spans_equal_plain_search(spark):
    got = found(spark, CASES)
    for i, text in enumerate(CASES):
        assert got[i][0] == spans_text(base_spans(text))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="a.@1+- (4é_%,2", max_size=60), min_size=20, max_size=20))
def test_base_spans_of_random_texts(spark, texts):
    got = found(spark, texts)
    for i, text in enumerate(texts):
        assert got[i][0] == spans_text(base_spans(text))


def test_checksums_and_context_carry_further_kinds(spark):
    texts = [
        "pay to DE89 3704 0044 0532 0130 00 now",
        "pay to DE88 3704 0044 0532 0130 00 now",
        "iban DE88 3704 0044 0532 0130 00 now",
        "my card is 378282246310005",
        "number 378282246310005",
        "my ssn: 123-45-6789",
        "item 123-45-6789",
        "call (212) 555-0187",
        "code (212) 555-0187",
    ]
    more = {i: m for i, (_, m) in found(spark, texts).items()}
    assert more[0] == "iban:7:34"
    assert more[3] == "short_card:11:26"
    assert more[5] == "social_number:8:19"
    assert more[7].startswith("local_phone:5:")
    assert [more[i] for i in (1, 2, 4, 6, 8)] == [""] * 5


def test_numbers_hold_whatever_stands_around_them(spark):
    texts = [
        "DE89370400440532013000 The rest",
        "DE89 3704 0044 0532 0130 00 BIC COBADEFF",
        "GB82 WEST 1234 5698 7654 32 2024",
        "AT12 DE89 3704 0044 0532 0130 00 AND NO91 MORE",
        "amex card 378282246310005 2027",
        "card 3782 822463 10005 12/27",
        "card 12 3782 822463 10005-2027",
        "card 30569309025904 2027 and 4222222222222 1",
        "378282246310005 is my card",
        "123-45-6789 is my SSN",
        "(212) 555-0187 (mobile)",
        "123-45-6789" + " " * 41 + "ssn",
        "DE89370400440532013000A and DE8937040044053201300 0A",
        "é😀 NO93 8601 1117 947 MT84 MALT 0110 0001 2345 MTLC AST0 01S END",
    ]
    more = {i: m for i, (_, m) in found(spark, texts).items()}
    assert [more[i] for i in range(len(texts))] == [
        "iban:0:22",
        "iban:0:27",
        "iban:0:27",
        "iban:5:32",
        "short_card:10:25",
        "short_card:5:22",
        "short_card:8:25",
        "short_card:5:19,short_card:29:42",
        "short_card:0:15",
        "social_number:0:11",
        "local_phone:0:14",
        "",
        "",
        "iban:3:21,iban:22:60",
    ]
    docs = spark.createDataFrame([(0, texts[5]), (1, texts[13])], "doc_id int, text string")
    assert [r["text"] for r in pii.redacted(docs).orderBy("doc_id").collect()] == [
        "card [SHORT_CARD] 12/27",
        "é😀 [IBAN] [IBAN] END",
    ]


def test_redaction_merges_overlaps_and_keeps_other_columns(spark):
    docs = spark.createDataFrame(
        [(1, "x +1 (555) 010-9999 y a@b.co", 5), (1, None, 6), (None, "", 7)],
        "doc_id int, text string, kind int",
    )
    rows = sorted(pii.redacted(docs).collect(), key=lambda r: r["kind"])
    assert [r["text"] for r in rows] == ["x [PHONE] y [EMAIL]", None, ""]
    assert rows[0].asDict().keys() == {"doc_id", "text", "kind"}


def test_empty_table(spark):
    assert pii.redacted(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_query_equals_plain_search(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = {r["doc_id"]: r for r in queries.op1_pii(spark, small).collect()}
    for d in docs:
        spans = base_spans(d["text"])
        got = rows[d["doc_id"]]
        for kind in BASE:
            assert got[f"n_{kind}"] == sum(s[0] == kind for s in spans)
        assert got["base_sha256"] == hashlib.sha256(spans_text(spans).encode()).hexdigest()
        assert got["spans"].startswith(spans_text(spans))


def test_long_texts_of_numbers(spark):
    """A megabyte of single digits, one of words with some finds, and columns named like the operator's."""
    digits = "1 x " * 250_000
    words = "word " * 200_000 + "a.b@c.de 378282246310005 amex GB82 WEST 1234 5698 7654 32"
    docs = spark.createDataFrame([(1, digits, "kept"), (2, words, "kept")], "doc_id int, text string, spans_email string")
    out = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert out[1]["text"] == digits and out[1]["spans_email"] == out[2]["spans_email"] == "kept"
    assert out[2]["text"] == "word " * 200_000 + "[EMAIL] [SHORT_CARD] amex [IBAN]"
