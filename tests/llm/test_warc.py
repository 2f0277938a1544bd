"""Archives against a plain reading of the pages, the merge against sorting."""

import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from outlay.llm import warc

SCHEMA = "page_id long, url string, html string, key string, size int, payload string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)


def brute(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        again = len(payload) >= 1000 and bool(same) and page != max(same)
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=repr)


def odd_pages():
    big, long = "é" * 600, "<p>x\r\n\r\n" * 200_000
    return [
        (1, "http://a.example/x", big), (2, "http://a.example/x", big), (3, None, big), (None, "http://b.example", big),
        (4, "http://a.example/y", "small"), (5, "http://a.example/y", "small"), (6, "", None), (7, "not a url\r\nX: y", ""),
        (8, "//c.example", long), (9, "http://[::1", "b" * 999), (10, "http://[::1]/", "b" * 999), (11, "u", "c" * 1000),
        (12, "u", "c" * 1000), (12, "v", "c" * 1000), (12, "v", "c" * 1000), (None, None, "d" * 2000), (None, "w", "d" * 2000),
        (-5, "http://a.example/ ", "WARC/1.1\r\n\r\n" * 100), (2**62, "http://a.example/z", "z" * 1500), (0, "q", "z" * 1500),
    ]


def test_archives_of_odd_pages(spark):
    rows = odd_pages()
    got = [tuple(r) for r in warc.archived(frame(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_empty_table(spark):
    assert warc.archived(frame(spark, [])).collect() == []


def test_files_hold_whole_records(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example/{i % 3}", "t" * (i * 37)) for i in range(200)]
    warc.archived(frame(spark, rows).repartition(4), folder=str(tmp_path)).collect()
    texts = [gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/*.warc.gz")]
    assert sum(t.count(b"WARC/1.1\r\nWARC-Type: response") for t in texts) == 200
    assert any(b"WARC-Target-URI: http://h1.example/1\r\n" in t for t in texts)


def test_index_is_in_global_order_over_ranges(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([None, i]), rng.choice(["http://hot.example/", f"http://h{i % 50}.example/p"]), f"{i}") for i in range(3000)]
    runs = warc.write_archives(warc.records(frame(spark, rows).repartition(5), F.lit(7).cast("long") + F.col("page_id") % 11), str(tmp_path))
    index = warc.merged_index(runs, range_entries=400).orderBy("part", "nr").collect()
    assert len(index) == 3000 and len({r["part"] for r in index}) > 4
    keys = [warc.sort_key({**r.asDict(), "at": r["at"] or 0}) for r in index]
    assert keys == sorted(keys) and len(set(keys)) == 3000
    hot = [r for r in warc.histories(warc.merged_index(runs)).collect() if r["url_key"] == "example,hot)/"]
    assert hot[0]["captures"] == sum("hot" in r[1] for r in rows)


def test_a_damaged_archive_is_an_error(spark, tmp_path):
    runs = warc.write_archives(warc.records(frame(spark, [(1, "u", "one")])), str(tmp_path))
    entry = runs.first()
    path = f"{tmp_path}/{entry['file']}"
    data = gzip.decompress(open(path, "rb").read()).replace(b"\r\n\r\none\r\n", b"\r\n\r\ntwo\r\n")
    packed = gzip.compress(data)
    open(path, "wb").write(packed)
    moved = runs.withColumn("length", F.lit(len(packed)).cast("long"))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_records(moved, str(tmp_path)).collect()


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize(
    "url, key",
    [
        (None, ""), ("", ""), ("http://www.Example.com:80/a/?b=2&a=1#f", "com,example)/a?a=1&b=2"), ("https://example.com", "com,example)/"),
        ("//u:p@x.y.z/p/", "z,y,x)/p"), ("http://[::1]:8/", "[::1]:8)/"), ("http://[::1", "[::1)/"), ("mailto:a#b", "mailto:a"), ("http://www./", "www)/"),
    ],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key
