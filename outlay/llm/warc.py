"""Web archives: records written by many tasks, an index merged from sorted runs, reading by index.

Writing. Every task writes its own archive files, one gzip member per record, and an index entry for
each. Entries leave a task as runs sorted by URL key and time. Of records with one payload of at least
`SMALLEST_REVISIT` bytes that with the largest page_id holds it; the others are revisit records, which
name it and hold nothing. Rows at the largest page_id all hold it, also if there are several. A null
page_id is smaller than any; null html is an empty payload, a null URL has the empty key.

Merging. Splitters cut the key space of all runs into ranges; each range takes its slice of every run
and merges the slices by a loser tree. Ranges are cut on the whole entry, so captures of one URL may
span many, and one task holds about `RANGE_ENTRIES` entries. (part, nr) is the global order.

Reading. Entries are dealt out by stretches of an archive file and read there in the order of their
offsets; a payload that does not have its digest is an error. Files of tasks that were lost are in no
entry and never read.

An empty table gives no files and no rows. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.relations import lookup
from outlay.llm.frames import kept
from outlay.sources.storage import new_folder

SMALLEST_REVISIT = 1000
#: Bytes after which a task begins a new archive file.
FILE_BYTES = 256 << 20
#: Entries that a task sorts at a time, and that a merging task holds.
RUN_ENTRIES = 100_000
RANGE_ENTRIES = 200_000
#: Packed bytes of an archive file that one group of entries reads.
STRETCH = 8 << 20

ENTRY = (
    "url_key string, at long, page_id long, kind string, record_id string, refers_id string, "
    "file string, start long, length long"
)
#: What entries are ordered by; file and start make it unique.
ORDER = ("url_key", "at", "page_id", "file", "start")


# ---- keys and records


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the last to the first, then path and sorted query. Scheme,
    user, port, fragment, a leading www and the slash at the end do not count."""
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?", (url or "").strip())
    if not found:
        return (url or "").strip().partition("#")[0]
    place, path, query = found.groups()
    host = place.rpartition("@")[2].lower()
    if not host.startswith("["):
        host = re.sub(r"^www\d*\.(?=.)", "", host.partition(":")[0].strip("."))
        host = ",".join(reversed(host.split(".")))
    words = "&".join(sorted((query or "").split("&")))
    return f"{host}){path.rstrip('/') or '/'}" + (f"?{words}" if words else "")


def record_bytes(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def parsed_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not gap or not version.startswith("WARC/"):
        raise ValueError("no WARC record where the index names one")
    fields = (line.partition(":") for line in lines)
    headers = {name.strip().lower(): value.strip() for name, _, value in fields}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record ends elsewhere than its length says")
    return headers, rest[:size]


def _header_safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def _time(seconds: int) -> str:
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _warc_record(row: dict) -> bytes:
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    headers = [
        ("WARC-Type", row["kind"]),
        ("WARC-Record-ID", f"<urn:uuid:{row['record_id']}>"),
        ("WARC-Date", _time(row["at"])),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", _header_safe(row["url"])))
    if row["page_id"] is not None:
        headers.append(("X-Page-Id", str(row["page_id"])))
    if row["kind"] == "revisit":
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        headers.append(("WARC-Refers-To", f"<urn:uuid:{row['refers_id']}>"))
        return record_bytes(headers, b"")
    payload = row["payload"]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return record_bytes(headers, http + payload)


def _opened(folder: str):
    """The file system of a folder, for use in tasks, and the folder's path in it."""
    return arrow_fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


# ---- planning what to write


def capture_time(page_id: Column) -> Column:
    """Seconds since 1970 for tables without a capture time: one second per page_id from 2024 on."""
    return F.lit(1_704_067_200).cast("long") + F.pmod(F.coalesce(page_id, F.lit(0)).cast("long"), F.lit(100_000_000).cast("long"))


def _record_id(kind: str, page_id: Column, key: Column) -> Column:
    hashed = F.md5(F.concat(F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(":"), F.hex(key)))
    return F.regexp_replace(hashed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _keyed(pages: DataFrame, at: Column) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", at.alias("at"), payload.alias("payload"))
    return rows.withColumns(
        {
            "size": F.octet_length("payload"),
            "digest": F.sha1("payload"),
            "key": F.unhex(F.sha2("payload", 256)),
        }
    )


def revisits(pages: DataFrame, at: Column) -> DataFrame:
    """Rows whose payload a larger page_id holds, without their payload: page_id, url, at, digest, key,
    refers_to. Written once, since the responses are all rows but these."""
    large = _keyed(pages, at).where(F.col("size") >= SMALLEST_REVISIT).drop("payload", "size")
    best = large.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
    several = best.where("copies > 1").select(F.col("key").alias("held"), "refers_to")
    marked = lookup(large, several, {"held": F.col("key")})
    return kept(marked.where("refers_to is not null and not (page_id <=> refers_to)"), "warc-revisits")


def records(pages: DataFrame, at: Column | None = None) -> DataFrame:
    """One row per record to write; a revisit has no payload. A null time counts as 1970."""
    at = capture_time(F.col("page_id")) if at is None else F.coalesce(at, F.lit(0)).cast("long")
    again = revisits(pages, at)
    every = _keyed(pages, at)
    gone = again.select(F.col("key").alias("gone_key"), F.col("page_id").alias("gone_id"))
    same = (F.col("key") == F.col("gone_key")) & F.col("page_id").eqNullSafe(F.col("gone_id"))
    first = every.join(gone, same, "left_anti")
    shape = ("page_id", "url", "at", "digest", "kind", "record_id", "refers_id", "payload")
    responses = first.withColumns(
        {
            "kind": F.lit("response"),
            "record_id": _record_id("response", F.col("page_id"), F.col("key")),
            "refers_id": F.lit(None).cast("string"),
        }
    )
    repeats = again.withColumns(
        {
            "kind": F.lit("revisit"),
            "record_id": _record_id("revisit", F.col("page_id"), F.col("key")),
            "refers_id": _record_id("response", F.col("refers_to"), F.col("key")),
            "payload": F.lit(None).cast("binary"),
        }
    )
    return responses.select(*shape).unionByName(repeats.select(*shape))


# ---- writing, merging, reading


def sort_key(entry: dict) -> tuple:
    return entry["url_key"], entry["at"], entry["page_id"] is not None, entry["page_id"] or 0, entry["file"], entry["start"]


def write_archives(to_write: DataFrame, folder: str) -> DataFrame:
    """Write the records below the folder; returns the index as sorted runs: entries with run and pos."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files, runs, out, held = uuid.uuid4().hex, 0, 0, None, []
        system, path = _opened(folder)

        def run() -> pa.RecordBatch:
            nonlocal held, runs
            held.sort(key=sort_key)
            named = [{**e, "run": f"{task}-{runs}", "pos": pos} for pos, e in enumerate(held)]
            held, runs = [], runs + 1
            return pa.RecordBatch.from_pylist(named, schema=shape)

        try:
            for batch in batches:
                columns = {name: batch.column(name) for name in batch.schema.names}
                for i in range(batch.num_rows):
                    row = {name: column[i].as_py() for name, column in columns.items()}
                    if out is None:
                        system.create_dir(path, recursive=True)
                        file, files, start = f"{task}-{files}.warc.gz", files + 1, 0
                        out = system.open_output_stream(f"{path}/{file}", compression=None)
                    packer = zlib.compressobj(wbits=31)
                    member = packer.compress(_warc_record(row)) + packer.flush()
                    out.write(member)
                    entry = {f: row[f] for f in ("at", "page_id", "kind", "record_id", "refers_id")}
                    held.append({**entry, "url_key": url_key(row["url"]), "file": file, "start": start, "length": len(member)})
                    start += len(member)
                    if start >= FILE_BYTES:
                        out.close()
                        out = None
                    if len(held) >= RUN_ENTRIES:
                        yield run()
        finally:
            if out is not None:
                out.close()
        if held:
            yield run()

    longs = ("at", "page_id", "start", "length", "pos")
    names = [f.strip().split()[0] for f in f"{ENTRY}, run string, pos long".split(",")]
    shape = pa.schema([(n, pa.int64() if n in longs else pa.string()) for n in names])
    return kept(to_write.mapInArrow(write, f"{ENTRY}, run string, pos long"), "warc-runs")


class LoserTree:
    """Merges sorted iterators. Inner nodes hold the loser of their match, so the next winner takes one
    comparison per level, along the path of the iterator that won last."""

    def __init__(self, sources: list[Iterator], key: Callable):
        self.sources, self.key, self.n = sources, key, max(len(sources), 1)
        self.heads: list = [None] * self.n
        for i in range(len(sources)):
            self._advance(i)
        # leaf i is node n + i; a match is played once both sides have their winner
        self.losers = [0] * self.n
        winners = list(range(self.n)) * 2
        for node in range(self.n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.n > 1 else 0

    def _advance(self, i: int) -> None:
        item = next(self.sources[i], None)
        self.heads[i] = None if item is None else (self.key(item), i, item)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            last = self.winner
            yield self.heads[last][2]
            self._advance(last)
            node = (self.n + last) // 2
            while node:
                if self._before(self.losers[node], self.winner):
                    self.winner, self.losers[node] = self.losers[node], self.winner
                node //= 2


def _slices(batches: Iterator[pa.RecordBatch]) -> list[list[dict]]:
    """The entries of one range, by run."""
    found: list[list[dict]] = []
    run = None
    for batch in batches:
        for entry in batch.to_pylist():
            if entry["run"] != run:
                run = entry["run"]
                found.append([])
            found[-1].append(entry)
    return found


def merged_index(runs: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """All runs as one index in the order of URL key and time: entries with part and nr."""
    ranges = max(1, math.ceil(runs.count() / range_entries))
    dealt = runs.repartitionByRange(ranges, *ORDER).sortWithinPartitions("run", "pos")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = _slices(batches)
        tree = LoserTree([iter(s) for s in slices], sort_key)
        buffer: list[dict] = []
        for nr, entry in enumerate(tree):
            buffer.append({**{n: entry[n] for n in names}, "nr": nr})
            if len(buffer) == 10_000:
                yield pa.RecordBatch.from_pylist(buffer, schema=shape)
                buffer = []
        if buffer:
            yield pa.RecordBatch.from_pylist(buffer, schema=shape)

    longs = ("at", "page_id", "start", "length", "nr")
    names = [f.strip().split()[0] for f in ENTRY.split(",")]
    shape = pa.schema([(n, pa.int64() if n in longs else pa.string()) for n in [*names, "nr"]])
    return dealt.mapInArrow(merge, f"{ENTRY}, nr long").withColumn("part", F.spark_partition_id())


def histories(index: DataFrame) -> DataFrame:
    """One row per URL key: its captures, the first and last time, and how many records are revisits."""
    return index.groupBy("url_key").agg(
        F.count("*").alias("captures"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.count(F.when(F.col("kind") == "revisit", 1)).alias("revisits"),
    )


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """What the archives hold for the entries: record_id, page_id, record_type, refers_id, payload
    (null for a revisit), payload_digest. A payload without its digest is an error."""
    fields = "record_id string, page_id long, record_type string, refers_id string, payload binary, payload_digest string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        name, file = None, None
        try:
            for batch in batches:
                found: list[dict] = []
                size = 0
                for entry in batch.to_pylist():
                    if entry["file"] != name:
                        if file is not None:
                            file.close()
                        name, file = entry["file"], system.open_input_file(f"{path}/{entry['file']}")
                    file.seek(entry["start"])
                    headers, block = parsed_record(zlib.decompress(file.read(entry["length"]), wbits=31))
                    found.append(_read_row(headers, block))
                    size += len(block)
                    if size > 32 << 20:
                        yield pa.RecordBatch.from_pylist(found, schema=shape)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=shape)
        finally:
            if file is not None:
                file.close()

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    shape = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in fields.split(", "))])
    # entries are small, what they read is not: the number of tasks follows the bytes of the archives
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(total / STRETCH))
    stretch = F.shiftright("start", STRETCH.bit_length() - 1)
    dealt = index.select("file", "start", "length").repartition(tasks, "file", stretch)
    return dealt.sortWithinPartitions("file", "start").mapInArrow(read, fields)


def _read_row(headers: dict[str, str], block: bytes) -> dict:
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind, payload = headers["warc-type"], None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {headers['warc-record-id']} does not have its digest")
    refers = headers.get("warc-refers-to")
    return {
        "record_id": headers["warc-record-id"][10:-1],
        "page_id": int(headers["x-page-id"]) if "x-page-id" in headers else None,
        "record_type": kind,
        "refers_id": refers[10:-1] if refers else None,
        "payload": payload,
        "payload_digest": digest,
    }


def resolved(read: DataFrame) -> DataFrame:
    """Records with their payload's size, and for a revisit the page_id and size of the record that it
    refers to. The payloads end here."""
    rows = kept(read.withColumn("size", F.octet_length("payload").cast("long")).drop("payload"), "warc-read")
    held = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("held_id")).agg(
        F.max("page_id").alias("refers_to"), F.max("size").alias("held_size")
    )
    found = lookup(rows, held, {"held_id": F.col("refers_id")})
    return found.select(
        "page_id",
        F.coalesce("size", "held_size").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


def archived(pages: DataFrame, at: Column | None = None, folder: str | None = None) -> DataFrame:
    """Write the pages as archives, merge their index, and read them back through it."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    runs = write_archives(records(pages, at), folder)
    index = kept(merged_index(runs), "warc-index")
    return resolved(read_records(index, folder))
