"""Repair of conversation structure as a lightest derivation.

Items are (rows read, state): nothing yet, after a system row, after a user row, after an assistant
row. Axiom: nothing read, nothing written. Edits are the deductions: keep, rerole or delete the next row,
or insert one. Their weight function (cost plus the edit's, audit plus its letter) is superior: no result
is below its antecedent, since a longer audit sorts after its beginning. So Knuth's agenda holds: items
are popped by (cost, audit), the first pop of an item is its least weight, and the search ends when the
goal, all rows read with an empty or a completed conversation, is popped.

Long conversations are cut into blocks. A block has an item for each pair of states before and after
it, weighted by an agenda of its own, and two adjacent items deduce one over both. That is exact: of two
audits of one item with one cost neither begins the other, so joining on the right keeps their order.

Rows lie in ranges of (conversation, turn, role, start of the text), so one conversation may span many
tasks. Conversations within one range and below `LONG_ROWS` rows and `LONG_CHARS` characters are done there. The others
go a second way: texts that occur earlier by a join, one summary per piece, summaries in turn, and
their digest in one task that streams the rows, as a digest is one sequential hash.

Rows are taken by turn (nulls first), then role, then text. Null roles and texts count as one space. A role is
known by its first character; an empty role has none and cannot be kept. Columns other than conv_id, turn,
role and text are not read. A null conv_id is a conversation; an empty table has none.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlay.functions.relations import lookup
from outlay.llm.frames import kept, text_key

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
#: Rows that one agenda reads; the rows and characters of a conversation that a task holds at a time.
BLOCK = 256
LONG_ROWS = 4096
LONG_CHARS = 16 << 20
#: Characters of role and text that ranges are cut by.
CUT = 32

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row is written, which the state before it decides.
NEXT = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT_AS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
VERDICT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"

# A row of an agenda: the first character of its role, whether it must go, what keeping it costs.
Row = tuple[str, bool, int]
Weight = tuple[int, str]


# ---- agenda and items


def after_keeping(state: int, initial: str) -> int | None:
    """The state after a kept row, or None where the row may not stand."""
    kept_as = KEPT_AS.get(initial)
    if kept_as == SYSTEM:
        return SYSTEM if state == NOTHING else None
    return kept_as if kept_as is not None and NEXT[state] == kept_as else None


def agenda(rows: list[Row], start: int, ends: Iterable[int], first_only: bool) -> dict[int, Weight]:
    """Least weights of the items (all rows read, state) for the states `ends`, from `start` on; with
    first_only the search ends at the first of them."""
    ends, found = set(ends), {}
    done: set[tuple[int, int]] = set()
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    while heap:
        cost, audit, read, state = heapq.heappop(heap)
        if (read, state) in done:
            continue
        done.add((read, state))
        if read == len(rows):
            if state in ends:
                found[state] = cost, audit
                if first_only or len(found) == len(ends):
                    return found
        else:
            initial, must_go, extra = rows[read]
            heapq.heappush(heap, (cost + DELETE, audit + "D", read + 1, state))
            if not must_go:
                heapq.heappush(heap, (cost + REROLE + extra, audit + "R", read + 1, NEXT[state]))
                then = after_keeping(state, initial)
                if then is not None:
                    heapq.heappush(heap, (cost + KEEP + extra, audit + "K", read + 1, then))
        heapq.heappush(heap, (cost + INSERT, audit + "I", read, NEXT[state]))
    return found


Items = dict[int, dict[int, Weight]]


def joined(left: dict[int, Weight], right: Items) -> dict[int, Weight]:
    """Items over two adjacent stretches from those over each."""
    out: dict[int, Weight] = {}
    for middle, (cost, audit) in left.items():
        for end, (more, rest) in right.get(middle, {}).items():
            weight = (cost + more, audit + rest)
            if end not in out or weight < out[end]:
                out[end] = weight
    return out


def items_of(rows: list[Row], starts: Iterable[int]) -> Items:
    """Items over all rows for every state in `starts`, from items over their blocks."""
    every = range(4)
    found: Items = {s: {s: (0, "")} for s in starts}
    for lo in range(0, len(rows), BLOCK):
        block = rows[lo : lo + BLOCK]
        needed = {m for ends in found.values() for m in ends}
        weights = {m: agenda(block, m, every, False) for m in needed}
        found = {s: joined(ends, weights) for s, ends in found.items()}
    return found


def goal(ends: dict[int, Weight]) -> Weight:
    """The least weight of a complete conversation, inserts after the last row included."""
    closed = joined(ends, {m: agenda([], m, (NOTHING, ASSISTANT), False) for m in ends})
    return min(closed[s] for s in (NOTHING, ASSISTANT) if s in closed)


def derivation(rows: list[Row]) -> Weight:
    """Cost and audit of the cheapest repair."""
    if len(rows) <= BLOCK:
        return min(agenda(rows, NOTHING, (NOTHING, ASSISTANT), True).values())
    return goal(items_of(rows, [NOTHING])[NOTHING])


class Replay:
    """Applies an audit to the rows one after the other; gives the repaired rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _written(self, text: str, edit: str) -> tuple[str, str, str]:
        self.state = NEXT[self.state]
        return ROLE[self.state], text, edit

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._written("", "I")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._written(text, edit)
        elif edit == "K":
            self.state = KEPT_AS[role[:1]]
            yield role, text, edit


class Digest:
    def __init__(self):
        self.hash, self.gap = hashlib.sha256(), b""

    def add(self, rows: Iterable[tuple[str, str, str]]) -> None:
        for role, text, _ in rows:
            self.hash.update(self.gap + f"{role}:{text}".encode())
            self.gap = b"\n"


class Tally:
    """Counts over consecutive rows of one conversation; tallies of adjacent pieces add up."""

    FIELDS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")

    def __init__(self, **state):
        self.__dict__.update({f: 0 for f in self.FIELDS} | {"low": None, "high": None, "first": "", "last": ""} | state)

    def take(self, turn: int | None, role: str, text: str, repeated: bool) -> Row:
        """Count a row and classify it by its first fault."""
        initial, shown = role[:1], text.rstrip(BLANKS)
        blank = not shown
        duplicate = not blank and repeated
        truncated = not blank and not duplicate and shown[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        row = Tally(rows=1, first=initial, last=initial, low=turn, high=turn, turns=int(turn is not None))
        self.add(row)
        return initial, blank or duplicate, TRUNCATED if truncated else 0

    def add(self, other: "Tally") -> None:
        if self.rows and other.rows:
            self.illegal += self.last + other.first not in ("su", "ua", "au")
        if other.low is not None:
            self.turns -= self.high is not None and self.high == other.low
            self.low = other.low if self.low is None else self.low
            self.high = other.high
        if other.rows:
            self.first = self.first if self.rows else other.first
            self.last = other.last
        for f in ("rows", "blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, f, getattr(self, f) + getattr(other, f))

    def counts(self) -> dict[str, int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


# ---- rows and ranges


def damaged(conversations: DataFrame) -> DataFrame:
    """A known share of rows made faulty, by the crc32 of conversation and turn; a null is one space."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    place = F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")
    hurt = conversations.select(
        "conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), F.pmod(F.crc32(place), F.lit(20)).alias("_hurt")
    )
    text = F.when(F.col("_hurt") == 1, "").when(F.col("_hurt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_hurt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        hurt.where("_hurt <> 0")
        .select("conv_id", "turn", F.when(F.col("_hurt") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies))
        .drop("col")
    )


def _prepared(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")],
    )


ORDER = ("conv_id", "real", "turn", "role", "text")


def _ranged(rows: DataFrame) -> DataFrame:
    """Rows in ranges of the order, sorted; ranges are cut by bounded keys that follow the order."""
    short = F.length("role") < CUT
    cuts = [F.substring("role", 1, CUT), F.when(short, F.substring("text", 1, CUT)).otherwise("")]
    return rows.repartitionByRange("conv_id", "real", "turn", *cuts).sortWithinPartitions(*ORDER)


def _records(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _verdict_batch(rows: list[dict]) -> pa.RecordBatch:
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(names, kinds))))


def _verdict(conv_id, tally: Tally, cost: int, audit: str, digest: str) -> dict:
    return {"conv_id": conv_id, **tally.counts(), "cost": cost, "audit": audit, "repaired_sha256": digest}


def _one(conv_id, rows: list[tuple]) -> dict:
    """The verdict of one whole conversation from its (turn, role, text)."""
    tally, seen, read = Tally(), set(), []
    for turn, role, text in rows:
        read.append(tally.take(turn, role, text, (role, text) in seen))
        seen.add((role, text))
    cost, audit = derivation(read)
    replay, digest = Replay(audit), Digest()
    for _, role, text in rows:
        digest.add(replay.row(role, text))
    digest.add(replay.inserts())
    return _verdict(conv_id, tally, cost, audit, digest.hash.hexdigest())


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts of the conversations that lie inside a range; of the first, the last and long ones only
    the id, with a null cost."""
    out: list[dict] = []
    conv, groups, held, chars = None, 0, [], 0

    def left_over(conv_id) -> dict:
        return {"conv_id": conv_id, **dict.fromkeys(COUNTS), "audit": None, "repaired_sha256": None}

    for conv_id, real, turn, role, text in _records(batches, ORDER):
        if not groups or conv_id != conv:
            if groups:
                out.append(left_over(conv) if groups == 1 or held is None else _one(conv, held))
            conv, groups, held, chars = conv_id, groups + 1, [], 0
        if real and held is not None and groups > 1:
            held.append((turn, role, text))
            chars += len(role) + len(text)
            if len(held) > LONG_ROWS or chars > LONG_CHARS:
                held = None
        if len(out) >= 1000:
            yield _verdict_batch(out)
            out = []
    if groups:
        out.append(left_over(conv))
    if out:
        yield _verdict_batch(out)


# ---- conversations over several ranges


PIECE = "conv_id long, piece int, tally struct<" + ", ".join(
    f"{f}: {'string' if f in ('first', 'last') else 'bigint'}" for f in Tally.FIELDS
) + ">, items array<struct<start: int, end: int, cost: bigint, audit: string>>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A summary of every conversation's rows in a range."""
    tally_type = pa.struct([(f, pa.string() if f in ("first", "last") else pa.int64()) for f in Tally.FIELDS])
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    shape = pa.schema([("conv_id", pa.int64()), ("tally", tally_type), ("items", pa.list_(item))])
    begun, conv, tally, items, block, before = False, None, Tally(), {}, [], None

    def more() -> None:
        nonlocal items, block
        weights = items_of(block, range(4))
        items, block = {s: joined(ends, weights) for s, ends in items.items()}, []

    def summary() -> pa.RecordBatch:
        more()
        flat = [{"start": s, "end": e, "cost": w[0], "audit": w[1]} for s, ends in items.items() for e, w in ends.items()]
        row = {"conv_id": conv, "tally": {f: getattr(tally, f) for f in Tally.FIELDS}, "items": flat}
        return pa.RecordBatch.from_pylist([row], schema=shape)

    for conv_id, real, turn, role, text, later in _records(batches, (*ORDER, "later")):
        if not begun or conv_id != conv:
            if begun:
                yield summary()
            begun, conv, tally, block, before = True, conv_id, Tally(), [], None
            items = {s: {s: (0, "")} for s in range(4)}
        if real:
            block.append(tally.take(turn, role, text, later or before == (turn, role, text)))
            before = turn, role, text
            if len(block) == LONG_ROWS:
                more()
    if begun:
        yield summary()


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts without a digest from the summaries of each conversation in turn."""
    begun, conv, tally, ends = False, None, Tally(), {}

    def verdict() -> pa.RecordBatch:
        return _verdict_batch([_verdict(conv, tally, *goal(ends), None)])

    for conv_id, counted, items in _records(batches, ("conv_id", "tally", "items")):
        if not begun or conv_id != conv:
            if begun:
                yield verdict()
            begun, conv, tally, ends = True, conv_id, Tally(), {NOTHING: (0, "")}
        tally.add(Tally(**counted))
        right: Items = {}
        for i in items:
            right.setdefault(i["start"], {})[i["end"]] = i["cost"], i["audit"]
        ends = joined(ends, right)
    if begun:
        yield verdict()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts with their digest; each stands before the rows of its conversation."""
    verdict, replay, digest = None, None, None

    def done() -> pa.RecordBatch:
        digest.add(replay.inserts())
        return _verdict_batch([{**verdict, "repaired_sha256": digest.hash.hexdigest()}])

    for real, role, text, given in _records(batches, ("real", "role", "text", "verdict")):
        if not real:
            if verdict is not None:
                yield done()
            verdict, replay, digest = given, Replay(given["audit"]), Digest()
        else:
            digest.add(replay.row(role, text))
    if verdict is not None:
        yield done()


def _over_ranges(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Verdicts of the conversations in `ids`, whatever their length."""
    same = F.col("conv_id").eqNullSafe(F.col("wanted"))
    some = rows.join(ids.select(F.col("conv_id").alias("wanted")), same, "left_semi")
    keyed = some.withColumn("key", text_key(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    real = keyed.where("real")
    first = real.groupBy(F.col("conv_id").alias("first_conv"), F.col("key").alias("first_key")).agg(
        F.count("*").alias("copies"), F.min("turn").alias("first_turn"), F.max(F.col("turn").isNull()).alias("first_null")
    )
    marked = lookup(
        keyed, first.where("copies > 1").drop("copies"), {"first_conv": F.col("conv_id"), "first_key": F.col("key")}, null_safe=True
    )
    later = F.col("turn").isNotNull() & (F.col("first_null") | (F.col("turn") > F.col("first_turn")))
    flagged = marked.select(*ORDER, F.coalesce(later, F.lit(False)).alias("later"))
    shape = PIECE.replace(" piece int,", "")
    pieces = _ranged(flagged).mapInArrow(_pieces, shape).withColumn("piece", F.spark_partition_id())
    summed = kept(pieces, "repair-pieces").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    verdicts = summed.mapInArrow(_in_turn, VERDICT)
    heads = verdicts.select(
        "conv_id",
        F.lit(False).alias("real"),
        F.lit(None).cast("long").alias("turn"),
        F.lit("").alias("role"),
        F.lit("").alias("text"),
        F.struct(*verdicts.columns).alias("verdict"),
    )
    body = some.where("real").select(*ORDER, F.lit(None).cast(heads.schema["verdict"].dataType).alias("verdict"))
    return (
        heads.unionByName(body).repartition("conv_id").sortWithinPartitions(*ORDER).select("real", "role", "text", "verdict").mapInArrow(_digested, VERDICT)
    )


def verdicts(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: gaps between turns, rows by their first fault, adjacent roles that may not
    meet, the cost and audit of the cheapest repair, and the digest of what it gives.

    `ids` (conv_id) names conversations that must appear though they have no row.
    """
    given = _prepared(rows).withColumn("real", F.lit(True))
    if ids is not None:
        named = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        empty = {"turn": F.lit(None).cast("long"), "role": F.lit(""), "text": F.lit(""), "real": F.lit(False)}
        given = given.unionByName(named.withColumns(empty))
    given = given.select(*ORDER)
    found = kept(_ranged(given).mapInArrow(_whole, VERDICT), "repair-ranges")
    rest = found.where("audit is null").select("conv_id").distinct()
    return found.where("audit is not null").unionByName(_over_ranges(given, rest))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows by their verdicts: conv_id, nr, role, text, edit. A conversation is streamed by one task."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, replay, nr, out = None, None, 0, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=shape)

        def put(new) -> None:
            nonlocal nr
            for role, text, edit in new:
                out.append({"conv_id": conv, "nr": nr, "role": role, "text": text, "edit": edit})
                nr += 1

        for conv_id, real, role, text, audit in _records(batches, ("conv_id", "real", "role", "text", "audit")):
            if not real:
                if replay is not None:
                    put(replay.inserts())
                conv, replay, nr = conv_id, Replay(audit), 0
            else:
                put(replay.row(role, text))
            if len(out) >= 1000:
                yield batch()
                out.clear()
        if replay is not None:
            put(replay.inserts())
        if out:
            yield batch()

    shape = pa.schema([("conv_id", pa.int64()), ("nr", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    body = _prepared(rows).select("conv_id", F.lit(True).alias("real"), "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    empty = F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text")
    heads = found.select("conv_id", F.lit(False).alias("real"), *empty, "audit")
    ordered = heads.unionByName(body).repartition("conv_id").sortWithinPartitions(*ORDER)
    return ordered.mapInArrow(apply, "conv_id long, nr long, role string, text string, edit string")
