"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. To find where a turn ended
up without knowing the template, the turns before it are rendered with and without it and the two
outputs compared: what the longer one adds at its end is the turn's piece. If the longer output does
not begin with the shorter, the template rewrites history, and the turn is reported as such.
Whole prefixes are rendered at every turn. A template may declare in its attribute `lookback` at how many
earlier turns it looks; then that many are rendered beside the whole prefix, at every turn, with an error where
they differ.

Rows stream through tasks sorted by conversation and turn. A conversation is held whole while its turns
pass, and its work grows with the square of its turns.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escaped(text: str) -> str:
    """The text with one backslash more in each "<", any backslashes, "|", so that no control string
    is left in it."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    """Inverse of `escaped`."""
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: str) -> str:
    """The role on one line and without control strings."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def marked_turns(turns: Sequence[Turn]) -> str:
    """Each turn between control strings, with its role on the first line."""
    return "".join(f"{OPEN}{escaped_role(r)}\n{escaped(t)}{CLOSE}\n" for r, t in turns)


def read_back(piece: str) -> tuple[str, str, int, int]:
    """Role, text, and start and end of the escaped text in a piece of `marked_turns`."""
    inner = piece[len(OPEN) : -len(CLOSE) - 1]
    role, _, text = inner.partition("\n")
    start = len(OPEN) + len(role) + 1
    return unescaped_role(role), unescaped(text), start, start + len(text)


def step(known: str, after: str) -> tuple[str | None, int]:
    """The piece that `after` adds to `known`, or None if it does not begin with it; and how many
    characters of `known` it keeps."""
    if after.startswith(known):
        return after[len(known) :], len(known)
    same = (i for i, (a, b) in enumerate(zip(known, after)) if a != b)
    return None, next(same, min(len(known), len(after)))


def rendered(
    turns: Iterator[Turn], template: Template, lookback: int | None = None
) -> Iterator[tuple[str | None, int]]:
    """For each turn the piece it adds, or None if it changed earlier output; and how many
    characters of the earlier output the new one keeps. A declared lookback is held against the whole prefix at
    every turn."""
    before: list[Turn] = []
    known = template([])
    for n, turn in enumerate(turns):
        after = template([*before, turn])
        piece, kept = step(known, after)
        if lookback is not None and n > lookback:
            near = before[n - lookback :]
            seen = template(near)
            in_window, kept_there = step(seen, template([*near, turn]))
            if (in_window, kept_there + len(known) - len(seen)) != (piece, kept):
                raise ValueError(
                    f"the template looks back on more than the {lookback} turns it declares (turn {n})"
                )
        yield piece, kept
        known = after
        before.append(turn)


def formatted(conversations: DataFrame, template: Template = marked_turns) -> DataFrame:
    """One row per turn: conv_id, turn, role, piece, start, rewrites.

    piece is what the turn adds to the conversation's output, start its place in it (code points);
    a turn that rewrites earlier output has a null piece, and start is where the change begins. Turns are
    ordered by turn (nulls first), then role and text, so ties and repeated rows keep a fixed order
    and all stay. Null roles and texts count as empty; a null conv_id is a conversation. Rows come
    out sorted within their partition. Extra columns are ignored.
    """
    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    lookback = getattr(template, "lookback", None)
    empty = F.lit("")
    rows_in = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
    )

    def rows(batches):
        state: dict = {"conv": None, "turns": None, "any": False}
        for batch in batches:
            convs = batch.column(0).to_pylist()
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            pieces, starts = [], []
            for conv, role, text in zip(convs, roles, texts):
                if not state["any"] or conv != state["conv"]:
                    queue: deque[Turn] = deque()
                    feed = iter(queue.popleft, None)
                    state |= {
                        "any": True,
                        "conv": conv,
                        "queue": queue,
                        "turns": rendered(feed, template, lookback),
                    }
                state["queue"].append((role, text))
                piece, start = next(state["turns"])
                pieces.append(piece)
                starts.append(start)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array(pieces, pa.string()),
                    pa.array(starts, pa.int64()),
                    pa.array([p is None for p in pieces], pa.bool_()),
                ],
                names=["conv_id", "turn", "role", "piece", "start", "rewrites"],
            )

    return (
        rows_in.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(
            rows,
            f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, piece string, "
            "start long, rewrites boolean",
        )
    )


def digests(turns: DataFrame, trained_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """Per conversation, read back from pieces of `marked_turns` in the order `formatted` gives:
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The loss mask covers the escaped texts of trained roles; its digest is over these, unescaped.
    """
    kind = turns.schema["conv_id"].dataType
    trained = frozenset(trained_roles)

    def rows(batches):
        conv, has = None, False
        state: dict = {}
        fields = ("n_turns", "turns", "loss_chars", "loss", "chars")

        def fresh():
            return dict(zip(fields, (0, hashlib.sha256(), 0, hashlib.sha256(), 0)))

        def out(done):
            columns = list(zip(*done)) or [()] * 6
            types = [arrow_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        def closed():
            return (
                conv,
                state["n_turns"],
                state["turns"].hexdigest(),
                state["loss_chars"],
                state["loss"].hexdigest(),
                state["chars"],
            )

        for batch in batches:
            arrow_kind, done = batch.schema.field(0).type, []
            for c, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not has or c != conv:
                    if has:
                        done.append(closed())
                    conv, has, state = c, True, fresh()
                role, text, _, _ = read_back(piece)
                state["n_turns"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
                if role in trained:
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode())
                state["chars"] += len(piece)
            yield out(done)
        if has:
            yield out([closed()])

    return turns.select("conv_id", "piece").mapInArrow(
        rows,
        f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long",
    )
