"""Words and word shingles of Arrow text columns as 64-bit hashes, for use inside tasks.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
return. Everything is computed on whole chunks of bytes at a time: a word's hash is a difference
of two prefix sums of a polynomial over scrambled byte values. Chunks end at text boundaries and
hold about `CHUNK` bytes, or one text if that is longer, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
U64 = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def byte_values(fold_case: bool) -> np.ndarray:
    """A scrambled value per byte; with fold_case A-Z have the values of a-z."""
    source = np.arange(256, dtype=np.uint64)
    if fold_case:
        source[65:91] = source[97:123]
    return mixed(source + np.uint64(0x1234567))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, step = 1, base & U64
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step)
        have, step = have + take, step * step & U64
    return out


@dataclass
class Chunk:
    """Consecutive texts: rows `lo` to `hi` of the batch, text i at bytes bounds[i]:bounds[i+1]."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[Chunk]:
    """Cut a text column at text boundaries; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Chunk(lo, hi, raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi


@dataclass
class Words:
    """Words of a chunk: word j is at bytes start[j]:end[j]; text i has words first[i]:first[i+1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class WordHasher:
    """Splits chunks into words and hashes them; keeps its power tables between chunks."""

    def __init__(self, fold_case: bool = False):
        self.values = byte_values(fold_case)
        self.inverse = pow(BASE, -1, 1 << 64)
        self.up = self.down = powers(1, BASE)

    def words(self, chunk: Chunk) -> Words:
        data, bounds, n = chunk.data, chunk.bounds, len(chunk.data)
        if len(self.up) < n + 1:
            self.up, self.down = powers(n + 1, BASE), powers(n + 1, self.inverse)
        word = (data != 32) & ((data < 9) | (data > 13))
        before = np.zeros(n, dtype=bool)
        before[1:] = word[:-1]
        before[bounds[:-1][bounds[:-1] < n]] = False
        start = np.flatnonzero(word & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = word[1:]
        inner = bounds[1:-1]
        after[inner[inner > 0] - 1] = False
        end = np.flatnonzero(word & ~after) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=sums[1:])
        hashed = mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))
        return Words(start, end, np.searchsorted(start, bounds), hashed)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, first word and length in words of every shingle.

    A text with fewer words than `width`, but at least one, has one shingle of all its words.
    """
    n, first = len(words.hash), words.first
    text = words.text_of()
    counts = np.diff(first)
    full = np.arange(n) + width <= first[1:][text]
    short = np.flatnonzero((counts > 0) & (counts < width))
    at = np.flatnonzero(full)
    total = np.zeros(len(at), dtype=np.uint64)
    for j in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words.hash[at + j]
    hashed, length = mixed(total), np.full(len(at), width)
    if len(short):
        few = np.zeros(len(short), dtype=np.uint64)
        for j in range(width - 1):
            has = counts[short] > j
            few[has] = few[has] * np.uint64(0xD6E8FEB86659FD93) + words.hash[first[short][has] + j]
        few = mixed(few + counts[short].astype(np.uint64))
        hashed, at = np.concatenate([hashed, few]), np.concatenate([at, first[short]])
        length = np.concatenate([length, counts[short]])
    return hashed, text[at], at, length


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like `shingles` for all runs of `width` words, with the hashes of texts that are that short."""
    text = words.text_of()
    at = np.flatnonzero(np.arange(len(words.hash)) + width <= words.first[1:][text])
    total = np.zeros(len(at), dtype=np.uint64)
    for j in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words.hash[at + j]
    return mixed(total + np.uint64(width)), text[at], at, np.full(len(at), width)
