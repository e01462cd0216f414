"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Words are runs of bytes other than space and 0x09-0x0D, which never cut a code point. Documents go through in
chunks of about ``CHUNK`` bytes, so memory does not follow the size of a batch; a longer document is a chunk of
its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, for arrays of unsigned 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes that are hashed at a time; tables of powers have this length, whatever the text's.
BLOCK = 1 << 18


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The first BLOCK + 1 powers of the base and of its inverse."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(BLOCK + 1, base, U64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=U64))
    return both[0], both[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of ``data``, each byte read through ``table`` if given; equal bytes have equal hashes anywhere.

    A span's hash is the difference of two running sums; they are taken at the spans' ends alone, block by block."""
    up, down = _powers()
    out = np.zeros(len(starts), U64)
    order = [None if len(places) < 2 or (places[1:] >= places[:-1]).all() else np.argsort(places, kind="stable") for places in (starts, ends)]
    sides = [(places if own is None else places[own], own) for places, own in zip((starts, ends), order, strict=True)]
    total, power, inverse, begun = U64(0), 1, 1, [1]
    back = pow(int(up[BLOCK]), -1, 1 << 64)
    for low in range(0, max(1, len(data)), BLOCK):
        block = data[low : low + BLOCK]
        block = block if table is None else table[block]
        sums = np.zeros(len(block) + 1, U64)
        np.cumsum((block.astype(U64) + U64(1)) * up[: len(block)], out=sums[1:])
        sums = total + sums * U64(power)
        last = low + BLOCK >= len(data)
        for (places, own), sign in zip(sides, (np.subtract, np.add), strict=True):
            here = slice(int(np.searchsorted(places, low)), int(np.searchsorted(places, low + len(block), side="right" if last else "left")))
            at = here if own is None else own[here]
            out[at] = sign(out[at], sums[places[here] - low])
        total = sums[-1]
        power, inverse = power * int(up[BLOCK]) % (1 << 64), inverse * back % (1 << 64)
        begun.append(inverse)
    begun = np.array(begun, U64)
    for low in range(0, len(out), BLOCK):
        part = slice(low, low + BLOCK)
        at = starts[part]
        out[part] = mix64(out[part] * begun[at // BLOCK] * down[at % BLOCK] + (ends[part] - at).astype(U64))
    return out


@dataclass
class Chunk:
    """Bytes of some whole documents; document i has the bytes offsets[i] to offsets[i + 1]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each document the number of its first word (one more at the end)."""
        starts, ends, inner = [], [], np.unique(self.offsets)
        kind = np.int32 if len(self.data) < 1 << 31 else np.int64
        for low in range(0, len(self.data), BLOCK):  # with the byte before and the byte after the block
            high = min(low + BLOCK, len(self.data))
            word = np.zeros(high - low + 2, bool)
            word[1:-1] = IS_WORD[self.data[low:high]]
            if low:
                word[0] = IS_WORD[self.data[low - 1]]
            if high < len(self.data):
                word[-1] = IS_WORD[self.data[high]]
            cut = np.zeros(high - low + 1, bool)  # a document ends before this byte
            cut[inner[np.searchsorted(inner, low) : np.searchsorted(inner, high, side="right")] - low] = True
            starts.append(np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1])).astype(kind) + kind(low))
            ends.append(np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])).astype(kind) + kind(low + 1))
        starts = np.concatenate(starts) if starts else np.zeros(0, kind)
        ends = np.concatenate(ends) if ends else np.zeros(0, kind)
        return starts, ends, np.searchsorted(starts, self.offsets)


def string_chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield Chunk(at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def sums_between(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of values[cuts[i]:cuts[i + 1]] are set."""
    hits = np.flatnonzero(values)
    return np.diff(np.searchsorted(hits, cuts))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, from the words' hashes. Each place has an odd factor of its own, drawn at random."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, U64)
    for k, factor in enumerate(mix64(np.arange(1, width + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)):
        for low in range(0, n, BLOCK):
            high = min(low + BLOCK, n)
            out[low:high] += words[low + k : high + k] * factor
    for low in range(0, n, BLOCK):
        out[low : low + BLOCK] = mix64(out[low : low + BLOCK])
    return out
