"""Sweeps over the bytes of many texts at once, straight from an Arrow column's buffers.

Byte classes are table lookups, counts per text are differences of prefix sums, and the words are
byte ranges: nothing becomes a Python object. Word hashes are those of ``hashing``; ``differing``
compares the bytes of word pairs eight at a time, so equal hashes can be verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sparquill.llm.hashing import P, P_INVERSE, SLICE_BYTES, SPACE, U, mix, powers

#: Texts of one sweep; its index fits the upper bits of a sort key.
SWEEP_TEXTS = 1 << 15
#: Words up to so many bytes are compared in steps of eight, longer ones as a whole.
STEPPED_BYTES = 256
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text begins in them (and the end)."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def sweeps(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Index of the first text, bytes and text offsets of consecutive runs of about ``size`` bytes; a longer text is swept by itself."""
    data, at = buffer_of(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = min(max(int(np.searchsorted(at, at[first] + size, "right")) - 1, first + 1), first + SWEEP_TEXTS, n)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def counts(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)))
    return sums[at[1:]] - sums[at[:-1]]


def word_ranges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges (starts, ends) of the words of all texts, and the index of each text's first word (and the end)."""
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # a word ends where its text does
    before, after = np.concatenate(([True], space)), np.concatenate((space, [True]))
    starts = np.flatnonzero(~space & (before[:-1] | edge[:-1]))
    ends = np.flatnonzero(~space & (after[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    sums = np.concatenate((np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * powers(P, len(data)), dtype=U)))
    return mix((sums[ends] - sums[starts]) * powers(P_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U))


def differing(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of words (by index): whether their bytes differ."""
    size = ends - starts
    out = size[a] != size[b]
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = np.flatnonzero(~out)
    for k in range(0, STEPPED_BYTES, 8):
        if not len(left):
            return out
        x, y = a[left], b[left]
        bad = ((eight[starts[x] + k] ^ eight[starts[y] + k]) & _LOW_BYTES[np.minimum(size[x] - k, 8)]) != 0
        out[left[bad]] = True
        left = left[~bad & (size[x] > k + 8)]
    for i in left:
        out[i] = not np.array_equal(data[starts[a[i]] : ends[a[i]]], data[starts[b[i]] : ends[b[i]]])
    return out
