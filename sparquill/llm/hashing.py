"""Vectorised word and shingle hashes.

The words of many texts are hashed in one sweep over their bytes: with prefix sums of
``byte * P**i`` modulo 2**64 the hash of any byte range is a difference of two sums times a power
of the inverse of P, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
P = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
P_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Texts are swept in slices of about so many bytes; a longer text is swept by itself.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:
            _powers[key] = have
    return have[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after the other, and the index of each text's first word (and the end)."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = SPACE[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space))))  # word starts and ends in turn
    starts, ends = edge[0::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, U), np.cumsum((joined.astype(U) + U(1)) * powers(P, len(joined)), dtype=U)))
    hashes = (sums[ends] - sums[starts]) * powers(P_INVERSE, len(joined))[starts] + (ends - starts).astype(U)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return mix(hashes), np.searchsorted(starts, offsets)


def slices(texts: list[bytes], size: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts of about ``size`` bytes together, each with the index of its first."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > size:
            yield first, texts[first:i]
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words; of the whole sequence where there are fewer."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * P + words[k : len(words) - n + 1 + k])
    return out


def distinct_shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return np.unique(shingle_hashes(word_hashes([text])[0], n))


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z in lower case and all else as it is."""
    return text.encode().lower()
