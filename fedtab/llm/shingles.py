"""Word-shingle sets of whole texts, computed on the UTF-8 bytes of a batch at once.

A word is a run of bytes outside the ASCII white space ``[\\x20\\x09-\\x0D]``; A-Z count as a-z. A shingle is
the 64-bit hash of ``width`` neighbouring words; a text with fewer words is one shingle of all its words; a
text without words (or null) has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 256 << 10
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = np.uint64(0x9E3779B97F4A7C15)  # odd: invertible modulo 2**64
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**0..r**n and their inverses; kept for a chunk, made anew for a longer text."""
    if n <= CHUNK_BYTES and _POWERS:
        return _POWERS["up"], _POWERS["down"]
    out = []
    for base in (_R, _R_INV):
        a = np.full(max(n, CHUNK_BYTES) + 2, base, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a, out=a))
    if n <= CHUNK_BYTES:
        _POWERS["up"], _POWERS["down"] = out
    return out[0], out[1]


def _sets_of(data: np.ndarray, ends: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of the texts that lie back to back in ``data``, each ending at ``ends``."""
    n = len(data)
    gap = _SPACE[data]
    word = ~gap
    starts_here = word.copy()
    starts_here[1:] &= gap[:-1]
    limits = np.concatenate(([0], ends))
    inner = limits[(limits > 0) & (limits < n)]
    starts_here[inner] = word[inner]  # a text begins a new word
    ends_here = word.copy()
    ends_here[:-1] &= gap[1:]
    ends_here[inner - 1] = word[inner - 1]
    start, stop = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    words = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    first = np.searchsorted(start, limits)
    long = len(words) - width + 1
    grams = np.zeros(max(long, 0), np.uint64)
    for k in range(width):
        if long > 0:
            grams = grams * np.uint64(0xD6E8FEB86659FD93) + words[k:k + long]
    grams = mix(grams)
    for i in range(len(ends)):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            yield np.unique(grams[a:b - width + 1])
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = h * np.uint64(0xD6E8FEB86659FD93) + w
            yield mix(np.asarray([h]))
        else:
            yield np.empty(0, np.uint64)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of an Arrow string array, in order; memory beyond the array is bounded by
    ``CHUNK_BYTES`` or the longest text."""
    big = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(big):
        return
    offsets = np.frombuffer(big.buffers()[1], np.int64, len(big) + 1, big.offset * 8)
    raw = np.frombuffer(big.buffers()[2], np.uint8) if big.buffers()[2] and big.buffers()[2].size else np.empty(0, np.uint8)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(big):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
            yield from _sets_of(raw[offsets[a]:offsets[b]], offsets[a + 1:b + 1] - offsets[a], width)
            a = b
