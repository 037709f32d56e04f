"""Bidirectional FM-index over a delimited word list, and search schemes with one error on it.

The text is ``$w1$w2$...$wn$``. The index holds the Burrows-Wheeler transforms of the text and of its reverse with
counts at every ``BLOCK`` places; a pattern is a pair of suffix-rank intervals, one in each, which a symbol added on
either side narrows together. All patterns of a batch move at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32
END, MARK, FIRST = 0, 1, 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s``, whose last symbol is smaller than all others; by prefix doubling."""
    n, k = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        if k < n:
            second[:-k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class Transform:
    """One transform with rank support: symbols of a prefix that equal a symbol or are smaller."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.order = suffix_array(s)
        n = len(s)
        last = s[self.order - 1]
        blocks = n // BLOCK + 1
        padded = np.full(blocks * BLOCK, symbols, s.dtype)
        padded[:n] = last
        self.blocks = padded.reshape(blocks, BLOCK)
        per_block = np.zeros((symbols + 1, blocks + 1), np.int32)
        np.add.at(per_block, (last, np.arange(n) // BLOCK + 1), 1)
        counts = np.cumsum(per_block, axis=1, dtype=np.int32)
        self.equal = counts
        self.smaller = np.vstack([np.zeros((1, blocks + 1), np.int32), np.cumsum(counts, axis=0, dtype=np.int32)])[:-1]
        self.start = np.concatenate(([0], np.cumsum(counts[:, -1])))

    def rank(self, c: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of symbols below c and equal to c among the first i, for arrays of c and i."""
        b, inside = i // BLOCK, i % BLOCK
        rows = self.blocks[b]
        seen = np.arange(BLOCK) < inside[:, None]
        return (self.smaller[c, b] + ((rows < c[:, None]) & seen).sum(1),
                self.equal[c, b] + ((rows == c[:, None]) & seen).sum(1))

    def add(self, c, lo, hi, other):
        """The interval [lo, hi) after a symbol c on this transform's side, and the start of the interval of the
        other one."""
        below_lo, at_lo = self.rank(c, lo)
        below_hi, at_hi = self.rank(c, hi)
        return self.start[c] + at_lo, self.start[c] + at_hi, other + below_hi - below_lo


def _padded(codes: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(codes), width), np.int64)
    for i, a in enumerate(codes):
        out[i, :len(a)] = a
    return out


class WordIndex:
    """Both transforms over distinct ``words``."""

    def __init__(self, words: list[str]):
        self.words = words
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.letters = np.unique(points)
        self.symbols = FIRST + len(self.letters) + 1  # the last one stands for letters that no word has
        kind = np.uint8 if self.symbols < 255 else np.int64
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        text = np.full(len(points) + len(words) + 2, MARK, kind)
        text[np.arange(len(points)) + np.repeat(np.arange(len(words)), sizes) + 1] = np.searchsorted(self.letters, points) + FIRST
        text[-1] = END
        self.n = len(text)
        self.left = Transform(text, self.symbols)
        self.right = Transform(np.concatenate((text[-2::-1], text[-1:])), self.symbols)

    def codes(self, word: str) -> np.ndarray:
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + FIRST, self.symbols - 1).astype(np.int64)

    def _scheme(self, exact: list[np.ndarray], rest: list[np.ndarray], inner: Transform, outer: Transform):
        """Patterns whose ``exact`` part matches as it is on the side of ``inner`` and whose ``rest``, up to the next mark,
        matches on the side of ``outer`` with exactly one error: (pattern, interval start on either side)."""
        q = np.arange(len(exact))
        sizes = np.fromiter(map(len, exact), np.int64, len(exact))
        pattern = _padded(exact, int(sizes.max()))
        lo, hi, other = np.zeros(len(q), np.int64), np.full(len(q), self.n, np.int64), np.zeros(len(q), np.int64)
        for t in range(pattern.shape[1]):
            go = np.flatnonzero((t < sizes) & (lo < hi))
            lo[go], hi[go], other[go] = inner.add(pattern[go, t], lo[go], hi[go], other[go])
        size = np.fromiter(map(len, rest), np.int64, len(rest))
        pattern = _padded([np.append(a, MARK) for a in rest], int(size.max()) + 2)
        alive = hi > lo
        # the outer side's interval is the one that is searched from here on
        q, lo, hi, other = q[alive], other[alive], (other + hi - lo)[alive], lo[alive]
        letters = np.arange(FIRST, self.symbols - 1)
        wrong = [np.zeros(0, np.int64)] * 5  # pattern, place in rest, lo, hi, other
        found = []
        for j in range(int(size.max()) + 3):
            if len(wrong[0]):
                wq, wj, wlo, whi, wother = wrong
                c = pattern[wq, wj]
                wlo, whi, wother = outer.add(c, wlo, whi, wother)
                ok = whi > wlo
                done = ok & (c == MARK)
                found.append((wq[done], wlo[done], wother[done]))
                wrong = [a[ok & ~done] for a in (wq, wj + 1, wlo, whi, wother)]
            if len(q):
                own, last = pattern[q, j], j >= size[q]
                c = np.tile(letters, len(q))
                at = np.repeat(np.arange(len(q)), len(letters))
                clo, chi, cother = outer.add(c, lo[at], hi[at], other[at])
                odd = (chi > clo) & (c != own[at])
                inserted = at[odd]
                new = [(q[inserted], np.full(len(inserted), j), clo[odd], chi[odd], cother[odd])]
                replaced = odd & ~last[at]
                new.append((q[at[replaced]], np.full(int(replaced.sum()), j + 1), clo[replaced], chi[replaced], cother[replaced]))
                gone = ~last & (pattern[q, j + 1] != own)  # of equal letters in a row the last one goes
                new.append((q[gone], np.full(int(gone.sum()), j + 1), lo[gone], hi[gone], other[gone]))
                wrong = [np.concatenate([w, *(x[i] for x in new)]) for i, w in enumerate(wrong)]
                lo, hi, other = outer.add(own, lo, hi, other)
                go = ~last & (hi > lo)
                q, lo, hi, other = q[go], lo[go], hi[go], other[go]
        if not found:
            return [np.zeros(0, np.int64)] * 3
        return [np.concatenate(x) for x in zip(*found)]

    def _word_at(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.left.order[place])

    def near_by_first_half(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs that differ by one error after an equal first half (the shorter one)."""
        heads = [self.codes(x[:len(x) // 2])[::-1] for x in queries]
        tails = [self.codes(x[len(x) // 2:]) for x in queries]
        q, _, place = self._scheme([np.append(a, MARK) for a in heads], tails, self.left, self.right)
        return q, self._word_at(place)

    def near_by_second_half(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs that differ by one error before an equal second half."""
        heads = [self.codes(x[:len(x) // 2])[::-1] for x in queries]
        tails = [self.codes(x[len(x) // 2:]) for x in queries]
        q, place, _ = self._scheme([np.append(a, MARK) for a in tails], heads, self.right, self.left)
        return q, self._word_at(place)
