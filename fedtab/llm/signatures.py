"""Signature trees over sets: which pairs of a group may overlap enough.

A leaf entry is a set's size and a bitmap of its hashed elements; a node holds the OR of its entries' bitmaps and
their size range. Two nodes are followed together only while the largest possible overlap of a set of one with
a set of the other allows a link: no more than the bits they have in common, plus the elements that share a
bit with another of the same set, and no more than either's largest size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 16
FAN_OUT = 8
#: Of a first look; with ``FINE_BITS`` sets whose bitmaps allow a link nearly always have one.
BITS_PER_ELEMENT, FINE_BITS = 2, 8
LEAST_BITS, MOST_BITS = 64, 1 << 17


def bitmap(elements: np.ndarray, each: int = BITS_PER_ELEMENT) -> np.ndarray:
    """Bitmap of a set of 64-bit hashes as 64-bit words; its length follows the size of the set."""
    bits = LEAST_BITS
    while bits < each * len(elements) and bits < MOST_BITS:
        bits *= 2
    out = np.zeros(bits, bool)
    out[(elements >> np.uint64(40)) & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little").view("<u8")


def fold(words: np.ndarray, length: int) -> np.ndarray:
    """Bitmaps brought to a smaller length: bits that then coincide are joined by OR."""
    while words.shape[-1] > length:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


class Rule:
    """Sets link when ``den * overlap >= num * union``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def links(self, overlap, a, b):
        return self.den * overlap >= self.num * (a + b - overlap)

    def prefix(self, n: int) -> int:
        """So many elements of a set of n, in an order shared by all sets, meet those of any set it links with."""
        return n - -(-self.num * n // self.den) + 1 if n else 0


class Tree:
    """Entries with bitmaps of one length, packed bottom up in the order given."""

    def __init__(self, index: np.ndarray, sizes: np.ndarray, words: np.ndarray, labels: np.ndarray):
        self.index, self.sizes, self.words, self.labels = index, sizes, words, labels
        self.excess = sizes - np.bitwise_count(words).sum(axis=1).astype(np.int64)
        starts = np.arange(0, len(index), LEAF)
        self.levels = [self._level(starts, self.words, sizes, sizes, self.excess, labels)]
        while len(self.levels[-1][1]) > 1:
            _, words, lo, hi, excess, label = self.levels[-1]
            self.levels.append(self._level(np.arange(0, len(lo), FAN_OUT), words, lo, hi, excess, label))

    @staticmethod
    def _level(starts, words, lo, hi, excess, labels):
        first, last = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        return (starts, np.bitwise_or.reduceat(words, starts, axis=0), np.minimum.reduceat(lo, starts),
                np.maximum.reduceat(hi, starts), np.maximum.reduceat(excess, starts), np.where(first == last, first, -1))


def _possible(rule: Rule, a: tuple, i: int, b: tuple, j: int) -> bool:
    _, wa, lo_a, hi_a, ex_a, la = a
    _, wb, lo_b, hi_b, ex_b, lb = b
    if la[i] >= 0 and la[i] == lb[j]:
        return False
    top = min(int(hi_a[i]), int(hi_b[j]))
    if not rule.links(top, int(lo_a[i]), int(lo_b[j])) or max(int(lo_a[i]), int(lo_b[j])) * rule.num > top * rule.den:
        return False
    length = min(wa.shape[1], wb.shape[1])
    common = int(np.bitwise_count(fold(wa[i], length) & fold(wb[j], length)).sum()) + max(int(ex_a[i]), int(ex_b[j]))
    if wa.shape[1] != wb.shape[1]:
        common = top  # folding hides elements; the leaves look closer
    return rule.links(min(top, common), int(lo_a[i]), int(lo_b[j]))


def traverse(rule: Rule, x: Tree, y: Tree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entry numbers of pairs that may link and their largest possible overlap, from a dual descent."""
    same = x is y
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        p, i, q, j = stack.pop()
        if not _possible(rule, x.levels[p], i, y.levels[q], j):
            continue
        if p == 0 and q == 0:
            yield from _leaves(rule, x, i, y, j)
        elif p >= q:
            children = range(i * FAN_OUT, min((i + 1) * FAN_OUT, len(x.levels[p - 1][2])))
            if same and p == q and i == j:
                stack += [(p - 1, c, p - 1, d) for c in children for d in children if c <= d]
            else:
                stack += [(p - 1, c, q, j) for c in children]
        else:
            stack += [(p, i, q - 1, d) for d in range(j * FAN_OUT, min((j + 1) * FAN_OUT, len(y.levels[q - 1][2])))]


def _leaves(rule: Rule, x: Tree, i: int, y: Tree, j: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    a, b = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
    length = min(x.words.shape[1], y.words.shape[1])
    wa, wb = fold(x.words[a], length), fold(y.words[b], length)
    na, nb = x.sizes[a][:, None], y.sizes[b][None, :]
    common = np.bitwise_count(wa[:, None, :] & wb[None, :, :]).sum(axis=2).astype(np.int64)
    # elements whose bit the other has not are no part of the overlap
    over = np.minimum(na - np.bitwise_count(wa).sum(axis=1).astype(np.int64)[:, None], nb - np.bitwise_count(wb).sum(axis=1).astype(np.int64)[None, :]) + common
    over = np.minimum(over, np.minimum(na, nb))
    fits = rule.links(over, na, nb) & (x.labels[a][:, None] != y.labels[b][None, :])
    if x is y and i == j:
        fits &= np.triu(np.ones(fits.shape, bool), 1)
    r, c = np.nonzero(fits)
    if len(r):
        yield x.index[a][r], y.index[b][c], over[r, c]


def candidates(rule: Rule, sizes: np.ndarray, bitmaps: list[np.ndarray], order: np.ndarray, labels: np.ndarray,
               side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of a group that differ in label and may link. ``order`` clusters like sets (least element);
    with ``side``, only pairs of unlike sides are wanted."""
    lengths = np.asarray([len(b) for b in bitmaps])
    trees: dict[int, list[Tree]] = {}
    for n in np.unique(lengths):
        for s in (0, 1) if side is not None else (0,):
            at = np.flatnonzero((lengths == n) & (side == s) if side is not None else lengths == n)
            if len(at):
                at = at[np.argsort(order[at], kind="stable")]
                trees.setdefault(int(n), []).append(Tree(at, sizes[at], np.stack([bitmaps[k] for k in at]), labels[at]))
            elif side is not None:
                trees.setdefault(int(n), []).append(None)
    for n, own in trees.items():
        bigger = [t for m, ts in trees.items() if m > n for t in ts]
        if side is None:
            pairs = [(own[0], own[0])] + [(own[0], t) for t in bigger]
        else:
            other = [ts for m, ts in trees.items() if m > n]
            pairs = [(own[0], own[1])] + [(own[s], ts[1 - s]) for ts in other for s in (0, 1)]
        for a, b in pairs:
            if a is not None and b is not None:
                yield from traverse(rule, a, b)
