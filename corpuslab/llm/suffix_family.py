"""A logarithmic family of suffix arrays over byte strings.

``add`` takes a batch of bytes and the starts of its suffixes. The batch gets its
suffix array by prefix doubling (ranks of 8, 16, .. bytes), is merge-scanned against
the existing levels for common prefixes of ``depth`` bytes, and becomes a level; two
levels of equal generation merge, so b batches leave about log b levels. Every
comparison is of bytes; suffixes that share ``depth`` bytes are kept once.

Memory: one byte of text, one of marks and eight of level for each suffix kept.
Empty batches change nothing. A suffix must have ``depth`` bytes in its batch.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    if size <= len(x):
        return x
    return np.concatenate([x, np.zeros(max(size - len(x), len(x)), x.dtype)])


def _words(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that sorts as they do."""
    view = np.ndarray((len(data) - WORD + 1,), dtype=">u8", buffer=data, strides=(1,))
    return view[places].astype(np.uint64)


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def suffix_array(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``starts`` by their first ``depth`` bytes, and
    where in that order a suffix differs from the one before (a common prefix
    shorter than ``depth``)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
    rank, h = _ranks(_words(padded, np.arange(n))), WORD
    while h * 2 <= depth:
        after = np.zeros(n, np.int64)
        after[:n - h] = rank[h:] + 1
        rank, h = _ranks(rank * (n + 1) + after), h * 2
    # depth - h <= h: the two ranks overlap and cover the depth
    key = rank[starts] * (n + 1) + (rank[starts + depth - h] if depth > h else 0)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(starts), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    return order, new


class SuffixFamily:
    def __init__(self, depth: int):
        if depth < WORD:
            raise ValueError(f"depth is {depth}; at least {WORD} bytes are compared")
        self.depth, self.size = depth, 0
        self.data, self.marks = np.zeros(WORD, np.uint8), np.zeros(WORD, bool)
        #: (generation, places in order of their suffixes, no two with one prefix)
        self.levels: list[tuple[int, np.ndarray]] = []

    def matched(self, places: np.ndarray) -> np.ndarray:
        """Whether the suffix at each place shares ``depth`` bytes with another."""
        return self.marks[places]

    def add(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Adds a batch; returns the places of its suffixes for ``matched``."""
        if len(starts) == 0:
            return starts
        base, self.size = self.size, self.size + len(data)
        self.data, self.marks = _grown(self.data, self.size + WORD), _grown(self.marks, self.size)
        self.data[base:self.size] = data
        order, new = suffix_array(data, starts, self.depth)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        batch, hit = base + starts[order[first]], count > 1
        held = np.zeros(len(batch), bool)
        for _, level in self.levels:
            at, same = self._scan(level, batch)
            self.marks[level[at[same]]] = True
            held |= same
        self.marks[base + starts[order]] = np.repeat(hit | held, count)
        self.levels.append((0, batch[~held]))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (gen, young), (_, old) = self.levels.pop(), self.levels.pop()
            self.levels.append((gen + 1, np.insert(old, self._scan(old, young)[0], young)))
        return base + starts

    def _scan(self, level: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of a sorted batch its place in a level, and whether the
        suffix there has the same ``depth`` bytes."""
        words, mine = _words(self.data, level), _words(self.data, batch)
        lo, end = np.searchsorted(words, mine, "left"), np.searchsorted(words, mine, "right")
        hi = end.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            less = self._compare(level[mid], batch[live]) < 0
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        same = lo < end
        same[same] = self._compare(level[lo[same]], batch[same]) == 0
        return lo, same

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for pairs of suffixes with the same first word."""
        out, live = np.zeros(len(a), np.int8), np.arange(len(a))
        for at in [*range(WORD, self.depth - WORD + 1, WORD), self.depth - WORD]:
            x, y = _words(self.data, a[live] + at), _words(self.data, b[live] + at)
            apart = x != y
            out[live[apart]] = np.where(x[apart] < y[apart], -1, 1)
            live = live[~apart]
            if not len(live):
                break
        return out
