"""Sorting suffixes by hashes.

Places in a byte array are sorted by what follows them (or, backward, by what precedes them), as
far as each may look. Two places are compared by the length they have in common, found by binary
search over prefix polynomial hashes, and the byte behind it: a logarithmic number of steps for
any length. Places come in groups; each group is merge-sorted, all groups at once: on each level
every place finds its rank in the sibling run by binary search. Common lengths of neighbours are
then verified on the bytes themselves, so that a hash collision can't lengthen them; a group in which
one shows is sorted anew by its bytes.
"""

from __future__ import annotations

import numpy as np

from quern.llm import words as W


class Suffixes:
    """``place`` and how far each may look, ``reach``; groups are runs that begin at ``first``."""

    def __init__(self, data: np.ndarray, place: np.ndarray, reach: np.ndarray, backward: bool = False):
        self.data, self.place, self.reach, self.backward = data, place, reach, backward
        self.c = W.prefix_hashes(data)
        self.inverse = W.powers(len(self.c), "down")
        self.steps = int(reach.max(initial=0)).bit_length()

    def _hash(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        start = self.place[i] - n if self.backward else self.place[i]
        return (self.c[start + n] - self.c[start]) * self.inverse[start]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common length of the places numbered i and j, by binary search."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.reach[i], self.reach[j])
        for _ in range(self.steps):
            middle = (low + high + 1) >> 1
            same = self._hash(i, middle) == self._hash(j, middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def _next(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The byte behind n common ones, or -1 at the end."""
        at = self.place[i] - n - 1 if self.backward else self.place[i] + n
        inside = n < self.reach[i]
        return np.where(inside, self.data[np.where(inside, at, 0)].astype(np.int64), -1)

    def _before(self, i: np.ndarray, j: np.ndarray, ties: bool) -> np.ndarray:
        """Whether i comes before j; equal ones count as before if ``ties``."""
        n = self.common(i, j)
        a, b = self._next(i, n), self._next(j, n)
        return (a < b) | ((a == b) & ties)

    def sort(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the places in order, group by group, and the verified common length of
        each with the one before it (-1 at the begin of a group)."""
        size = len(self.place)
        order = np.arange(size)
        group = np.repeat(np.arange(len(first) - 1), np.diff(first))
        begin, end = first[group], first[group + 1]
        longest = int(np.diff(first).max(initial=0))
        width = 1
        while width < longest:
            position = np.arange(size)
            run = (position - begin) // width
            mine = begin + run * width
            other = np.where(run % 2 == 0, np.minimum(mine + width, end), mine - width)
            other_end = np.minimum(other + width, end)
            busy = other < other_end
            low, high = other.copy(), other_end.copy()
            ties = run % 2 == 1
            todo = np.flatnonzero(busy)
            while len(todo):
                middle = (low[todo] + high[todo]) >> 1
                ahead = self._before(order[middle], order[todo], ties[todo])
                low[todo[ahead]] = middle[ahead] + 1
                high[todo[~ahead]] = middle[~ahead]
                todo = todo[low[todo] < high[todo]]
            target = np.where(run % 2 == 0, mine, other) + (position - mine) + np.where(busy, low - other, 0)
            moved = np.empty_like(order)
            moved[target] = order
            order = moved
            width *= 2
        shared = np.full(size, -1, np.int64)
        inner = np.ones(size, bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        at = np.flatnonzero(inner)
        if len(at):
            hashed = self.common(order[at - 1], order[at])
            shared[at] = self._verified(order[at - 1], order[at], hashed)
            for g in np.unique(group[at[shared[at] != hashed]]).tolist():
                self._exactly(order, shared, int(first[g]), int(first[g + 1]))
        return order, shared

    def _bytes(self, i: int) -> bytes:
        p, n = int(self.place[i]), int(self.reach[i])
        return self.data[p - n : p].tobytes()[::-1] if self.backward else self.data[p : p + n].tobytes()

    def _exactly(self, order: np.ndarray, shared: np.ndarray, begin: int, end: int) -> None:
        """Sort a group anew by the bytes: equal hashes of different bytes have misled the sort."""
        text = {i: self._bytes(i) for i in order[begin:end].tolist()}
        order[begin:end] = sorted(text, key=text.__getitem__)
        for k in range(begin + 1, end):
            a, b = text[order[k - 1]], text[order[k]]
            shared[k] = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    def _verified(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Common lengths on the bytes, for the lengths n that the hashes give."""
        out = n.copy()
        for k in range(0, len(i), 8192):
            part = slice(k, k + 8192)
            span = np.arange(int(n[part].max(initial=0)))
            inside = span < n[part][:, None]
            at = [np.where(inside, self.place[x[part]][:, None] + (-1 - span if self.backward else span), 0) for x in (i, j)]
            differ = inside & (self.data[at[0]] != self.data[at[1]])
            found = differ.any(axis=1)
            out[part][found] = differ.argmax(axis=1)[found]
        return out
