"""Edit distances of many pairs of texts at once.

Columns of the table of distances are kept as vertical differences, 64 rows a number (Myers, with
carries between numbers as by Hyyrö). All pairs whose first texts take as many numbers advance
together, by one character of their second texts; pairs come by falling length of these, so those
that are through are the last ones. Where only distances within a limit matter, rows far from the
diagonal are left out, and pairs beyond their limits go early.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np

#: First texts of more numbers than this, and groups of fewer pairs for each number, cost less one by one.
NUMBERS, LEAST = 8, 32
#: The same for distances within a limit, which take fewer steps.
MOST, FEW = 64, 2
TABLE_BYTES = 1 << 22
_ONE, _HIGH = np.uint64(1), np.uint64(63)


def _numbers(a: str) -> int:
    return (len(a) + 63) >> 6


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of texts, which text each belongs to, and its place there."""
    size = np.array([len(t) for t in texts])
    text = np.repeat(np.arange(len(texts)), size)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, text, np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)


def _advance(a: list[str], b: list[str], numbers: int, limit: np.ndarray) -> np.ndarray:
    """Distances of pairs, by falling length of b; each a fits into as many numbers. What is beyond a
    pair's limit, at least the difference of its lengths, is some number beyond it: only rows within the
    widest limit of the diagonal are kept, the others count as reached by insertions or deletions, and
    pairs whose every way on costs more than their limit go."""
    pairs = len(a)
    (codes_a, pair_a, at_a), (codes_b, pair_b, at_b) = _codes(a), _codes(b)
    seen = np.zeros(int(max(codes_a.max(), codes_b.max())) + 1, bool)
    seen[codes_a] = seen[codes_b] = True
    known, place = np.flatnonzero(seen), np.cumsum(seen) - 1
    same = np.zeros(numbers * len(known) * pairs, np.uint64)
    np.add.at(same, ((at_a >> 6) * len(known) + place[codes_a]) * pairs + pair_a, _ONE << (at_a & 63).astype(np.uint64))
    same = same.reshape(numbers, len(known) * pairs)
    size_a, size_b = (np.array([len(t) for t in x]) for x in (a, b))
    step = np.zeros((size_b[0], pairs), np.int64)
    step[at_b, pair_b] = place[codes_b] * pairs + pair_b
    more, less = np.full((numbers, pairs), ~np.uint64(0)), np.zeros((numbers, pairs), np.uint64)
    widest = int(limit.max())
    out, here = limit + 1, np.arange(pairs)
    last = min(numbers, (widest >> 6) + 1)
    bottom = np.full(pairs, 64 * last)  # the distance in the last row of the last number
    for j in range(size_b[0]):
        n = len(here)
        while last < numbers and 64 * last <= j + 1 + widest:
            last, bottom = last + 1, bottom + 64
        first = min(last - 1, max(0, (j - widest) >> 6))
        at = step[j] if n == pairs else step[j, here]
        up, down = _ONE, np.uint64(0)
        for k in range(first, last):
            eq, p, m = same[k].take(at), more[k], less[k]
            vertical = eq | m
            eq |= down
            across = eq & p
            across += p
            across ^= p
            across |= eq
            plus = ~(across | p)
            plus |= m
            minus = across
            minus &= p
            next_up, next_down = plus >> _HIGH, minus >> _HIGH
            plus <<= _ONE
            plus |= up
            minus <<= _ONE
            minus |= down
            np.bitwise_or(minus, ~(vertical | plus), out=p)
            np.bitwise_and(plus, vertical, out=m)
            up, down = next_up, next_down
        bottom += up.astype(np.int64) - down.astype(np.int64)
        through = n - int(np.searchsorted(size_b[here][::-1], j + 1, "right"))
        if through < n:
            of = here[through:]
            rows = np.clip(size_a[of] - 64 * np.arange(first, last)[:, None], 0, 64)
            beyond = np.where(rows == 64, np.uint64(0), ~np.uint64(0) << (rows & 63).astype(np.uint64))
            out[of] = bottom[through:] - _rise(more[first:last, through:] & beyond, less[first:last, through:] & beyond).sum(axis=0)
        if through < n or not (j + 1) & 63:
            left = np.arange(through)
            if not (j + 1) & 63:
                left = np.flatnonzero(_least(more[first:last, :through], less[first:last, :through], bottom[:through], first, size_a[here[:through]] - size_b[here[:through]] + j + 1) <= limit[here[:through]])
            if not len(left):
                break
            here, bottom = here[left], bottom[left]
            more, less = np.ascontiguousarray(more[:, left]), np.ascontiguousarray(less[:, left])
    return out


def _rise(more: np.ndarray, less: np.ndarray) -> np.ndarray:
    return np.bitwise_count(more).astype(np.int64) - np.bitwise_count(less)


def _least(more: np.ndarray, less: np.ndarray, bottom: np.ndarray, first: int, diagonal: np.ndarray) -> np.ndarray:
    """At least what any way through the numbers of a column costs in the end; ``diagonal`` is the row
    from which the rest has as many rows as columns."""
    found = np.full(len(bottom), np.iinfo(np.int64).max)
    for k in range(len(more) - 1, -1, -1):
        top = bottom - _rise(more[k], less[k])
        row = 64 * (first + k)
        np.minimum(found, (top + bottom - 64) // 2 + np.maximum(0, np.maximum(row - diagonal, diagonal - row - 64)), out=found)
        bottom = top
    return found


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """The edit distance of each pair, or -1 where a pair is left to the caller: those with a first
    text that is empty or long, an empty second, or few others of the first's length."""
    able = [i for i in range(len(a)) if a[i] and b[i] and _numbers(a[i]) <= NUMBERS]
    return _together(a, b, np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64), able, LEAST)


def within(a: list[str], b: list[str], limit: np.ndarray) -> np.ndarray:
    """For each pair 1 or 0, whether its edit distance is within its limit, or -1 where a pair is left
    to the caller, as in ``distances``."""
    out = np.full(len(a), -1, np.int64)
    able = []
    for i, (x, y, most) in enumerate(zip(a, b, limit.tolist(), strict=True)):
        if abs(len(x) - len(y)) > most:
            out[i] = 0
        elif x == y:
            out[i] = 1
        elif x and y and _numbers(min(x, y, key=len)) <= MOST:
            able.append(i)
    short, long = list(a), list(b)
    for i in able:
        if len(a[i]) > len(b[i]):
            short[i], long[i] = b[i], a[i]
    found = _together(short, long, limit, able, FEW)
    some = found >= 0
    out[some] = found[some] <= limit[some]
    return out


def _together(a: list[str], b: list[str], limit: np.ndarray, able: list[int], least: int) -> np.ndarray:
    out = np.full(len(a), -1, np.int64)
    number = {i: n if n <= NUMBERS else -(-n // 4) * 4 for i in able for n in [_numbers(a[i])]}
    able.sort(key=lambda i: (number[i], -len(b[i])))
    for numbers, found in groupby(able, lambda i: number[i]):
        of = list(found)
        if len(of) < least * numbers:
            continue
        alphabet = len(set().union(*(a[i] for i in of), *(b[i] for i in of)))
        first = 0
        while first < len(of):
            some = of[first : first + max(1, TABLE_BYTES // (8 * max(numbers * alphabet, len(b[of[first]]))))]
            first += len(some)
            if len(some) >= least * numbers:
                out[some] = _advance([a[i] for i in some], [b[i] for i in some], numbers, limit[some])
    return out
