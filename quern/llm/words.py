"""Words, lines and hashes of many UTF-8 texts at once, as numpy arrays.

A ``Block`` is a run of whole texts of an Arrow batch, about ``BLOCK_BYTES`` long, or one longer
text. White space is the six ASCII characters 0x20 and 0x09 to 0x0D throughout, so words of bytes
and words of code points are the same.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Each byte of a block takes some sixty of memory.
BLOCK_BYTES = 1 << 18
_libc = ctypes.CDLL(None)
if hasattr(_libc, "mallopt"):
    # Arrays from 256 kB on are mapped each, so that a worker that Spark keeps for other tasks
    # gives back what it has freed; glibc would else raise this threshold (its option -3) as it goes.
    _libc.mallopt(-3, 1 << 18)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def release() -> None:
    """Give memory that is free back to the system: Spark keeps Python workers for other tasks."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n numbers of the splitmix64 generator."""
    return mix64(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


BYTE = stream(11, 256)
BASE = int(stream(12, 1)[0]) | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, which: str = "up") -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    if len(_powers[which]) < n:
        p = np.full(max(n, BLOCK_BYTES + 4096), BASE if which == "up" else INVERSE, np.uint64)
        p[0] = 1
        _powers[which] = np.cumprod(p, dtype=np.uint64)
    return _powers[which][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """C with C[i] the sum of BYTE[data[j]] * BASE**j over j < i, modulo 2**64."""
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum(BYTE[data] * powers(len(data)), out=c[1:])
    return c


def span_hashes(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] from the prefix hashes; equal content has equal hashes anywhere."""
    return (c[end] - c[start]) * powers(len(c), "down")[start]


class Block:
    """Texts ``first`` to ``first + n`` of a batch: their bytes and where each starts and ends."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first, self.n = data, bounds, first, len(bounds) - 1

    def _edges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of ``inside``, cut where texts meet."""
        size = len(inside)
        if not size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        cuts = self.bounds[(self.bounds > 0) & (self.bounds < size)]
        before = np.empty(size, bool)
        before[0] = False
        before[1:] = inside[:-1]
        before[cuts] = False
        after = np.empty(size, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[cuts - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and for each text the index of its first word (one more for the end)."""
        starts, ends = self._edges(~SPACE[self.data])
        return starts, ends, np.searchsorted(starts, self.bounds)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines between line feeds, one at least for each text, and where
        each text's lines start among them."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.bounds[:-1], feeds + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.bounds[1:], feeds]), kind="stable")
        first = np.searchsorted(feeds, self.bounds) + np.arange(self.n + 1)
        return starts, ends, first


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Null texts count as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        b = min(b, n)
        yield Block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a)
        a = b


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k words within a text, in order, and where each text's begin. A text
    of fewer words, but at least one, has a single run of them all."""
    n = np.diff(first)
    weight = stream(13, k) | np.uint64(1)
    made = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(int(bounds[-1]), np.uint64)
    text = np.repeat(np.arange(len(n)), made)
    at = first[text] + np.arange(len(out)) - bounds[text]
    for j in range(k):
        there = j < n[text]
        out[there] += words[at[there] + j] * weight[j]
    out += np.minimum(n[text], k).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(out), bounds
