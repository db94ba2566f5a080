"""Fuzzy line deduplication.

Lines are normalised: A-Z in lower case, digits as 0, punctuation and white space between words as
one blank. Equal normalised lines are one class, however short. A class has SimHashes: one of 128
bits over its pairs of neighbouring words, and one of 64 for each block of words. Words are dealt
into blocks by their hash, so a changed word spoils two blocks at most, and by the pigeonhole
principle the others agree:

* from ``LONG`` words on, one block for about every four words, each of them a key;
* from ``MIDDLE`` words on, five blocks, two of them a key;
* below, a word is a block, and a key is all of them but one, or all.

Classes near a limit have the keys of both sides. A key of different words of less than ``WEIGHT``,
their bytes less one each, is common; it holds the class of the line's length too, and stands only
where what a changed word leaves has no heavier key: short lines keep all of theirs, middle ones have
one of the four blocks left, and long ones with few keys have those of the middle too. So lines that
differ by one word share a key whatever their words weigh, if they have a word in common. Characters
of scripts without blanks count as words of weight two.

The classes of a key form a bucket with those of all keys that have the same first class by a hash.
Classes that share a bucket, whose lengths allow it and whose 128 bits differ in at most ``BITS``
are links if their edit similarity, 1 - distance / longer length, is at least ``SIMILARITY``: what
is linked is exact, which pairs are looked at is not (the README has the recall). Of each connected
group the first occurrence, by document and line, stays; all other lines of the group go, other
lines stay as they are.

Defined cases: a null text stays null and has no lines; lines without a letter or digit are never
dropped; repeated rows are documents of their own, whose lines go; rows without an id come last in
order; very long lines are compared whole; an empty table gives an empty result; all other columns
pass through under any name, but for the result's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quern.llm import bloom, edits
from quern.llm import words as W
from quern.llm.components import components
from quern.llm.linking import cells, links, spread_join
from quern.session import attach, drop_table, free_shuffles, numbered, scope, table

SIMILARITY = 80
BITS = 44
SHORT, MIDDLE, LONG = 1, 9, 24
#: A class this near to a limit has the keys of both sides.
NEAR = 2
BLOCKS, FEW = 6, 3
#: Keys to a range, and keys or pairs that a worker holds before it passes them on.
RANGE, HELD = 500_000, 1_000_000
#: Bytes that keys, and ids in buckets, are cut to: what is told apart no more is compared in vain.
CUT = 5
#: Rows of whole cells that are compared together.
CELL_ROWS = 8192
#: The least weight of a short, middle and long line's keys that need no class of length.
WEIGHT = (8, 10, 14)
#: Lengths of lines that are alike are in the same or in neighbouring classes, as 1 / 0.8 is less.
CLASS = 1.26
MADE = ("n_lines", "n_removed")
#: What a byte of a line becomes; 0x20 separates. Bytes of other scripts stay.
NORMAL = W.LOWER.copy()
NORMAL[48:58] = 48
NORMAL[[b for b in range(128) if not (chr(b).isalnum())]] = 32
_SALT = W.stream(31, 8)
PLACE = ["_file", "_row"]


class Lines:
    """The lines of a block of texts: where they start (``first_line`` by text), and their words."""

    def __init__(self, b: W.Block):
        starts, ends, self.first_line = b.lines()
        data = NORMAL[b.data]
        inside = data != 32
        size = len(data)
        before = np.zeros(size, bool)
        before[1:] = inside[:-1]
        before[b.bounds[b.bounds < size]] = False
        start = inside & ~before
        run_starts = np.flatnonzero(start)
        whole = (data & 0xC0) != 0x80
        if (data >= 0xE0).any():
            after = np.zeros(size, bool)
            after[3:] |= (data[:-3] >= 0xE0) & (data[:-3] < 0xF0)
            after[4:] |= data[:-4] >= 0xF0
            start |= inside & whole & ((data >= 0xE0) | after)
        word_start = np.flatnonzero(start)
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | start[1:]
        word_end = np.flatnonzero(stop) + 1
        wide = data[word_start] >= 0xE0
        self.weight = np.where(wide, 2, np.maximum(word_end - word_start - 1, 0))
        self.hashes = W.mix64(W.span_hashes(W.prefix_hashes(data), word_start, word_end))
        self.first = np.append(np.searchsorted(word_start, starts), len(word_start))
        self.n = np.diff(self.first)
        chars = np.concatenate([[0], np.cumsum(inside & whole, dtype=np.int64)])
        runs = np.searchsorted(run_starts, ends) - np.searchsorted(run_starts, starts)
        self.chars = chars[ends] - chars[starts] + np.maximum(runs - 1, 0)


def simhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits for each run of hashes, each set if more than half of the run's hashes have it. Counts
    share a number: eight of 8 bits if the longest run allows it, or else fewer, wider ones. Half the
    run's length is taken off all of them at once, which leaves the answer in their highest bits."""
    size = np.diff(np.append(first, len(hashes))).astype(np.uint64)
    longest = int(size.max(initial=0))
    width = 8 if longest < 1 << 7 else 16 if longest < 1 << 15 else 32
    ones = np.uint64(sum(1 << k for k in range(0, 64, width)))
    bias = (np.uint64((1 << width - 1) - 1) - (size >> np.uint64(1))) * ones
    out = np.zeros(len(first), np.uint64)
    for shift in range(width):
        counts = np.add.reduceat((hashes >> np.uint64(shift)) & ones, first)
        out |= (((counts + bias) >> np.uint64(width - 1)) & ones) << np.uint64(shift)
    return out


def _expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of n items from ``first`` on: each item's place, and which run it belongs to."""
    run = np.repeat(np.arange(len(n)), n)
    return first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n), run


def _blocks(x: Lines, line: np.ndarray, dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different words of lines in ``dealt`` blocks each, by their hash: for each block that has
    any the entry of ``line`` it belongs to, its number, its SimHash and its weight."""
    at, run = _expanded(x.first[line], x.n[line])
    number = ((x.hashes[at] >> np.uint64(33)) % dealt[run].astype(np.uint64)).astype(np.int64)
    offset = np.cumsum(dealt) - dealt
    group = offset[run] + number
    code = (group << 32) | (x.hashes[at] >> np.uint64(32)).astype(np.int64)
    order = np.argsort(code)
    order = order[np.concatenate([[True], np.diff(code[order]) != 0])]
    group, at = group[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return run[order][first], group[first] - offset[run[order][first]], simhash(x.hashes[at], first), np.add.reduceat(x.weight[at], first)


def _light(x: Lines, line: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common keys, each with the class of the line's length and with the next: lines that are alike
    and have the same key share one of these."""
    length = np.floor(np.log(x.chars[line]) / np.log(CLASS)).astype(np.uint64)
    return np.tile(line, 2), np.concatenate([W.mix64(W.mix64(keys ^ _SALT[5]) + c) for c in (length, length + np.uint64(1))])


def _short_keys(x: Lines, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = x.n[line]
    at, run = _expanded(x.first[line], n)
    value, size = W.mix64(x.hashes[at] ^ _SALT[0]), x.weight[at]
    first = np.cumsum(n) - n
    total, total_size = np.add.reduceat(value, first), np.add.reduceat(size, first)
    keys = np.concatenate([W.mix64(total), W.mix64(total[run] - value)])
    sizes = np.concatenate([total_size, total_size[run] - size])
    lines, able = np.concatenate([line, line[run]]), sizes >= WEIGHT[0]
    light = ~able & np.concatenate([np.ones(len(line), bool), n[run] > 1])
    common = _light(x, lines[light], keys[light])
    return np.concatenate([lines[able], common[0]]), np.concatenate([keys[able], common[1]])


def _middle_keys(x: Lines, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    entry, number, value, size = _blocks(x, line, np.full(len(line), BLOCKS))
    values, sizes = np.zeros((len(line), BLOCKS), np.uint64), np.zeros((len(line), BLOCKS), np.int64)
    values[entry, number], sizes[entry, number] = W.mix64(value ^ _SALT[1]), size
    found = []
    heavy = {(i, j): sizes[:, i] + sizes[:, j] >= WEIGHT[1] for i, j in combinations(range(BLOCKS), 2)}
    for (i, j), able in heavy.items():
        found.append((line[able], W.mix64(values[able, i] * np.uint64(3) + values[able, j] + np.uint64(BLOCKS * i + j))))
    for left in combinations(range(BLOCKS), BLOCKS - 2):
        light = np.flatnonzero(~np.any([heavy[pair] for pair in combinations(left, 2)], axis=0))
        keys = np.full(len(light), sum(1 << k for k in left), np.uint64)
        for k in left:
            keys = W.mix64(keys) + values[light, k]
        found.append(_light(x, line[light], keys))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _long_keys(x: Lines, line: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines and keys, and those lines that have fewer than ``FEW`` on a level."""
    entry, number, value, size = _blocks(x, line, np.int64(8) << level)
    keys = W.mix64(W.mix64(value ^ _SALT[2]) + (number * 64 + level[entry]).astype(np.uint64))
    able = size >= WEIGHT[2]
    return line[entry[able]], keys[able], line[np.bincount(entry[able], minlength=len(line)) < FEW]


def line_keys(x: Lines, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of ``use`` and all their keys, by line. Long lines with fewer keys than ``FEW`` on a level,
    all of which a changed word may spoil, get those of a middle one too. Word counts a fifth apart
    share a level."""
    n = x.n[use]
    found = []
    middle = use[(n >= MIDDLE) & (n < LONG + NEAR + 1)]
    if len(some := use[(n >= SHORT) & (n < MIDDLE + NEAR)]):
        found.append(_short_keys(x, some))
    if len(line := use[n >= LONG - NEAR]):
        m = x.n[line]
        level = np.maximum(0, np.floor(np.log2(m / LONG))).astype(np.int64)
        up, down = m > 0.9 * (LONG << (level + 1)), (m <= 1.125 * (LONG << level)) & (level > 0)
        of, keys, few = _long_keys(x, np.concatenate([line, line[up], line[down]]), np.concatenate([level, level[up] + 1, level[down] - 1]))
        found.append((of, keys))
        middle = np.union1d(middle, few)
    if len(middle):
        found.append(_middle_keys(x, middle))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    line, keys = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.argsort(line, kind="stable")
    return line[order], keys[order]


BITS_OF = ["bits0", "bits1"]
LINE_ROWS = "doc long, _file long, _row long, line long, id long, n long, bits0 long, bits1 long, keys binary"


def line_bits(x: Lines, use: np.ndarray) -> list[np.ndarray]:
    """The SimHashes of lines over pairs of neighbouring words, the last with what ends a line."""
    first = x.first[use]
    after = np.append(x.hashes[1:], np.uint64(0))
    after[first + x.n[use] - 1] = _SALT[3]
    pairs = W.mix64(x.hashes * np.uint64(3) + after)
    return [simhash(pairs, first), simhash(W.mix64(pairs ^ _SALT[4]), first)]


def line_rows(texts: DataFrame) -> DataFrame:
    """(doc, _file, _row, text) to a row for each line with a word: its number (from 0), class,
    normalised length in characters, SimHash and keys, of ``CUT`` bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [batch.column(k).to_numpy() for k in range(3)]
            for b in W.blocks(batch.column(3)):
                x = Lines(b)
                use = np.flatnonzero(x.n)
                if not len(use):
                    continue
                first = x.first[use]
                rank = np.arange(len(x.hashes)) - np.repeat(first, x.n[use])
                whole = W.mix64(np.add.reduceat(W.mix64(x.hashes + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first))
                line, keys = line_keys(x, use)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(x.n))[use])])
                text = np.searchsorted(x.first_line, use, "right") - 1
                columns = [p[b.first + text] for p in places] + [use - x.first_line[text], whole.view(np.int64), x.chars[use], *(bits.view(np.int64) for bits in line_bits(x, use))]
                made = pa.Array.from_buffers(pa.binary(), len(use), [None, pa.py_buffer((CUT * offsets).astype(np.int32)), pa.py_buffer(_cut(keys).tobytes())])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), made], names=["doc", "_file", "_row", "line", "id", "n", *BITS_OF, "keys"])

    return texts.select("doc", *PLACE, "text").mapInArrow(run, LINE_ROWS)


def normalised(line: Column) -> Column:
    """The words of a line as ``line_rows`` sees them, joined by blanks."""
    changed = [k for k in range(128) if k != NORMAL[k]]
    plain = F.translate(line, "".join(map(chr, changed)), "".join(chr(NORMAL[k]) for k in changed))
    return F.trim(F.regexp_replace(plain, " +", " "))


def keyed_lines(lines: DataFrame) -> DataFrame:
    """(id, keys) to (key, id), each once, of the keys that several classes have. The classes of a key
    have the one among them that comes first by a hash as their key instead, so that keys of the same
    classes become one, and classes are compared in few buckets however many keys they share; what
    shares a key shares a bucket. Ids are cut (``short``). Keys travel packed:
    a row holds many of one range of keys, sorted, byte by byte, so what they have in common shrinks.
    Each range has about ``RANGE`` of them, copies of classes aside, and is sorted in one task."""
    total = lines.agg(F.sum(F.octet_length("keys") / CUT).cast("long")).first()[0] or 0
    parts = -(-total // RANGE) or 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            keys, ids = _once(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
            rows = [(int(part[a]), _planes(keys[a:b]), _planes(ids[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=["part", "keys", "ids"])

        for batch in batches:
            column = batch.column(1)
            n = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)
            if n[-1] > n[0]:
                keys = _whole(np.frombuffer(column.buffers()[2], np.uint8, n[-1] - n[0], n[0]).reshape(-1, CUT))
                ids = batch.column(0).to_numpy().view(np.uint64) & _SHORT
                held.append((keys, np.repeat(ids, np.diff(n) // CUT)))
            if sum(len(h[0]) for h in held) >= HELD:
                yield packed()
                held.clear()
        if held:
            yield packed()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(_values(k.as_py()), _values(i.as_py())) for batch in batches for k, i in zip(batch.column(1), batch.column(2), strict=True)]
        if found:
            keys, ids = _once(*(np.concatenate([f[k] for f in found]) for k in (0, 1)))
            again = np.concatenate([[False], keys[1:] == keys[:-1]])
            again[:-1] |= again[1:]
            keys, ids = _once(*_led(keys[again], ids[again]))
            keys, ids = keys.view(np.int64), ids.view(np.int64)
            for a in range(0, len(keys), HELD):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + HELD]), pa.array(ids[a : a + HELD])], names=["key", "id"])

    some = lines.select("id", "keys").mapInArrow(pack, "part long, keys binary, ids binary")
    return some.repartition(parts, "part").mapInArrow(shared, "key long, id long").distinct()


def _led(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ids in order of their keys, each once for a key: the key's id of the least hash, and the ids."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    if not len(first):
        return ids, ids
    size, order = np.diff(np.append(first, len(keys))), W.mix64(ids ^ _SALT[6])
    return np.repeat(ids[order == np.repeat(np.minimum.reduceat(order, first), size)], size), ids


def _once(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and ids in order of the keys, each pair once."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    tied = np.concatenate([[False], keys[1:] == keys[:-1]])
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)
    at = at[np.lexsort((ids[at], keys[at]))]
    same = np.concatenate([[False], (keys[at[1:]] == keys[at[:-1]]) & (ids[at[1:]] == ids[at[:-1]])]) if len(at) else np.empty(0, bool)
    left = np.ones(len(keys), bool)
    left[at[same]] = False
    return keys[left], ids[left]


_SHORT = np.uint64((1 << 64) - (1 << 64 - 8 * CUT))


def short(column: str) -> Column:
    """An id as in buckets."""
    return F.col(column).bitwiseAND(F.lit(int(_SHORT) - (1 << 64)))


def _cut(values: np.ndarray) -> np.ndarray:
    """The highest bytes of numbers, a row each."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, 8 - CUT :]


def _whole(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, 8 - CUT :] = rows
    return out.view(np.uint64).ravel()


def _planes(values: np.ndarray) -> bytes:
    """Cut numbers as their first bytes, then their second ones and so on."""
    return _cut(values).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    return _whole(np.frombuffer(planes, np.uint8).reshape(CUT, -1).T)


def class_texts(texts: DataFrame, wanted: DataFrame, number: int) -> DataFrame:
    """id and normalised text of the ``number`` wanted classes (id, _file, _row, line), from the line
    where each occurs first. Only lines that the Bloom filter lets pass are shuffled."""
    place = [*PLACE, "line"]
    at = F.xxhash64(*PLACE, F.col("line").cast("long")).alias("_at")
    every = texts.select(*PLACE, F.posexplode(F.split("text", "\n", -1)).alias("line", "raw")).select(*PLACE, F.col("line").cast("long").alias("line"), "raw")
    some = bloom.filtered(every.select("*", at), "_at", wanted.select(at), number).drop("_at")
    return some.join(wanted, place).select("id", normalised(F.col("raw")).alias("norm"))


def distance(a: str, b: str) -> int:
    """Edit distance: common ends are cut off, the rest goes by bit vectors over the first text."""
    size = min(len(a), len(b))
    i = next((k for k in range(0, size, 256) if a[k : k + 256] != b[k : k + 256]), size)
    while i < size and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        j = next((k for k in (4096, 64, 1) if k <= min(len(a), len(b)) and a[-k:] == b[-k:]), 1)
        a, b = a[:-j], b[:-j]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, found = every, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        across = (((same & more) + more) ^ more) | same
        up, down = less | (every & ~(across | more)), more & across
        found += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, (down << 1) & every
        more, less = down | (every & ~((same | less) | up)), up & (same | less)
    return found


def at_most(a: list[str], b: list[str], limit: int) -> bool:
    """Whether an alignment of words shows that the edit distance is within the limit; None of the
    words between two that agree need be alike. False shows nothing."""
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for step in range(1, 9):
            k = next((k for k in range(step + 1) if a[i + k : i + k + 1] == b[j + step - k : j + step - k + 1] != []), None)
            if k is not None:
                break
        else:
            return False
        cost += max(sum(map(len, a[i : i + k])) + k, sum(map(len, b[j : j + step - k])) + step - k)
        if cost > limit:
            return False
        i, j = i + k, j + step - k
    return cost + sum(map(len, a[i:])) + len(a) - i + sum(map(len, b[j:])) + len(b) - j <= limit


def alike(a: str, b: str) -> bool:
    """Whether the edit similarity is at least ``SIMILARITY``."""
    limit = (100 - SIMILARITY) * max(len(a), len(b)) // 100
    return abs(len(a) - len(b)) <= limit and (at_most(a.split(" "), b.split(" "), limit) or distance(a, b) <= limit)


def all_alike(a: list[str], b: list[str]) -> list[bool]:
    """``alike`` of each pair; pairs whose words do not show it at once are compared together."""
    limit = [(100 - SIMILARITY) * max(len(x), len(y)) // 100 for x, y in zip(a, b, strict=True)]
    out = [abs(len(x) - len(y)) <= n and at_most(x.split(" "), y.split(" "), n) for x, y, n in zip(a, b, limit, strict=True)]
    rest = [i for i, shown in enumerate(out) if not shown and abs(len(a[i]) - len(b[i])) <= limit[i]]
    found = edits.within([a[i] for i in rest], [b[i] for i in rest], np.array([limit[i] for i in rest], np.int64)).tolist()
    for i, d in zip(rest, found, strict=True):
        out[i] = distance(a[i], b[i]) <= limit[i] if d < 0 else d == 1
    return out


@F.pandas_udf(BooleanType())
def similar(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(all_alike(x.tolist(), y.tolist()), dtype=bool)


CELL = ["key", "_low", "_high"]


def near_rows(cells: DataFrame) -> DataFrame:
    """The rows of ``cells`` of ``linking`` that have another one near by bits in their cell."""
    rows = cells.select(*CELL, "_part", "c", "id", "n", *BITS_OF)
    return rows.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_by_cell(_near), rows.schema)


def connect(cells: DataFrame, norms: DataFrame) -> DataFrame:
    """Links (a, b) of the lines of each cell that connect all that are alike there, as ``cells`` of
    ``linking``, fewer than the cell has lines: lines are compared in the task that has their cell, and
    not at all once they are connected. Only lines with another one near by bits meet their texts."""
    rows = near_rows(cells)
    dealt = rows.join(norms, "id").select(*rows.columns, "norm").repartition(*CELL).sortWithinPartitions(*CELL)
    return dealt.mapInArrow(_by_cell(_linked), "a long, b long")


def _by_cell(f: Callable[[pa.Table, np.ndarray], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Applies a function to the rows of many whole cells at a time and the places where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            if len(rest) < CELL_ROWS:
                continue
            first = _cell_starts(rest)
            if len(first) > 1:
                yield from f(rest.slice(0, first[-1]), first[:-1]).to_batches()
                rest = rest.slice(first[-1])
        if rest is not None and len(rest):
            yield from f(rest, _cell_starts(rest)).to_batches()

    return run


def _cell_starts(rows: pa.Table) -> np.ndarray:
    if not len(rows):
        return np.empty(0, np.int64)
    new = np.zeros(len(rows) - 1, bool)
    for k in range(3):
        new |= np.diff(rows.column(k).to_numpy()) != 0
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _near_pairs(rows: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of each cell, by cell, whose components differ and whose lengths and bits allow a link."""
    low, high, part, c, n, bits0, bits1 = (rows.column(k).to_numpy() for k in (1, 2, 3, 4, 6, 7, 8))
    after = np.arange(len(rows)) + 1
    j, i = _expanded(after, np.repeat(np.append(first[1:], len(rows)), np.diff(np.append(first, len(rows)))) - after)
    able = (c[i] != c[j]) & ((low[i] == high[i]) | (part[i] != part[j])) & (100 * np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j]))
    i, j = i[able], j[able]
    differ = np.bitwise_count((bits0[i] ^ bits0[j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((bits1[i] ^ bits1[j]).view(np.uint64))
    return i[differ <= BITS], j[differ <= BITS]


def _near(rows: pa.Table, first: np.ndarray) -> pa.Table:
    i, j = _near_pairs(rows, first)
    return rows.take(pa.array(np.union1d(i, j)))


def _linked(rows: pa.Table, first: np.ndarray) -> pa.Table:
    """Links of whole cells. Pairs are compared in growing numbers a cell, those first that come first,
    so that most are connected before their turn; those of all cells together."""
    ids, texts = rows.column(5).to_numpy(), rows.column(9).to_pylist()
    i, j = _near_pairs(rows, first)
    _, of = np.unique(rows.column(4).to_numpy(), return_inverse=True)
    root = np.arange(of.max(initial=-1) + 1)
    size = np.diff(np.append(first, len(rows)))
    found: list[tuple[int, int]] = []
    while len(i):
        cell = np.searchsorted(first, i, "right") - 1
        turn = np.arange(len(i)) - np.searchsorted(cell, cell) < size[cell]
        some = alike_pairs(texts, i[turn], j[turn])
        for x, y in zip(i[turn][some].tolist(), j[turn][some].tolist(), strict=True):
            a, b = of[x], of[y]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                root[max(a, b)] = min(a, b)
        while (root[root] != root).any():
            root = root[root]
        left = ~turn & (root[of[i]] != root[of[j]])
        i, j, size = i[left], j[left], 2 * size
    return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def alike_pairs(texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.array(all_alike([texts[k] for k in i], [texts[k] for k in j]), bool)


def _groups(texts: DataFrame, lines: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Components (node, component) of the classes. Keys that only one class has stay behind."""
    pairs = table(keyed_lines(lines), "line-keys")
    if pairs.isEmpty():
        return None
    ids = table(pairs.select(F.col("id").alias("_short")).distinct(), "line-ids")
    free_shuffles(texts.sparkSession)
    about = bloom.filtered(lines.select("id", "n", *BITS_OF, short("id").alias("_short")), "_short", ids, ids.count()).dropDuplicates(["id"])
    members = table(pairs.withColumnRenamed("id", "_short").join(about, "_short").select("id", "n", *BITS_OF, "key"), "line-buckets")
    drop_table(pairs)
    # Lines that are near no other one of a bucket by bits are none of it: they have no links there.
    some = near_rows(cells(members.withColumn("c", F.col("id")), ["key"], BITS_OF)).select("id", "n", *BITS_OF, "key")
    members, every = table(some.dropDuplicates(["key", "id"]), "line-buckets-near"), members
    drop_table(every)
    if members.isEmpty():
        return None
    # The texts of all members, once for all rounds.
    place = [F.col(f"first.{k}").alias(k) for k in (*PLACE, "line")]
    wanted = table(classes.join(members.select("id").distinct(), "id", "left_semi").select("id", *place), "line-classes-wanted")
    norms = table(class_texts(texts, wanted, wanted.count()), "line-texts", compression="zstd")

    def confirm(pairs: DataFrame) -> DataFrame:
        half = spread_join(pairs, norms.select(F.col("id").alias("a"), F.col("norm").alias("x")), "a", pairs)
        both = spread_join(half, norms.select(F.col("id").alias("b"), F.col("norm").alias("y")), "b", pairs)
        return both.filter(similar("x", "y")).select("a", "b")

    close = f"100 * least(na, nb) >= {SIMILARITY} * greatest(na, nb)"
    near = " + ".join(f"bit_count({b} ^ o_{b})" for b in BITS_OF) + f" <= {BITS}"
    found = links(members, ["key"], close, confirm, lambda rest: rest, BITS_OF, near, lambda dealt: connect(dealt, norms))
    return None if found is None else components(found)


def repeated(docs: DataFrame) -> DataFrame:
    """(_file, _row, lines): the lines to remove from each row of ``numbered`` docs (doc_id, text)
    that loses any. A table."""
    spark = docs.sparkSession
    attach(spark)
    with scope(spark) as s:
        doc = F.coalesce(F.col("row.doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc")
        texts = docs.select(doc, *PLACE, F.col("row.text").alias("text"))
        lines = table(line_rows(texts), "lines")
        place = F.struct("doc", *PLACE, "line")
        classes = table(lines.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("k")), "line-classes")
        free_shuffles(spark)
        comp = _groups(texts, lines, classes)
        if comp is None:
            several = classes.filter("k > 1").select("id", F.col("first").alias("stays"))
        else:
            joined = classes.join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
            grouped = joined.filter("component is not null")
            first = grouped.groupBy("component").agg(F.min("first").alias("stays"))
            several = grouped.join(first, "component").select("id", "stays").unionByName(joined.filter("component is null and k > 1").select("id", F.col("first").alias("stays")))
        several = table(several, "lines-several")
        some = bloom.filtered(lines.select("id", *PLACE, "line", place.alias("place")), "id", several.select("id"), several.count())
        gone = some.join(several, "id").filter(F.col("place") != F.col("stays")).groupBy(*PLACE).agg(F.collect_list("line").alias("lines"))
        return s.keep(table(gone, "lines-gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with the text less its repeated lines, n_lines and n_removed."""
    kept = [c for c in docs.columns if c not in MADE]
    rows = numbered(docs.select(*(F.col(f"`{c}`") for c in kept)), "line-documents")
    gone = repeated(rows)
    at = F.xxhash64(*PLACE).alias("_at")
    blocks = bloom.size(gone.count())
    bits = table(bloom.build(gone.select(at), "_at", blocks), "line-documents-changed") if blocks else None
    marked = bloom.probe(rows.select("*", at), "_at", bits, blocks)
    text = F.col("row.text")
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1, F.lit(0)).cast("long").alias("n_lines")
    left = F.filter(F.split(text, "\n", -1), lambda x, k: ~F.array_contains(F.coalesce("lines", F.array().cast("array<bigint>")), k.cast("long")))
    whole = [F.col(f"row.`{c}`").alias(c) for c in kept]
    cut = [F.array_join(left, "\n").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in kept]
    some = marked.filter("_possible").join(gone, PLACE, "left")
    some = some.select(*cut, n_lines, F.coalesce(F.when(F.size("lines") >= 0, F.size("lines")), F.lit(0)).cast("long").alias("n_removed"))
    return some.unionByName(marked.filter("not _possible").select(*whole, n_lines, F.lit(0).cast("long").alias("n_removed")))
