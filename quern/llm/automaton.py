"""Byte automata of regular expressions: subset construction, minimisation, one pass over bytes.

The syntax is what rules of plain tokens need: literals, ``\\xHH``, classes with ranges, groups,
``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}`` and ``{m,n}``. A pattern is over ASCII; bytes above
0x7F belong to no class, so matches in UTF-8 bytes are matches in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Parser:
    """Recursive descent from a pattern to fragments of a nondeterministic automaton."""

    def __init__(self, nfa: Nfa, pattern: str, fold: bool):
        self.nfa, self.s, self.i, self.fold = nfa, pattern, 0, fold

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def either(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.nfa.state(), self.nfa.state()
        for x, y in parts:
            self.nfa.free[a].append(x)
            self.nfa.free[y].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        a = at = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            begun = self.i
            x, y = self.atom()
            low, high = self.times()
            ended = self.i
            copies = [(x, y)]
            while len(copies) < max(low, 1 if high is None else high):
                self.i = begun
                copies.append(self.atom())
            self.i = ended
            for k, (x, y) in enumerate(copies):
                if k >= low:
                    self.nfa.free[at].append(x)
                    after = self.nfa.state()
                    self.nfa.free[at].append(after)
                    self.nfa.free[y].append(after)
                    at, y = after, y
                else:
                    self.nfa.free[at].append(x)
                    at = y
                if high is None and k == len(copies) - 1:
                    self.nfa.free[y].append(x)
        return a, at

    def times(self) -> tuple[int, int | None]:
        c = self.peek()
        if c in ("?", "*", "+"):
            self.i += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            end = self.s.index("}", self.i)
            low, comma, high = self.s[self.i + 1 : end].partition(",")
            self.i = end + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def atom(self) -> tuple[int, int]:
        c = self.s[self.i]
        if c == "(":
            self.i += 1
            found = self.either()
            self.i += 1
            return found
        return self.nfa.step(self.fold_case(self.members() if c == "[" else {self.char()}))

    def char(self) -> int:
        c = self.s[self.i]
        if c == "\\":
            if self.s[self.i + 1] == "x":
                self.i += 4
                return int(self.s[self.i - 2 : self.i], 16)
            self.i += 1
            c = self.s[self.i]
        self.i += 1
        return ord(c)

    def members(self) -> set[int]:
        self.i += 1
        found: set[int] = set()
        while self.peek() != "]":
            low = self.char()
            high = low
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                high = self.char()
            found.update(range(low, high + 1))
        self.i += 1
        return found

    def fold_case(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {ord(chr(c).swapcase()) for c in found if chr(c).isalpha()}
        return frozenset(found)


class Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.on: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append([])
        return len(self.free) - 1

    def step(self, found: frozenset[int]) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.on[a].append((found, b))
        return a, b

    def close(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    def turned(self, start: int, end: int) -> tuple[Nfa, int, int]:
        """The automaton of the reversed strings."""
        back = Nfa()
        for _ in self.free:
            back.state()
        for a, xs in enumerate(self.free):
            for x in xs:
                back.free[x].append(a)
        for a, xs in enumerate(self.on):
            for found, x in xs:
                back.on[x].append((found, a))
        return back, end, start


@dataclass(frozen=True)
class Dfa:
    """``step[state * classes + class_of[byte]]`` is the next state, ``accepts[state]`` a bit for
    each rule that a match of ends there. State 0 is the start."""

    class_of: np.ndarray
    classes: int
    step: np.ndarray
    accepts: np.ndarray

    def resets(self) -> np.ndarray:
        """Bytes after which the state is the start, whatever it was, so that scans can begin there."""
        table = self.step.reshape(-1, self.classes)
        return (table == 0).all(axis=0)[self.class_of]


def _determine(nfa: Nfa, start: int, ends: dict[int, int], searching: bool) -> Dfa:
    """Subset construction over classes of bytes that no rule tells apart, then minimisation by
    splitting blocks of states until no class of bytes tells two states of a block apart."""
    sets = {found for xs in nfa.on for found, _ in xs}
    marks: dict[tuple[bool, ...], int] = {}
    order = sorted(sets, key=sorted)
    class_of = np.array([marks.setdefault(tuple(b in x for x in order), len(marks)) for b in range(256)], np.int64)
    sample = {int(c): b for b, c in reversed([*enumerate(class_of)])}
    begin = nfa.close({start})
    names, todo, rows = {begin: 0}, [begin], []
    while len(rows) < len(todo):
        here, row = todo[len(rows)], []
        for c in range(len(marks)):
            moved = {x for a in here for found, x in nfa.on[a] if sample[c] in found}
            there = nfa.close(moved | ({start} if searching else set()))
            if there not in names:
                names[there] = len(todo)
                todo.append(there)
            row.append(names[there])
        rows.append(row)
    accept = np.array([sum(1 << r for r in {ends[x] for x in here if x in ends}) for here in todo], np.int64)
    step = np.array(rows)
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    first = {int(b): k for k, b in reversed([*enumerate(block)])}
    place = {b: k for k, b in enumerate(sorted(first, key=lambda b: first[b]))}
    kept = sorted(first.values())
    renamed = np.vectorize(place.__getitem__)(block)
    return Dfa(class_of, len(marks), renamed[step[kept]].astype(np.int64).reshape(-1), accept[kept])


def combined(rules: list[tuple[str, bool]]) -> Dfa:
    """One automaton that searches for all rules (pattern, either case) at once."""
    nfa = Nfa()
    start, ends = nfa.state(), {}
    for k, (pattern, fold) in enumerate(rules):
        a, b = _Parser(nfa, pattern, fold).either()
        nfa.free[start].append(a)
        ends[b] = k
    return _determine(nfa, start, ends, True)


def anchored(pattern: str, fold: bool, backward: bool = False) -> Dfa:
    """The automaton of one rule from a fixed place on, forward or backward."""
    nfa = Nfa()
    start, end = _Parser(nfa, pattern, fold).either()
    if backward:
        nfa, start, end = nfa.turned(start, end)
    return _determine(nfa, start, {end: 0}, False)


def hits(dfa: Dfa, data: np.ndarray, bounds: np.ndarray, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Where matches end, in one pass over the bytes: places (the match's last byte) and their bits.

    ``data`` holds texts back to back, cut at ``bounds``. The texts are cut further, behind bytes
    that reset the automaton, into lanes of about ``lane`` bytes, and all lanes advance together.
    """
    size = len(data)
    if not size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    symbols = dfa.class_of[data]
    safe = np.flatnonzero(dfa.resets()[data]) + 1
    grid = np.arange(lane, size, lane)
    cuts = safe[np.minimum(np.searchsorted(safe, grid), len(safe) - 1)] if len(safe) else safe
    starts = np.unique(np.concatenate([bounds[:-1], cuts]))
    starts = starts[starts < size]
    lengths = np.diff(np.append(starts, size))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    ending = dfa.accepts != 0
    state = np.zeros(len(starts), np.int64)
    where: list[np.ndarray] = []
    bits: list[np.ndarray] = []
    for k in range(int(lengths[0])):
        n = alive[k]
        if n <= 4:
            break
        at = starts[:n] + k
        state = dfa.step[state[:n] * dfa.classes + symbols[at]]
        found = ending[state]
        if found.any():
            where.append(at[found])
            bits.append(dfa.accepts[state[found]])
    else:
        k = int(lengths[0])
    step, accepts, classes = (dfa.step.tolist(), dfa.accepts.tolist(), dfa.classes) if k < lengths[0] else ([], [], 0)
    for j in range(int(alive[k]) if k < lengths[0] else 0):
        here, begun, ended = int(state[j]), int(starts[j]) + k, int(starts[j] + lengths[j])
        found = []
        for i, c in enumerate(symbols[begun:ended].tolist(), begun):
            here = step[here * classes + c]
            if accepts[here]:
                found.append((i, accepts[here]))
        if found:
            where.append(np.array([i for i, _ in found]))
            bits.append(np.array([x for _, x in found]))
    if not where:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    places, marks = np.concatenate(where), np.concatenate(bits)
    order = np.argsort(places)
    return places[order], marks[order]
