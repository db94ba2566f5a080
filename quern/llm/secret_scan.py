"""Secret scans: all rules in one automaton, one pass over the bytes.

The pass finds where matches end. At the first end that is not yet covered, the rule's reversed
automaton walks back to the leftmost start, its own automaton walks forward to the longest match,
and the search goes on behind it: leftmost matches that do not overlap, by rule. Matches that a
rule's checks fail are dropped after that.

The base rules are ``assign``, ``access`` and ``hex``; ``key`` (private key headers) and
``hub`` (prefixed tokens) are added. Spans are kind, start and end in
code points, end exclusive, ordered by start, then by rule.

Defined cases: a null or empty text has no spans; equal rows have equal spans; an empty table
gives an empty result; other columns pass through unless they bear one of the result's names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.llm.automaton import Dfa, anchored, combined, hits
from quern.session import attach


@dataclass(frozen=True)
class Rule:
    """least: characters of the match, or, with ``tail``, of what the last part matches."""

    kind: str
    pattern: str
    fold: bool = False
    least: int = 0
    tail: bool = False
    base: bool = False


# The patterns of the base rules.
BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=\-]+", True, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", False, 20, False, True),
    Rule("hex", r"[0-9a-f]{24,}", False, 24, False, True),
)
ADDED = (
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub", r"(gh[opsur]|glpat|xox[abprs])[_\-][A-Za-z0-9]+", False, 24),
)
RULES = BASE + ADDED


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = combined([(r.pattern, r.fold) for r in rules])
        self.forward = [self._lists(anchored(r.pattern, r.fold)) for r in rules]
        self.back = [self._lists(anchored(r.pattern, r.fold, backward=True)) for r in rules]

    @staticmethod
    def _lists(dfa: Dfa) -> tuple[list, list, int, list]:
        """With the marks of the states from which no match can be reached."""
        table = dfa.step.reshape(-1, dfa.classes)
        lives = dfa.accepts != 0
        while (more := lives | lives[table].any(axis=1)).sum() > lives.sum():
            lives = more
        return dfa.class_of.tolist(), dfa.step.tolist(), dfa.classes, [int(a) if x else -1 for a, x in zip(dfa.accepts, lives, strict=True)]

    @staticmethod
    def _walk(automaton: tuple[list, list, int, list], data: np.ndarray, places: Iterator[int]) -> tuple[int, int]:
        """The first and the last place at which a match ends, or -1 twice."""
        class_of, step, classes, accepts = automaton
        state, first, last = 0, -1, -1
        for i in places:
            state = step[state * classes + class_of[data[i]]]
            if accepts[state] < 0:
                break
            if accepts[state]:
                first, last = (i if first < 0 else first), i
        return first, last

    def _matches(self, k: int, data: np.ndarray, begin: int, end: int, ends: np.ndarray) -> list[tuple[int, int]]:
        """Spans of rule k in the text at data[begin:end]; ``ends``: where its matches end."""
        rule, found, at = self.rules[k], [], begin
        for e in ends.tolist():
            if e < at:
                continue
            _, start = self._walk(self.back[k], data, iter(range(e, at - 1, -1)))
            if start < 0:
                continue
            first, last = self._walk(self.forward[k], data, iter(range(start, end)))
            length = last + 1 - (first if rule.tail else start)
            if length >= rule.least:
                found.append((start, last + 1))
            at = last + 1
        return found

    def spans(self, b: W.Block) -> list[list[tuple[int, int, int]]]:
        """For each text, (start, rule, end) in bytes from its begin, in order."""
        places, bits = hits(self.all, b.data, b.bounds)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(b.n)]
        if not len(places):
            return out
        text = np.searchsorted(b.bounds, places, "right") - 1
        for t in np.unique(text).tolist():
            lo, hi = np.searchsorted(text, [t, t + 1])
            begin, end = int(b.bounds[t]), int(b.bounds[t + 1])
            for k in range(len(self.rules)):
                ends = places[lo:hi][(bits[lo:hi] >> k) & 1 == 1]
                if len(ends):
                    out[t] += [(s - begin, k, e - begin) for s, e in self._matches(k, b.data, begin, end, ends)]
            out[t].sort()
        return out


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def _in_points(data: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Bytes to code points."""
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(points[s]), k, int(points[e])) for s, k, e in spans]


def scan(docs: DataFrame, keep: tuple[str, ...] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The kept columns (all if not given) with ``found``: an array of (kind, start, end, base)."""
    attach(docs.sparkSession)
    kept = [c for c in (keep or docs.columns) if c != "found"]
    source = docs.select(*kept, F.col("text").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "found array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for batch in batches:
            out = []
            for b in W.blocks(batch.column(len(kept))):
                for t, spans in enumerate(s.spans(b)):
                    in_points = _in_points(b.data[b.bounds[t] : b.bounds[t + 1]], spans) if spans else []
                    out.append([{"kind": rules[k].kind, "start": x, "end": y, "base": rules[k].base} for x, k, y in in_points])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, kind)], names=[*kept, "found"])

    return source.mapInArrow(run, schema)


def joined(only: str = "") -> Column:
    """kind:start:end, comma-joined, of the spans that fulfil a SQL condition on x."""
    spans = f"filter(found, x -> {only})" if only else "found"
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")
