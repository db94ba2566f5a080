"""Packing token sequences: bounded-space online best fit.

Each partition keeps ``open_windows`` windows. A document is cut into whole windows and a rest;
the rest goes to the open window that it fits best. If it fits none, a new window is opened, or,
if the number is reached, the fullest is emitted, filled up first from the head of the rest unless
its gap is under ``min_cut`` ids. At the end of a partition the leftovers are merged: the fullest
windows are filled from the emptiest ones. What remains is less than one window; it is written as
sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled. A partition's result depends on that partition's rows alone, so a task that
runs again gives the same sequences.

Ids are those of the tokenizer for the whole text. The text is cut before single blanks and around
single line feeds between other characters, where the tokenizer's pre-tokens end in any case, and
the ids of these short pieces are remembered, as many as ``CACHE`` of them.

Defined cases: a null or empty text is the end id alone; ties go to the window opened first; equal
rows are packed one by one; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quern.session import attach

WINDOW = 2048
OPEN_WINDOWS = 64
MIN_CUT = 16
END_ID = 1
CACHE = 1 << 19
# Fixed value: the pre-tokens of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

_ODD_SPACE = re.compile(r"[^\S \n]|\s\s")
_CUT = re.compile(r"(?<=\S)(?= \S)")


class _Pieces(dict):
    """Little-endian unsigned 32-bit ids of short pieces of text; emptied when full."""

    def __init__(self, ids_of: Callable[[str], list[int]], lead: str):
        self.ids_of, self.lead = ids_of, lead

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids_of(self.lead + piece)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = out
        return out


def byte_of() -> dict[str, int]:
    """The characters that stand for bytes in files of byte-level vocabularies: printable bytes
    stand for themselves, the others, in order, for the characters from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}


def piece_encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of short pieces by the tokenizer's file. Calls of the tokenizer cost more than the
    pieces, so where the file is a plain byte-level BPE, its merges numbered in order, another
    implementation is given the file's vocabulary; it does not know the special tokens, and
    pieces that contain one go to the tokenizer itself."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    own = lambda piece: tokenizer.encode(piece, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, lead = file["model"], file.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", ())]
    vocabulary = model.get("vocab", {})
    special = [t["content"] for t in file.get("added_tokens", ())]
    plain = model.get("type") == "BPE" and lead.get("type") == "ByteLevel" and not lead.get("add_prefix_space") and lead.get("use_regex", True) and not file.get("normalizer")
    ranks = [vocabulary.get(m.replace(" ", "")) for m in merges]
    if not plain or ranks != sorted({r for r in ranks if r is not None}):
        return own
    import tiktoken

    byte = byte_of()
    table = {bytes(byte[c] for c in word): k for word, k in vocabulary.items() if word not in special}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    return lambda piece: own(piece) if any(t in piece for t in special) else fast(piece)


class Encoder:
    """Whole texts to ids, as packed 32-bit integers."""

    def __init__(self, path: str):
        ids_of = piece_encoder(path)
        self.bare, self.spaced = _Pieces(ids_of, ""), _Pieces(ids_of, " ")
        self.feed = self.bare["\n"]

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return b"".join(map(self.bare.__getitem__, _CUT.split(text)))
        parts: list[bytes] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            parts += (self.feed, self.bare[first])
            parts += map(self.spaced.__getitem__, rest)
        return b"".join(parts[1:])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Windows of one partition. ``done`` gathers (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, first: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT):
        self.next, self.window, self.most, self.min_cut = first, window, open_windows, min_cut
        self.free: list[tuple[int, int]] = []  # (room, window), by room
        self.held: dict[int, list[tuple]] = {}
        self.opened = 0
        self.done: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        start = 0
        while total - start >= self.window:
            self.emit([(doc, start, ids[4 * start : 4 * (start + self.window)], total)])
            start += self.window
        while start < total:
            n = total - start
            k = bisect_left(self.free, (n, -1))
            if k < len(self.free):
                room, w = self.free.pop(k)
            elif len(self.free) < self.most:
                room, w = self.window, self.opened
                self.held[w] = []
                self.opened += 1
            else:
                room, w = self.free.pop(0)
                if room >= self.min_cut:
                    self.held[w].append((doc, start, ids[4 * start : 4 * (start + room)], total))
                    start += room
                self.emit(self.held.pop(w))
                continue
            self.held[w].append((doc, start, ids[4 * start :], total))
            if room > n:
                insort(self.free, (room - n, w))
            else:
                self.emit(self.held.pop(w))
            return

    def close(self) -> None:
        """Merge the leftovers: fill the fullest windows from the emptiest ones."""
        left = [self.held[w] for _, w in self.free]
        room = [r for r, _ in self.free]
        while len(left) > 1:
            need, taken = room[0], left[-1]
            while need and taken:
                doc, start, ids, total = taken.pop()
                n = min(need, len(ids) // 4)
                left[0].append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    taken.append((doc, start + n, ids[4 * n :], total))
                need -= n
                room[-1] += n
            room[0] = need
            if not need:
                self.emit(left.pop(0))
                room.pop(0)
            if not taken:
                left.pop()
                room.pop()
        for pieces in left:
            n = self.window - room[0]
            while pieces:
                need, part = 1 << (n.bit_length() - 1), []
                n -= need
                while need:
                    doc, start, ids, total = pieces.pop(0)
                    k = min(need, len(ids) // 4)
                    part.append((doc, start, ids[: 4 * k], total))
                    if 4 * k < len(ids):
                        pieces.insert(0, (doc, start + k, ids[4 * k :], total))
                    need -= k
                self.emit(part)
        self.free, self.held = [], {}

    def take(self) -> pa.RecordBatch:
        columns = [*zip(*self.done, strict=True)] or [[] for _ in ARROW]
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=ARROW)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents (doc_id, text) with the sequence and the offset that hold them."""
    attach(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 36, window, open_windows, min_cut)
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0).to_pylist()
            for k, doc in enumerate(ids):
                packer.add(doc, encode(texts[k].as_py()) + end)
                if len(packer.done) >= 20_000:
                    yield packer.take()
        packer.close()
        yield packer.take()

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA)
