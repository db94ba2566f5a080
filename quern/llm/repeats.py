"""Removal of repeated byte strings: every byte covered by a string of ``LENGTH`` bytes that also
starts anywhere else in the corpus, same document included.

1. Of the 101 grams of 100 bytes in each window of 200 bytes, the one with the least hash is the
   window's anchor, the first if several have it; equal windows have the same anchor at the same
   place. A corpus has one anchor in about fifty bytes.
2. Anchors are written once and counted by gram. A gram that occurs once repeats no window. Anchors
   of a gram whose surroundings, the up to 300 bytes around, are the same are one kind, by a
   cryptographic digest (BLAKE2b, 128 bits) of the bytes themselves: all windows of a kind that
   occurs twice repeat. No decision rests on a polynomial hash.
3. One anchor of each kind, of grams that have several, goes to the sorted suffixes: the
   surroundings of a gram's kinds are sorted by what follows the anchor and by what precedes it;
   from the common lengths of neighbours, verified on the bytes, come the classes of equal
   continuations of any length, and a window of ``l`` bytes before and ``200 - l`` behind the anchor
   repeats if two kinds share both classes. The windows of an anchor all contain its gram, so the
   covered bytes run from the earliest repeated window's start to the latest one's end. A gram of
   more than ``SORTED`` kinds would not fit a task: its windows are counted by their digests, spread
   over all tasks, with the same results.
4. Covered runs are merged by document and cut out.

Only anchors and surroundings are shuffled, and texts that have a repeated gram; a Bloom filter of
bounded size spares the others.

Defined cases: a null text counts as empty; texts of less than 200 bytes lose nothing; equal
rows are repeats of each other; matches never cross documents; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bloom
from quern.llm import words as W
from quern.llm.suffix_sort import Suffixes
from quern.session import attach, drop_table, scope, table

LENGTH = 200
GRAM = 100
LEAD = LENGTH - GRAM
SORTED = 20_000
CHUNK = 20_000
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def digests(parts: list[bytes]) -> np.ndarray:
    """128 bits of each, as two numbers."""
    return np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in parts), np.int64).reshape(-1, 2)


def anchors(b: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: the anchors' places, texts, gram hashes and digests of their surroundings."""
    size = len(b.data)
    none = np.empty(0, np.int64)
    if size < LENGTH:
        return none, none, none.astype(np.uint64), none.reshape(0, 2)
    c = W.prefix_hashes(b.data)
    m = size - GRAM + 1
    down = W.powers(len(c), "down")
    gram = W.mix64((c[GRAM:] - c[:m]) * down[:m])
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    width = LEAD + 1
    padded = np.full(-(-m // width) * width, ALL)
    padded[:m] = key
    forward = np.minimum.accumulate(padded.reshape(-1, width), axis=1).reshape(-1)
    backward = np.minimum.accumulate(padded.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(backward[: size - LENGTH + 1], forward[LEAD : size - LENGTH + 1 + LEAD])
    starts = np.zeros(size - LENGTH + 2, np.int64)
    long = np.flatnonzero(np.diff(b.bounds) >= LENGTH)
    np.add.at(starts, b.bounds[long], 1)
    np.add.at(starts, b.bounds[long + 1] - LENGTH + 1, -1)
    chosen = np.zeros(m, bool)
    chosen[(least[np.cumsum(starts[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    place = np.flatnonzero(chosen)
    text = np.searchsorted(b.bounds, place, "right") - 1
    begin, end = np.maximum(place - LEAD, b.bounds[text]), np.minimum(place + LENGTH, b.bounds[text + 1])
    raw = b.data.tobytes()
    around = digests([raw[x:y] + bytes((p - x,)) for x, y, p in zip(begin.tolist(), end.tolist(), place.tolist(), strict=True)])
    return place, text, gram[place], around


def anchor_rows(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for b in W.blocks(batch.column(1)):
                place, text, gram, around = anchors(b)
                columns = [gram.view(np.int64), *np.ascontiguousarray(around.T), ids[b.first + text] if len(text) else np.empty(0, np.int64), (place - b.bounds[text]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["gram", "around1", "around2", "rid", "place"])

    return texts.select("rid", "text").mapInArrow(run, "gram long, around1 long, around2 long, rid long, place long")


def surroundings(wanted: DataFrame) -> DataFrame:
    """(rid, text, at: array of gram and place) to one row for each anchor with its surroundings
    and how many bytes of them precede it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 64):
                part = batch.slice(first, 64)
                out: list[tuple] = []
                for rid, text, at in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    raw = (text or "").encode()
                    out += [(x["gram"], rid, x["place"], min(LEAD, x["place"]), raw[max(0, x["place"] - LEAD) : x["place"] + LENGTH]) for x in at]
                columns = [*zip(*out, strict=True)] or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["gram", "rid", "place", "lead", "bytes"])

    return wanted.mapInArrow(run, "gram long, rid long, place long, lead int, bytes binary")


def repeated_windows(data: np.ndarray, bounds: np.ndarray, lead: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For surroundings back to back, in groups, the greatest and the least number of bytes before
    the anchor with which a window repeats in the group; -1 and LEAD + 1 if none does."""
    place = bounds[:-1] + lead
    behind = bounds[1:] - place
    classes = []
    for backward, reach in ((True, lead), (False, behind)):
        order, shared = Suffixes(data, place, reach, backward).sort(first)
        classes.append((order, shared))
    n = len(lead)
    most, least = np.full(n, -1), np.full(n, LEAD + 1)

    def repeats(before: int) -> np.ndarray:
        ids = []
        for (order, shared), length in zip(classes, (before, LENGTH - before), strict=True):
            of = np.empty(n, np.int64)
            of[order] = np.cumsum(shared < length)
            ids.append(of)
        able = np.flatnonzero((lead >= before) & (behind >= LENGTH - before))
        _, which, count = np.unique(ids[0][able] * (n + 1) + ids[1][able], return_inverse=True, return_counts=True)
        out = np.zeros(n, bool)
        out[able] = count[which] > 1
        return out

    for before in range(LEAD + 1):
        hit = repeats(before)
        most[hit] = before
        least[hit & (least > LEAD)] = before
    return most, least


def sorted_spans(rows: DataFrame) -> DataFrame:
    """Surroundings to covered spans (rid, start, end). Rows of a gram are in one task, in a row."""

    def settle(t: pa.Table) -> pa.RecordBatch:
        gram = t.column("gram").to_numpy()
        raw = t.column("bytes").combine_chunks().cast(pa.large_binary())
        bounds = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        data = np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        first = np.concatenate([np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])), [len(gram)]])
        most, least = repeated_windows(data, bounds - bounds[0], t.column("lead").to_numpy().astype(np.int64), first)
        hit = most >= 0
        place = t.column("place").to_numpy()[hit]
        columns = [t.column("rid").to_numpy()[hit], place - most[hit], place - least[hit] + LENGTH]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["rid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= CHUNK:
                t = pa.Table.from_batches(held)
                gram = t.column("gram").to_numpy()
                last = int(np.searchsorted(gram, gram[-1]))
                if last:
                    yield settle(t.slice(0, last).combine_chunks())
                    held = t.slice(last).to_batches()
        if held and sum(map(len, held)):
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "rid long, start long, end long")


def counted_spans(rows: DataFrame) -> DataFrame:
    """The same for grams of very many kinds: every window's digest, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(4).cast(pa.large_binary())
            bounds = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
            data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.empty(0, np.uint8)
            data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
            lead = batch.column(3).to_numpy()
            n = np.maximum(0, np.diff(bounds) - LENGTH + 1)
            row = np.repeat(np.arange(len(batch)), n)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            raw_bytes = data.tobytes()
            h = digests([raw_bytes[x : x + LENGTH] for x in (bounds[row] + offset).tolist()])
            place = batch.column(2).to_numpy()[row]
            columns = [*np.ascontiguousarray(h.T), batch.column(1).to_numpy()[row], place - lead[row] + offset]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["h1", "h2", "rid", "start"])

    windows = rows.select("gram", "rid", "place", "lead", "bytes").mapInArrow(run, "h1 long, h2 long, rid long, start long")
    windows = windows.select("h1", "h2", "rid", "start").distinct()
    windows = table(windows, "windows")
    twice = table(windows.groupBy("h1", "h2").agg(F.count("*").alias("_n")).filter("_n > 1").select("h1", "h2"), "windows-repeated")
    return windows.join(twice, ["h1", "h2"]).select("rid", "start", (F.col("start") + LENGTH).alias("end"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((x["start"], x["end"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def cut(joined: DataFrame) -> DataFrame:
    """(doc_id, text, spans) to doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                out: list[tuple] = []
                for doc, text, spans in zip(*(x.to_pylist() for x in batch.slice(first, 256).columns), strict=True):
                    raw, runs = (text or "").encode(), merged(spans or [])
                    edges = [0, *(e for run in runs for e in run), len(raw)]
                    kept = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                    out.append((doc, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([*zip(*out, strict=True)], kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")


def _marked(texts: DataFrame, rids: DataFrame, n: int) -> DataFrame:
    """The texts with ``_possible``, whether they may be among the n rids."""
    blocks = bloom.size(n)
    return bloom.probe(texts, "rid", table(bloom.build(rids, "rid", blocks), "texts-wanted") if blocks else None, blocks)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes for each row (doc_id, text)."""
    attach(docs.sparkSession)
    with scope(docs.sparkSession) as s:
        texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
        texts = s.keep(table(texts, "texts", compression="zstd"))
        runs = s.keep(table(_spans(texts).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans"))
        blocks = bloom.size(runs.count())
        bits = s.keep(table(bloom.build(runs, "rid", blocks), "texts-cut")) if blocks else None
    texts = bloom.probe(texts, "rid", bits, blocks)
    removed = cut(texts.filter("_possible").join(runs, "rid", "left").select("doc_id", "text", "spans"))
    raw = F.encode(F.col("text"), "UTF-8")
    rest = texts.filter("not _possible").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept_bytes"))
    return removed.unionByName(rest)


def _spans(texts: DataFrame) -> DataFrame:
    """Covered spans (rid, start, end), which may overlap."""
    kind = ["gram", "around1", "around2"]
    found = table(anchor_rows(texts), "anchors")
    grams = table(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "repeated-grams")
    hits = table(bloom.filtered(found, "gram", grams, grams.count()).join(grams, "gram"), "repeated-anchors")
    drop_table(found)
    kinds = table(hits.groupBy(*kind).agg(F.count("*").alias("k"), F.min(F.struct("rid", "place")).alias("first")), "anchor-kinds")
    whole = hits.join(kinds.filter("k > 1").select(*kind), kind).select("rid", "place")
    whole = whole.select("rid", (F.col("place") - F.least(F.lit(LEAD), F.col("place"))).alias("start"), (F.col("place") + LENGTH).alias("end"))
    several = table(kinds.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "grams-of-kinds")
    open_ = table(kinds.join(several, "gram").select("gram", "n", "first.rid", "first.place"), "open-anchors")
    wanted = table(open_.groupBy("rid").agg(F.collect_list(F.struct("gram", "place")).alias("at")), "texts-with-anchors")
    around = surroundings(_marked(texts, wanted, wanted.count()).filter("_possible").join(wanted, "rid").select("rid", "text", "at"))
    many = several.filter(f"n > {SORTED}").select("gram")
    if many.isEmpty():
        return sorted_spans(around).unionByName(whole)
    around = table(around, "surroundings", compression="zstd")
    return sorted_spans(around.join(many, "gram", "left_anti")).unionByName(counted_spans(around.join(many, "gram", "left_semi"))).unionByName(whole)
