"""Near-duplicate documents by min-max hashing.

Under each permutation of the shingle hashes both the least and the greatest value are kept, so
half as many permutations give a signature of a given length; either value agrees between two
sets with the probability of their Jaccard similarity. A band takes both values of a few
permutations. At 32 bands of 8 values a pair at similarity 0.85 shares no band with probability
4e-5; of 6 values, at 0.8, 6e-5.

Documents with the same set (two 64-bit sums over its hashes) are one class, which its smallest id
stands for; only classes are banded. Members of a bucket are linked as ``linking`` says: with
leaders, and what that leaves across components by sketches of ``SKETCH`` bits (one bit of each
least and greatest value under further permutations), in the first bucket that two members share.
A pair at the wanted similarity falls short of the sketches' bound, five standard deviations below
what it expects, with probability 3e-7. So no group of copies is paired out. Links are confirmed
on the full sets of 64-bit shingle hashes. Two different shingles of a pair of documents have the
same hash with a probability under n * m / 2**64 for n and m shingles, and two different sets the
same two sums with one under 2**-100; nothing else is taken on trust.

Defined cases: a null text, or one without words, has no shingles and no links; one with fewer
words than a shingle has a single shingle, of all its words; rows without an id get no component
and are kept; rows that repeat an id are one node, linked by the text that
is first in order; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.llm.components import components
from quern.llm.linking import links, spread_join
from quern.session import attach, drop_table, scope, table

WORDS = 5
SIMILARITY = 80
BANDS = 32
SKETCH = 3072
PER_BAND = {80: 3, 85: 4}


def shingle_sets(b: W.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of the block, back to back, and where they begin."""
    low = W.Block(W.LOWER[b.data], b.bounds, b.first)
    starts, ends, first = low.words()
    hashes = W.mix64(W.span_hashes(W.prefix_hashes(low.data), starts, ends))
    grams, at = W.shingle_hashes(hashes, first, k)
    parts = [np.unique(grams[at[i] : at[i + 1]]) for i in range(b.n)]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.concatenate(parts) if parts else grams, bounds.astype(np.int64)


def signatures(hashes: np.ndarray, at: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """Band hashes, sets x bands; ``at`` are the begins of non-empty sets."""
    x = hashes.astype(np.uint32)
    flips = W.stream(21, bands * per_band).astype(np.uint32)
    factors = W.stream(22, bands * per_band).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(at), bands), np.uint64)
    for band in range(bands):
        mixed = np.full(len(at), band, np.uint64)
        for j in range(band * per_band, (band + 1) * per_band):
            y = x ^ flips[j]
            y *= factors[j]
            y ^= y >> np.uint32(15)
            both = np.minimum.reduceat(y, at).astype(np.uint64) << np.uint64(32) | np.maximum.reduceat(y, at)
            mixed = W.mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + both)
        out[:, band] = mixed
    return out


def profiles(docs: DataFrame, k: int, bands: int, per_band: int) -> DataFrame:
    """doc_id, n_shingles, two sums that stand for the set, and the band hashes."""
    attach(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.blocks(batch.column(1)):
                hashes, bounds = shingle_sets(b, k)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                sums = np.zeros((2, b.n), np.uint64)
                columns: list[pa.Array] = []
                values, sizes = np.empty(0, np.int64), np.zeros(b.n, np.int32)
                if len(full):
                    at = bounds[:-1][full]
                    sums[0, full] = np.add.reduceat(W.mix64(hashes), at)
                    sums[1, full] = np.add.reduceat(W.mix64(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), at)
                    values, sizes[full] = signatures(hashes, at, bands, per_band).view(np.int64).reshape(-1), bands
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                columns = [batch.column(0).slice(b.first, b.n), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set1", "set2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """id and the set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.blocks(batch.column(1)):
                hashes, bounds = shingle_sets(b, k)
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n), sets], names=["id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, shingles array<long>")


def carried(bands: int) -> list[str]:
    """Columns of a sketch: SKETCH bits, then the band hashes. Columns, not arrays: the join's
    condition then compiles to one short method."""
    return [*(f"s{k}" for k in range(SKETCH // 64)), *(f"v{k}" for k in range(bands))]


def sketches(sets: DataFrame, bands: int, per_band: int) -> DataFrame:
    """id and the sketch of each set."""
    names = carried(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = W.stream(23, SKETCH // 2).astype(np.uint32)
        factors = W.stream(24, SKETCH // 2).astype(np.uint32) | np.uint32(1)
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                whole = part.column(1).flatten().to_numpy().view(np.uint64)
                x = whole.astype(np.uint32)
                at = np.concatenate([[0], np.cumsum(pc.list_value_length(part.column(1)).to_numpy())])[:-1]
                bits = np.empty((len(part), SKETCH), np.uint8)
                for j in range(SKETCH // 2):
                    y = x ^ flips[j]
                    y *= factors[j]
                    y ^= y >> np.uint32(15)
                    bits[:, 2 * j] = np.minimum.reduceat(y, at) & 1
                    bits[:, 2 * j + 1] = np.maximum.reduceat(y, at) & 1
                packed = np.column_stack([np.packbits(bits, axis=1).view(np.int64), signatures(whole, at, bands, per_band).view(np.int64)])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(c)) for c in packed.T)], names=["id", *names])

    return sets.mapInArrow(run, ", ".join(["id long", *(f"{n} long" for n in names)]))


def alike(similarity: int, bands: int) -> str:
    """SQL: two sketches agree in as many bits as similar sets' do, and this is their first band."""
    p = (1 + similarity / 100) / 2
    most = math.ceil(SKETCH * (1 - p) + 5 * math.sqrt(SKETCH * p * (1 - p)))
    differ = " + ".join(f"bit_count(s{k} ^ o_s{k})" for k in range(SKETCH // 64))
    first = " ".join(f"WHEN v{k} = o_v{k} THEN {k}" for k in range(bands))
    return f"{differ} <= {most} AND band = CASE {first} END"


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= similarity * union."""
    left = spread_join(pairs, sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a")), "a", pairs)
    both = spread_join(left, sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b")), "b", pairs)
    common = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - common
    return both.filter(100 * common.cast("long") >= similarity * union.cast("long")).select("a", "b")


def groups(docs: DataFrame, k: int = WORDS, similarity: int = SIMILARITY, bands: int = BANDS, per_band: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text)."""
    per_band = per_band or PER_BAND[similarity]
    with scope(docs.sparkSession) as s:
        made = s.keep(table(profiles(docs, k, bands, per_band), "min-max"))
        classes = s.keep(table(_classes(docs, made, k, similarity, bands, per_band), "set-components"))
    out = made.select("doc_id", "n_shingles", "set1", "set2")
    alone = out.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rest = out.filter("n_shingles > 0 and doc_id is not null").join(classes, ["set1", "set2", "n_shingles"], "left")
    both = alone.unionByName(rest.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _classes(docs: DataFrame, made: DataFrame, k: int, similarity: int, bands: int, per_band: int) -> DataFrame:
    """(set1, set2, n_shingles, component) of the classes of several documents or with links."""
    identical = made.filter("n_shingles > 0 and doc_id is not null").groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("id"), F.count("*").alias("_k"))
    identical = table(identical, "set-classes")
    band = made.join(identical.select("id"), made["doc_id"] == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "value")).distinct()
    band = table(band, "bands")
    shared = band.groupBy("band", "value").agg(F.count("*").alias("_k")).filter("_k > 1").select("band", "value")
    members = table(band.join(shared, ["band", "value"]), "buckets")
    drop_table(band)
    linked = _links(docs, members, k, similarity, bands, per_band)
    if linked is None:
        return identical.filter("_k > 1").select("set1", "set2", "n_shingles", F.col("id").alias("component"))
    comp = components(linked).select(F.col("node").alias("id"), "component")
    joined = identical.join(comp, "id", "left").filter("_k > 1 or component is not null")
    return joined.select("set1", "set2", "n_shingles", F.coalesce("component", "id").alias("component"))


def _links(docs: DataFrame, members: DataFrame, k: int, similarity: int, bands: int, per_band: int) -> DataFrame | None:
    """Confirmed links that give the components of all pairs that share a bucket."""
    involved = members.select(F.col("id").alias("doc_id")).distinct()
    if involved.isEmpty():
        return None
    texts = docs.select("doc_id", "text").join(involved, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = table(full_sets(texts, k), "sets")

    def sketch(rest: DataFrame) -> DataFrame:
        drawn = sketches(sets.join(rest.select("id").distinct(), "id", "left_semi"), bands, per_band)
        return rest.join(table(drawn, "sketches"), "id")

    close = f"100 * least(na, nb) >= {similarity} * greatest(na, nb)"
    return links(members, ["band", "value"], close, lambda pairs: confirmed(pairs, sets, similarity), sketch, carried(bands), alike(similarity, bands))
