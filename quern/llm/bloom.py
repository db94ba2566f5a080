"""A blocked Bloom filter as a small table, built and probed by DataFrame expressions.

One hash of the key picks a block of 256 bits, another sets two bits in each of its four words. The
table has at most ``MAX_BLOCKS`` rows of 40 bytes, so broadcasting it is safe. It has 16 bits a key
and, where that would be too many, down to 4; for still more keys there is no filter, and the exact
join that follows every use shuffles all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 17
BITS_PER_KEY = 16
LEAST_BITS = 4
WORDS = 4


def size(keys: int) -> int:
    """How many blocks the keys need; 0 if no filter of bounded size is of use."""
    if keys * LEAST_BITS > MAX_BLOCKS * 64 * WORDS:
        return 0
    return min(MAX_BLOCKS, 1 << max(0, (keys * BITS_PER_KEY // (64 * WORDS)).bit_length()))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """The two bits of each word, from twelve bits of a second hash."""
    h = F.xxhash64(key, F.lit(2))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def build(keys: DataFrame, name: str, blocks: int) -> DataFrame:
    """The filter of a column's values; blocks without one have no row."""
    masks = keys.select(_block(F.col(name), blocks).alias("_block"), *(m.alias(f"_w{k}") for k, m in enumerate(_masks(F.col(name)))))
    return masks.groupBy("_block").agg(*(F.bit_or(f"_w{k}").alias(f"_w{k}") for k in range(WORDS)))


def probe(df: DataFrame, name: str, bits: DataFrame | None, blocks: int, out: str = "_possible") -> DataFrame:
    """``df`` with a boolean column: false where the value is null or surely not among the keys.
    ``bits``: what ``build`` made, ignored for 0 blocks."""
    if not blocks or bits is None:
        return df.withColumn(out, F.col(name).isNotNull())
    joined = df.withColumn("_block", _block(F.col(name), blocks)).join(F.broadcast(bits), "_block", "left")
    possible = F.col(name).isNotNull()
    for k, mask in enumerate(_masks(F.col(name))):
        possible = possible & (F.col(f"_w{k}").bitwiseAND(mask) == mask)
    return joined.withColumn(out, F.coalesce(possible, F.lit(False))).drop("_block", *(f"_w{k}" for k in range(WORDS)))


def filtered(df: DataFrame, name: str, keys: DataFrame, n: int) -> DataFrame:
    """The rows of ``df`` whose value may be among the n ``keys``, a column of the same name."""
    blocks = size(n)
    return probe(df, name, build(keys, name, blocks) if blocks else None, blocks).filter("_possible").drop("_possible")
