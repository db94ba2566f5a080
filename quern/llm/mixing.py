"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, ``target / source_size``. The
expectations are prefix-summed in a fixed order within the source, one offset per source is
added, and a document is emitted once for each integer that its interval crosses.

The order is by bucket, which is a hash of the whole row, and in a bucket by size, up and down in
turn, and hash. A rank in it is the number of rows in earlier buckets of the source, from a small
table with one row per (source, bucket), plus a row number within the bucket. Buckets grow in number
with the input, so none is large, however many rows one source has. Equal rows have the same hash;
where a row occurs more than once, its occurrences are first counted by where they were read, and
numbered within that, so that a row repeated without end does not meet in one task either.

Only sizes, hashes and identities of rows are ranked; whole rows are joined with the result once.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows
without an id, and rows that repeat one, are documents of their own, told apart by their columns;
equal rows are interchangeable; an empty input gives an empty result; other columns pass through
under any name unless they bear one of the result's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import numbered, scope, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
GROUP_ROWS = 4096
MADE = ("size", "source_size", "target", "copies", "taken")
PLACE = ["_file", "_row"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights repeat over the sources in
    code-point order; what would exceed ``cap`` times a source's size goes to the others by weight.

    The capped sources are a prefix in the order of cap over weight, so one running sum finds the
    level at which the rest share. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.lit(cap) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = t.withColumns({
        "left": F.lit(share) * F.sum("source_size").over(everything) - (F.sum("cap").over(by_level) - F.col("cap")),
        "w_left": F.sum("w").over(everything) - (F.sum("w").over(by_level) - F.col("w")),
    }).withColumn("level", F.col("left") / F.col("w_left"))
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def _hashed(rows: DataFrame, seed: int) -> DataFrame:
    """hash: of every column as text, nulls told apart, and the seed."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(f"row.`{f.name}`").cast("string")), F.lit("-")) if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant") else F.coalesce(F.concat(F.lit("="), F.to_json(F.struct(F.col(f"row.`{f.name}`")))), F.lit("-")) for f in rows.schema["row"].dataType.fields]
    return rows.withColumn("hash", F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *cells)))


def mix(docs: DataFrame, seed: int = 17, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, size: Column | None = None) -> DataFrame:
    """``docs`` (with ``source`` and ``text``, or an own ``size`` expression) with size, source_size,
    target, copies and taken. ``copies`` is 0, 1 or 2 at the default cap."""
    kept = [c for c in docs.columns if c not in MADE]
    sized = docs.select(*(F.col(f"`{c}`") for c in kept), (word_count(F.col("text")) if size is None else size).alias("size"))
    rows = numbered(sized, "mix-rows")
    with scope(docs.sparkSession) as s:
        narrow = _hashed(rows, seed).select(*PLACE, F.col("row.source").alias("source"), F.col("row.size").alias("size"), "hash")
        narrow = table(narrow, "mix-narrow")
        decided = s.keep(table(_decided(narrow, seed, weights, share, cap), "mix-copies"))
    out = rows.join(decided, PLACE)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), F.col("row.size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("row.size")).alias("taken"))


def _decided(rows: DataFrame, seed: int, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(_file, _row, source_size, target, copies) of narrow rows."""
    number = lambda h, k: F.conv(F.substring(h, k, 8), 16, 10).cast("long")
    buckets = max(1, -(-rows.count() // GROUP_ROWS))
    bucket = F.pmod(number(F.col("hash"), 1), F.lit(buckets))
    rows = rows.withColumns({"null": F.col("source").isNull(), "source": F.coalesce("source", F.lit("")), "bucket": bucket, "sign": F.lit(1) - 2 * F.pmod(bucket, F.lit(2))})
    again = rows.groupBy("null", "source", "hash").agg(F.count("*").alias("_k")).filter("_k > 1").select("null", "source", "hash", F.lit(1).alias("_again"))
    rows = rows.join(table(again, "mix-repeated"), ["null", "source", "hash"], "left")
    # A part: the rows of a bucket that occur once, or one repeated row as far as one file has it, by thousands.
    part = F.when(F.col("_again").isNull(), F.lit("")).otherwise(F.concat_ws("/", "hash", "_file", F.floor(F.col("_row") / 1024)))
    rows = table(rows.withColumn("part", part).drop("_again"), "mix-parts")
    counts = rows.groupBy("null", "source", "bucket", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    counts = table(counts, "mix-counts")
    of_buckets = counts.groupBy("null", "source", "bucket").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    totals = of_buckets.groupBy("null", "source").agg(F.sum("words").cast("long").alias("source_size"))
    targets = source_targets(totals.select(F.when(~F.col("null"), F.col("source")).alias("source"), "source_size"), weights, share, cap)
    targets = targets.select(F.col("source").isNull().alias("null"), F.coalesce("source", F.lit("")).alias("source"), "source_size", "target")
    earlier = lambda *by: Window.partitionBy("null", "source", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    of_buckets = of_buckets.select("null", "source", "bucket", before(earlier("bucket")).alias("before"))
    counts = counts.withColumn("inside", before(earlier("bucket", "part"))).join(of_buckets, ["null", "source", "bucket"]).join(targets, ["null", "source"])
    counts = counts.select("null", "source", "bucket", "part", (F.col("before") + F.col("inside")).alias("before"), "source_size", "target")
    in_part = Window.partitionBy("null", "source", "bucket", "part").orderBy(F.col("sign") * F.col("size"), "hash", *PLACE)
    ranked = rows.withColumn("rank", F.row_number().over(in_part)).join(counts, ["null", "source", "bucket", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("source"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(F.col("rank") * rate + offset) - F.floor((F.col("rank") - 1) * rate + offset)
    return ranked.select(*PLACE, "source_size", "target", copies.cast("long").alias("copies"))
