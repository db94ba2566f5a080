"""Links among the members of buckets, without pairing out a bucket.

In each round the members of a bucket are compared with one of them, its leader; in the first round
each member with one leader only, the same for many of its buckets. What has come to the same
component by confirmed links needs no further comparison. After ``ROUNDS`` rounds, with
another leader each, buckets that still hold several components have their members compared across
components, within a join or by a given function (small buckets at once then), by a condition on columns that they carry. So every pair of a bucket
that is alike by that condition is confirmed or already connected.

The last comparison is laid out in cells: a bucket's members are dealt into parts of about ``PART``,
and each pair of parts is a key of its own, so that no task holds a bucket. Members that all are
nearly, but not quite, alike cost comparisons, not rows, with the square of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.session import drop_table, table

ROUNDS = 2
PART = 256
#: Buckets of more parts have leaders before a given function compares their members.
LED = 4
#: Keys, of 12 bytes each, that are broadcast at most.
FEW = 100_000


def spread_join(left: DataFrame, right: DataFrame, key: str, pairs: DataFrame, part: int = PART) -> DataFrame:
    """The inner join of ``left``, rows of ``pairs`` (a, b) with more columns, with one row a key on
    the right, which is copied for every ``part`` pairs of its key: they meet it in as many tasks. The
    keys that are copied are counted first, and broadcast if they are at most ``FEW``, so either side is
    shuffled once; beyond that they are joined by shuffle, with the same result."""
    many = table(pairs.groupBy(key).agg(F.ceil(F.count("*") / part).cast("int").alias("_parts")).filter("_parts > 1"), "keys-spread")
    number = many.count()
    if not number:
        return left.join(right, key)
    many = F.broadcast(many) if number <= FEW else many
    salted = left.join(many, key, "left").withColumn("_salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = right.join(many, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def cells(rest: DataFrame, key: list[str], carried: list[str]) -> DataFrame:
    """The members of buckets in each cell (_low, _high) that compares them, with the part they are in.
    Buckets of several parts are counted first, and broadcast if they are at most ``FEW``."""
    parts = table(rest.groupBy(*key).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts")).filter("_parts > 1"), "bucket-parts")
    parts = F.broadcast(parts) if parts.count() <= FEW else parts
    dealt = rest.join(parts, key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.struct(F.least(j, F.col("_part")).alias("low"), F.greatest(j, F.col("_part")).alias("high"))))
    return dealt.withColumn("_cell", cell).select(*key, F.col("_cell.low").alias("_low"), F.col("_cell.high").alias("_high"), "_part", "id", "n", "c", *carried)


def across(rest: DataFrame, key: list[str], carried: list[str], alike: str) -> DataFrame:
    """Pairs (a, b, na, nb) of a bucket's members in different components ``c`` that are ``alike``."""
    dealt = cells(rest, key, carried)
    other = dealt.select(*key, "_low", "_high", F.col("_part").alias("o_part"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), *(F.col(x).alias(f"o_{x}") for x in carried))
    pairs = dealt.withColumnsRenamed({"id": "a", "n": "na"}).join(other, [*key, "_low", "_high"])
    return pairs.filter("c < cb and (_low = _high or _part <> o_part)").filter(alike).select("a", "b", "na", "nb")


def links(members: DataFrame, key: list[str], close: str, confirm: Callable[[DataFrame], DataFrame], sketch: Callable[[DataFrame], DataFrame], carried: list[str], alike: str, within: Callable[[DataFrame], DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame | None:
    """``members``: the key's columns, id and n. ``close``: a condition on the sizes na and nb that
    links fulfil. ``confirm``: the linked ones of pairs (a, b). ``sketch``: adds the columns
    ``carried`` to members; ``alike``: a condition on a member's, named as they are, and another
    member's, with ``o_`` before the name; it counts from the first round if members have the columns
    already. ``within``: confirmed links of ``cells`` that connect what is alike there, in place of the
    pairs; buckets of at most ``LED`` parts need no leaders then. Confirmed links (a, b), as a table, or None if there are none."""
    found: DataFrame | None = None
    tried: DataFrame | None = None
    now = members.withColumn("c", F.col("id"))
    at_once = [x for x in carried if x in members.columns]
    for number in range(rounds + 1):
        if within is not None and number == rounds and found is None:
            return table(within(cells(sketch(now), key, carried)), "links")
        lead = F.min_by(F.struct("id", "n", "c", *at_once), F.struct(F.xxhash64("id", F.lit(number)), F.col("id")))
        several = now.groupBy(*key).agg(F.min("c").alias("_least"), F.max("c").alias("_most"), lead.alias("lead"), F.count("*").alias("_members"))
        several = several.filter("_least < _most" if within is None or number == rounds else f"_least < _most and _members > {LED * PART}")
        several = table(several, "buckets-led")  # a table: Spark splits a hot key only in a join of plain shuffles
        if within is not None and number < rounds and several.isEmpty():
            continue
        if number < rounds:
            pairs = now.join(several.select(*key, "lead"), key).filter("c <> lead.c")
            if at_once:
                pairs = pairs.withColumns({f"o_{x}": F.col(f"lead.{x}") for x in carried}).filter(alike)
            pairs = pairs.select(F.col("id").alias("a"), F.col("lead.id").alias("b"), F.col("n").alias("na"), F.col("lead.n").alias("nb")).filter(close)
            if not number:
                pairs = pairs.groupBy("a", "na").agg(F.min_by(F.struct("b", "nb"), F.struct(F.xxhash64("b", F.lit(number)), "b")).alias("_b")).select("a", "na", "_b.b", "_b.nb")
        else:
            rest = table(now.join(several.select(*key), key), "buckets-mixed")
            if rest.isEmpty():
                break
            if within is not None:
                new = within(cells(sketch(rest), key, carried))
                return table(new if found is None else found.unionByName(new), "links")
            pairs = across(sketch(rest), key, carried, alike)
        pairs = pairs.filter(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = table(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = confirm(pairs)
        before, found = found, table(new if found is None else found.unionByName(new), "links")
        if before is not None:
            drop_table(before)
        if number < rounds:
            comp = components(found).select(F.col("node").alias("id"), "component")
            now = table(members.join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"), "buckets-now")
    return found
