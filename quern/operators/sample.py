"""Seeded samples of exact size. Rows are ranked by a hash of seed and key, so a sample depends on
neither partitioning nor order, and is the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(seed: int | str, *key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)))


def uniform(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows, or all if there are fewer; the key keeps the order. The n least hashes are found by
    partial sorts, and only the largest of them goes to the other tasks."""
    hashed = df.withColumn("_h", draw(seed, F.col(key)))
    if n <= 0:
        return df.limit(0)
    last = hashed.select("_h", key).orderBy("_h", key).limit(n).agg(F.max(F.struct("_h", key)).alias("_last"))
    return hashed.join(F.broadcast(last), F.struct("_h", key) <= F.col("_last")).drop("_h", "_last")


def stratified(df: DataFrame, n: int, seed: int, key: str, stratum: str) -> DataFrame:
    """In proportion to the strata's sizes: round(n * size / total), half to even, of each."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_take", F.least(F.col("_size"), F.bround(F.lit(float(n)) * F.col("_size") / F.sum("_size").over(Window.partitionBy()), 0).cast("long")))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, F.col(stratum), F.col(key)), key)))
    joined = ranked.join(sizes.withColumnRenamed(stratum, "_s"), F.col(stratum).eqNullSafe(F.col("_s")))
    return joined.filter("_rank <= _take").drop("_rank", "_take", "_size", "_s")


def take(df: DataFrame, n: int | None, seed: int, name: str, key: str) -> DataFrame:
    """n rows of a source, by (seed, name); all if n is None."""
    if n is None:
        return df
    return df.withColumn("_h", draw(seed, F.lit(name), F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """In a seeded global order, by range partitions."""
    return df.withColumn("_h", draw(seed, *map(F.col, key))).orderBy("_h", *key).drop("_h")


def first_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)


def numbered(df: DataFrame, key: str, name: str = "row") -> DataFrame:
    """A dense row number in the order of the key, from 0: a number within each range partition, plus
    how many rows earlier partitions have."""
    from quern.session import table

    parted = table(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()), "numbered")
    counts = parted.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return parted.withColumn(name, within).join(F.broadcast(before), "_p").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_p", "_before")
