"""Repeated attempts to pass rates and difficulty buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CORRECT = 0.5


def pass_rates(graded: DataFrame, sample: str, k: int | str, *keep: str) -> DataFrame:
    """(sample, grade) to correct_count, k_samples and pass_rate. ``k``: how many attempts each
    sample was given, a number or a column."""
    correct = F.count_if(F.col("grade.correctness") > CORRECT).alias("correct_count")
    given = F.lit(k).cast("long") if isinstance(k, int) else F.max(k).cast("long")
    out = graded.groupBy(sample, *keep).agg(correct, given.alias("k_samples"))
    return out.withColumn("pass_rate", F.col("correct_count") / F.col("k_samples"))


def stats(rates: DataFrame, *by: str) -> DataFrame:
    return rates.groupBy(*by).agg(
        F.count("*").alias("num_samples"),
        F.count_if(F.expr("pass_rate = 1")).alias("too_easy"),
        F.count_if(F.expr("pass_rate = 0")).alias("too_hard"),
        F.count_if(F.expr("pass_rate > 0 and pass_rate < 1")).alias("keep"),
        F.coalesce(F.avg("pass_rate"), F.lit(0.0)).alias("mean_pass_rate"),
    )


def histogram(rates: DataFrame, k: int) -> DataFrame:
    """Samples by number of correct attempts, for every number from 0 to k."""
    bins = rates.sparkSession.range(0, k + 1).select(F.col("id").alias("correct_count"))
    n = rates.groupBy("correct_count").agg(F.count("*").alias("n"))
    return bins.join(F.broadcast(n), "correct_count", "left").select("correct_count", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rollup(rates: DataFrame, source: str) -> DataFrame:
    """By source, and over all (a null source): samples, kept ones, and their share."""
    out = rates.rollup(source).agg(F.count("*").alias("n"), F.count_if(F.expr("pass_rate > 0 and pass_rate < 1")).alias("keep"))
    return out.withColumn("keep_share", F.try_divide("keep", "n"))


def advantage(graded: DataFrame, sample: str, eps: float = 1e-6) -> DataFrame:
    """Rewards relative to the sample's other attempts: less the mean, over the deviation."""
    w = Window.partitionBy(sample)
    r = F.col("grade.total_reward")
    return graded.withColumn("advantage", (r - F.avg(r).over(w)) / (F.coalesce(F.stddev_samp(r).over(w), F.lit(0.0)) + F.lit(eps)))
