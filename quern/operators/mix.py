"""Training mixes: filter by pass rate, take from each source, union, shuffle, account."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.sample import shuffled, take
from quern.sources.config import MixConfig


class Shortage(RuntimeError):
    """A source has fewer rows than were asked for."""


@dataclass(frozen=True)
class Taken:
    name: str
    n_pool: int
    n_after_filter: int
    n_taken: int
    take_requested: int | None
    was_shortage: bool
    histogram: dict[int, int]
    rows: DataFrame


def between(p: Column, low: float, high: float) -> Column:
    """Within the open interval."""
    return (p > low) & (p < high)


def take_source(pool: DataFrame, name: str, config: MixConfig, key: str, allow_shortage: bool = False) -> Taken:
    low, high = config.pass_rate_range
    good = pool.filter(between(F.col("pass_rate"), low, high))
    row = pool.agg(F.count("*").alias("pool"), F.count_if(between(F.col("pass_rate"), low, high)).alias("good")).first()
    wanted = config.sources[name]
    short = wanted is not None and wanted > row["good"]
    if short and not allow_shortage:
        raise Shortage(f"{name}: {wanted} rows are asked for, {row['good']} are there")
    rows = take(good, None if short else wanted, config.seed, name, key)
    bins = rows.groupBy("correct_count", "k_samples").count().collect()
    most = max((b["k_samples"] for b in bins), default=-1)
    counts = {k: 0 for k in range(most + 1)} | {b["correct_count"]: b["count"] for b in bins}
    return Taken(name, row["pool"], row["good"], sum(b["count"] for b in bins), wanted, short, counts, rows)


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows; fields that a part lacks, nested ones included, are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def build(pools: dict[str, DataFrame], config: MixConfig, key: str, allow_shortage: bool = False) -> tuple[DataFrame, list[Taken]]:
    """The shuffled mix and the account of each source, in the configured order."""
    taken = [take_source(pools[name], name, config, key, allow_shortage) for name in config.sources]
    rows = union([t.rows.withColumn("_source", F.lit(t.name)) for t in taken])
    return shuffled(rows, config.seed, "_source", key).drop("_source"), taken


def stats(taken: list[Taken]) -> dict:
    return {"total_rows": sum(t.n_taken for t in taken), "sources": [{"name": t.name, "n_pool": t.n_pool, "n_after_filter": t.n_after_filter, "n_taken": t.n_taken, "take_requested": "all" if t.take_requested is None else t.take_requested, "was_shortage": t.was_shortage, "pass_rate_hist_taken": {str(k): n for k, n in sorted(t.histogram.items())}} for t in taken]}
