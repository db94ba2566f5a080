"""Removal of training records that coincide with evaluation items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import get_field, ngrams, norm_exact, preview, tokens

N = 13
THRESHOLD = 0.8
#: An index of more rows than this is joined by shuffle.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcasting if it has no more rows than that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def exact_index(evals: DataFrame) -> DataFrame:
    """(eid, ordinal, text) to norm and the first item that has it."""
    return evals.select("eid", "ordinal", norm_exact(F.col("text")).alias("norm")).filter("norm <> ''").groupBy("norm").agg(F.min_by("eid", "ordinal").alias("eid"))


def gram_index(evals: DataFrame, n: int = N) -> DataFrame:
    """(eid, ordinal, text) to gram and the first item that has it."""
    return evals.filter(get_field(F.col("text")) != "").select("eid", "ordinal", F.explode(ngrams(tokens(F.col("text")), n)).alias("gram")).groupBy("gram").agg(F.min_by("eid", "ordinal").alias("eid"))


def classify(records: DataFrame, evals: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``records`` (id, text, ...) with is_hit, match_type, hit_rate and matched_eval.

    An exact match of normalised texts comes first; else the share of the record's n-grams found in
    the index must exceed the threshold, and the item with most of them, the earliest on a tie, is
    named. Records have ids of their own; they are read once, and where the index is broadcast one row
    for each, and for each item with a common gram, is shuffled."""
    exact = bounded(exact_index(evals).withColumnRenamed("eid", "_exact"))
    grams = bounded(gram_index(evals, n))
    toks = records.select("id", norm_exact(F.col("text")).alias("norm"), tokens(F.col("text")).alias("_t"))
    known = toks.join(exact, "norm", "left").select("id", "_exact", (F.size("_t") - F.lit(n - 1)).alias("_total"), F.when(F.col("_exact").isNull(), ngrams(F.col("_t"), n)).alias("_grams"))
    # One pass: grams that match nothing fold into one row a record before the shuffle.
    found = known.select("id", "_exact", "_total", F.posexplode_outer("_grams").alias("_at", "gram")).join(grams, "gram", "left")
    by_item = found.groupBy("id", "_exact", "_total", "eid").agg(F.count("*").alias("k"), F.min("_at").alias("_at"))
    hit = F.col("eid").isNotNull()
    out = by_item.groupBy("id", "_exact", "_total").agg(F.sum(F.when(hit, F.col("k"))).alias("_matched"), F.max_by("eid", F.when(hit, F.struct(F.col("k"), -F.col("_at")))).alias("_eid"))
    rate = F.when(F.col("_exact").isNotNull(), F.lit(1.0)).when(F.col("_matched").isNull(), F.lit(0.0)).otherwise(F.col("_matched") / F.col("_total"))
    out = out.withColumn("hit_rate", rate)
    ngram = F.col("_exact").isNull() & (F.col("hit_rate") > threshold)
    kind = F.when(F.col("_exact").isNotNull(), "exact").when(ngram, "ngram").otherwise("")
    eid = F.when(F.col("_exact").isNotNull(), F.col("_exact")).when(ngram, F.col("_eid"))
    return out.select("id", (kind != "").alias("is_hit"), kind.alias("match_type"), "hit_rate", eid.alias("matched_eval"))


def clean(records: DataFrame, classified: DataFrame) -> DataFrame:
    return records.join(classified.filter("is_hit").select("id"), "id", "left_anti")


def stats(records: DataFrame, classified: DataFrame, group: Column) -> tuple[DataFrame, DataFrame]:
    """One row of totals, and flagged records by match type and by group, in two grouping sets."""
    totals = classified.agg(F.count("*").alias("total"), F.count_if("is_hit").alias("flagged"), F.count_if(~F.col("is_hit")).alias("kept"))
    totals = totals.withColumn("retention", F.try_divide("kept", "total"))
    flagged = classified.filter("is_hit").join(records.select("id", group.alias("subsource")), "id")
    by = flagged.groupingSets([[F.col("match_type")], [F.col("subsource")]], F.col("match_type"), F.col("subsource")).agg(F.count("*").alias("n"))
    return totals, by


def review(records: DataFrame, classified: DataFrame, first: int = 30, chars: int = 300) -> DataFrame:
    """The first flagged records, with previews."""
    flagged = classified.filter("is_hit").join(records.select("id", "subsource", "text"), "id")
    return flagged.orderBy("id").limit(first).select("id", "match_type", F.bround("hit_rate", 3).alias("hit_rate"), "matched_eval", "subsource", preview(F.col("text"), chars).alias("problem"))
