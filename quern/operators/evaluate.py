"""Evaluation metrics over the long form: one row per completion, greedy ones with index -1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.grade import as_completion, extract_answer, score

KEY = ("eval_set", "sample_index")


def long_form(generations: DataFrame) -> DataFrame:
    """Generations (eval_set, index, data_source, ground_truth, greedy_completion,
    sampled_completions) to one row per completion."""
    more = [c for c in ("numbers",) if c in generations.columns]
    same = ("eval_set", F.col("index").alias("sample_index"), "data_source", "ground_truth", *more)
    greedy = generations.select(*same, F.lit("greedy").alias("completion_kind"), F.lit(-1).cast("long").alias("completion_index"), F.col("greedy_completion").alias("completion_text"))
    sampled = generations.select(*same, F.lit("sampled").alias("completion_kind"), F.posexplode("sampled_completions").alias("completion_index", "completion_text"))
    return greedy.unionByName(sampled.withColumn("completion_index", F.col("completion_index").cast("long")))


def scored(long: DataFrame) -> DataFrame:
    """The long form with extracted_answer (empty if there is none), correctness, format_ok and
    total_reward. A column ``numbers`` is what expressions may use; without it they are never right."""
    numbers = "numbers" if "numbers" in long.columns else None
    out = score(long, "completion_text", "ground_truth", "data_source", numbers)
    answer = F.coalesce(extract_answer(F.col("data_source"), F.col("completion_text")), F.lit(""))
    return out.select(*(c for c in long.columns if c != numbers), answer.alias("extracted_answer"), "grade.correctness", "grade.format_ok", "grade.total_reward")


def majority(rows: DataFrame) -> DataFrame:
    """The most frequent non-empty answer among each sample's sampled completions; of equally
    frequent ones the first seen."""
    votes = rows.filter("completion_kind = 'sampled' and extracted_answer <> ''")
    votes = votes.groupBy(*KEY, "data_source", "ground_truth", "extracted_answer").agg(F.count("*").alias("votes"), F.min("completion_index").alias("_first"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("votes"), "_first")
    return votes.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select(*KEY, "data_source", "ground_truth", "extracted_answer", "votes")


def majority_scores(rows: DataFrame) -> DataFrame:
    """Each winner graded once more, in the form that its grader reads; expressions are never right,
    as there are no numbers here."""
    winners = majority(rows)
    winners = winners.withColumn("_text", as_completion(F.col("data_source"), F.col("extracted_answer")))
    return score(winners, "_text", "ground_truth", "data_source").select(*KEY, "data_source", "extracted_answer", "votes", F.col("grade.correctness").alias("correctness"))


def metrics(rows: DataFrame) -> DataFrame:
    """One row per evaluation set. Samples without any valid answer count as wrong in maj_at_8,
    whose name stands for however many completions there are."""
    greedy = F.col("completion_kind") == "greedy"
    mean = lambda c, when: F.coalesce(F.avg(F.when(when, F.col(c))), F.lit(0.0))
    out = rows.groupBy("eval_set").agg(
        F.min("data_source").alias("data_source"),
        F.count_if(greedy).alias("num_samples"),
        mean("correctness", greedy).alias("pass_at_1"),
        mean("format_ok", greedy).alias("format_rate"),
        mean("total_reward", greedy).alias("total_reward_greedy"),
        mean("total_reward", ~greedy).alias("total_reward_sampled_mean"),
    )
    right = majority_scores(rows).groupBy("eval_set").agg(F.sum(F.when(F.col("correctness") > 0.5, 1.0).otherwise(0.0)).alias("_right"))
    out = out.join(right, "eval_set", "left")
    maj = F.when(F.col("num_samples") > 0, F.coalesce("_right", F.lit(0.0)) / F.greatest("num_samples", F.lit(1))).otherwise(F.lit(0.0))
    return out.select(F.col("eval_set").alias("eval_set_name"), "data_source", "num_samples", "pass_at_1", maj.alias("maj_at_8"), "format_rate", "total_reward_greedy", "total_reward_sampled_mean")
