"""Raw question-answer rows to five-field records, and what was dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.boxed import ground_truth
from quern.functions.text import get_field, strip

# Fixed value: the instruction behind each problem.
INSTRUCTION = "Please reason step by step, and put your final answer within \\boxed{}."


def five_field(data_source: str, content: Column, truth: Column, extra: Column) -> list[Column]:
    return [
        F.lit(data_source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"),
        F.lit("math").alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        extra.alias("extra_info"),
    ]


def parse(raw: DataFrame, split: str, data_source: str = "numina_math", instruction: str = INSTRUCTION) -> DataFrame:
    """(index, problem, solution, source) to records with _keep, _reason and _subsource."""
    raw = raw.withColumn("_truth", ground_truth(F.col("solution")))
    keep = F.col("_truth.reason") == "ok"
    problem, source = get_field(F.col("problem")), get_field(F.col("source"))
    content = F.when(keep, F.concat(problem, F.lit(" " + instruction))).otherwise(F.lit(""))
    extra = F.struct(F.lit(split).alias("split"), F.col("index").cast("long").alias("index"), problem.alias("question"), get_field(F.col("solution")).alias("answer"), source.alias("subsource"))
    return raw.select(*five_field(data_source, content, get_field(F.col("_truth.answer")), extra), keep.alias("_keep"), F.col("_truth.reason").alias("_reason"), source.alias("_subsource"))


def kept(parsed: DataFrame) -> DataFrame:
    return parsed.filter("_keep").drop("_keep", "_reason", "_subsource")


def eval_records(raw: DataFrame, split: str, data_source: str = "math500", instruction: str = INSTRUCTION) -> DataFrame:
    """(index, problem, answer, subject, level, unique_id) to records; nothing is dropped."""
    extra = F.struct(F.lit(split).alias("split"), F.col("index").cast("long").alias("index"), get_field(F.col("problem")).alias("problem"), "subject", "level", "unique_id")
    return raw.select(*five_field(data_source, F.concat(get_field(F.col("problem")), F.lit(" " + instruction)), strip(get_field(F.col("answer"))), extra))


def empty_answers(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(get_field(F.col("reward_model.ground_truth")) == "").alias("n_empty"))


def stats(parsed: DataFrame) -> DataFrame:
    rate = F.when(F.count("*") > 0, F.bround(F.count_if("_keep") / F.greatest(F.count("*"), F.lit(1)), 4)).otherwise(F.lit(0.0))
    return parsed.agg(F.count("*").alias("original"), F.count_if("_keep").alias("kept"), F.count_if(~F.col("_keep")).alias("dropped"), rate.alias("retention"))


def subsource_stats(parsed: DataFrame) -> DataFrame:
    out = parsed.groupBy(F.col("_subsource").alias("subsource")).agg(F.count("*").alias("total"), F.count_if("_keep").alias("kept"))
    return out.withColumn("rate", F.bround(F.col("kept") / F.col("total"), 4)).orderBy(F.desc("total"), "subsource")


def drop_reasons(parsed: DataFrame) -> DataFrame:
    return parsed.filter("_reason <> 'ok'").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))
