"""Parquet tables of records, and evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import chat_template, first_filled

MESSAGE = "struct<role:string,content:string>"
FIVE_FIELDS = f"data_source string, prompt array<{MESSAGE}>, ability string, reward_model struct<style:string,ground_truth:string>"


class MissingInputs(FileNotFoundError):
    """All inputs that are not there."""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, paths: list[str]) -> None:
    if missing := [p for p in paths if not exists(spark, p)]:
        raise MissingInputs("missing inputs: " + ", ".join(missing))


def records(spark: SparkSession, path: str, extra: str | None = None) -> DataFrame:
    """Five-field records; ``extra``: the type of extra_info, if the file's is not to be inferred."""
    reader = spark.read if extra is None else spark.read.schema(f"{FIVE_FIELDS}, extra_info {extra}")
    return reader.parquet(path)


def splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several splits of a data set, each a Parquet or JSON path, with the column ``split``."""
    parts = [(spark.read.json(p) if p.endswith((".json", ".jsonl")) else spark.read.parquet(p)).withColumn("split", F.lit(s)) for s, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def eval_samples(df: DataFrame, name: str, position: Column | None = None, numbers: bool = False) -> DataFrame:
    """Records to eval_set, index, data_source, prompt_text, ground_truth and raw_question, and, if
    asked for, the numbers of a puzzle (null for others). The index is that of extra_info, or else the
    row's position."""
    fields = {f.name for f in df.schema["extra_info"].dataType.fields}
    own = F.col("extra_info.index").cast("long") if "index" in fields else F.lit(None).cast("long")
    index = F.coalesce(own, position) if position is not None else own
    question = first_filled(*(F.col(f"extra_info.{f}").cast("string") for f in ("question", "problem") if f in fields))
    given = F.col("extra_info.numbers").cast("array<bigint>") if "numbers" in fields else F.lit(None).cast("array<bigint>")
    more = [given.alias("numbers")] if numbers else []
    return df.select(F.lit(name).alias("eval_set"), index.alias("index"), "data_source", chat_template(F.col("prompt")).alias("prompt_text"), F.col("reward_model.ground_truth").cast("string").alias("ground_truth"), question.alias("raw_question"), *more)


def load_eval(spark: SparkSession, eval_sets: list[dict], working_dir: str = ".") -> DataFrame:
    paths = {s["name"]: s["path"] if s["path"].startswith("/") or "://" in s["path"] else f"{working_dir}/{s['path']}" for s in eval_sets}
    require(spark, [*paths.values()])
    out = None
    for name, path in paths.items():
        df = spark.read.parquet(path).withColumn("_row", F.col("_metadata.row_index"))
        part = eval_samples(df, name, F.col("_row"), numbers=True)
        out = part if out is None else out.unionByName(part)
    return out


class Mismatch(ValueError):
    """Completions that don't pair off with what they were made for."""


def paired(samples: DataFrame, completions: DataFrame, on: list[str], once: bool = True, every: bool = True) -> DataFrame:
    """Samples joined with their completions. Each sample must have completions, one row if ``once``;
    each row of completions must have its sample if ``every``; else Mismatch."""
    own = samples.groupBy(*on).agg(F.count("*").alias("_l"))
    other = completions.groupBy(*on).agg(F.count("*").alias("_r"))
    seen = own.join(other, on, "full_outer").agg(F.count_if(F.col("_r").isNull()).alias("bare"), F.count_if(F.col("_l").isNull()).alias("stray"), F.count_if(F.col("_r") > 1).alias("several"), F.count_if(F.col("_l") > 1).alias("twice")).first()
    if seen["bare"] or seen["twice"] or (every and seen["stray"]) or (once and seen["several"]):
        raise Mismatch(f"{seen['bare']} samples without completions, {seen['twice']} samples more than once, {seen['stray']} completions without a sample, {seen['several']} with several rows")
    return samples.join(completions, on)


def checks(samples: DataFrame, eval_sets: list[dict]) -> list[str]:
    """Warnings: sets whose size or data sources are other than configured."""
    rows = {r["eval_set"]: r for r in samples.groupBy("eval_set").agg(F.count("*").alias("n"), F.collect_set("data_source").alias("sources")).collect()}
    said = []
    for s in eval_sets:
        r = rows.get(s["name"])
        n, found = (r["n"], set(r["sources"])) if r else (0, set())
        if n != s["size"]:
            said.append(f"{s['name']}: {n} rows, {s['size']} configured")
        if found != {s["data_source"]}:
            said.append(f"{s['name']}: data sources {sorted(found)}, {s['data_source']} configured")
    return said


def peek(df: DataFrame, n: int = 1, chars: int = 120) -> DataFrame:
    return df.limit(n).select(*(F.substring(F.col(f"`{c}`").cast("string"), 1, chars).alias(c) for c in df.columns))


def random_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Values with their number and percentage, most frequent first; null is ``unknown``."""
    from pyspark.sql.window import Window

    out = df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))
    return out.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), column)
