"""Arithmetic puzzles: numbers and a target that a chain of operations reaches."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.arith import value
from quern.operators.clean import five_field
from quern.operators.sample import numbered
from quern.session import table

# Fixed value: the instruction behind each puzzle.
INSTRUCTION = "Using each of the given numbers exactly once and the operations +, -, *, /, write an arithmetic expression that equals the target. Please reason step by step, and put your final expression within \\boxed{}."
ORDERS = [*permutations(range(4))]
#: Attempts for each puzzle wanted; more than the last of them show that there are not so many.
SPARE = (4, 32, 256, 2048)


def combine(state: Column, b: Column, pick: Column, most: int) -> Column:
    """struct(v, expr) after one more operand. Of the operations in the order numbered ``pick``, one of
    24, the first that is allowed is taken: values must be positive, whole and at most ``most``."""
    a, expr = state["v"], state["expr"]
    text = lambda op: F.concat(F.lit("("), expr, F.lit(f" {op} "), b.cast("string"), F.lit(")"))
    made = [(a + b, text("+"), a + b <= most), (a - b, text("-"), a > b), (a * b, text("*"), a * b <= most), (F.expr("cast(null as bigint)"), text("/"), F.lit(False))]
    whole = (b > 0) & (F.pmod(a, F.greatest(b, F.lit(1))) == 0)
    made[3] = (F.floor(a / F.greatest(b, F.lit(1))).cast("bigint"), text("/"), whole)
    ordered = F.array(*(F.struct(F.element_at(F.array(*(F.lit(o.index(k)) for o in ORDERS)), pick.cast("int") + 1).alias("k"), v.cast("bigint").alias("v"), e.alias("expr"), (ok & (v > 0) & (v <= most)).alias("ok")) for k, (v, e, ok) in enumerate(made)))
    best = F.try_element_at(F.array_sort(F.filter(ordered, lambda x: x["ok"])), F.lit(1))
    return F.when(state["v"].isNotNull(), F.struct(best["v"].alias("v"), best["expr"].alias("expr")))


def chain(numbers: Column, picks: Column, most: int = 1000) -> Column:
    """struct(v, expr) of the left-deep chain over the numbers, null if it breaks off."""
    first = F.struct(numbers[0].cast("bigint").alias("v"), numbers[0].cast("string").alias("expr"))
    rest = F.arrays_zip(F.slice(numbers, 2, F.size(numbers) - 1).alias("n"), F.slice(picks, 2, F.size(numbers) - 1).alias("p"))
    return F.aggregate(rest, first, lambda s, x: combine(s, x["n"].cast("bigint"), x["p"], most))


def draws(key: Column, seed: int, n: int, low: int, high: int) -> Column:
    """n numbers in [low, high], from hashes."""
    return F.array(*(F.lit(low) + F.pmod(F.xxhash64(key, F.lit(seed), F.lit(k)), F.lit(high - low + 1)) for k in range(n))).cast("array<bigint>")


def distinct(puzzles: DataFrame, order: str) -> DataFrame:
    """The first of the puzzles that have the same numbers, in any order, and target."""
    w = Window.partitionBy(F.array_sort("numbers"), "target").orderBy(order)
    return puzzles.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def unseen(puzzles: DataFrame, seen: DataFrame) -> DataFrame:
    """Puzzles that are not among the seen ones."""
    key = lambda df: df.withColumn("_key", F.array_sort("numbers"))
    return key(puzzles).join(key(seen).select("_key", "target").distinct(), ["_key", "target"], "left_anti").drop("_key")


def attempts(spark: SparkSession, n: int, seed: int, k_min: int, k_max: int, low: int, high: int, most: int) -> DataFrame:
    """Distinct puzzles out of n attempts: id, numbers, target and expr. The chain takes the numbers in
    an order of its own."""
    key = F.col("id")
    size = F.lit(k_min) + F.pmod(F.xxhash64(key, F.lit(seed), F.lit(-1)), F.lit(k_max - k_min + 1))
    tries = spark.range(n).withColumn("numbers", F.slice(draws(key, seed, k_max, low, high), F.lit(1), size.cast("int")))
    shuffled = F.array_sort(F.transform("numbers", lambda x, k: F.struct(F.xxhash64(key, F.lit(seed + 2), k).alias("h"), x.alias("n"))))
    tries = tries.withColumn("_order", F.transform(shuffled, lambda x: x["n"]))
    tries = tries.withColumn("_chain", chain(F.col("_order"), draws(key, seed + 1, k_max, 0, len(ORDERS) - 1), most)).filter("_chain.v is not null")
    return distinct(tries.select("id", "numbers", F.col("_chain.v").alias("target"), F.col("_chain.expr").alias("expr")), "id")


def generate(spark: SparkSession, n: int, seed: int = 42, k_min: int = 3, k_max: int = 4, low: int = 1, high: int = 99, most: int = 1000, other_than: DataFrame | None = None) -> DataFrame:
    """Exactly n distinct puzzles, numbered from 0, none of which is in ``other_than``. ValueError if
    there are not as many to be found."""
    for spare in SPARE:
        made = attempts(spark, n * spare, seed, k_min, k_max, low, high, most)
        made = table((made if other_than is None else unseen(made, other_than)).orderBy("id").limit(n), "puzzles")
        if made.count() == n:
            return numbered(made, "id", "_row").select(F.col("_row").alias("id"), "numbers", "target", "expr")
    raise ValueError(f"no {n} different puzzles were found")


def sane(puzzles: DataFrame) -> DataFrame:
    """Puzzles whose expression does not have the target's value; there should be none."""
    return puzzles.withColumn("_v", value(F.col("expr"))).filter("_v is null or abs(_v - target) >= 1e-6").drop("_v")


def content(numbers: Column, target: Column, instruction: str = INSTRUCTION) -> Column:
    joined = F.array_join(F.transform(numbers, lambda x: x.cast("string")), ", ")
    return F.concat(F.lit("Numbers: "), joined, F.lit("\nTarget: "), target.cast("string"), F.lit(f"\n{instruction}"))


def records(puzzles: DataFrame, split: str) -> DataFrame:
    extra = F.struct(F.lit(split).alias("split"), F.col("id").cast("long").alias("index"), "numbers", F.col("target").cast("long").alias("target"), F.col("expr").alias("example_solution"))
    return puzzles.select(*five_field("countdown", content(F.col("numbers"), F.col("target")), F.col("target").cast("string"), extra))
