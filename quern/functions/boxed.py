"""Answers in boxes: balanced braces behind ``\\boxed``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from quern.functions.text import LONGEST_ANSWER, normalize_answer

MARK = "\\boxed"


def last_boxed(c: Column) -> Column:
    """What the rightmost box holds; null if there is none, or its braces don't balance.

    A fold over the characters behind the last mark: the depth, and what has been read until it
    falls to 0 for the first time."""
    rest = F.ltrim(F.substring_index(c, MARK, -1))
    state = F.aggregate(
        F.split(F.substring(rest, 2, 1 << 30), ""),
        F.struct(F.lit(1).alias("depth"), F.lit("").alias("out")),
        lambda a, x: F.when(a["depth"] == 0, a).otherwise(
            F.struct(
                (a["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)).alias("depth"),
                F.when((a["depth"] == 1) & (x == "}"), a["out"]).otherwise(F.concat(a["out"], x)).alias("out"),
            )
        ),
    )
    return F.when((F.instr(c, MARK) > 0) & rest.startswith("{") & (state["depth"] == 0), state["out"])


def has_boxed(c: Column) -> Column:
    return last_boxed(c).isNotNull()


def boxes(text: str | None) -> list[str]:
    """What each box holds, from left to right. An inner box belongs to the outer one; a box that
    isn't closed holds all the rest."""
    found: list[str] = []
    parts = (text or "").split(MARK)
    k = 1
    while k < len(parts):
        rest = MARK.join(parts[k:]).lstrip(" ")
        k += 1
        if not rest.startswith("{"):
            continue
        depth, end = 0, len(rest)
        for i, x in enumerate(rest):
            depth += (x == "{") - (x == "}")
            if not depth:
                end = i
                break
        found.append(rest[1:end])
        k += rest[:end].count(MARK)
    return found


@pandas_udf(ArrayType(StringType()))
def all_boxed(texts: pd.Series) -> pd.Series:
    return texts.map(boxes)


def ground_truth(c: Column) -> Column:
    """struct(answer, reason) of a solution: no_boxed, multi_boxed, empty, too_long or ok, in this
    order; equal boxes count as one; the answer is null unless ok."""
    answers = F.array_distinct(F.transform(all_boxed(F.coalesce(c, F.lit(""))), normalize_answer))
    answer = F.try_element_at(answers, F.lit(1))
    reason = (
        F.when(F.size(answers) == 0, "no_boxed").when(F.size(answers) > 1, "multi_boxed").when(answer == "", "empty").when(F.length(answer) > LONGEST_ANSWER, "too_long").otherwise("ok")
    )
    return F.struct(F.when(reason == "ok", answer).alias("answer"), reason.alias("reason"))
