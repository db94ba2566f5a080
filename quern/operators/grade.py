"""Grading of completions. A grade is struct(correctness, format_ok, total_reward), the last
being the first plus a tenth of the second; both parts come from one expression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quern.functions import arith
from quern.functions.boxed import has_boxed, last_boxed
from quern.functions.symbolic import equivalent
from quern.functions.text import EXPRESSION_JUNK, extract_flexible, extract_strict, normalize_number, strip, without

# The names of sources by grader.
NUMERIC = ("openai/gsm8k", "gsm8k")
SYMBOLIC = ("numina_math", "math500", "math")
EXPRESSION = ("countdown",)
FORMAT_WEIGHT = 0.1
TOLERANCE = 1e-6


def _grade(correct: Column, formed: Column, weight: float = FORMAT_WEIGHT, score: float = 1.0) -> Column:
    c, f = (F.coalesce(x, F.lit(False)).cast("double") for x in (correct, formed))
    return F.struct((c * F.lit(score)).alias("correctness"), f.alias("format_ok"), (c * F.lit(score) + f * F.lit(weight)).alias("total_reward"))


def numeric(text: Column, truth: Column, null_equal: bool = False) -> Column:
    """Equality of normalised number strings, found behind hashes or else anywhere. With
    ``null_equal`` no answer is right where there is no truth."""
    strict = extract_strict(text)
    answer, wanted = normalize_number(F.coalesce(strict, extract_flexible(text))), normalize_number(truth)
    return _grade(answer.eqNullSafe(wanted) if null_equal else answer == wanted, strict.isNotNull())


def symbolic(text: Column, truth: Column) -> Column:
    box = last_boxed(text)
    return _grade(box.isNotNull() & equivalent(box, truth), box.isNotNull())


def expression_text(box: Column) -> Column:
    """LaTeX arithmetic as plain arithmetic."""
    c = without(box, EXPRESSION_JUNK)
    for name, op in (("\\times", "*"), ("\\cdot", "*"), ("\\div", "/")):
        c = F.replace(c, F.lit(name), F.lit(op))
    return F.translate(c, "{}", "()")


def segments(box: Column) -> Column:
    """The sides of an equation that are plain arithmetic."""
    return F.filter(F.transform(F.split(expression_text(box), "="), strip), lambda s: s.rlike(r"^[0-9+*/() -]+\z"))


def integers(text: Column) -> Column:
    """The integers in a text, in ascending order."""
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.try_cast("decimal(38,0)")))


def target(truth: Column) -> Column:
    """The truth as an integer, or null."""
    t = strip(truth)
    return F.when(t.rlike(r"^[+-]?[0-9]+\z"), t.try_cast("bigint").cast("double"))


def expression(df: DataFrame, text: str, truth: str, numbers: str, out: str = "grade", ids: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the grade: some side of the boxed equation uses exactly the numbers and has the
    target's value. Values are computed for one joined string of the sides that may count."""
    wanted = F.array_sort(F.transform(F.col(numbers), lambda x: x.cast("decimal(38,0)")))
    box = last_boxed(F.col(text))
    fit = F.filter(segments(box), lambda s: integers(s) == wanted)
    df = df.withColumns({"_box": box, "_fit": F.when(F.coalesce(F.size(numbers) > 0, F.lit(False)), fit)})
    df = df.withColumn("_values", _values(F.col("_fit")))
    hit = F.exists("_values", lambda v: F.abs(v - target(F.col(truth))) < TOLERANCE)
    return df.withColumn(out, _grade(hit, F.col("_box").isNotNull())).drop("_box", "_fit", "_values")


@F.pandas_udf(ArrayType(DoubleType()))
def _values(sides: pd.Series) -> pd.Series:
    return sides.map(lambda xs: None if xs is None else [v for x in xs if (v := arith.evaluate(x)) is not None])


def score(df: DataFrame, text: str = "text", truth: str = "truth", source: str = "data_source", numbers: str | None = None, out: str = "grade") -> DataFrame:
    """``df`` with the grade by source; unknown sources get zeros. Without numbers an expression can
    only earn its format."""
    none = _grade(F.lit(False), F.lit(False))
    s = F.col(source)
    if numbers:
        df = expression(df, text, truth, numbers, "_expression")
        third = F.col("_expression")
    else:
        third = _grade(F.lit(False), has_boxed(F.col(text)))
    graded = F.when(s.isin(*NUMERIC), numeric(F.col(text), F.col(truth))).when(s.isin(*SYMBOLIC), symbolic(F.col(text), F.col(truth))).when(s.isin(*EXPRESSION), third).otherwise(none)
    return df.withColumn(out, graded).drop("_expression")


def extract_answer(source: Column, text: Column) -> Column:
    """The answer that votes; null for sources without a rule, the short alias among them."""
    number = normalize_number(F.coalesce(extract_strict(text), extract_flexible(text)))
    return F.when(source == NUMERIC[0], number).when(source.isin("math500", "numina_math", "countdown"), last_boxed(text))


def as_completion(source: Column, answer: Column) -> Column:
    """An answer in the form that its source's grader reads."""
    return F.when(source == NUMERIC[0], F.concat(F.lit("#### "), answer)).when(source.isin("math500", "numina_math", "countdown"), F.concat(F.lit("\\boxed{"), answer, F.lit("}"))).otherwise(answer)
