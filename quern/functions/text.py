"""String functions of the curation and grading operators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is deleted from an answer, in this order, and from an arithmetic expression.
ANSWER_JUNK = ("\\left", "\\right", "\\!", "\\,", "\\;", "\\ ", "$", "\n")
EXPRESSION_JUNK = ("\\left", "\\right", "\\!", "\\,", "\\;")
LONGEST_ANSWER = 100


def strip(c: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def norm_exact(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def ngrams(toks: Column, n: int) -> Column:
    """Contiguous n-grams, joined by blanks, repeats kept; empty if there are fewer tokens. The tokens
    are bound once: where they are computed, they would be anew for each n-gram."""
    some = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
    made = F.transform(F.array(toks), lambda t: F.when(F.size(t) >= n, some(t)).otherwise(F.array().cast("array<string>")))
    return F.when(toks.isNull(), F.lit(None)).otherwise(made[0])


def without(c: Column, junk: tuple[str, ...]) -> Column:
    for j in junk:
        c = F.replace(c, F.lit(j), F.lit(""))
    return c


def normalize_answer(c: Column) -> Column:
    c = without(strip(c), ANSWER_JUNK)
    for wide in ("\\dfrac", "\\tfrac"):
        c = F.replace(c, F.lit(wide), F.lit("\\frac"))
    return strip(c)


def extract_strict(c: Column) -> Column:
    """The last number behind four hashes, without commas; null if there is none."""
    found = F.try_element_at(F.regexp_extract_all(c, F.lit("#### (-?[0-9.,]+)"), F.lit(1)), F.lit(-1))
    return without(found, (",", "$"))


def extract_flexible(c: Column) -> Column:
    """The last run of digits, points and commas other than a lone point; if there are only lone
    points, the first; null if there is none."""
    found = F.regexp_extract_all(c, F.lit("(-?[0-9.,]+)"), F.lit(1))
    good = F.filter(found, lambda x: ~x.isin("", "."))
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.try_element_at(found, F.lit(1)))


def normalize_number(c: Column) -> Column:
    return F.regexp_replace(strip(without(c, (",", "$"))), r"\.+\z", "")


def preview(c: Column, n: int = 300) -> Column:
    return F.substring(c, 1, n)


def chat_template(messages: Column, start: str = "<|im_start|>", end: str = "<|im_end|>\n", generation_prompt: bool = True) -> Column:
    """Messages (role, content) as one prompt text, in the ChatML form unless other marks are given."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(start), m["role"], F.lit("\n"), m["content"], F.lit(end))), "")
    return F.concat(body, F.lit(f"{start}assistant\n")) if generation_prompt else body


def get_field(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, or else an empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))
