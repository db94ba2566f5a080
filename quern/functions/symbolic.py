"""Normal forms of mathematical answers, after the published rules for the MATH data set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import without

# Spacing and delimiters that carry no meaning.
_NOTHING = ("\n", "\\!", "\\left", "\\right", "^{\\circ}", "^\\circ", "\\$", "$", "\\%", "%")


def normal_form(c: Column) -> Column:
    c = F.replace(c, F.lit("\\\\"), F.lit("\\"))
    for wide in ("tfrac", "dfrac"):
        c = F.replace(c, F.lit(wide), F.lit("frac"))
    c = without(c, _NOTHING)
    c = F.regexp_replace(c, r"\\text\{ .*$", "")
    c = F.regexp_replace(c, r"(^|[ {])\.", "$10.")
    c = F.regexp_replace(c, r"^[^=]{1,2}=", "")
    c = F.regexp_replace(c, r"\\sqrt([^{])", r"\\sqrt{$1}")
    c = F.replace(c, F.lit(" "), F.lit(""))
    c = F.regexp_replace(c, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    c = F.regexp_replace(c, r"\\frac([^{])\{", r"\\frac{$1}{")
    c = F.when(c == "0.5", F.lit("\\frac{1}{2}")).otherwise(c)
    return F.regexp_replace(c, r"^(-?[0-9]+)/(-?[0-9]+)$", r"\\frac{$1}{$2}")


def equivalent(a: Column, b: Column) -> Column:
    return F.coalesce(normal_form(a) == normal_form(b), F.lit(False))
