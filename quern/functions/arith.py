"""Values of arithmetic expressions: integers, + - * /, signs and parentheses."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_TOKEN = re.compile(r"\s*([0-9]+|[-+*/()])")
DEEPEST = 200


class _Wrong(ValueError):
    pass


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise _Wrong(text)
        out.append(m[1])
        at = m.end()
        if m[1] in "*/" and text[at : at + 1] == m[1]:
            raise _Wrong("powers and whole divisions are no part of the language")
    return out


class _Reader:
    """Sums of products of signed factors."""

    def __init__(self, text: str):
        self.tokens, self.at, self.depth = _tokens(text), 0, 0

    def take(self, among: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at] in among:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def whole(self) -> float:
        value = self.sum()
        if self.at < len(self.tokens):
            raise _Wrong("more than one expression")
        return value

    def sum(self) -> float:
        value = self.product()
        while op := self.take("+-"):
            other = self.product()
            value = value + other if op == "+" else value - other
        return value

    def product(self) -> float:
        value = self.factor()
        while op := self.take("*/"):
            other = self.factor()
            value = value * other if op == "*" else value / other
        return value

    def factor(self) -> float:
        self.depth += 1
        if self.depth > DEEPEST:
            raise _Wrong("too deep")
        try:
            if op := self.take("+-"):
                value = self.factor()
                return -value if op == "-" else value
            if self.take("("):
                value = self.sum()
                if not self.take(")"):
                    raise _Wrong("a parenthesis is open")
                return value
            if self.at < len(self.tokens) and self.tokens[self.at].isdigit():
                digits = self.tokens[self.at]
                if len(digits) > 1 and digits[0] == "0" and digits.strip("0"):
                    raise _Wrong("leading zeros")
                self.at += 1
                return int(digits)
            raise _Wrong("a number is missing")
        finally:
            self.depth -= 1


def evaluate(text: str | None) -> float | None:
    """The value, by true division; null where the text is no expression or has no value."""
    if text is None:
        return None
    try:
        return float(_Reader(text).whole())
    except (ValueError, ArithmeticError):
        return None


@pandas_udf(DoubleType())
def value(texts: pd.Series) -> pd.Series:
    return texts.map(evaluate).astype("float64")
