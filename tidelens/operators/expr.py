"""Derived columns from arithmetic text: a precedence parser that yields a Column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.limits import LIMITS

_INF, _NAN = float("inf"), float("nan")


def _log(f):
    """IEEE logarithms: -inf at 0, NaN below."""
    return lambda x: F.when(x.isNull(), None).when(x == 0, F.lit(-_INF)).when(x < 0, F.lit(_NAN)).otherwise(f(F.when(x > 0, x)))


FUNCTIONS = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "log": _log(F.log), "ln": _log(F.log), "log2": _log(F.log2), "log10": _log(F.log10),
    "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "round": F.round,
}


def _divide(a: Column, b: Column) -> Column:
    """IEEE division: infinite or NaN for a zero divisor."""
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(_NAN)).when(a > 0, F.lit(_INF)).otherwise(F.lit(-_INF))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, at_zero).otherwise(a / F.when(b != 0, b))


def _remainder(a: Column, b: Column) -> Column:
    """The sign of the dividend; NaN for a zero divisor."""
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, F.lit(_NAN)).otherwise(a % F.when(b != 0, b))


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(.))")


class _Parser:
    def __init__(self, text: str, columns: list[str]):
        self.tokens = [(n, name, op) for n, name, op in _TOKEN.findall(text) if n or name or op.strip()]
        self.at, self.columns = 0, columns

    def peek(self) -> str:
        return "".join(self.tokens[self.at]) if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> tuple[str, str, str]:
        if self.at == len(self.tokens) or wanted and self.peek() != wanted:
            raise ValueError(f"expected {wanted or 'a value'} at token {self.at + 1}, found {self.peek() or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def sum(self) -> Column:
        left = self.product()
        while (op := self.peek()) in ("+", "-"):
            self.take()
            right = self.product()
            left = left + right if op == "+" else left - right
        return left

    def product(self) -> Column:
        left = self.signed()
        while (op := self.peek()) in ("*", "/", "%"):
            self.take()
            right = self.signed()
            left = left * right if op == "*" else _divide(left, right) if op == "/" else _remainder(left, right)
        return left

    def signed(self) -> Column:
        if self.peek() in ("-", "+"):
            negative = self.take()[2] == "-"
            inner = self.signed()
            return -inner if negative else inner
        number, name, op = self.take()
        if number:
            return F.lit(float(number))
        if op == "(":
            inner = self.sum()
            self.take(")")
            return inner
        if op:
            raise ValueError(f"unexpected {op!r}")
        if self.peek() == "(":
            if name not in FUNCTIONS:
                raise ValueError(f"unknown function {name!r}; known are {', '.join(sorted(FUNCTIONS))}")
            self.take("(")
            inner = self.sum()
            self.take(")")
            return FUNCTIONS[name](inner)
        if name not in self.columns:
            raise ValueError(f"unknown column {name!r}")
        return F.col(f"`{name}`").cast("double")


def parse(text: str, columns: list[str]) -> Column:
    """Numbers, columns, + - * / %, parentheses, signs and the functions above, all in doubles."""
    if not text.strip() or len(text) > LIMITS.expression:
        raise ValueError(f"an expression has 1 to {LIMITS.expression} characters")
    parser = _Parser(text, columns)
    out = parser.sum()
    if parser.peek():
        raise ValueError(f"unexpected {parser.peek()!r}")
    return out


def transform(df: DataFrame, expression: str, output: str, ts: str = "ts") -> DataFrame:
    """df with the expression's values under the output name, which replaces a column of that name."""
    if not output.strip() or output in ("ts", ts):
        raise ValueError("the output needs a name other than the time column's")
    return df.withColumn(output, parse(expression, df.columns))
