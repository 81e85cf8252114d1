"""Numbers, dates and error values. A computed value is a pair: a double and the name of what broke it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spelling of numbers and dates, and of an error value.
NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
DATE = r"^([0-9]{1,4})([-/])([0-9]{1,2})\2([0-9]{1,2})$"
ERROR = "#REF!(%s)"


def number(text: Column) -> Column:
    """The double a cell's text spells, else null. A bare cast would also take 1e3, 5d, +5, .5 or NaN."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def date_key(text: Column) -> Column:
    """struct(y, m, d) of date text, without a calendar; null otherwise."""
    part = lambda n: F.regexp_extract(text, DATE, n).try_cast("int")
    return F.when(text.rlike(DATE), F.struct(part(1).alias("y"), part(3).alias("m"), part(4).alias("d")))


def order_kind(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), "number").when(text.rlike(DATE), "date").otherwise("text")


def error_text(err: Column) -> Column:
    return F.format_string(ERROR, err)


@dataclass(frozen=True)
class Pair:
    value: Column
    err: Column

    @staticmethod
    def of(value: Column, own: Column, *parts: Pair) -> Pair:
        """own: the error of this step itself; an error of its parts goes first, from left to right."""
        err = F.coalesce(*(p.err for p in parts), own)
        return Pair(F.when(err.isNull(), value), err)


def none() -> Column:
    return F.lit(None).cast("string")


def arithmetic(sign: str, a: Pair, b: Pair) -> Pair:
    if sign == "/":
        return Pair.of(F.try_divide(a.value, b.value), F.when(b.value == 0, "/0"), a, b)
    value = {"+": a.value + b.value, "-": a.value - b.value, "*": a.value * b.value}[sign]
    return Pair.of(value, none(), a, b)
