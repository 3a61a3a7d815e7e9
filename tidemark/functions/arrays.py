"""Small column helpers shared by the other function modules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once per row and use it as often as body likes.

    A plain Python variable would paste the whole expression into every use,
    and into every turn of a higher-order function.
    """
    return F.transform(F.array(value), body)[0]


def sorted_set(items: Column) -> Column:
    return F.sort_array(F.array_distinct(items))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def string_list(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def one_of(words: Iterable[str]) -> str:
    """A regex alternation of literal words."""
    return "|".join(re.sub(r"([.^$*+?()\[\]{}|\\-])", r"\\\1", w) for w in words)


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)
