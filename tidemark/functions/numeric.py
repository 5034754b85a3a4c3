"""Null rules shared by every operator: undefined values are NULL, never NaN and never an error."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def sum_or_zero(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def share(condition: Column) -> Column:
    """Aggregate: share of rows on which the condition holds; NULL counts as not held."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def total_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def any_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def half_even_count(fraction: float, n: Column) -> Column:
    """``max(1, round_half_even(fraction * n))`` rows."""
    return F.greatest(F.lit(1).cast("long"), F.bround(F.lit(fraction) * n, 0).cast("long"))
