"""Tail probabilities as column expressions, so no test needs a numeric library."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_tail(x: Column, df: int) -> Column:
    """Upper tail of chi-square; finite sum for even degrees of freedom."""
    if df % 2:
        raise ValueError("the closed form needs even degrees of freedom")
    half = x / 2
    series = F.lit(0.0)
    for i in range(df // 2):
        series = series + F.pow(half, F.lit(float(i))) / F.lit(float(math.factorial(i)))
    return F.exp(-half) * series


def student_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for integer degrees of freedom (finite trigonometric sum)."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos2 = F.pow(F.cos(theta), F.lit(2.0))
    odd = (df % 2) == 1
    steps = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int")

    def extend(state: Column, i: Column) -> Column:
        growth = F.when(odd, (2.0 * i) / (2.0 * i + 1.0)).otherwise((2.0 * i - 1.0) / (2.0 * i))
        term = state["term"] * growth * cos2
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    series = F.when(
        steps >= 1, F.aggregate(F.sequence(F.lit(1), steps), first, extend, lambda s: s["total"])
    ).otherwise(F.lit(1.0))
    inside_odd = F.lit(2 / math.pi) * (
        theta + F.when(df == 1, 0.0).otherwise(F.sin(theta) * F.cos(theta) * series)
    )
    inside = F.when(odd, inside_odd).otherwise(F.sin(theta) * series)
    return F.greatest(F.lit(0.0), 1 - inside)

