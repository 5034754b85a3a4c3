"""Small frame helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """One-row tables with different columns as one row. Stacked and folded, so there is no join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def with_period_columns(df: DataFrame, periods: DataFrame, key: str, columns: Sequence[str], most: int = 10_000) -> DataFrame:
    """Left join of a table with one row per period, without moving a row of ``df``.

    The period table is folded to a map in one row and read as a scalar, so a few periods never become the keys of
    a shuffle. It is bounded by the calendar: more than ``most`` periods, or a repeated one, fail the job.
    """
    entries = F.map_from_entries(F.collect_list(F.struct(key, F.struct(*columns))))
    too_many = F.raise_error(F.lit(f"more than {most} periods in {key}"))
    folded = periods.filter(F.col(key).isNotNull()).agg(F.when(F.count(F.lit(1)) <= most, entries).otherwise(too_many).alias("m"))
    found = df.withColumn("__at", folded.scalar()[F.col(key)])
    return found.select(*df.columns, *[F.col(f"__at.{c}").alias(c) for c in columns])
