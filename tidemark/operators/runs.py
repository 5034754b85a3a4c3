"""Putting results of separate runs together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys only on the left, only on the right, and whether the two key sets are equal."""
    sides = (
        left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(*keys)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    return sides.agg(
        F.count_if(F.col("r") == 0).alias("only_left"), F.count_if(F.col("l") == 0).alias("only_right")
    ).withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def merge_runs_guarded(first: DataFrame, second: DataFrame, keys: Sequence[str], scored: Sequence[str]) -> DataFrame:
    """Both runs' error rows when they scored the same key set, otherwise the first run alone.

    A stale or partial run would silently shrink a comparison through an inner join.
    """
    same = key_set_difference(first, second, keys).select("same").scalar()
    return first.select(*scored).unionByName(second.filter(same).select(*scored))


def merge_columns_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer merge: new values replace old columns of the same name, other columns are kept."""
    kept = old.select(*keys, *[c for c in old.columns if c not in keys and c not in new.columns])
    return kept.join(new, list(keys), "full")


def align_common(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")
