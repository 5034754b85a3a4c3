"""Leakage guards and input checks. Each has a table form (one row per group) and a raising form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LeakageError(AssertionError):
    """Training or feature data reach into the evaluation period."""


def temporal_split_table(df: DataFrame, keys: Sequence[str], ds: str, is_train: Column) -> DataFrame:
    """Last train and first test period per group; ``ok`` is NULL when a side is empty."""
    last, first = F.max(F.when(is_train, F.col(ds))), F.min(F.when(~is_train, F.col(ds)))
    return (
        df.groupBy(*keys)
        .agg(last.alias("train_end"), first.alias("test_start"))
        .withColumn("ok", F.col("train_end") < F.col("test_start"))
    )


def assert_temporal_split(df: DataFrame, keys: Sequence[str], ds: str, is_train: Column) -> None:
    """Raise on the first group that is empty on one side or overlaps."""
    bad = temporal_split_table(df, keys, ds, is_train).filter(F.col("ok").isNull() | ~F.col("ok")).take(1)
    if not bad and keys and df.isEmpty():
        raise ValueError("train and test must both be non-empty")
    if bad:
        row = bad[0]
        if row["ok"] is None:
            raise ValueError(f"train and test must both be non-empty: {row.asDict()}")
        raise LeakageError(f"train ends {row['train_end']} but test starts {row['test_start']}")


def assert_ordered_roles(df: DataFrame, ds: str, role: str, order: Sequence[str]) -> None:
    """Raise unless every role has rows and each ends before every later one begins; one pass for all pairs."""
    spans = {r[role]: r for r in df.filter(F.col(role).isin(*order)).groupBy(role).agg(F.min(ds).alias("first"), F.max(ds).alias("last")).collect()}
    for name in order:
        if name not in spans:
            raise ValueError(f"{name} has no rows")
    for i, early in enumerate(order):
        for late in order[i + 1 :]:
            if spans[early]["last"] >= spans[late]["first"]:
                raise LeakageError(f"{early} ends {spans[early]['last']} but {late} starts {spans[late]['first']}")


def features_known_table(df: DataFrame, keys: Sequence[str], stamp: str, origin: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.max(stamp).alias("latest_stamp"),
        F.count_if(F.col(stamp) > origin).alias("late_rows"),
    ).withColumn("ok", F.col("late_rows") == 0)


def assert_features_known(df: DataFrame, stamp: str, origin: Column) -> None:
    late = df.filter(F.col(stamp) > origin).select(stamp).take(1)
    if late:
        raise LeakageError(f"a feature known at {late[0][0]} is after its origin")


def validate_series(df: DataFrame, series: str, y: str, min_length: int) -> DataFrame:
    return df.groupBy(series).agg(
        F.count("*").alias("n"), F.count(y).alias("n_known")
    ).withColumn("valid", F.col("n_known") >= min_length)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail the job when a key repeats (the check runs with the query, not before it)."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*df.columns)).alias("__r"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"duplicate key on {', '.join(keys)}")).cast("boolean")).otherwise(True)
    return counted.filter(checked).select("__r.*")
