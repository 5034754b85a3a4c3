"""Descriptive tables: key figures, quartiles, missing values, growth pivots, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import with_period_columns
from tidemark.functions.numeric import ratio


def series_kpis(df: DataFrame, series: str, order: str, y: str = "y") -> DataFrame:
    """Growth, annual growth, variation, extremes and the strongest and weakest quarter of each series."""
    per = df.groupBy(series).agg(
        F.min_by(y, order).alias("first_value"),
        F.max_by(y, order).alias("latest_value"),
        F.count(y).alias("n"),
        (ratio(F.stddev_samp(y), F.avg(y)) * 100).alias("variation_pct"),
        F.max_by("ds", F.struct(F.col(y), -F.col(order))).alias("peak_ds"),
        F.min_by("ds", F.struct(F.col(y), F.col(order))).alias("trough_ds"),
    )
    by_quarter = df.groupBy(series, F.quarter("ds").alias("qtr")).agg(F.avg(y).alias("m"))
    seasons = by_quarter.groupBy(series).agg(
        F.max_by("qtr", F.struct("m", -F.col("qtr"))).alias("best_quarter"),
        F.min_by("qtr", F.struct("m", "qtr")).alias("worst_quarter"),
    )
    grown = ratio(F.col("latest_value"), F.col("first_value"))
    years = F.greatest(F.col("n") / 4.0, F.lit(1.0))
    return (
        per.withColumn("total_growth_pct", (grown - 1) * 100)
        .withColumn("cagr_pct", (F.pow(grown, 1 / years) - 1) * 100)
        .join(seasons, series)
    )


def describe_series(df: DataFrame, series: str, y: str = "y") -> DataFrame:
    return df.groupBy(series).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"),
        F.percentile(y, 0.25).alias("q25"), F.percentile(y, 0.5).alias("median"), F.percentile(y, 0.75).alias("q75"),
        F.max(y).alias("max"),
    )


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column, one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count("*").alias("__rows"))
    long = counts.unpivot(["__rows"], list(columns), "column_name", "n_missing")
    return long.select("column_name", "n_missing", (ratio(F.col("n_missing"), F.col("__rows")) * 100).alias("missing_pct"))


def growth_pivot(df: DataFrame, growth: str = "yoy_growth") -> DataFrame:
    out = df.groupBy(F.year("ds").alias("year")).pivot("qtr", [1, 2, 3, 4]).agg(F.avg(growth))
    return out.select("year", *[F.col(str(k)).alias(f"q{k}") for k in range(1, 5)])


def histogram_density(df: DataFrame, keys: Sequence[str], x: str, bins: int = 15, few_groups: bool = False) -> DataFrame:
    """Equal-width bins between the extremes of each group with the density and the normal curve at the
    bin centre. Bins are counted before anything is gathered.

    With ``few_groups`` (one key, at most 10,000 values, checked) the statistics are read as a one-row map and no row
    of ``df`` is moved to meet them, however unevenly the rows lie on the groups.
    """
    stats = df.groupBy(*keys).agg(
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"),
        F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.floor((F.col(x) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    )
    known = df.filter(F.col(x).isNotNull())
    named = ("lo", "hi", "n", "mu", "sd")
    counted = (
        (with_period_columns(known.select(*keys, x), stats, keys[0], named) if few_groups else known.join(stats, list(keys)))
        .withColumn("bin", slot.cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.count("*").alias("count"), *[F.max(c).alias(c) for c in named])
    )
    centre = F.col("lo") + (F.col("bin") + 0.5) * width
    z = F.try_divide(centre - F.col("mu"), F.col("sd"))
    return counted.select(
        *keys, "bin", "count", centre.alias("centre"),
        F.try_divide(F.col("count").cast("double"), F.col("n") * width).alias("density"),
        F.try_divide(F.exp(-0.5 * z * z), F.col("sd") * F.sqrt(2 * F.pi())).alias("normal_density"),
    )


def forecast_outlook(forecasts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First forecast against the last actual, and growth from first to last forecast, in percent."""
    d = forecasts.groupBy(*keys).agg(
        F.max_by("actual", order).alias("last_actual"),
        F.min_by("pred", order).alias("first_pred"),
        F.max_by("pred", order).alias("last_pred"),
        F.count("*").alias("n_periods"),
    )
    return d.withColumn("vs_actual_pct", (ratio(F.col("first_pred"), F.col("last_actual")) - 1) * 100).withColumn(
        "forecast_growth_pct", (ratio(F.col("last_pred"), F.col("first_pred")) - 1) * 100
    )


def holdout_worst_ape(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    e = F.abs(F.try_divide(F.col("pred") - F.col("actual"), F.col("actual"))) * 100
    return forecasts.groupBy(*keys).agg(F.max(e).alias("worst_ape_pct"))


def mape_tiers(board: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Models of each group in the tiers below 3, 3 to 6, and 6 or more percent."""
    tier = F.when(F.col("mape") < 3, "excellent").when(F.col("mape") < 6, "good").otherwise("fair")
    names = F.array_sort(F.collect_list("model"))  # one entry per model of a series
    return (
        board.filter(F.col("mape").isNotNull()).withColumn("tier", tier)
        .groupBy(*keys, "tier")
        .agg(F.count("*").alias("n_models"), F.array_join(names, ", ").alias("models"))
    )


def cv_health(mape: str):
    c = F.col(mape)
    return F.when(c.isNull(), "N/A").when(c < 2, "Excellent").when(c < 5, "Good").when(c < 10, "Fair").otherwise("Poor")
