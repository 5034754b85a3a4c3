"""Forecast comparison and residual tests as grouped expressions. Groups are single series, so their
size is bounded by the calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.distributions import chi2_tail, student_two_sided


def diebold_mariano(df: DataFrame, keys: Sequence[str], order: str, e1: str, e2: str, h: int = 1) -> DataFrame:
    """Test of equal squared error with the small-sample factor; negative means ``e1`` is smaller.

    A non-positive variance gives (0, 1) when the mean difference is zero and NULL otherwise.
    """
    whole, w = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(order)
    d = df.withColumn("__d", F.col(e1) * F.col(e1) - F.col(e2) * F.col(e2))
    d = d.withColumn("__c", F.col("__d") - F.avg("__d").over(whole))
    d = d.select("*", *[F.lag("__c", k).over(w).alias(f"__c{k}") for k in range(1, h)])
    sums = d.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("__d").alias("d_mean"),
        F.sum(F.col("__c") * F.col("__c")).alias("g0"),
        *[F.coalesce(F.sum(F.col("__c") * F.col(f"__c{k}")), F.lit(0.0)).alias(f"g{k}") for k in range(1, h)],
    )
    n = F.col("n")
    gamma = F.col("g0") / n
    for k in range(1, h):
        gamma = gamma + 2 * F.col(f"g{k}") / n
    var = gamma / n
    shrink = F.sqrt(F.greatest(F.lit(0.0), (n + 1 - 2 * h + h * (h - 1) / n) / n))
    stat = F.when(var > 0, F.col("d_mean") / F.sqrt(F.when(var > 0, var)) * shrink).when(F.col("d_mean") == 0, 0.0)
    return sums.withColumn("dm_stat", stat).select(
        *keys, "n", "dm_stat",
        F.when(var > 0, student_two_sided(F.col("dm_stat"), n - 1)).when(F.col("d_mean") == 0, 1.0).alias("p_value"),
    )


def dm_table(forecasts: DataFrame, series: str, order: str, baseline: str = "SeasonalNaive") -> DataFrame:
    """Every model of a series against its baseline."""
    err = F.col("actual") - F.col("pred")
    at = W.partitionBy(series, order)
    paired = (
        forecasts.withColumn("e_model", err)
        .withColumn("e_base", F.max(F.when(F.col("model") == baseline, err)).over(at))
        .filter((F.col("model") != baseline) & F.col("e_base").isNotNull())
    )
    return (
        diebold_mariano(paired, [series, "model"], order, "e_model", "e_base")
        .withColumn("significant_5pct", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
    )


def jarque_bera(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    stat = F.col("n") / 6 * (F.pow("skew", F.lit(2.0)) + F.pow("kurt", F.lit(2.0)) / 4)
    return (
        df.groupBy(*keys)
        .agg(F.count(x).alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))
        .withColumn("jb", stat)
        .withColumn("p_value", F.exp(-F.col("jb") / 2))
        .withColumn("normal", F.col("p_value") > 0.05)
    )


def autocorrelations(df: DataFrame, keys: Sequence[str], order: str, x: str, max_lag: int = 15) -> DataFrame:
    """One row per lag 1..min(max_lag, n/2 - 1) with the autocorrelation and its 95% band.

    The lagged products are window columns, so no pair of rows is ever materialised.
    """
    whole, w = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(order)
    c = df.withColumn("__c", F.col(x) - F.avg(x).over(whole))
    c = c.select(*keys, "__c", *[F.lag("__c", k).over(w).alias(f"__l{k}") for k in range(1, max_lag + 1)])
    sums = c.groupBy(*keys).agg(
        F.count("__c").alias("n"),
        F.sum(F.col("__c") * F.col("__c")).alias("__c0"),
        *[F.sum(F.col("__c") * F.col(f"__l{k}")).alias(f"__s{k}") for k in range(1, max_lag + 1)],
    )
    lags = F.array(
        *[
            F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"__s{k}"), F.col("__c0")).alias("acf"))
            for k in range(1, max_lag + 1)
        ]
    )
    return (
        sums.select(*keys, "n", F.explode(lags).alias("r"))
        .filter(F.col("r.lag") <= F.floor(F.col("n") / 2) - 1)
        .select(*keys, "n", "r.lag", "r.acf", (1.96 / F.sqrt(F.col("n").cast("double"))).alias("band"))
    )


def ljung_box(df: DataFrame, keys: Sequence[str], order: str, x: str, lags: int = 10) -> DataFrame:
    """Portmanteau test on the first ``lags`` autocorrelations of groups with more rows than lags."""
    whole, w = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(order)
    c = df.withColumn("__c", F.col(x) - F.avg(x).over(whole))
    c = c.select(*keys, "__c", *[F.lag("__c", k).over(w).alias(f"__l{k}") for k in range(1, lags + 1)])
    sums = c.groupBy(*keys).agg(
        F.count("__c").alias("n"),
        F.sum(F.col("__c") * F.col("__c")).alias("__c0"),
        *[F.sum(F.col("__c") * F.col(f"__l{k}")).alias(f"__s{k}") for k in range(1, lags + 1)],
    ).filter(F.col("n") > lags)
    n = F.col("n")
    q = F.lit(0.0)
    for k in range(1, lags + 1):
        r = F.try_divide(F.col(f"__s{k}"), F.col("__c0"))
        q = q + r * r / (n - k)
    return (
        sums.withColumn("q_stat", n * (n + 2) * q)
        .select(*keys, "n", "q_stat", chi2_tail(F.col("q_stat"), lags).alias("p_value"))
        .withColumn("no_autocorrelation", F.col("p_value") > 0.05)
    )


def residual_stats(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.skewness(x).alias("skewness"),
        F.kurtosis(x).alias("kurtosis"),
        F.percentile(x, 0.25).alias("q25"),
        F.percentile(x, 0.75).alias("q75"),
    )


def health(passed: Sequence[Column]) -> tuple[Column, Column]:
    """Percent of the available tests passed and its label; a NULL flag is a test that did not run."""
    ran = sum((p.isNotNull().cast("int") for p in passed), F.lit(0))
    ok = sum((F.coalesce(p, F.lit(False)).cast("int") for p in passed), F.lit(0))
    score = F.round(F.coalesce(F.try_divide(ok * 100.0, ran.cast("double")), F.lit(0.0)), 1)
    label = (
        F.when(score >= 75, "Excellent").when(score >= 50, "Good").when(score >= 25, "Fair").otherwise("Poor")
    )
    return score, label
