"""Series features: positional lags, rolling statistics, differences, exogenous handling, splits.

Lags here are positional (previous row of the series); calendar-exact lags live in ``leads``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numeric import finite, ratio


def series_window(series: str, order: str) -> WindowSpec:
    return W.partitionBy(series).orderBy(order)


def positional_lags(df: DataFrame, series: str, order: str, y: str, lags: Iterable[int]) -> DataFrame:
    w = series_window(series, order)
    return df.select("*", *[F.lag(y, k).over(w).alias(f"{y}_t{k}") for k in lags])


def growth_pct(df: DataFrame, series: str, order: str, y: str, lag: int = 4, out: str = "yoy_growth") -> DataFrame:
    """Percent change over ``lag`` rows; an existing column of that name is kept."""
    if out in df.columns:
        return df
    before = F.lag(y, lag).over(series_window(series, order))
    return df.withColumn(out, ratio(F.col(y) - before, before) * 100)


def full_window(agg: Column, y: str, w: WindowSpec, size: int) -> Column:
    """A rolling aggregate that is NULL until the window holds ``size`` values."""
    frame = w.rowsBetween(-(size - 1), 0)
    return F.when(F.count(y).over(frame) == size, agg.over(frame))


def rolling_mean(df: DataFrame, series: str, order: str, y: str, sizes: Iterable[int] = (4,)) -> DataFrame:
    w = series_window(series, order)
    return df.select("*", *[full_window(F.avg(y), y, w, s).alias(f"{y}_mean_{s}") for s in sizes])


def rolling_volatility(df: DataFrame, series: str, order: str, y: str, size: int = 4) -> DataFrame:
    w = series_window(series, order)
    return df.withColumn(f"{y}_vol_{size}", full_window(F.stddev_samp(y), y, w, size))


def interaction(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return df.withColumn(out, finite(F.col(a) * F.col(b)))


def quarter_dummies(df: DataFrame, ds: str) -> DataFrame:
    missing = [k for k in range(1, 5) if f"q{k}" not in df.columns]
    return df.select("*", *[(F.quarter(ds) == k).cast("int").alias(f"q{k}") for k in missing])


def log_diff_features(
    df: DataFrame, series: str, order: str, y: str, lags: int = 8, means: Sequence[int] = (4, 8)
) -> DataFrame:
    """Change of log level, its lags, and trailing means of the first lag."""
    w = series_window(series, order)
    d = df.withColumn("dlog", F.ln(y) - F.ln(F.lag(y).over(w)))
    d = d.select("*", *[F.lag("dlog", k).over(w).alias(f"dlog_l{k}") for k in range(1, lags + 1)])
    return d.select("*", *[full_window(F.avg("dlog_l1"), "dlog_l1", w, s).alias(f"dlog_mean_{s}") for s in means])


def lagged_exog(
    df: DataFrame, series: str, order: str, cols: Sequence[str], horizon: int, known_at: str = "known_at"
) -> DataFrame:
    """Exogenous columns shifted by the full horizon, with the date each value was known."""
    w = series_window(series, order)
    return df.select(
        *[c for c in df.columns if c not in cols],
        *[F.lag(c, horizon).over(w).alias(c) for c in cols],
        F.lag("ds", horizon).over(w).alias(known_at),
    )


def fill_exog(df: DataFrame, series: str, order: str, cols: Sequence[str], is_train: str) -> DataFrame:
    """Train rows: forward, backward, mean, zero. Test rows: forward inside the test part, then the mean
    of the filled train rows, then zero. Nothing flows from test to train."""
    part = W.partitionBy(series, is_train).orderBy(order)
    past = part.rowsBetween(W.unboundedPreceding, 0)
    future = part.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(series)
    train = F.col(is_train)
    out = df.select(
        *[c for c in df.columns if c not in cols],
        *[
            F.coalesce(
                F.last(c, ignorenulls=True).over(past),
                F.when(train, F.first(c, ignorenulls=True).over(future)),
            ).alias(c)
            for c in cols
        ],
    )
    return out.select(
        *[c for c in out.columns if c not in cols],
        *[
            F.coalesce(F.col(c), F.avg(F.when(train, F.col(c))).over(whole), F.lit(0.0)).alias(c) for c in cols
        ],
    )


def scale_by_train(df: DataFrame, series: str, cols: Sequence[str], is_train: Column) -> DataFrame:
    """Standardise with the mean and population deviation of the train rows; zero deviation counts as 1."""
    whole = W.partitionBy(series)

    def scaled(c: str) -> Column:
        x = F.when(is_train, F.col(c))
        sd = F.stddev_pop(x).over(whole)
        return ((F.col(c) - F.avg(x).over(whole)) / F.when(sd == 0, 1.0).otherwise(sd)).alias(c)

    return df.select(*[c for c in df.columns if c not in cols], *[scaled(c) for c in cols])


def scale_complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Whole-table standardisation fitted on rows without nulls, applied to those rows only."""
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    # One row of moments, read as a scalar subquery: nothing is joined.
    moments = F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols])
    stats = df.filter(complete).select(moments.alias("__s")).scalar()
    joined = df.withColumn("__s", stats)

    def scaled(c: str) -> Column:
        sd = F.when(F.col(f"__s.{c}.s") == 0, 1.0).otherwise(F.col(f"__s.{c}.s"))
        return F.when(complete, (F.col(c) - F.col(f"__s.{c}.m")) / sd).otherwise(F.col(c)).alias(c)

    return joined.select(*[c for c in df.columns if c not in cols], *[scaled(c) for c in cols])


def chronological_split(df: DataFrame, series: str, order: str, fraction: float = 0.8) -> DataFrame:
    """Number the rows and mark the first ``floor(n * fraction)`` of each series as train."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie strictly between 0 and 1")
    pos = F.row_number().over(series_window(series, order))
    n = F.count("*").over(W.partitionBy(series))
    return (
        df.withColumn("pos", pos)
        .withColumn("n_train", F.floor(n * F.lit(fraction)).cast("int"))
        .withColumn("is_train", F.col("pos") <= F.col("n_train"))
    )


def seasonal_decompose(df: DataFrame, series: str, order: str, y: str, phase: Column) -> DataFrame:
    """Additive decomposition with a centred 2x4 moving average."""
    w = series_window(series, order)
    around = [F.lag(y, 2), F.lag(y, 1), F.col(y), F.lead(y, 1), F.lead(y, 2)]
    weights = (0.125, 0.25, 0.25, 0.25, 0.125)
    terms = [wt * (c if i == 2 else c.over(w)) for i, (wt, c) in enumerate(zip(weights, around))]
    trend = terms[0] + terms[1] + terms[2] + terms[3] + terms[4]
    d = df.withColumn("trend", trend).withColumn("__phase", phase)
    by_phase = F.avg(F.col(y) - F.col("trend")).over(W.partitionBy(series, "__phase"))
    d = d.withColumn("__raw", by_phase)
    # The centre is the mean of the phase means, each phase counted once.
    first = F.row_number().over(W.partitionBy(series, "__phase").orderBy(order)) == 1
    d = d.withColumn("__once", F.when(first, F.col("__raw")))
    centre = F.avg("__once").over(W.partitionBy(series))
    return (
        d.withColumn("seasonal", F.col("__raw") - centre)
        .withColumn("resid", F.col(y) - F.col("trend") - F.col("seasonal"))
        .drop("__phase", "__raw", "__once")
    )


def quadratic_trend(df: DataFrame, series: str, order: str, y: str) -> DataFrame:
    """Least-squares parabola on the centred row position, from running sums (no matrix code)."""
    n = F.count("*").over(W.partitionBy(series))
    x = F.row_number().over(series_window(series, order)) - (n + 1) / 2
    d = df.withColumn("x", x.cast("double"))
    sums = d.groupBy(series).agg(
        F.count("*").cast("double").alias("n"),
        F.sum(F.pow("x", F.lit(2.0))).alias("x2"),
        F.sum(F.pow("x", F.lit(4.0))).alias("x4"),
        F.sum(y).alias("sy"),
        F.sum(F.col("x") * F.col(y)).alias("sxy"),
        F.sum(F.col("x") * F.col("x") * F.col(y)).alias("sx2y"),
    )
    det = F.col("n") * F.col("x4") - F.col("x2") * F.col("x2")
    coef = sums.select(
        series,
        F.try_divide(F.col("x4") * F.col("sy") - F.col("x2") * F.col("sx2y"), det).alias("c0"),
        F.try_divide(F.col("sxy"), F.col("x2")).alias("c1"),
        F.try_divide(F.col("n") * F.col("sx2y") - F.col("x2") * F.col("sy"), det).alias("c2"),
    )
    return (
        d.join(coef, series)
        .withColumn("trend", F.col("c0") + F.col("c1") * F.col("x") + F.col("c2") * F.col("x") * F.col("x"))
        .drop("x", "c0", "c1", "c2")
    )

