"""Tests that need small linear algebra, run as vectorised functions over arrays of series.

A series is first folded into one ordered array (bounded by the calendar); Spark then hands batches
of arrays to numpy, where all series of equal length are one matrix: no step is taken per series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.distributions import chi2_tail


def series_arrays(df: DataFrame, keys: Sequence[str], order: str, x: str, out: str = "values") -> DataFrame:
    """One row per key with the values in order; missing values are left out."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("v"))))
    return (
        df.filter(F.col(x).isNotNull())
        .groupBy(*keys)
        .agg(ordered.alias("__s"))
        .select(*keys, F.transform("__s", lambda s: s["v"]).alias(out))
    )


def _by_length(series: pd.Series, test: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """One row of ``width`` results per series; ``test`` sees all series of one length as a matrix (series, time)."""
    out = np.full((len(series), width), np.nan)
    lengths = series.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[at] = test(np.stack(series.iloc[at].to_list()).astype(float))
    return out


def _least_squares(design: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residual sums and the pseudo-inverse for a stack of regressions (series, time, column)."""
    inverse = np.linalg.pinv(design, rcond=np.finfo(float).eps * max(design.shape[1:]))
    beta = np.einsum("skt,st->sk", inverse, target)
    rest = target - np.einsum("stk,sk->st", design, beta)
    return beta, (rest**2).sum(axis=1), inverse


def _lagged(x: np.ndarray, lags: int) -> list[np.ndarray]:
    """The lags 1 to ``lags`` of each row, beside its values from place ``lags`` on."""
    return [x[:, lags - k : x.shape[1] - k] for k in range(1, lags + 1)]


def _arch_rows(values: np.ndarray, lags: int) -> np.ndarray:
    sq = values**2
    n = sq.shape[1] - lags
    if sq.shape[1] <= 2 * lags:
        return np.full((len(values), 1), np.nan)
    target = sq[:, lags:]
    total = ((target - target.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    _, sse, _ = _least_squares(np.stack([np.ones_like(target), *_lagged(sq, lags)], axis=2), target)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, n * (1 - sse / total), np.nan)[:, None]


def arch_lm(arrays: DataFrame, lags: int = 4) -> DataFrame:
    """Lagrange-multiplier test for autoregressive variance; NULL when the series is too short."""

    @F.pandas_udf("double")
    def stat(values: pd.Series) -> pd.Series:
        return pd.Series(_by_length(values, lambda x: _arch_rows(x, lags), 1)[:, 0])

    lm = stat("values")
    return (
        arrays.withColumn("__s", lm)
        .withColumn("arch_stat", F.when(~F.isnan("__s"), F.col("__s")))
        .withColumn("arch_p", chi2_tail(F.col("arch_stat"), lags))
        .withColumn("no_arch", F.col("arch_p") > 0.05)
        .drop("__s")
    )


# Polynomial coefficients of the published W approximation (Royston, 1995).
W_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
W_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
MU_SMALL = (0.5440, -0.39978, 0.025054, -0.0006714)
SIGMA_SMALL = (1.3822, -0.77857, 0.062767, -0.0020322)
MU_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915)
SIGMA_LARGE = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients: Sequence[float], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


@lru_cache(maxsize=4096)
def _shapiro_weights(n: int) -> np.ndarray:
    """Weights of the ordered values; they depend on the length alone."""
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssm = float(m @ m)
    u = n**-0.5
    weights = m / np.sqrt(ssm)
    last = weights[-1] + _poly(W_LAST, u)
    if n > 5:
        next_ = weights[-2] + _poly(W_NEXT, u)
        phi = (ssm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2)
        a = m / np.sqrt(phi)
        a[[0, 1, -2, -1]] = -last, -next_, next_, last
    else:
        phi = (ssm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a = m / np.sqrt(phi)
        a[[0, -1]] = -last, last
    return a


def _shapiro_rows(values: np.ndarray) -> np.ndarray:
    """W and its p value; none for fewer than four values or equal ones."""
    n, x = values.shape[1], np.sort(values, axis=1)
    if n < 4:
        return np.full((len(x), 2), np.nan)
    spread = ((x - x.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(spread > 0, np.minimum(1.0, (x @ _shapiro_weights(n)) ** 2 / spread), np.nan)
        if n <= 11:
            gap = -2.273 + 0.459 * n - np.log(1 - w)
            z = np.where(gap > 0, (-np.log(gap) - _poly(MU_SMALL, n)) / np.exp(_poly(SIGMA_SMALL, n)), np.inf)
        else:
            z = (np.log(1 - w) - _poly(MU_LARGE, np.log(n))) / np.exp(_poly(SIGMA_LARGE, np.log(n)))
    p = 0.5 * np.vectorize(math.erfc, otypes=[float])(z / math.sqrt(2))
    return np.column_stack([w, np.where(w >= 1, 1.0, np.where(np.isnan(w), np.nan, p))])


def shapiro_wilk(arrays: DataFrame) -> DataFrame:
    @F.pandas_udf("w double, p double")
    def test(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_by_length(values, _shapiro_rows, 2), columns=["w", "p"])

    return (
        arrays.withColumn("__t", test("values"))
        .withColumn("shapiro_w", F.when(~F.isnan("__t.w"), F.col("__t.w")))
        .withColumn("shapiro_p", F.when(~F.isnan("__t.p"), F.col("__t.p")))
        .withColumn("shapiro_normal", F.col("shapiro_p") > 0.05)
        .drop("__t")
    )


# Response-surface critical values for the constant-only regression (MacKinnon, 2010).
CRITICAL_1 = (-3.43035, -6.5393, -16.786, -79.433)
CRITICAL_5 = (-2.86154, -2.8903, -4.234, -40.040)


def _finite(values: Column) -> Column:
    return F.filter(values, lambda v: F.abs(v) < float("inf"))  # a NaN is beyond every number


def _adf_rows(x: np.ndarray) -> np.ndarray:
    """Statistic, critical values at 1% and 5%, and the number of lags."""
    none = np.full((len(x), 4), np.nan)
    if x.shape[1] < 8:
        return none
    lags = int((x.shape[1] - 1) ** (1 / 3))
    d = np.diff(x, axis=1)
    n = d.shape[1] - lags
    if n <= lags + 3:
        return none
    target = d[:, lags:]
    design = np.stack([np.ones_like(target), x[:, lags:-1], *_lagged(d, lags)], axis=2)
    beta, sse, inverse = _least_squares(design, target)
    spread = (inverse[:, 1] ** 2).sum(axis=1) * sse / (n - design.shape[2])
    with np.errstate(divide="ignore", invalid="ignore"):
        rows = np.column_stack([beta[:, 1] / np.sqrt(spread), np.broadcast_to([_poly(CRITICAL_1, 1 / n), _poly(CRITICAL_5, 1 / n), lags], (len(x), 3))])
    return np.where((spread > 0)[:, None], rows, none)


def adf_screen(arrays: DataFrame) -> DataFrame:
    """Unit-root regression with a fixed lag order; the verdict is taken at the 5% critical value."""

    @F.pandas_udf("stat double, c1 double, c5 double, lags double")
    def test(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_by_length(values, _adf_rows, 4), columns=["stat", "c1", "c5", "lags"])

    def known(c: str):
        return F.when(~F.isnan(f"__t.{c}"), F.col(f"__t.{c}"))

    return (
        arrays.withColumn("__t", test(_finite(F.col("values"))))
        .withColumn("adf_stat", known("stat"))
        .withColumn("critical_1", known("c1"))
        .withColumn("critical_5", known("c5"))
        .withColumn("lags_used", known("lags").cast("int"))
        .withColumn("stationary", F.col("adf_stat") <= F.col("critical_5"))
        .drop("__t")
    )


def select_differencing(arrays: DataFrame, max_d: int = 2) -> DataFrame:
    """Fewest differences of the log series that pass the unit-root screen; ``max_d`` if none does."""

    @F.pandas_udf("int")
    def pick(logs: pd.Series) -> pd.Series:
        def fewest(x: np.ndarray) -> np.ndarray:
            chosen = np.full((len(x), 1), float(max_d))
            for d in reversed(range(max_d + 1)):
                if x.shape[1] > d:
                    rows = _adf_rows(np.diff(x, d, axis=1))
                    chosen[rows[:, 0] <= rows[:, 2]] = d
            return chosen

        return pd.Series(_by_length(logs, fewest, 1)[:, 0].astype("int32"))

    logs = F.transform(F.filter("values", lambda v: v > 0), lambda v: F.ln(v))
    return arrays.withColumn("d", pick(_finite(logs)))


def partial_autocorrelations(arrays: DataFrame, keys: Sequence[str], max_lag: int = 15) -> DataFrame:
    """Yule-Walker partial autocorrelations by the Durbin-Levinson recursion."""

    def coefficients(x: np.ndarray) -> np.ndarray:
        out = np.full((len(x), max_lag), np.nan)
        c = x - x.mean(axis=1, keepdims=True) if x.shape[1] else x
        top, var = min(max_lag, x.shape[1] // 2 - 1), (c**2).sum(axis=1)
        if top < 1:
            return out
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.column_stack([(c[:, k:] * c[:, : x.shape[1] - k]).sum(axis=1) for k in range(top + 1)]) / var[:, None]
            phi = np.zeros((len(x), 0))
            for k in range(1, top + 1):
                bottom = 1 - (phi * r[:, 1:k]).sum(axis=1)
                new = np.where(np.abs(bottom) > 1e-12, (r[:, k] - (phi * r[:, 1:k][:, ::-1]).sum(axis=1)) / bottom, 0.0)
                phi = np.column_stack([phi - new[:, None] * phi[:, ::-1], new])
                out[:, k - 1] = new
        out[var <= 0] = np.nan
        return out

    @F.pandas_udf("array<double>")
    def recursion(values: pd.Series) -> pd.Series:
        found = _by_length(values, coefficients, max_lag)
        known = (~np.isnan(found)).sum(axis=1)
        return pd.Series([row[:n] for row, n in zip(found, known)])

    return arrays.select(*keys, F.posexplode(recursion("values")).alias("pos", "pacf")).select(
        *keys, (F.col("pos") + 1).alias("lag"), "pacf"
    )


@lru_cache(maxsize=4096)
def _quantiles(n: int) -> list[float]:
    return [NormalDist().inv_cdf((i + 0.5) / n) for i in range(n)]


def normal_quantiles(arrays: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ordered values against standard normal quantiles, with the least-squares line per series."""

    @F.pandas_udf("array<double>")
    def theoretical(n: pd.Series) -> pd.Series:
        return n.map(_quantiles)

    # The quantiles depend on the length alone; the order is found in the array.
    points = F.arrays_zip(theoretical(F.size("values")).alias("theoretical"), F.array_sort("values").alias("ordered"))
    pts = arrays.select(*keys, F.posexplode(points).alias("pos", "p")).select(*keys, "pos", "p.*")
    line = pts.groupBy(*keys).agg(
        F.regr_slope("ordered", "theoretical").alias("line_slope"),
        F.regr_intercept("ordered", "theoretical").alias("line_intercept"),
    )
    return pts.join(line, list(keys))
