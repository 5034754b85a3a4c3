"""Anomaly flags, drift tests, forecast confidence and model ensembles, per series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numeric import clip, ratio

DETECTORS = ("iqr", "zscore", "rolling")

# Parts of the confidence score and the labels of score bands.
ERROR_POINTS, ERROR_DECAY, ERROR_UNKNOWN = 40.0, 0.07, 50.0
STABILITY_SHARE, STABILITY_UNKNOWN = 0.30, 50.0
HORIZON_POINTS, HORIZON_DECAY, HORIZON_FLOOR = 20.0, 0.18, 5.0
WIDTH_POINTS, WIDTH_DECAY, WIDTH_UNKNOWN = 10.0, 2.5, 5.0
DRIFT_PENALTY = 15.0
CONFIDENCE_BANDS = ((80, "Very High"), (65, "High"), (45, "Medium"), (25, "Low"), (None, "Very Low"))
EXPORT_BANDS = ((75, "High"), (45, "Medium"), (None, "Low"))
SEVERITIES = ("None", "Mild", "Moderate", "Severe")


def detector_flag(method: str, series: str, order: str, y: str, fence: float = 1.5, z_limit: float = 2.5,
                  window: int = 6, rolling_limit: float = 2.0) -> Column:
    """Boolean column of one detector; the rolling one cannot fire before its third point."""
    whole = W.partitionBy(series)
    x = F.col(y)
    if method == "iqr":
        q1, q3 = F.percentile(y, 0.25).over(whole), F.percentile(y, 0.75).over(whole)
        return (x < q1 - fence * (q3 - q1)) | (x > q3 + fence * (q3 - q1))
    if method == "zscore":
        return F.coalesce(
            F.abs((x - F.avg(y).over(whole)) / (F.stddev_samp(y).over(whole) + 1e-9)) > z_limit, F.lit(False)
        )
    if method == "rolling":
        near = W.partitionBy(series).orderBy(order).rowsBetween(-(window - 1), 0)
        sd = F.stddev_samp(y).over(near)
        z = (x - F.avg(y).over(near)) / F.when(sd == 0, 1e-9).otherwise(sd)
        return F.coalesce((F.count(y).over(near) >= 3) & (F.abs(z) > rolling_limit), F.lit(False))
    raise ValueError(method)


def detect_anomalies(df: DataFrame, series: str, order: str, y: str, methods: Sequence[str] = DETECTORS, **limits) -> DataFrame:
    """Flags per method, votes, the list of methods and whether all agree. Missing values are dropped,
    unknown method names are skipped."""
    known = [m for m in methods if m in DETECTORS]
    flagged = df.filter(F.col(y).isNotNull()).select(
        "*", *[detector_flag(m, series, order, y, **limits).alias(m) for m in known]
    )
    return votes(flagged, known)


def votes(flagged: DataFrame, methods: Sequence[str]) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(F.col(m), m) for m in methods]))
    everyone = F.lit(bool(methods))
    for m in methods:
        everyone = everyone & F.col(m)
    return (
        flagged.withColumn("votes", sum((F.col(m).cast("int") for m in methods), F.lit(0)))
        .withColumn("methods", F.array_join(names, ", "))
        .withColumn("consensus", everyone)
    )


def flagged_periods(report: DataFrame, min_methods: int = 1) -> DataFrame:
    """Rows with enough votes, graded ``High`` from two votes."""
    return report.filter(F.col("votes") >= min_methods).withColumn(
        "severity", F.when(F.col("votes") >= 2, "High").otherwise("Medium")
    )


def anomaly_rates(report: DataFrame, series: str, methods: Sequence[str] = DETECTORS) -> DataFrame:
    return report.groupBy(series).agg(
        *[F.round(F.avg(F.col(m).cast("double")) * 100, 2).alias(f"{m}_rate") for m in methods],
        F.count_if(F.col("consensus")).alias("consensus_periods"),
        F.count("*").alias("n"),
    )


def reference_moments(train_residuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    sd = F.stddev_pop("residual")
    return train_residuals.groupBy(*keys).agg(
        F.avg("residual").alias("ref_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("ref_std")
    )


def cusum_path(live: DataFrame, keys: Sequence[str], order: str, z: str, slack: float = 0.5) -> DataFrame:
    """Two-sided CUSUM from zero; the first value only opens the chart.

    max(0, S + x) unrolled is the running sum minus its own running minimum, so two windows replace
    the recursion.
    """
    w = W.partitionBy(*keys).orderBy(order)
    past = w.rowsBetween(W.unboundedPreceding, 0)
    first = F.row_number().over(w) == 1
    d = live.withColumn("__u", F.when(first, 0.0).otherwise(F.col(z) - slack)).withColumn(
        "__d", F.when(first, 0.0).otherwise(-F.col(z) - slack)
    )
    d = d.withColumn("__cu", F.sum("__u").over(past)).withColumn("__cd", F.sum("__d").over(past))
    return (
        d.withColumn("cusum_pos", F.col("__cu") - F.min("__cu").over(past))
        .withColumn("cusum_neg", F.col("__cd") - F.min("__cd").over(past))
        .drop("__u", "__d", "__cu", "__cd")
    )


def standardised(live: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    return live.join(reference, list(keys)).withColumn("z", (F.col("residual") - F.col("ref_mean")) / F.col("ref_std"))


def cusum(live: DataFrame, reference: DataFrame, keys: Sequence[str], order: str, limit: float = 4.0) -> DataFrame:
    path = cusum_path(standardised(live, reference, keys), keys, order, "z")
    return (
        path.groupBy(*keys)
        .agg(F.greatest(F.max("cusum_pos"), F.max("cusum_neg")).alias("cusum_max"))
        .withColumn("cusum_signal", F.col("cusum_max") > limit)
    )


def residual_shift(live: DataFrame, reference: DataFrame, keys: Sequence[str], limit: float = 3.0) -> DataFrame:
    z = F.abs(F.avg("residual") - F.max("ref_mean")) / F.max("ref_std")
    return (
        live.join(reference, list(keys))
        .groupBy(*keys)
        .agg(z.alias("residual_z"))
        .withColumn("residual_drift", F.col("residual_z") > limit)
    )


def live_with_last_train(split: DataFrame, series: str, order: str) -> DataFrame:
    """Live rows preceded by the last training row, so that the step into the live part counts."""
    last = F.max(F.when(F.col("is_train"), F.col(order))).over(W.partitionBy(series))
    return split.withColumn("__last", last).filter(~F.col("is_train") | (F.col(order) == F.col("__last"))).drop("__last")


def ks_two_sample(values: DataFrame, keys: Sequence[str], x: str, is_live: str, alpha: float = 0.05) -> DataFrame:
    """Largest distance between two empirical distributions, ties counted together, with its exact p-value."""
    w = W.partitionBy(*keys)
    upto = w.orderBy(x).rangeBetween(W.unboundedPreceding, 0)
    live = F.col(is_live)

    def ecdf(cond: Column) -> Column:
        hit = F.when(cond, 1)
        return F.try_divide(F.count(hit).over(upto).cast("double"), F.count(hit).over(w).cast("double"))

    d = values.withColumn("__gap", F.abs(ecdf(~live) - ecdf(live)))
    measured = d.groupBy(*keys).agg(
        F.max("__gap").alias("ks_statistic"),
        F.count_if(~live).alias("n_train"),
        F.count_if(live).alias("n_live"),
    )
    return ks_exact_p(measured, out="ks_p_value").withColumn("ks_drift", F.coalesce(F.col("ks_p_value") < alpha, F.lit(False)))


def ks_exact_p(df: DataFrame, statistic: str = "ks_statistic", n1: str = "n_train", n2: str = "n_live", out: str = "ks_p_exact") -> DataFrame:
    """Exact two-sided p-value by counting lattice paths; null where a sample is empty.

    A distance is a whole number of steps of 1 / (n1 n2), and series of one calendar share their sizes. So each
    distinct (n1, n2, steps) is counted once, all of a batch side by side, and joined back.
    """

    @F.pandas_udf("double")
    def p(m: pd.Series, n: pd.Series, steps: pd.Series) -> pd.Series:
        m, n, steps = (c.to_numpy("int64") for c in (m, n, steps))
        # Share of the paths to (i, j) that stay strictly below the distance, for every triple at once.
        row = np.zeros((int(n.max()) + 1, len(m)))
        result = np.zeros(len(m))
        for i in range(int(m.max()) + 1):
            for j in range(len(row)):
                if i == j == 0:
                    row[0] = 1.0
                    continue
                left = row[j - 1] * j / (i + j) if j else 0.0
                row[j] = np.where(np.abs(i * n - j * m) >= steps, 0.0, (row[j] * i / (i + j) if i else 0.0) + left)
            ends = m == i
            result[ends] = row[n[ends], np.flatnonzero(ends)]
        return pd.Series(np.where(steps <= 0, 1.0, np.clip(1.0 - result, 0.0, 1.0)))

    steps = F.round(F.col(statistic) * F.col(n1) * F.col(n2)).cast("long")
    keyed = df.withColumn("__k", F.when((F.col(n1) > 0) & (F.col(n2) > 0) & ~F.isnan(statistic), steps))
    triples = keyed.filter("__k is not null").select(F.col(n1).alias("__m"), F.col(n2).alias("__n"), F.col("__k").alias("__s")).distinct()
    counted = triples.withColumn(out, p("__m", "__n", "__s"))
    match = (F.col(n1) == F.col("__m")) & (F.col(n2) == F.col("__n")) & (F.col("__k") == F.col("__s"))
    return keyed.join(counted, match, "left").drop("__k", "__m", "__n", "__s")


def log_growth(split: DataFrame, series: str, order: str, y: str) -> DataFrame:
    """Log change of each row, labelled by the part it belongs to; the first live row steps from the last
    training row."""
    w = W.partitionBy(series).orderBy(order)
    return split.withColumn("growth", F.ln(y) - F.ln(F.lag(y).over(w))).filter(F.col("growth").isNotNull())


def severity(alerts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in SEVERITIES]), (alerts + 1).cast("int"))


def banded(score: Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the highest band the score reaches; the last band takes the rest, NULL stays NULL."""
    label = F.lit(bands[-1][1])
    for floor, name in reversed(bands[:-1]):
        label = F.when(score >= floor, name).otherwise(label)
    return F.when(score.isNotNull(), label)


def drift_report(
    ks: DataFrame, cusum_table: DataFrame, shift: DataFrame, keys: Sequence[str]
) -> DataFrame:
    joined = ks.join(cusum_table, list(keys)).join(shift, list(keys))
    alerts = sum(
        (F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("ks_drift", "cusum_signal", "residual_drift")),
        F.lit(0),
    )
    return (
        joined.withColumn("alerts", alerts)
        .withColumn("overall_drift", F.col("alerts") > 0)
        .withColumn("severity", severity(F.col("alerts")))
        .withColumn("model_health_score", health_of(F.col("alerts")))
    )


def health_of(alerts: Column) -> Column:
    return F.round(100.0 - 25.0 * alerts, 1)


def drift_payload(series_list: DataFrame, report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status fields per series, with safe values where no report exists."""
    return series_list.join(report, list(keys), "left").select(
        *keys,
        F.coalesce("overall_drift", F.lit(False)).alias("drift_detected"),
        F.coalesce("severity", F.lit("Unavailable")).alias("drift_type"),
        F.col("ks_statistic").alias("test_statistic"),
        F.coalesce("cusum_signal", F.lit(False)).alias("cusum_signal"),
        F.coalesce("residual_drift", F.lit(False)).alias("residual_drift"),
        "model_health_score",
    )


def confidence_label(score: Column) -> Column:
    return banded(score, CONFIDENCE_BANDS)


def confidence_scores(forecasts: DataFrame, quality: DataFrame, keys: Sequence[str], penalty: float = DRIFT_PENALTY) -> DataFrame:
    """Score each forecast step 0-100 from model error, stability, horizon and interval width.

    ``forecasts`` has step, pred, lower, upper; ``quality`` has mape, stability and drift_detected.
    """
    joined = forecasts.join(quality, list(keys))
    lo = F.coalesce(F.col("lower"), F.col("pred") * 0.9)
    hi = F.coalesce(F.col("upper"), F.col("pred") * 1.1)
    mape = F.greatest(F.coalesce("mape", F.lit(ERROR_UNKNOWN)), F.lit(0.0))
    error = clip(ERROR_POINTS * F.exp(-ERROR_DECAY * mape), 0, ERROR_POINTS)
    steady = F.coalesce("stability", F.lit(STABILITY_UNKNOWN)) * STABILITY_SHARE
    near = clip(HORIZON_POINTS * F.exp(-HORIZON_DECAY * (F.col("step") - 1)), HORIZON_FLOOR, HORIZON_POINTS)
    width = F.try_divide(hi - lo, F.abs("pred"))
    narrow = F.when(F.col("pred") <= 0, WIDTH_UNKNOWN).otherwise(
        clip(WIDTH_POINTS * F.exp(-WIDTH_DECAY * width), 0, WIDTH_POINTS)
    )
    scored = (
        joined.withColumn("mape_score", F.round(error, 2))
        .withColumn("stability_score", F.round(steady + 1e-9, 2))  # half up whatever the binary form
        .withColumn("horizon_score", F.round(near, 2))
        .withColumn("ci_score", F.round(narrow, 2))
        .withColumn("drift_penalty", F.when(F.col("drift_detected"), float(penalty)).otherwise(0.0))
    )
    total = clip(
        F.col("mape_score") + F.col("stability_score") + F.col("horizon_score") + F.col("ci_score")
        - F.col("drift_penalty"), 0, 100,
    )
    return (
        scored.withColumn("__total", F.round(total, 6))
        .withColumn("confidence_score", F.round("__total", 1))
        .withColumn("confidence_label", confidence_label(F.col("__total")))
        .select(*keys, "step", "mape_score", "stability_score", "horizon_score", "ci_score", "drift_penalty",
                "confidence_score", "confidence_label")
    )


def confidence_summary(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.avg("confidence_score").alias("confidence_mean"),
        F.min("confidence_score").alias("confidence_min"),
        F.max("confidence_score").alias("confidence_max"),
    )


def ensemble_weights(quality: DataFrame, series: str, strategy: str = "inverse_mape", top_k: int | None = None) -> DataFrame:
    """Normalised weights over the best ``top_k`` models of each series by error.

    ``quality`` should come from an origin earlier than the one being forecast.
    """
    w = W.partitionBy(series).orderBy(F.asc_nulls_last("mape"), "model")
    best = quality.withColumn("mape_rank", F.row_number().over(w))
    if top_k:
        best = best.filter(F.col("mape_rank") <= top_k)
    raw = {
        "inverse_mape": 1 / F.greatest(F.coalesce("mape", F.lit(9999.0)), F.lit(0.01)),
        "inverse_rmse": 1 / F.greatest(F.coalesce("rmse_pct", F.lit(9999.0)), F.lit(0.01)),
        "rank": 1 / F.col("mape_rank").cast("double"),
        "equal": F.lit(1.0),
    }[strategy]
    return best.withColumn("__raw", raw).select(
        series, "model", "mape_rank",
        F.round(F.col("__raw") / F.sum("__raw").over(W.partitionBy(series)), 4).alias("weight"),
    )


def ensemble_forecast(forecasts: DataFrame, weights: DataFrame, series: str, order: str) -> DataFrame:
    """Weighted mean of the kept models with a band from their spread."""
    joined = forecasts.join(weights, [series, "model"])
    return (
        joined.groupBy(series, order)
        .agg(
            F.max("actual").alias("actual"),
            F.sum(F.col("pred") * F.col("weight")).alias("pred"),
            F.stddev_pop("pred").alias("__sd"),
        )
        .withColumn("lower", F.col("pred") - 1.96 * F.col("__sd"))
        .withColumn("upper", F.col("pred") + 1.96 * F.col("__sd"))
        .drop("__sd")
    )


def dashboard_confidence(score: Column) -> Column:
    """The coarser three-way label used on exported pages."""
    return banded(score, EXPORT_BANDS)


def risk_status(score: Column, drift: Column) -> Column:
    return (
        F.when(F.coalesce(drift, F.lit(False)), "Elevated")
        .when(score.isNull(), "Unknown")
        .when(score >= 70, "Stable")
        .when(score >= 45, "Watch")
        .otherwise("Elevated")
    )


def model_badges(rank: Column, stability: Column, mape: Column, fit_seconds: Column | None = None) -> Column:
    fast = F.lit(False) if fit_seconds is None else fit_seconds <= 0.5
    badges = F.array_compact(
        F.array(
            F.when(rank == 1, "Production Candidate"),
            F.when(rank == 1, "Best Accuracy"),
            F.when(stability >= 75, "Most Stable"),
            F.when(fast, "Fastest"),
            F.when(mape >= 5, "Risky"),
        )
    )
    return F.array_join(badges, ", ")


def kpi_snapshot(levels: DataFrame, ensemble: DataFrame, board: DataFrame, confidence: DataFrame,
                 drift: DataFrame, series: str, order: str, forecasts: DataFrame | None = None) -> DataFrame:
    """One status row per series: latest level, last forecast, growth, best model, confidence and risk.

    Where a series has no ensemble forecast, ``forecasts`` (series, model, order, pred) stands in: that of the best
    model, else of the first model by name that has one.
    """
    latest = levels.groupBy(series).agg(F.max_by("y", order).alias("current_level"), F.max("ds").alias("latest_ds"))
    ahead = ensemble.groupBy(series).agg(F.max_by("pred", order).alias("forecast_value"))
    best = board.filter("recommended").select(series, F.col("model").alias("best_model"), F.col("mape").alias("best_mape"))
    conf = confidence.groupBy(series, "model").agg(F.max_by("confidence_score", "step").alias("confidence_score"))
    joined = (
        latest.join(ahead, series, "left").join(best, series, "left")
        .join(conf.withColumnRenamed("model", "best_model"), [series, "best_model"], "left")
        .join(drift.select(series, F.col("model").alias("best_model"), "drift_detected"), [series, "best_model"], "left")
    )
    if forecasts is not None:
        last = forecasts.filter(F.col("pred").isNotNull()).groupBy(series, F.col("model").alias("__model")).agg(F.max_by("pred", order).alias("__pred"))
        known = best.select(series, F.col("best_model").alias("__best"))
        instead = F.min_by("__pred", F.struct(F.coalesce(F.col("__model") != F.col("__best"), F.lit(True)), F.col("__model")))
        stand_in = last.join(known, series, "left").groupBy(series).agg(instead.alias("__instead"))
        joined = joined.join(stand_in, series, "left").withColumn("forecast_value", F.coalesce("forecast_value", "__instead")).drop("__instead")
    return (
        joined.withColumn("growth_pct", F.round((ratio(F.col("forecast_value"), F.col("current_level")) - 1) * 100, 2))
        .withColumn("risk", risk_status(F.col("confidence_score"), F.col("drift_detected")))
    )
