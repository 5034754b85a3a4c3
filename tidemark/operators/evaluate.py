"""Error metrics, scores and leaderboards, grouped by any key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numeric import clip, ratio
from tidemark.functions.ranking import exact_quantiles
from tidemark.session import settle

# Weight of each metric in the composite score.
COMPOSITE_WEIGHTS = {"mape": 0.35, "rmse_pct": 0.25, "mae_pct": 0.20, "stability": 0.20}


def _actual() -> Column:
    return F.col("actual")


def _pred() -> Column:
    return F.col("pred")


def _error() -> Column:
    return F.col("actual") - F.col("pred")


def mape() -> Column:
    return F.avg(F.abs(F.try_divide(_error(), _actual()))) * 100


def smape() -> Column:
    half = (F.abs(_actual()) + F.abs(_pred())) / 2
    return F.avg(F.try_divide(F.abs(_error()), half)) * 100


def bias() -> Column:
    return F.avg(-_error())


def stability(residual: Column) -> Column:
    return clip(100 - 50 * F.stddev_pop(residual) / (F.avg(F.abs(residual)) + 1e-9), 0, 100)


def r2() -> Column:
    sse, sst = F.sum(_error() * _error()), F.var_pop("actual") * F.count("actual")
    return F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(sse, sst))


def adjusted(r2_value: Column, n: Column, n_features: int) -> Column:
    return F.when(n > n_features + 1, 1 - (1 - r2_value) * (n - 1) / (n - n_features - 1))


def with_steps(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Previous actual and prediction inside each group."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("actual_1", F.lag("actual").over(w)).withColumn("pred_1", F.lag("pred").over(w))


def theil_u() -> Column:
    later = F.col("actual_1").isNotNull()
    top = F.sqrt(F.avg(F.when(later, _error() * _error())))
    step = _actual() - F.col("actual_1")
    bottom = F.sqrt(F.avg(step * step))
    return F.when(F.count("*") > 2, F.try_divide(top, bottom))


def direction_accuracy() -> Column:
    da, dp = _actual() - F.col("actual_1"), _pred() - F.col("pred_1")
    return F.avg(F.when((da != 0) & (dp != 0), (F.signum(da) == F.signum(dp)).cast("double"))) * 100


def full_metrics(df: DataFrame, keys: Sequence[str], order: str, n_features: int = 1) -> DataFrame:
    """All error metrics of each group in one row, from one window pass and one aggregation."""
    level = F.avg("actual")
    safe = F.when(level == 0, 1.0).otherwise(level)
    mae, mse = F.avg(F.abs(_error())), F.avg(_error() * _error())
    wide = with_steps(df, keys, order).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(mae, 4).alias("mae"),
        F.round(F.sqrt(mse), 4).alias("rmse"),
        F.round(mse, 4).alias("mse"),
        F.round(mae / safe * 100, 3).alias("mae_pct"),
        F.round(F.sqrt(mse) / safe * 100, 3).alias("rmse_pct"),
        F.round(mse / (safe * safe) * 100, 4).alias("mse_pct"),
        F.round(mape(), 3).alias("mape"),
        F.round(smape(), 3).alias("smape"),
        r2().alias("__r2"),
        F.round(direction_accuracy(), 2).alias("direction_accuracy"),
        F.round(ratio(bias(), level) * 100, 3).alias("bias_pct"),
        F.round(theil_u(), 4).alias("theil_u"),
    )
    return (
        wide.withColumn("r2", F.round("__r2", 4))
        .withColumn("adjusted_r2", F.round(adjusted(F.col("__r2"), F.col("n"), n_features), 4))
        .drop("__r2")
    )


def residual_stability(residuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    return residuals.groupBy(*keys).agg(F.round(stability(F.col("residual")), 2).alias("stability"))


def composite(df: DataFrame, within: Sequence[str], weights: Mapping[str, float] = COMPOSITE_WEIGHTS) -> DataFrame:
    """Weighted min-max score (0-100) of each row against the rows it competes with."""
    w = W.partitionBy(*within)
    score = F.lit(0.0)
    for c, weight in weights.items():
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        up = (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))
        better = up if c == "stability" else 1 - up
        score = score + weight * F.when(hi == lo, 1.0).otherwise(better) * 100
    return df.withColumn("composite_score", F.round(score, 2))


def ranked(df: DataFrame, within: Sequence[str], model: str = "model") -> DataFrame:
    """Rank by composite score; the first is the recommended one. Ties go to the earlier name."""
    w = W.partitionBy(*within).orderBy(F.desc("composite_score"), F.asc(model))
    return df.withColumn("rank", F.row_number().over(w)).withColumn("recommended", F.col("rank") == 1)


def model_leaderboard(forecasts: DataFrame, residuals: DataFrame, series: str, order: str) -> DataFrame:
    keys = [series, "model"]
    table = full_metrics(forecasts, keys, order).join(residual_stability(residuals, keys), keys)
    return ranked(composite(table, [series]), [series])


def normalised_radar(df: DataFrame, within: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Each metric inverted to 0..1 so that larger is better."""
    w = W.partitionBy(*within)

    def inverted(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi == lo, 1.0).otherwise(1 - (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))).alias(f"{c}_norm")

    return df.select(*within, "model", *[inverted(c) for c in metrics])


def series_origin_mase(errors: DataFrame, series: str) -> DataFrame:
    """Mean absolute error over the in-sample seasonal scale, per series, origin and model."""
    return (
        errors.groupBy(series, "origin", "model")
        .agg(F.avg("ae").alias("mae"), F.max("scale").alias("scale"))
        .filter((F.col("scale") > 0) & ~F.isnan("scale"))
        .withColumn("mase", F.col("mae") / F.col("scale"))
    )


def panel_leaderboard(errors: DataFrame, series: str, baseline: str = "SeasonalNaive") -> DataFrame:
    """Mean and median scaled error per model and the share of series-origins beating the baseline.

    The mean and share combine on the map side; the median over all series of a model is exact and
    ranked across partitions, since a model name is a single key holding a share of all rows.
    """
    per = series_origin_mase(errors, series)
    base = F.max(F.when(F.col("model") == baseline, F.col("mase"))).over(W.partitionBy(series, "origin"))
    # Both halves below read this table, and the sort samples it first: compute it once.
    per = settle(per.select("model", "mase", base.alias("base")))
    means = per.groupBy("model").agg(
        F.avg("mase").alias("mase_mean"),
        F.avg(F.coalesce(F.col("mase") < F.col("base"), F.lit(False)).cast("double")).alias("share_beats_baseline"),
        F.count("*").alias("series_origins"),
    )
    medians = exact_quantiles(per.select("model", "mase"), ["model"], "mase", {"mase_median": 0.5})
    return means.join(medians, "model").select(
        "model",
        F.round("mase_mean", 4).alias("mase_mean"),
        F.round("mase_median", 4).alias("mase_median"),
        F.round("share_beats_baseline", 4).alias("share_beats_baseline"),
        "series_origins",
    )


def mase_by_origin(errors: DataFrame, series: str, models: Sequence[str]) -> DataFrame:
    return series_origin_mase(errors, series).groupBy("origin").pivot("model", list(models)).agg(F.round(F.avg("mase"), 4))


def aggregate_ape(errors: DataFrame, h: int = 1) -> DataFrame:
    """Sum of forecasts against sum of actuals per target date, mean absolute percent error."""
    sums = errors.filter(F.col("h") == h).groupBy("model", "ds").agg(
        F.sum("actual").alias("a"), F.sum("pred").alias("p")
    )
    return sums.groupBy("model").agg(
        F.avg(F.abs(F.try_divide(F.col("p") - F.col("a"), F.col("a"))) * 100).alias("ape_pct"),
        F.count("*").alias("n_dates"),
    )


def stress_window(errors: DataFrame, quarter: str, h: int = 1) -> DataFrame:
    """One-step scaled error in one quarter against all other quarters; undefined ratios are skipped."""
    r = F.try_divide(F.col("ae"), F.col("scale"))
    hit = F.col("ds") == F.lit(quarter).cast("date")
    return errors.filter(F.col("h") == h).groupBy("model").agg(
        F.avg(F.when(hit, r)).alias("stress"), F.avg(F.when(~hit, r)).alias("other")
    )


def cv_summary(fold_metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fold_metrics.groupBy(*keys).agg(
        F.round(F.avg("mape"), 3).alias("cv_mape_mean"),
        F.round(F.stddev_samp("mape"), 3).alias("cv_mape_std"),
        F.round(F.avg("rmse_pct"), 3).alias("cv_rmse_pct_mean"),
        F.round(F.avg("r2"), 4).alias("cv_r2_mean"),
        F.round(F.avg("direction_accuracy"), 2).alias("cv_direction_mean"),
        F.count("*").alias("cv_folds"),
    )


def mase_of(forecasts: DataFrame, training: DataFrame, series: str, order: str, season: int = 4) -> DataFrame:
    """Test error over in-sample seasonal-naive error; NULL when the scale is missing or zero."""
    w = W.partitionBy(series).orderBy(order)
    scale = (
        training.withColumn("__d", F.abs(F.col("y") - F.lag("y", season).over(w)))
        .groupBy(series)
        .agg(F.avg("__d").alias("scale"))
    )
    err = forecasts.groupBy(series, "model").agg(F.avg(F.abs(_error())).alias("mae"))
    return err.join(scale, series, "left").withColumn("mase", F.try_divide(F.col("mae"), F.col("scale")))


def leaderboard_insights(board: DataFrame, within: Sequence[str]) -> DataFrame:
    """Best, most stable, lowest-error and worst model, and the spread of the error."""
    def pick(fn, metric: str, sign: int = 1) -> Column:
        # The name breaks ties, so the pick does not depend on row order.
        return fn(F.col("model"), F.struct(F.col(metric) * sign, F.col("model")))

    return board.groupBy(*within).agg(
        F.count("*").alias("n_models"),
        pick(F.min_by, "rank").alias("best_model"),
        pick(F.min_by, "stability", -1).alias("stable_model"),
        pick(F.min_by, "mape").alias("lowest_mape_model"),
        pick(F.min_by, "mape", -1).alias("worst_model"),
        (F.max("mape") - F.min("mape")).alias("mape_range"),
        F.avg("mape").alias("mape_mean"),
    )
