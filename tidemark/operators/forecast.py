"""Baseline forecasts and rolling-origin backtests for many series in one pass.

Everything a baseline needs to know at an origin (last level, first level, last season, scale,
regression of the log changes) is a running aggregate of the series. So one window pass computes
the state of *every* row, an origin is just a row of that pass, and no training window is ever
copied per origin.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import quarter_end_of_index, quarter_index
from tidemark.operators.models import FITTED, fit_rolling, forecast_at

BASELINES = ("Naive", "SeasonalNaive", "Drift", "ARDrift")


def running_state(panel: DataFrame, series: str, order: str, y: str = "y", season: int = 4) -> DataFrame:
    """Add ``pos`` and ``state``: what a model trained up to and including this row would know."""
    w = W.partitionBy(series).orderBy(order)
    past = w.rowsBetween(W.unboundedPreceding, 0)
    steps = (
        panel.withColumn("__step", F.col(y) - F.lag(y).over(w))
        .withColumn("__season", F.col(y) - F.lag(y, season).over(w))
        .withColumn("__dlog", F.ln(y) - F.ln(F.lag(y).over(w)))
        .withColumn("__dlog1", F.lag("__dlog").over(w))
    )
    state = F.struct(
        F.count(y).over(past).cast("int").alias("n"),
        F.col(y).alias("last"),
        F.first(y).over(past).alias("first"),
        F.array(*[F.lag(y, k).over(w) for k in range(season - 1, 0, -1)], F.col(y)).alias("season"),
        F.avg(F.abs("__season")).over(past).alias("scale"),
        F.stddev_samp("__step").over(past).alias("sd_step"),
        F.stddev_samp("__season").over(past).alias("sd_season"),
        F.regr_slope("__dlog", "__dlog1").over(past).alias("phi"),
        F.regr_intercept("__dlog", "__dlog1").over(past).alias("const"),
        F.col("__dlog").alias("dlog"),
        (F.stddev_samp("__dlog").over(past)).alias("sd_dlog"),
    )
    return (
        steps.withColumn("pos", F.row_number().over(w))
        .withColumn("state", state)
        .drop("__step", "__season", "__dlog", "__dlog1")
    )


def slope(state: Column) -> Column:
    return F.try_divide(state["last"] - state["first"], (state["n"] - 1).cast("double"))


def ar_drift_log(state: Column, h: Column) -> Column:
    """Log level after ``h`` steps of d[t+1] = c + phi * d[t], in closed form."""
    phi, h = state["phi"], h.cast("double")
    mean = F.try_divide(state["const"], 1 - phi)
    decay = F.try_divide(phi * (1 - F.pow(phi, h)), 1 - phi)
    return F.ln(state["last"]) + h * mean + (state["dlog"] - mean) * decay


def predictions(state: Column, h: Column, season: int = 4, models: Sequence[str] = BASELINES) -> Column:
    """Array of ``(model, pred, lower, upper)`` structs at step ``h`` (from 1)."""
    root_h = F.sqrt(h.cast("double"))
    seasonal = F.element_at(state["season"], ((h - 1) % season + 1).cast("int"))
    point = {
        "Naive": (state["last"], state["sd_step"]),
        "SeasonalNaive": (seasonal, state["sd_season"]),
        "Drift": (state["last"] + slope(state) * h, state["sd_step"]),
    }
    rows = []
    for m in models:
        if m == "ARDrift":
            centre, half = ar_drift_log(state, h), 1.96 * F.coalesce(state["sd_dlog"], F.lit(0.0)) * root_h
            values = (F.exp(centre), F.exp(centre - half), F.exp(centre + half))
        else:
            pred, sd = point[m]
            half = 1.96 * F.coalesce(sd, F.lit(0.0)) * root_h
            values = (pred, pred - half, pred + half)
        rows.append(F.struct(F.lit(m).alias("model"), *[v.alias(n) for v, n in zip(values, ("pred", "lower", "upper"))]))
    return F.array(*rows)


def origin_states(
    panel: DataFrame, series: str, origins: Sequence[str], min_history: int = 16, season: int = 4, horizon: int = 4
) -> DataFrame:
    """One row per (series, origin) for series reporting at the origin with enough history, with the
    levels of the next ``horizon`` quarters (NULL where the series does not report)."""
    w = W.partitionBy(series).orderBy("q")
    ahead = [F.max("y").over(w.rangeBetween(h, h)) for h in range(1, horizon + 1)]
    return (
        running_state(panel, series, "q", season=season)
        .withColumn("future", F.array(*ahead))
        .filter(F.col("ds").isin(*[date.fromisoformat(o) for o in origins]) & (F.col("state.n") >= min_history))
        .select(series, F.col("ds").alias("origin"), F.col("q").alias("origin_q"), "state", "future")
    )


def fan_out(panel: DataFrame, series: str, origins: Sequence[str], min_history: int = 16, horizon: int = 4) -> DataFrame:
    """Training and test rows per origin, for fitters that need the whole window.

    ``role`` is ``train`` up to the origin and ``test`` for the next ``horizon`` quarters.
    """
    at = F.array(*[F.lit(o).cast("date") for o in origins])
    w = W.partitionBy(series, "origin")
    # Shuffle each row once and copy it per origin afterwards: the windows keep the partitioning.
    rows = panel.repartition(series).withColumn("origin", F.explode(at)).withColumn("origin_q", quarter_index(F.col("origin")))
    train = F.col("q") <= F.col("origin_q")
    return (
        rows.filter(F.col("q") <= F.col("origin_q") + horizon)
        .withColumn("__n", F.count(F.when(train, 1)).over(w))
        .withColumn("__last", F.max(F.when(train, F.col("q"))).over(w))
        .filter((F.col("__n") >= min_history) & (F.col("__last") == F.col("origin_q")))
        .withColumn("role", F.when(train, "train").otherwise("test"))
        .drop("__n", "__last")
    )


def forecast_at_origins(states: DataFrame, horizon: int = 4, models: Sequence[str] = BASELINES) -> DataFrame:
    """Long forecasts ``(origin, h, ds, model, pred, lower, upper)`` for every origin state."""
    key = [c for c in states.columns if c not in ("state", "future")]
    steps = states.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return (
        steps.withColumn("p", F.explode(predictions(F.col("state"), F.col("h"), models=models)))
        .withColumn("q", F.col("origin_q") + F.col("h"))
        .select(*key, "h", "q", quarter_end_of_index(F.col("q")).alias("ds"), "p.*", "state", "future")
    )


def backtest_errors(
    panel: DataFrame, series: str, origins: Sequence[str], min_history: int = 16, horizon: int = 4,
    models: Sequence[str] = BASELINES,
) -> DataFrame:
    """Long error table: every forecast that has an actual, on the level scale."""
    states = origin_states(panel, series, origins, min_history, horizon=horizon)
    actual = F.element_at("future", F.col("h"))
    return (
        forecast_at_origins(states, horizon, models)
        .withColumn("actual", actual)
        .filter(F.col("actual").isNotNull())
        .select(
            series, "origin", "ds", "h", "model", "actual", "pred",
            F.abs(F.col("actual") - F.col("pred")).alias("ae"),
            F.col("state.scale").alias("scale"),
        )
    )


def holdout(panel: DataFrame, series: str, order: str = "q", fraction: float = 0.8) -> DataFrame:
    """All rows with ``is_train``, ``step`` past the split and the state at the split attached."""
    whole = W.partitionBy(series)
    rows = running_state(panel, series, order).withColumn(
        "n_train", F.floor(F.count("*").over(whole) * F.lit(fraction)).cast("int")
    )
    at_split = F.first(F.when(F.col("pos") == F.col("n_train"), F.col("state")), ignorenulls=True)
    return (
        rows.withColumn("split_state", at_split.over(whole.orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("is_train", F.col("pos") <= F.col("n_train"))
        .withColumn("step", F.col("pos") - F.col("n_train"))
    )


def holdout_forecasts(panel: DataFrame, series: str, order: str = "q", fraction: float = 0.8,
                      models: Sequence[str] = BASELINES) -> DataFrame:
    rows = holdout(panel, series, order, fraction).filter(~F.col("is_train"))
    return rows.withColumn("p", F.explode(predictions(F.col("split_state"), F.col("step"), models=models))).select(
        series, "ds", order, "step", "p.model", F.col("y").alias("actual"), "p.pred", "p.lower", "p.upper"
    )


def holdout_residuals(panel: DataFrame, series: str, order: str = "q", fraction: float = 0.8, season: int = 4) -> DataFrame:
    """In-sample one-step residuals of each baseline on the training rows."""
    w = W.partitionBy(series).orderBy(order)
    rows = holdout(panel, series, order, fraction).withColumn("__prev", F.lag("state").over(w)).withColumn(
        "__seas", F.lag("y", season).over(w)
    )
    st, prev = F.col("split_state"), F.col("__prev")
    ar = F.exp(F.ln(prev["last"]) + st["const"] + st["phi"] * prev["dlog"])
    fitted = {
        "Naive": prev["last"],
        "SeasonalNaive": F.col("__seas"),
        "Drift": prev["last"] + slope(st),
        "ARDrift": ar,
    }
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), f.alias("fitted")) for m, f in fitted.items()])
    return (
        rows.filter("is_train")
        .withColumn("f", F.explode(pairs))
        .select(series, order, "ds", "pos", "f.model", F.col("y").alias("actual"), "f.fitted",
                (F.col("y") - F.col("f.fitted")).alias("residual"))
        .filter(F.col("residual").isNotNull())
    )


def cv_forecasts(
    panel: DataFrame, series: str, order: str = "q", folds: int = 5, min_train: int = 16,
    models: Sequence[str] = BASELINES,
) -> DataFrame:
    """Expanding-window folds: each block of ``n // (folds + 1)`` rows is forecast from the state of
    the last row before it. Folds with a short training part are left out."""
    w = W.partitionBy(series).orderBy(order)
    n = F.count("*").over(W.partitionBy(series))
    rows = (
        running_state(panel, series, order)
        .withColumn("size", F.floor(n / (folds + 1)).cast("int"))
        .withColumn("past_start", (F.col("pos") - (n - F.col("size") * folds)).cast("int"))
        .filter(F.col("size") > 0)
    )
    block_end = (F.col("past_start") >= 0) & (F.col("past_start") % F.col("size") == 0)
    known = F.last(F.when(block_end, F.col("state")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return (
        rows.withColumn("known", known)
        .filter((F.col("past_start") > 0) & (F.col("known.n") >= min_train))
        .withColumn("fold", F.ceil(F.col("past_start") / F.col("size")).cast("int"))
        .withColumn("step", F.col("past_start") - (F.col("fold") - 1) * F.col("size"))
        .withColumn("p", F.explode(predictions(F.col("known"), F.col("step"), models=models)))
        .select(series, "fold", "step", "ds", "p.model", F.col("y").alias("actual"), "p.pred",
                F.col("known.n").alias("n_train"))
    )


def _ordered(panel: DataFrame, series: str, order: str) -> DataFrame:
    """One row per series: its values, their places and dates, in order. Missing values are left out."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("ds").alias("d"), F.col("y").cast("double").alias("v"))))
    packed = panel.filter(F.col("y").isNotNull()).groupBy(series).agg(rows.alias("__s"))
    return packed.select(series, F.col("__s.v").alias("values"), F.col("__s.o").alias("places"), F.col("__s.d").alias("dates"))


def origin_arrays(panel: DataFrame, series: str, origins: Sequence[str], min_history: int = 16, horizon: int = 4) -> DataFrame:
    """One row per series with ``values``, ``places``, ``dates``, and ``ends``: how many values each usable origin knows.

    An origin is usable where the series reports at it and has enough history. The series is not copied per origin.
    """
    at = F.array(*[quarter_index(F.lit(o).cast("date")) for o in sorted(origins)])
    ends = F.filter(F.transform(at, lambda q: F.array_position("places", q).cast("int")), lambda e: e >= min_history)
    rows = _ordered(panel, series, "q").withColumn("ends", ends).withColumn("horizon", F.lit(horizon))
    return rows.filter(F.size("ends") > 0)


def fitted_at_origins(arrays: DataFrame, series: str, models: Sequence[str] = FITTED, fitters: Mapping[str, Callable] | None = None) -> DataFrame:
    """Long forecasts ``(origin, h, q, ds, model, pred, lower, upper, actual, scale, seconds, error)`` of fitted models.

    ``actual`` is NULL where the series does not report. A part that failed is one row with step 0 and ``error``.
    """
    made = [fit_rolling(arrays, [series, "values", "places", "dates"], m, (fitters or {}).get(m)) for m in models]
    rows = reduce(DataFrame.unionByName, made)
    q = F.element_at("places", F.col("end")) + F.col("h")
    where = F.array_position("places", q)
    return rows.select(
        series, F.element_at("dates", F.col("end")).alias("origin"), "h", q.alias("q"), quarter_end_of_index(q).alias("ds"), "model", "pred", "lower", "upper",
        F.when(where > 0, F.get("values", (where - 1).cast("int"))).alias("actual"), "scale", "seconds", "error",
    )


def fitted_errors(
    panel: DataFrame, series: str, origins: Sequence[str], min_history: int = 16, horizon: int = 4, models: Sequence[str] = FITTED,
    fitters: Mapping[str, Callable] | None = None,
) -> DataFrame:
    """The error table of ``backtest_errors`` for fitted models; failed parts are not in it."""
    rows = fitted_at_origins(origin_arrays(panel, series, origins, min_history, horizon), series, models, fitters)
    return rows.filter("h > 0 and actual is not null").select(
        series, "origin", "ds", "h", "model", "actual", "pred", F.abs(F.col("actual") - F.col("pred")).alias("ae"), "scale"
    )


def global_errors(
    models: Mapping, panel: DataFrame, series: str, origins: Sequence[str], min_history: int = 16, horizon: int = 4, name: str = "GlobalGBT",
) -> DataFrame:
    """The error table of ``backtest_errors`` for one model over all series per origin; what could not be forecast is not in it."""
    made = forecast_at(models, panel, series, origins, horizon).filter("error is null").drop("error", "q")
    states = origin_states(panel, series, origins, min_history, horizon=horizon)
    rows = made.join(states, [series, "origin"]).withColumn("actual", F.element_at("future", F.col("h"))).filter("actual is not null")
    ds = quarter_end_of_index(F.col("origin_q") + F.col("h"))
    return rows.select(
        series, "origin", ds.alias("ds"), "h", F.lit(name).alias("model"), "actual", "pred", F.abs(F.col("actual") - F.col("pred")).alias("ae"),
        F.col("state.scale").alias("scale"),
    )


def cv_arrays(panel: DataFrame, series: str, order: str = "q", folds: int = 5, min_train: int = 16) -> DataFrame:
    """One row per series with the ends of the training parts of ``cv_forecasts``, and the size of a fold as ``horizon``."""
    n, size = F.size("values"), F.floor(F.size("values") / (folds + 1)).cast("int")
    rows = _ordered(panel, series, order).withColumn("horizon", size).filter("horizon > 0")
    ends = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: (n - F.col("horizon") * (F.lit(folds) - k)).cast("int"))
    return rows.withColumn("first_end", F.element_at(ends, 1)).withColumn("ends", F.filter(ends, lambda e: e >= min_train)).filter(F.size("ends") > 0)


def cv_fitted(
    panel: DataFrame, series: str, order: str = "q", folds: int = 5, min_train: int = 16, models: Sequence[str] = FITTED,
    fitters: Mapping[str, Callable] | None = None,
) -> DataFrame:
    """``cv_forecasts`` for any registered or given fitter, with ``seconds`` and ``error``; a fold that failed is one row with step 0."""
    arrays = cv_arrays(panel, series, order, folds, min_train)
    made = [fit_rolling(arrays, [series, "values", "dates", "first_end", "horizon"], m, (fitters or {}).get(m)) for m in models]
    rows, at = reduce(DataFrame.unionByName, made), (F.col("end") + F.col("h")).cast("int")
    return rows.select(
        series, ((F.col("end") - F.col("first_end")) / F.col("horizon") + 1).cast("int").alias("fold"), F.col("h").alias("step"),
        F.when(F.col("h") > 0, F.get("dates", at - 1)).alias("ds"), "model", F.when(F.col("h") > 0, F.get("values", at - 1)).alias("actual"),
        "pred", F.col("end").alias("n_train"), "seconds", "error",
    )


def tune(
    panel: DataFrame, series: str, tuning: Sequence[str], reported: Sequence[str], settings: Sequence[str], min_history: int = 12,
    horizon: int = 4, fitters: Mapping[str, Callable] | None = None,
) -> DataFrame:
    """Settings (registered or given fitters) scored on the tuning origins alone: (model, mase_mean, series_origins, tuned_to, chosen).

    The mean is over all series and tuning origins; the smallest is chosen, the earlier name of equals. Origins that
    are to be reported must not be among the tuning ones.
    """
    require_apart(reported, tuning)
    errors = fitted_errors(panel, series, tuning, min_history, horizon, settings, fitters)
    per = errors.groupBy(series, "origin", "model").agg(F.avg("ae").alias("mae"), F.max("scale").alias("scale")).filter("scale > 0")
    board = per.groupBy("model").agg(F.avg(F.col("mae") / F.col("scale")).alias("mase_mean"), F.count("*").alias("series_origins"))
    best = W.orderBy("mase_mean", "model")  # one row per setting
    return board.withColumn("tuned_to", F.lit(max(tuning)).cast("date")).withColumn("chosen", F.row_number().over(best) == 1)


def frozen_errors(
    panel: DataFrame, series: str, settings: DataFrame, origins: Sequence[str], min_history: int = 16, horizon: int = 4,
    fitters: Mapping[str, Callable] | None = None, name: str = "Tuned",
) -> DataFrame:
    """Errors at the reported origins of the setting that ``tune`` chose, as model ``name``.

    Fails if an origin is not later than all that the setting was tuned on.
    """
    chosen = settings.filter("chosen").select("model", "tuned_to").collect()  # one row
    if len(chosen) != 1:
        raise ValueError(f"{len(chosen)} settings are chosen instead of one")
    early = sorted(o for o in origins if date.fromisoformat(o) <= chosen[0].tuned_to)
    if early:
        raise ValueError(f"origins {early} are not after the last one used for tuning, {chosen[0].tuned_to}")
    return fitted_errors(panel, series, origins, min_history, horizon, [chosen[0].model], fitters).withColumn("model", F.lit(name))


def require_apart(reported: Sequence[str], tuning: Sequence[str]) -> None:
    if set(reported) & set(tuning):
        raise ValueError("an origin used for tuning must not be reported")


def origin_table(spark, reported: Sequence[str], tuning: Sequence[str]) -> DataFrame:
    """Origins with a role; the two sets must not meet."""
    require_apart(reported, tuning)
    rows = [(o, "report") for o in reported] + [(o, "tune") for o in tuning]
    return spark.createDataFrame(rows, "origin string, role string").select(
        F.col("origin").cast("date").alias("origin"), "role"
    )
