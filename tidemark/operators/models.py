"""Fitted forecasters: smoothing families over arrays of series, and one boosted model over all series.

The smoothing fitters see a batch of equally long series as one matrix and step through time once for
all of them, all grid points and all ends of a training part.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tidemark.functions.calendar import quarter_index
from tidemark.session import settle

if TYPE_CHECKING:
    from pyspark.ml.regression import GBTRegressionModel

SEASON = 4
#: Series fitted as one matrix at most: a worker's memory follows this, not the rows of an Arrow batch.
AT_ONCE = 256

#: For each end: forecasts (series x steps) and training RMSE per series.
Made = Sequence[tuple[np.ndarray, np.ndarray]]
RollingFitter = Callable[..., Made]


def _grid(*axes: Sequence[float]) -> list[np.ndarray]:
    return [g.ravel() for g in np.meshgrid(*axes, indexing="ij")]


def _smooth(y: np.ndarray, ends: Sequence[int], alpha: np.ndarray, beta: np.ndarray | None, gamma: np.ndarray | None):
    """Run additive smoothing once for n series (rows) and p grid points (columns).

    Yields the states after the first ``end`` values, for each of the ascending ends, and the squared error after
    the first season, which every family can predict. A state depends on earlier values alone, so it is what a run
    over a copy of the first ``end`` values would leave.
    """
    n, p = len(y), len(alpha)
    head = y[:, :SEASON].mean(axis=1, keepdims=True)
    season = np.zeros((n, p, SEASON))
    if gamma is not None:
        season += (y[:, :SEASON] - head)[:, None, :]
        level = np.repeat(head, p, axis=1)
        trend = np.repeat((y[:, SEASON : 2 * SEASON].mean(axis=1, keepdims=True) - head) / SEASON, p, axis=1)
        start = SEASON
    else:
        level = np.repeat(y[:, :1], p, axis=1)
        trend = np.repeat(y[:, 1:2] - y[:, :1], p, axis=1) if beta is not None else np.zeros((n, p))
        start = 1
    sse, wanted = np.zeros((n, p)), set(ends)
    for t in range(start, max(ends)):
        s = season[:, :, t % SEASON]
        obs = y[:, t : t + 1]
        if t >= SEASON:
            sse += (obs - level - trend - s) ** 2
        grown = level + trend
        new = alpha * (obs - s) + (1 - alpha) * grown
        if beta is not None:
            trend = beta * (new - level) + (1 - beta) * trend
        if gamma is not None:
            season[:, :, t % SEASON] = gamma * (obs - new) + (1 - gamma) * s
        level = new
        if t + 1 in wanted:
            yield level, trend, season, sse


def _fit(y: np.ndarray, ends: Sequence[int], horizon: int, alpha, beta=None, gamma=None):
    """Best grid point per series at each end: forecasts (n, horizon), squared error, chosen alpha."""
    rows, steps = np.arange(len(y)), np.arange(1, horizon + 1)
    for end, (level, trend, season, sse) in zip(ends, _smooth(y, ends, alpha, beta, gamma)):
        best = sse.argmin(axis=1)
        lv, tr, se = level[rows, best], trend[rows, best], season[rows, best]
        seasonal = se[:, (end + steps - 1) % SEASON]
        yield lv[:, None] + tr[:, None] * steps + seasonal, sse[rows, best], alpha[best]


_A = np.linspace(0.05, 0.95, 19)
_SES = _grid(_A)
_HOLT = _grid(np.linspace(0.1, 0.9, 9), (0.05, 0.1, 0.2, 0.4))
_HW = _grid((0.1, 0.3, 0.5, 0.7, 0.9), (0.02, 0.1, 0.3), (0.05, 0.2, 0.5))


def _of_grid(grid) -> RollingFitter:
    def fit(y: np.ndarray, ends: Sequence[int], horizon: int) -> Made:
        return [(fc, np.sqrt(sse / (end - SEASON))) for end, (fc, sse, _) in zip(ends, _fit(y, ends, horizon, *grid))]

    return fit


def theta_at(y: np.ndarray, ends: Sequence[int], horizon: int) -> Made:
    """Simple smoothing plus half the linear trend (two theta lines, 0 and 2)."""
    out, h = [], np.arange(1, horizon + 1)
    for end, (fc, sse, alpha) in zip(ends, _fit(y, ends, horizon, *_SES)):
        centred = np.arange(end) - (end - 1) / 2
        half = 0.5 * (y[:, :end] @ centred) / (centred @ centred)
        carried = (1 - (1 - alpha) ** end) / alpha
        out.append((fc + half[:, None] * (h - 1 + carried[:, None]), np.sqrt(sse / (end - SEASON))))
    return out


def smoothing_choice_at(y: np.ndarray, ends: Sequence[int], horizon: int) -> Made:
    """Simple, trended or seasonal smoothing, whichever has the lowest small-sample criterion at the end."""
    out, rows = [], np.arange(len(y))
    families = ((_SES, 2), (_HOLT, 4), (_HW, 8))
    for end, *fits in zip(ends, *[_fit(y, ends, horizon, *grid) for grid, _ in families]):
        n, scores = end - SEASON, []
        for (_, sse, _), (_, k) in zip(fits, families):
            room = max(n - k - 1, 1)
            scores.append(n * np.log(np.maximum(sse, 1e-12) / n) + 2 * k + 2 * k * (k + 1) / room)
        best = np.stack(scores).argmin(axis=0)
        out.append((np.stack([f[0] for f in fits])[best, rows], np.sqrt(np.stack([f[1] for f in fits])[best, rows] / n)))
    return out


#: Fitters that make the forecasts at all ends in one pass over time.
ROLLING: dict[str, RollingFitter] = {
    "HoltWinters": _of_grid(_HW), "Theta": theta_at, "SmoothingChoice": smoothing_choice_at,
    "SimpleSmoothing": _of_grid(_SES), "TrendSmoothing": _of_grid(_HOLT),
}
FITTED = ("HoltWinters", "Theta", "SmoothingChoice")


def holt_winters(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    return ROLLING["HoltWinters"](y, [y.shape[1]], horizon)[0]


def theta(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    return theta_at(y, [y.shape[1]], horizon)[0]


def smoothing_choice(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    return smoothing_choice_at(y, [y.shape[1]], horizon)[0]


Fitter = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]
FITTERS: dict[str, Fitter] = {"HoltWinters": holt_winters, "Theta": theta, "SmoothingChoice": smoothing_choice}


def rolled(fit: Callable) -> RollingFitter:
    """A fitter of whole matrices, ``fit(y, horizon)`` or ``fit(y, horizon, x)``, as one that is called per end.

    It sees the values, and the regressors, before the end only.
    """
    def at(y: np.ndarray, ends: Sequence[int], horizon: int, x: np.ndarray | None = None) -> Made:
        return [fit(y[:, :end], horizon, *([] if x is None else [x[:, :, :end]])) for end in ends]

    return at


def fit_rolling(arrays: DataFrame, keys: Sequence[str], model: str, fitter: RollingFitter | None = None, values: str = "values",
                ends: str = "ends", horizon: str = "horizon", regressors: str | None = None, min_length: int = 2 * SEASON) -> DataFrame:
    """Forecasts of every series at every end of its training part: one row per (series, end, step).

    ``ends`` is an ascending array of how many values a training part holds, ``horizon`` how many steps to forecast.
    A registered or given fitter takes (matrix of equally long series, ends, horizon) and, with ``regressors`` (array
    of arrays, one per regressor, as long as the values), their (series, regressor, time) block; for each end it
    returns forecasts and the training RMSE. Series of equal length, ends and horizon are fitted as one matrix, at
    most ``AT_ONCE`` of them, and their forecasts are handed on before the next ones are fitted.

    A part that fails, alone, gives one row with step 0 and ``error``; all others are forecast. ``scale`` is the
    mean absolute seasonal change of the training part, ``seconds`` the fitting time a part took.
    """
    fit = fitter or ROLLING[model]
    kind = "array<struct<end:int,h:int,pred:double,lower:double,upper:double,scale:double,seconds:double,error:string>>"

    def scale_of(y: np.ndarray, end: int) -> float | None:
        steps = np.abs(y[SEASON:end] - y[: end - SEASON])
        return float(steps.mean()) if len(steps) else None

    def failed(end: int, why: str) -> list[dict]:
        return [{"end": end, "h": 0, "error": why}]

    def forecast(y: np.ndarray, end: int, fc: np.ndarray, rmse: float, seconds: float) -> list[dict]:
        band, known = 1.96 * float(rmse), {"end": end, "scale": scale_of(y, end), "seconds": seconds, "error": None}
        return [{"h": h + 1, "pred": float(v), "lower": float(v) - band, "upper": float(v) + band, **known} for h, v in enumerate(fc)]

    def fitted(y: np.ndarray, x: np.ndarray | None, at: list[int], steps: int) -> list[list[dict]]:
        begin = time.perf_counter()
        made = list(fit(y, at, steps) if x is None else fit(y, at, steps, x))
        seconds = (time.perf_counter() - begin) / (len(y) * len(at))
        return [[r for end, (fc, rmse) in zip(at, made) for r in forecast(one, end, fc[k], rmse[k], seconds)] for k, one in enumerate(y)]

    def apart(y: np.ndarray, x: np.ndarray | None, at: list[int], steps: int) -> list[dict]:
        rows = []
        for end in at:
            try:
                rows += fitted(y, x, [end], steps)[0]
            except Exception as exc:  # noqa: BLE001 - reported per part
                rows += failed(end, str(exc))
        return rows

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                yield made_of(batch.iloc[at : at + AT_ONCE])

    def made_of(parts: pd.DataFrame) -> pd.Series:
        out: list = [None] * len(parts)
        groups: dict[tuple, list[int]] = {}
        for i, (v, e, h) in enumerate(zip(parts["v"], parts["e"], parts["h"])):
            groups.setdefault((len(v), tuple(e), h), []).append(i)
        for (_, at, steps), spots in groups.items():
            short = [r for end in at if end < min_length for r in failed(int(end), f"needs {min_length} values, has {end}")]
            good = sorted({int(end) for end in at if end >= min_length})
            y = np.stack([np.asarray(parts["v"].iloc[i], dtype=float) for i in spots])
            x = np.stack([np.stack([np.asarray(r, dtype=float) for r in parts["x"].iloc[i]]) for i in spots]) if regressors else None
            try:
                made = fitted(y, x, good, int(steps)) if good else [[] for _ in spots]
            except Exception:  # noqa: BLE001 - one part must not void the others
                made = [apart(y[k : k + 1], None if x is None else x[k : k + 1], good, int(steps)) for k in range(len(spots))]
            for i, rows in zip(spots, made):
                out[i] = short + rows
        return pd.Series(out)

    columns = {"v": F.col(values), "e": F.col(ends), "h": F.col(horizon)} | ({"x": F.col(regressors)} if regressors else {})
    parts = F.struct(*[c.alias(k) for k, c in columns.items()])
    return arrays.select(*keys, F.lit(model).alias("model"), F.explode(run(parts)).alias("r")).select(*keys, "model", "r.*")


def fit_arrays(arrays: DataFrame, keys: Sequence[str], model: str, horizon: int = 4, fitter: Fitter | None = None,
               values: str = "values", min_length: int = 2 * SEASON) -> DataFrame:
    """Forecast every series array with one registered or user-supplied fitter.

    A fitter takes (matrix of equally long series, horizon) and returns forecasts and the training RMSE.
    A series that fails alone yields its message in ``error``; the others of its batch are forecast.
    """
    fit = fitter or FITTERS[model]

    def failed(why: str) -> list[dict]:
        return [{"h": 0, "pred": None, "lower": None, "upper": None, "error": why}]

    def forecast(values: np.ndarray, rmse: float) -> list[dict]:
        band = 1.96 * float(rmse)
        return [{"h": h + 1, "pred": float(v), "lower": float(v) - band, "upper": float(v) + band, "error": None} for h, v in enumerate(values)]

    @F.pandas_udf("array<struct<h:int,pred:double,lower:double,upper:double,error:string>>")
    def run(series: pd.Series) -> pd.Series:
        out: list = [None] * len(series)
        lengths = series.map(len)
        for length, where in lengths.groupby(lengths).groups.items():
            spots = [series.index.get_loc(i) for i in where]
            if length < min_length:
                for i in spots:
                    out[i] = failed(f"needs {min_length} values, has {length}")
                continue
            matrix = np.stack([np.asarray(series.iloc[i], dtype=float) for i in spots])
            try:
                made = [forecast(fc, rmse) for fc, rmse in zip(*fit(matrix, horizon))]
            except Exception:  # noqa: BLE001 - one series must not void the others of its length
                made = []
                for one in matrix:
                    try:
                        made += [forecast(fc, rmse) for fc, rmse in zip(*fit(one[None, :], horizon))]
                    except Exception as exc:  # noqa: BLE001 - reported per series
                        made.append(failed(str(exc)))
            for i, rows in zip(spots, made):
                out[i] = rows
        return pd.Series(out)

    return arrays.select(*keys, F.lit(model).alias("model"), F.explode(run(values)).alias("r")).select(
        *keys, "model", "r.*"
    )


# One boosted model over all series ------------------------------------------------------------

N_LAGS = 8


def lag_vector_features(recent: Column, next_quarter: Column) -> dict[str, Column]:
    """Features of the next change from the last eight changes (newest last)."""
    def mean_of(k: int) -> Column:
        return F.aggregate(F.slice(recent, N_LAGS - k + 1, k), F.lit(0.0), lambda a, x: a + x) / k

    lags = {f"l{k}": F.element_at(recent, N_LAGS - k + 1) for k in range(1, N_LAGS + 1)}
    return lags | {"mean_4": mean_of(4), "mean_8": mean_of(8), "quarter": next_quarter.cast("double")}


FEATURES = [f"l{k}" for k in range(1, N_LAGS + 1)] + ["mean_4", "mean_8", "quarter"]


def with_recent(panel: DataFrame, series: str) -> DataFrame:
    """Log level, its change and the eight changes up to and including this row."""
    from pyspark.sql import Window as W

    w = W.partitionBy(series).orderBy("q")
    d = panel.withColumn("logy", F.ln("y")).withColumn("dlog", F.ln("y") - F.ln(F.lag("y").over(w)))
    recent = F.array(*[F.lag("dlog", k).over(w) for k in range(N_LAGS - 1, 0, -1)], F.col("dlog"))
    return d.withColumn("recent", recent)


def _vector(df: DataFrame, recent: Column, next_quarter: Column) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    named = df.withColumns(lag_vector_features(recent, next_quarter))
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="error").transform(named)


def _changes(recent: Column) -> Column:
    return F.size(F.filter(recent, lambda x: x.isNotNull()))


def training_rows(panel: DataFrame, series: str) -> DataFrame:
    """(series, next_ds, target, features): one row per period whose eight changes and next change are known.

    The rows of an origin are those with ``next_ds`` up to it, so one table serves every origin.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(series).orderBy("q")
    rows = with_recent(panel, series).withColumn("target", F.lead("dlog").over(w)).withColumn("next_ds", F.lead("ds").over(w))
    whole = rows.filter(F.col("target").isNotNull() & (_changes(F.col("recent")) == N_LAGS))
    return _vector(whole, F.col("recent"), F.quarter("next_ds")).select(series, "next_ds", "target", "features")


def _booster(max_iter: int, depth: int, **more):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(labelCol="target", featuresCol="features", maxIter=max_iter, maxDepth=depth, stepSize=0.1,
                        subsamplingRate=0.8, seed=42, **more)


def fit_global(panel: DataFrame, series: str, origin: str, max_iter: int = 20, depth: int = 5):
    """Boosted trees on the next log change of every series, a fixed number of rounds, trained up to the origin only."""
    return _booster(max_iter, depth).fit(training_rows(panel, series).filter(F.col("next_ds") <= F.lit(origin).cast("date")))


def parts_of(rows: int, cores: int, most: int = 2_000_000) -> int:
    """Partitions for the rows of one of several models fitted side by side: half the cores, or more to keep each within ``most`` rows."""
    return max(-(-cores // 2), -(-rows // most))


def fit_at_origins(panel: DataFrame, series: str, origins: Sequence[str], max_iter: int = 400, depth: int = 5, held_quarters: int = 2,
                   tol: float = 0.0, least_rows: int = 100, at_once: int = 16) -> dict[str, GBTRegressionModel]:
    """A model per origin from one training table.

    Targets of the last ``held_quarters`` quarters up to an origin are held back: rounds end when one gains no more
    than ``tol`` on them, at ``max_iter`` otherwise. A leaf holds at least ``least_rows`` rows. ``at_once`` origins are fitted side by side. An origin without rows to
    train or to hold back gets no model. Null and non-positive levels give no rows.

    Every level of every tree is a job whose tasks each report to the driver. Origins side by side fill the cores, so the
    rows of one lie in no more parts than ``parts_of`` allows: what the driver receives follows rounds and cores, not rows.
    """
    rows = settle(training_rows(panel, series))

    def role(origin: str) -> Column:
        at = F.lit(origin).cast("date")
        return F.when(F.col("next_ds") <= at, quarter_index(F.col("next_ds")) > quarter_index(at) - held_quarters)

    counts = rows.agg(*[f(role(o)).alias(f"{n}{k}") for k, o in enumerate(origins) for n, f in (("held", F.count_if), ("all", F.count))]).first()
    usable = [o for k, o in enumerate(origins) if 0 < counts[f"held{k}"] < counts[f"all{k}"]]
    dealt = rows.coalesce(parts_of(max(counts), panel.sparkSession.sparkContext.defaultParallelism))

    def fit(origin: str):
        part = dealt.withColumn("is_held", role(origin)).filter(F.col("is_held").isNotNull())
        return _booster(max_iter, depth, minInstancesPerNode=least_rows, validationIndicatorCol="is_held", validationTol=tol).fit(part)

    with ThreadPoolExecutor(at_once) as pool:  # the driver submits; the fits are Spark jobs
        return dict(zip(usable, pool.map(inheritable_thread_target(panel.sparkSession)(fit), usable)))


def states_at(panel: DataFrame, series: str, origins: Sequence[str]) -> DataFrame:
    """(series, origin, origin_q, logy, recent, error) for every series and origin; ``error`` says why one cannot be forecast."""
    dates = [F.lit(o).cast("date") for o in origins]
    found = F.when(F.col("ds").isin(*dates), F.struct("ds", F.struct(F.col("q").alias("origin_q"), "logy", "recent")))
    per = with_recent(panel, series).groupBy(series).agg(F.map_from_entries(F.collect_list(found)).alias("m"))
    each = per.select(series, "m", F.explode(F.array(*dates)).alias("origin")).select(series, "origin", F.try_element_at("m", F.col("origin")).alias("s"))
    known = _changes(F.col("s.recent"))
    error = F.when(F.col("s").isNull(), F.lit("no value at the origin")).when(
        known < N_LAGS, F.concat(F.lit(f"needs {N_LAGS} changes, has "), known.cast("string")))
    return each.select(series, "origin", "s.*", error.alias("error"))


def forecast_at(models: Mapping[str, GBTRegressionModel], panel: DataFrame, series: str, origins: Sequence[str] | None = None, horizon: int = 4) -> DataFrame:
    """(series, origin, h, q, pred, error): recursive forecasts, each predicted change entering the changes of the next step.

    A series that cannot be forecast at an origin is one row with step 0 and ``error``, as is every series at an origin
    without a model. The panel may be another one than the models were trained on.
    """
    origins = list(origins or models)
    states = settle(states_at(panel, series, origins))
    none = F.when(~F.col("origin").isin(*[F.lit(o).cast("date") for o in models]), F.lit("no model at the origin")) if models else F.lit("no model at the origin")
    failed = states.withColumn("error", F.coalesce("error", none)).filter(F.col("error").isNotNull()).select(
        series, "origin", F.lit(0).alias("h"), F.lit(None).cast("int").alias("q"), F.lit(None).cast("double").alias("pred"), "error")
    return reduce(DataFrame.unionByName, [
        _recursion(model, states.filter((F.col("origin") == F.lit(origin).cast("date")) & F.col("error").isNull()), series, horizon)
        for origin, model in models.items() if origin in origins], failed)


def _recursion(model: GBTRegressionModel, state: DataFrame, series: str, horizon: int) -> DataFrame:
    for h in range(1, horizon + 1):
        stepped = model.transform(_vector(state, F.col("recent"), (F.col("origin_q") + h) % 4 + 1))
        state = (
            stepped.withColumn("logy", F.col("logy") + F.col("prediction"))
            .withColumn("recent", F.concat(F.slice("recent", 2, N_LAGS - 1), F.array("prediction")))
            .withColumn(f"p{h}", F.exp("logy"))
            .drop(*FEATURES, "features", "prediction")
        )
    steps = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"p{h}").alias("pred")) for h in range(1, horizon + 1)])
    return state.select(series, "origin", "origin_q", "error", F.explode(steps).alias("r")).select(
        series, "origin", "r.h", (F.col("origin_q") + F.col("r.h")).cast("int").alias("q"), "r.pred", "error")


def forecast_global(model: GBTRegressionModel, panel: DataFrame, series: str, origin: str, horizon: int = 4) -> DataFrame:
    """``forecast_at`` of one model at one origin."""
    return forecast_at({origin: model}, panel, series, horizon=horizon)


def gains_at(models: Mapping[str, GBTRegressionModel], spark: SparkSession) -> DataFrame:
    """(origin, rounds, feature, gain): one row per model and feature."""
    rows = [(o, m.getNumTrees, f, float(m.featureImportances[k])) for o, m in models.items() for k, f in enumerate(FEATURES)]
    return spark.createDataFrame(rows, "origin string, rounds int, feature string, gain double").withColumn("origin", F.col("origin").cast("date"))
