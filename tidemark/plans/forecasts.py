"""Queries over forecasts: baselines, rolling origins, holdout, cross-validation and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.frames import with_period_columns
from tidemark.operators import evaluate as E
from tidemark.operators import forecast as B
from tidemark.operators import models as M
from tidemark.plans import inputs as I
from tidemark.plans.catalog import near, register
from tidemark.plans.inputs import CTES, ORIGINS, TUNING
from tidemark.session import settle

KEY = ["unique_id", "model"]

_ORIGIN_ROWS = ", ".join(f"(DATE '{o}')" for o in ORIGINS)
_LAGS = "lag(y, 1) OVER w AS l1, lag(y, 4) OVER w AS l4, ln(y) - ln(lag(y, 1) OVER w) AS dl, ln(lag(y, 1) OVER w) - ln(lag(y, 2) OVER w) AS dl1"
_STATE = """arg_max(y, q) AS y_last, arg_min(y, q) AS y_first, count(*) AS n, avg(abs(y - l4)) AS scale,
    stddev_samp(y - l1) AS sd1, stddev_samp(y - l4) AS sd4, regr_slope(dl, dl1) AS phi, regr_intercept(dl, dl1) AS c,
    arg_max(dl, q) AS d0, stddev_samp(dl) AS sdd"""

_PICK = """CASE model WHEN 'Naive' THEN y_last WHEN 'SeasonalNaive' THEN y_season
    WHEN 'Drift' THEN y_last + (y_last - y_first) / (n - 1) * h
    ELSE exp(ln(y_last) + h * c / (1 - phi) + (d0 - c / (1 - phi)) * phi * (1 - pow(phi, h)) / (1 - phi)) END"""
_HALF = "1.96 * CASE WHEN model = 'SeasonalNaive' THEN sd4 ELSE sd1 END * sqrt(h)"
_LOWER = f"CASE WHEN model = 'ARDrift' THEN pred * exp(-1.96 * sdd * sqrt(h)) ELSE pred - {_HALF} END AS lower"
_UPPER = f"CASE WHEN model = 'ARDrift' THEN pred * exp(1.96 * sdd * sqrt(h)) ELSE pred + {_HALF} END AS upper"
_MODELS = "(VALUES ('Naive'), ('SeasonalNaive'), ('Drift'), ('ARDrift')) m(model)"

_SMOOTH = "level + trend * h + season[(n + h - 1) % 4 + 1]"
_THETA = "level + slope / 2 * (h - 1 + (1 - pow(1 - a, n)) / a)"
_FITTED = "'" + "', '".join(M.FITTED) + "'"

CTES |= {
    "origins": (
        f"SELECT o AS origin, CAST(year(o)*4+quarter(o)-1 AS INTEGER) AS oq FROM (VALUES {_ORIGIN_ROWS}) t(o)", ()),
    "trainw": (
        f"""SELECT o.origin, o.oq, d.unique_id, d.q, d.ds, d.y, {_LAGS} FROM dense d JOIN origins o ON d.q <= o.oq
        WINDOW w AS (PARTITION BY o.origin, d.unique_id ORDER BY d.q)""", ("dense", "origins")),
    "states": (
        f"SELECT unique_id, origin, oq, {_STATE} FROM trainw GROUP BY 1, 2, 3 HAVING max(q) = oq AND count(*) >= 16", ("trainw",)),
    "fc": (
        f"""SELECT *, {_LOWER}, {_UPPER} FROM (SELECT *, {_PICK} AS pred FROM (
        SELECT s.*, h.h, m.model, b.y AS y_season FROM states s, (SELECT unnest([1,2,3,4]) AS h) h, {_MODELS},
        dense b WHERE b.unique_id = s.unique_id AND b.q = s.oq + h.h - 4))""", ("states", "dense")),
    "errs": (
        """SELECT f.unique_id, f.origin, a.ds, f.h, f.model, a.y AS actual, f.pred, abs(a.y - f.pred) AS ae, f.scale
        FROM fc f JOIN dense a ON a.unique_id = f.unique_id AND a.q = f.oq + f.h""", ("fc", "dense")),
    "numw": (
        f"SELECT *, {_LAGS} FROM num WINDOW w AS (PARTITION BY unique_id ORDER BY q)", ("num",)),
    "hstate": (f"SELECT unique_id, {_STATE} FROM numw WHERE pos <= n_train GROUP BY 1", ("numw",)),
    "hold": (
        f"""SELECT *, {_LOWER}, {_UPPER} FROM (SELECT *, {_PICK} AS pred FROM (
        SELECT s.*, t.ds, t.q, t.pos - t.n_train AS h, t.y AS actual, m.model, b.y AS y_season
        FROM hstate s JOIN num t ON t.unique_id = s.unique_id AND t.pos > t.n_train
        JOIN num b ON b.unique_id = s.unique_id AND b.pos = t.n_train - 3 + (t.pos - t.n_train - 1) % 4, {_MODELS}))""",
        ("hstate", "num")),
    "resid": (
        """SELECT w.unique_id, w.q, w.ds, w.pos, m.model, w.y AS actual, w.y - CASE m.model WHEN 'Naive' THEN l1 WHEN 'SeasonalNaive' THEN l4
        WHEN 'Drift' THEN l1 + (s.y_last - s.y_first) / (s.n - 1) ELSE exp(ln(l1) + s.c + s.phi * dl1) END AS residual
        FROM numw w JOIN hstate s ON w.unique_id = s.unique_id, """ + _MODELS + " WHERE w.pos <= w.n_train", ("numw", "hstate")),
    "resids": ("SELECT * FROM resid WHERE residual IS NOT NULL", ("resid",)),
    "folds": (
        """SELECT *, n_all - (6 - fold) * size AS train_end FROM (SELECT unique_id, max(n) AS n_all, CAST(floor(max(n) / 6) AS BIGINT) AS size FROM num GROUP BY 1),
        (SELECT unnest([1,2,3,4,5]) AS fold)""", ("num",)),
    "cvfc": (
        f"""SELECT unique_id, fold, h AS step, ds, model, actual, {_PICK} AS pred, n AS n_train FROM (
        SELECT s.*, t.ds, t.y AS actual, t.pos - s.train_end AS h, m.model, b.y AS y_season FROM (
          SELECT w.unique_id, f.fold, f.train_end, f.size, {_STATE} FROM numw w JOIN folds f ON w.unique_id = f.unique_id AND w.pos <= f.train_end
          GROUP BY 1, 2, 3, 4 HAVING count(*) >= 16) s
        JOIN num t ON t.unique_id = s.unique_id AND t.pos > s.train_end AND t.pos <= s.train_end + s.size
        JOIN num b ON b.unique_id = s.unique_id AND b.pos = s.train_end - 3 + (t.pos - s.train_end - 1) % 4, {_MODELS})""",
        ("numw", "folds", "num")),
}


def errors(spark, d):
    return B.backtest_errors(I.dense(spark, d), "unique_id", ORIGINS)


def hold(spark, d):
    return B.holdout_forecasts(I.dense(spark, d), "unique_id")


def residuals(spark, d):
    return B.holdout_residuals(I.dense(spark, d), "unique_id")


class Run:
    """Panel, holdout forecasts and training residuals of one run, each written once.

    Status queries read these tables many times, as they would read the stored results of a run.
    """

    def __init__(self, spark, d):
        self.panel = settle(I.dense(spark, d))
        self.hold = settle(B.holdout_forecasts(self.panel, "unique_id"))
        self.residuals = settle(B.holdout_residuals(self.panel, "unique_id"))


def steady(c: str):
    """Only the log model needs rounding: the others use the same four operations in both engines."""
    return F.when(F.col("model") == "ARDrift", F.round(c, 4)).otherwise(F.col(c)).alias(c)


@register(
    "origin_fanout",
    """SELECT t.unique_id, CAST(t.origin AS VARCHAR) AS origin, t.q, t.y, 'train' AS role FROM trainw t
    JOIN states s ON t.unique_id = s.unique_id AND t.origin = s.origin
    UNION ALL SELECT d.unique_id, CAST(s.origin AS VARCHAR), d.q, d.y, 'test' FROM dense d
    JOIN states s ON d.unique_id = s.unique_id AND d.q > s.oq AND d.q <= s.oq + 4""",
    ("trainw", "states", "dense"),
)
def origin_fanout(spark, d):
    return B.fan_out(I.dense(spark, d), "unique_id", ORIGINS).select("unique_id", "origin", "q", "y", "role")


@register(
    "active_at_origin",
    "SELECT unique_id, CAST(origin AS VARCHAR) AS origin, n FROM states", ("states",),
)
def active_at_origin(spark, d):
    s = B.origin_states(I.dense(spark, d), "unique_id", ORIGINS)
    return s.select("unique_id", "origin", F.col("state.n").alias("n"))


@register("mase_scale", "SELECT unique_id, CAST(origin AS VARCHAR) AS origin, round(scale + 1e-7, 3) AS scale FROM states", ("states",))
def mase_scale(spark, d):
    s = B.origin_states(I.dense(spark, d), "unique_id", ORIGINS)
    return s.select("unique_id", "origin", near("state.scale", 3))


def _forecast_query(name: str, model: str):
    @register(
        name,
        f"""SELECT unique_id, CAST(origin AS VARCHAR) AS origin, h, oq + h AS q,
        CASE WHEN model = 'ARDrift' THEN round(pred, 4) ELSE pred END AS pred FROM fc WHERE model = '{model}'""",
        ("fc",),
    )
    def run(spark, d):
        s = B.origin_states(I.dense(spark, d), "unique_id", ORIGINS)
        return B.forecast_at_origins(s, models=[model]).select("unique_id", "origin", "h", "q", steady("pred"))

    return run


for _name, _model in (
    ("forecast_naive", "Naive"), ("forecast_seasonal_naive", "SeasonalNaive"),
    ("forecast_drift", "Drift"), ("forecast_ar_drift", "ARDrift"),
):
    _forecast_query(_name, _model)


@register(
    "baseline_interval",
    "SELECT unique_id, model, h AS step, round(lower + 1e-7, 2) AS lower, round(upper + 1e-7, 2) AS upper FROM hold", ("hold",),
)
def baseline_interval(spark, d):
    return hold(spark, d).select(*KEY, "step", near("lower", 2), near("upper", 2))


@register(
    "backtest_score",
    """SELECT unique_id, CAST(origin AS VARCHAR) AS origin, CAST(ds AS VARCHAR) AS ds, h, model, actual,
    CASE WHEN model = 'ARDrift' THEN round(pred, 4) ELSE pred END AS pred,
    CASE WHEN model = 'ARDrift' THEN round(ae, 4) ELSE ae END AS ae, round(scale + 1e-7, 3) AS scale FROM errs""",
    ("errs",),
)
def backtest_score(spark, d):
    e = errors(spark, d)
    return e.select("unique_id", "origin", "ds", "h", "model", "actual", steady("pred"), steady("ae"), near("scale", 3))


@register(
    "score_join",
    """SELECT f.unique_id, f.h, CAST(f.origin AS VARCHAR) AS origin, f.model, a.y AS actual FROM fc f
    JOIN dense a ON a.unique_id = f.unique_id AND a.q = f.oq + f.h""",
    ("fc", "dense"),
)
def score_join(spark, d):
    """Forecasts that come from elsewhere are joined to actuals on (series, period)."""
    panel = I.dense(spark, d)
    fc = B.forecast_at_origins(B.origin_states(panel, "unique_id", ORIGINS)).drop("ds")
    actual = panel.select("unique_id", "q", F.col("y").alias("actual"))
    return fc.join(actual, ["unique_id", "q"]).select("unique_id", "h", "origin", "model", "actual")


@register(
    "validation_origins",
    """SELECT s.unique_id, CAST(s.origin AS VARCHAR) AS origin, s.role FROM (
      SELECT d.unique_id, o.origin, o.role FROM dense d JOIN (
        SELECT DATE '1997-12-31' AS origin, 'tune' AS role UNION ALL SELECT DATE '1998-06-30', 'tune'
        UNION ALL SELECT origin, 'report' FROM origins) o ON d.ds = o.origin) s""",
    ("dense", "origins"),
)
def validation_origins(spark, d):
    roles = B.origin_table(spark, ORIGINS, TUNING).withColumnRenamed("origin", "ds")
    return I.dense(spark, d).join(F.broadcast(roles), "ds").select("unique_id", F.col("ds").alias("origin"), "role")


@register(
    "timeseries_cv",
    f"""SELECT unique_id, fold, step, CAST(ds AS VARCHAR) AS ds, model, actual, round(pred + 1e-7, CASE WHEN model IN ({_FITTED}) THEN 2 ELSE 4 END) AS pred, n_train
    FROM cvfcall""",
    ("cvfcall",),
)
def timeseries_cv(spark, d):
    c = all_folds(spark, d)
    pred = F.when(F.col("model").isin(*M.FITTED), F.round(F.col("pred") + 1e-7, 2)).otherwise(F.round(F.col("pred") + 1e-7, 4))
    return c.select("unique_id", "fold", "step", "ds", "model", "actual", pred.alias("pred"), "n_train")


@register(
    "align_common_index",
    """SELECT h.unique_id, h.model, h.q, h.actual, m.rate FROM hold h JOIN macro m ON h.q = m.q WHERE m.rate IS NOT NULL""",
    ("hold", "macro"),
)
def align_common_index(spark, d):
    m = I.macro(spark, d).filter(F.col("rate").isNotNull()).select("q", "rate")
    return with_period_columns(hold(spark, d), m, "q", ["rate"]).filter(F.col("rate").isNotNull()).select(*KEY, "q", "actual", "rate")


_TRANSFER_SQL = """SELECT coalesce(a.unique_id, b.unique_id) AS unique_id, coalesce(a.h, b.h) AS h,
    round(b.pred + 1e-7, 4) AS pred, round(a.upper + 1e-7, 2) AS upper FROM (SELECT * FROM hold WHERE model = 'Drift' AND h <= 5) a
    FULL OUTER JOIN (SELECT * FROM hold WHERE model = 'Naive' AND h >= 2) b ON a.unique_id = b.unique_id AND a.h = b.h"""


@register("transfer_merge", _TRANSFER_SQL, ("hold",))
def transfer_merge(spark, d):
    from tidemark.operators.runs import merge_columns_by_key

    h = hold(spark, d)
    old = h.filter((F.col("model") == "Drift") & (F.col("step") <= 5)).select("unique_id", F.col("step").alias("h"), "pred", "upper")
    new = h.filter((F.col("model") == "Naive") & (F.col("step") >= 2)).select("unique_id", F.col("step").alias("h"), "pred")
    m = merge_columns_by_key(old, new, ["unique_id", "h"])
    return m.select("unique_id", "h", near("pred", 4), near("upper", 2))


@register(
    "merge_runs_guarded",
    "SELECT unique_id, CAST(origin AS VARCHAR) AS origin, h, model, CASE WHEN model = 'ARDrift' THEN round(ae, 4) ELSE ae END AS ae FROM errs", ("errs",),
)
def merge_runs_guarded(spark, d):
    """Two runs over the same origins: the second is taken in because both scored the same keys."""
    from tidemark.operators.runs import merge_runs_guarded as merge

    panel = I.dense(spark, d)
    first = B.backtest_errors(panel, "unique_id", ORIGINS, models=["Naive", "SeasonalNaive"])
    second = B.backtest_errors(panel, "unique_id", ORIGINS, models=["Drift", "ARDrift"])
    m = merge(first, second, ["unique_id", "origin"], ["unique_id", "origin", "h", "model", "ae"])
    return m.select("unique_id", "origin", "h", "model", steady("ae"))


@register(
    "union_origins",
    "SELECT unique_id, CAST(origin AS VARCHAR) AS origin, h, pred FROM fc WHERE model = 'Naive'", ("fc",),
)
def union_origins(spark, d):
    """Origins backtested apart and stacked give what one plan over all origins gives."""
    panel = settle(I.dense(spark, d))
    parts = [
        B.forecast_at_origins(B.origin_states(panel, "unique_id", origins), models=["Naive"])
        for origins in (ORIGINS[:5], ORIGINS[5:])
    ]
    return parts[0].unionByName(parts[1]).select("unique_id", "origin", "h", "pred")


@register(
    "sorted_output",
    "SELECT unique_id, CAST(ds AS VARCHAR) AS ds, y FROM dense ORDER BY unique_id, ds", ("dense",),
)
def sorted_output(spark, d):
    """Order is stated at the sink only."""
    return I.dense(spark, d).select("unique_id", "ds", "y").orderBy("unique_id", "ds")


# Fitted models ----------------------------------------------------------------------------------

# The grids of the fitters, and all their recursions as one: simple and trended smoothing start at the
# first value, seasonal smoothing after the first season; errors count after the first season.
CTES["grid"] = (
    """SELECT 'ses' AS kind, i * 0.05::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS g, 2 AS params FROM (SELECT unnest(range(1, 20)) AS i)
    UNION ALL SELECT 'holt', i * 0.1::DOUBLE, b, 0, 4 FROM (SELECT unnest(range(1, 10)) AS i), (SELECT unnest([0.05, 0.1, 0.2, 0.4]::DOUBLE[]) AS b)
    UNION ALL SELECT 'hw', a, b, g, 8 FROM (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS a), (SELECT unnest([0.02, 0.1, 0.3]::DOUBLE[]) AS b),
    (SELECT unnest([0.05, 0.2, 0.5]::DOUBLE[]) AS g)""", ())


def _smoothing_ctes(p: str, key: str, arrays: str, needs: tuple[str, ...]) -> None:
    """The recursions over training parts ``{p}arrays`` (unique_id, ``key``, ys, n, slope, steps), their best grid points and choice,
    and ``{p}fit`` (unique_id, ``key``, model, h, pred) of all fitted models."""
    CTES[f"{p}arrays"] = (arrays, needs)
    CTES[f"{p}smooth"] = (
        f"""SELECT unique_id, {key}, ys, n, slope, kind, a, b, g, params, CASE kind WHEN 'hw' THEN 4 ELSE 1 END AS t,
        CASE kind WHEN 'hw' THEN head ELSE ys[1] END AS level,
        CASE kind WHEN 'hw' THEN (list_sum(ys[5:8]) / 4 - head) / 4 WHEN 'holt' THEN ys[2] - ys[1] ELSE 0 END AS trend,
        CASE kind WHEN 'hw' THEN list_transform(ys[1:4], lambda v: v - head) ELSE [0, 0, 0, 0]::DOUBLE[] END AS season, 0::DOUBLE AS sse
        FROM (SELECT *, list_sum(ys[1:4]) / 4 AS head FROM {p}arrays), grid
        UNION ALL SELECT unique_id, {key}, ys, n, slope, kind, a, b, g, params, t + 1, fresh,
        CASE WHEN kind = 'ses' THEN 0 ELSE b * (fresh - level) + (1 - b) * trend END,
        CASE WHEN kind = 'hw' THEN list_transform(season, lambda v, i: CASE WHEN i = t % 4 + 1 THEN g * (obs - fresh) + (1 - g) * v ELSE v END) ELSE season END,
        sse + CASE WHEN t >= 4 THEN pow(obs - level - trend - s, 2) ELSE 0 END FROM (
          SELECT *, a * (obs - s) + (1 - a) * (level + trend) AS fresh FROM (SELECT *, ys[t + 1] AS obs, season[t % 4 + 1] AS s FROM {p}smooth WHERE t < n))""",
        (f"{p}arrays", "grid"))
    CTES[f"{p}smbest"] = (
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unique_id, {key}, kind ORDER BY sse, a, b, g) AS r,
        (n - 4) * ln(greatest(sse, 1e-12) / (n - 4)) + 2 * params + 2.0 * params * (params + 1) / greatest(n - 4 - params - 1, 1) AS aicc
        FROM {p}smooth WHERE t = n) WHERE r = 1""", (f"{p}smooth",))
    CTES[f"{p}smpick"] = (
        f"SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY unique_id, {key} ORDER BY aicc, params) AS pick FROM {p}smbest) WHERE pick = 1",
        (f"{p}smbest",))
    models = (("HoltWinters", "smbest", "hw", _SMOOTH), ("Theta", "smbest", "ses", _THETA), ("SmoothingChoice", "smpick", None, _SMOOTH),
              ("SimpleSmoothing", "smbest", "ses", _SMOOTH), ("TrendSmoothing", "smbest", "holt", _SMOOTH))
    parts = []
    for model, src, kind, pred in models:
        rows = f"SELECT s.*, unnest(range(1, x.steps + 1)) AS h FROM {p}{src} s JOIN {p}arrays x ON x.unique_id = s.unique_id AND x.{key} = s.{key}"
        only = f" WHERE kind = '{kind}'" if kind else ""
        parts.append(f"SELECT unique_id, {key}, '{model}' AS model, h, n, {pred} AS pred FROM ({rows}){only}")
    CTES[f"{p}fit"] = (" UNION ALL ".join(parts), (f"{p}smbest", f"{p}smpick", f"{p}arrays"))




_smoothing_ctes(
    "t", "origin", """SELECT t.unique_id, t.origin, list(t.y ORDER BY t.q) AS ys, count(*) AS n, regr_slope(t.y, t.q) AS slope, 4 AS steps FROM trainw t
    JOIN states s ON t.unique_id = s.unique_id AND t.origin = s.origin GROUP BY 1, 2""", ("trainw", "states"))
_smoothing_ctes(
    "c", "fold", """SELECT w.unique_id, f.fold, list(w.y ORDER BY w.pos) AS ys, count(*) AS n, regr_slope(w.y, w.pos) AS slope, max(f.size) AS steps FROM num w
    JOIN folds f ON w.unique_id = f.unique_id AND w.pos <= f.train_end GROUP BY 1, 2 HAVING count(*) >= 16 AND max(f.size) > 0""", ("num", "folds"))
_smoothing_ctes(
    "v", "origin", f"""SELECT d.unique_id, o.origin, list(d.y ORDER BY d.q) AS ys, count(*) AS n, regr_slope(d.y, d.q) AS slope, 4 AS steps FROM dense d
    JOIN (SELECT o AS origin, CAST(year(o)*4+quarter(o)-1 AS INTEGER) AS oq FROM (VALUES {", ".join(f"(DATE '{o}')" for o in TUNING)}) t(o)) o ON d.q <= o.oq
    GROUP BY 1, 2 HAVING count(*) >= 12 AND max(d.q) = max(o.oq)""", ("dense",))
CTES |= {
    "errsfit": (
        """SELECT f.unique_id, f.origin, a.ds, f.h, f.model, a.y AS actual, f.pred, abs(a.y - f.pred) AS ae, s.scale FROM tfit f
        JOIN states s ON s.unique_id = f.unique_id AND s.origin = f.origin JOIN dense a ON a.unique_id = f.unique_id AND a.q = s.oq + f.h""",
        ("tfit", "states", "dense")),
    "errsall": (f"SELECT * FROM errs UNION ALL SELECT * FROM errsfit WHERE model IN ({_FITTED})", ("errs", "errsfit")),
    "cvfcall": (
        f"""SELECT unique_id, fold, step, ds, model, actual, pred, n_train FROM cvfc UNION ALL
        SELECT f.unique_id, f.fold, f.h, t.ds, f.model, t.y, f.pred, f.n FROM cfit f JOIN num t ON t.unique_id = f.unique_id AND t.pos = f.n + f.h
        WHERE f.model IN ({_FITTED})""", ("cvfc", "cfit", "num")),
    "tuned": (
        """SELECT *, row_number() OVER (ORDER BY mase_mean, model) = 1 AS chosen FROM (
        SELECT model, avg(mase) AS mase_mean, count(*) AS series_origins FROM (
          SELECT f.unique_id, f.origin, f.model, avg(abs(a.y - f.pred)) / max(s.scale) AS mase FROM vfit f
          JOIN (SELECT unique_id, origin, list_avg(list_transform(range(5, n + 1), lambda i: abs(ys[i] - ys[i - 4]))) AS scale FROM varrays) s
          ON s.unique_id = f.unique_id AND s.origin = f.origin
          JOIN dense a ON a.unique_id = f.unique_id AND a.q = CAST(year(f.origin)*4+quarter(f.origin)-1 AS INTEGER) + f.h
          GROUP BY 1, 2, 3 HAVING max(s.scale) > 0) GROUP BY 1)""", ("vfit", "varrays", "dense")),
}

SETTINGS = ("SimpleSmoothing", "TrendSmoothing", "HoltWinters", "Theta", "SmoothingChoice")


def all_errors(spark, d):
    """Errors of the baselines and of the fitted models in one table; the panel is read once."""
    panel = settle(I.dense(spark, d))
    return B.backtest_errors(panel, "unique_id", ORIGINS).unionByName(B.fitted_errors(panel, "unique_id", ORIGINS))


def all_folds(spark, d):
    """Cross-validated forecasts of the baselines and of the fitted models."""
    panel = settle(I.dense(spark, d))
    return B.cv_forecasts(panel, "unique_id").unionByName(B.cv_fitted(panel, "unique_id").filter("step > 0").drop("seconds", "error"))


def _fitted_sql(src: str, model: str, pred: str) -> str:
    return f"""SELECT unique_id, CAST(origin AS VARCHAR) AS origin, '{model}' AS model, h, round(pred, 2) AS pred, round(pred - 1.96 * sqrt(sse / (n - 4)), 2) AS lower,
    round(pred + 1.96 * sqrt(sse / (n - 4)), 2) AS upper, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, {pred} AS pred FROM {src}, (SELECT unnest([1,2,3,4]) AS h))"""


def _fitted(name: str, model: str, sql: str, need: str):
    @register(name, sql, (need,))
    def run(spark, d):
        f = B.fitted_at_origins(B.origin_arrays(I.dense(spark, d), "unique_id", ORIGINS), "unique_id", [model])
        return f.select("unique_id", "origin", "model", "h", *[F.round(c, 2).alias(c) for c in ("pred", "lower", "upper")], "error")


_fitted("forecast_holt_winters", "HoltWinters", _fitted_sql("(SELECT * FROM tsmbest WHERE kind = 'hw')", "HoltWinters", _SMOOTH), "tsmbest")
_fitted("forecast_theta", "Theta", _fitted_sql("(SELECT * FROM tsmbest WHERE kind = 'ses')", "Theta", _THETA), "tsmbest")
_fitted("forecast_exp_smoothing_select", "SmoothingChoice", _fitted_sql("tsmpick", "SmoothingChoice", _SMOOTH), "tsmpick")


@register(
    "backtest_fitted",
    f"""SELECT unique_id, CAST(origin AS VARCHAR) AS origin, CAST(ds AS VARCHAR) AS ds, h, model, actual, round(pred, 2) AS pred, round(ae, 2) AS ae,
    round(scale + 1e-7, 3) AS scale FROM errsfit WHERE model IN ({_FITTED})""",
    ("errsfit",),
)
def backtest_fitted(spark, d):
    """One pass over each series leaves the state of every grid point at all nine origins."""
    e = B.fitted_errors(I.dense(spark, d), "unique_id", ORIGINS)
    return e.select("unique_id", "origin", "ds", "h", "model", "actual", F.round("pred", 2).alias("pred"), F.round("ae", 2).alias("ae"), near("scale", 3))


@register(
    "cv_failed_folds",
    """SELECT entity, fold, 'HoltWinters' AS model, n - (6 - fold) * size AS n_train, 'needs 8 values, has ' || (n - (6 - fold) * size) AS error
    FROM (SELECT entity, count(*) AS n, CAST(floor(count(*) / 6) AS BIGINT) AS size FROM gappy GROUP BY 1), (SELECT unnest([1,2,3,4,5]) AS fold)
    WHERE size > 0 AND n - (6 - fold) * size < 8""",
    ("gappy",),
)
def cv_failed_folds(spark, d):
    """Short series with no least training length: folds that a fitter cannot use are reported one by one."""
    c = B.cv_fitted(I.gappy(spark, d), "entity", min_train=1, models=["HoltWinters"])
    return c.filter(F.col("error").isNotNull()).select("entity", "fold", "model", "n_train", "error")


@register("tuned_settings", "SELECT model, round(mase_mean, 5) AS mase_mean, series_origins, chosen FROM tuned", ("tuned",))
def tuned_settings(spark, d):
    t = B.tune(I.dense(spark, d), "unique_id", TUNING, ORIGINS, SETTINGS)
    return t.select("model", F.round("mase_mean", 5).alias("mase_mean"), "series_origins", "chosen")


@register(
    "tuned_backtest",
    """SELECT unique_id, CAST(origin AS VARCHAR) AS origin, h, round(pred, 2) AS pred, round(ae, 2) AS ae FROM errsfit
    WHERE model = (SELECT model FROM tuned WHERE chosen)""",
    ("errsfit", "tuned"),
)
def tuned_backtest(spark, d):
    """The setting chosen on the tuning origins, frozen, at the reported ones."""
    panel = settle(I.dense(spark, d))
    e = B.frozen_errors(panel, "unique_id", B.tune(panel, "unique_id", TUNING, ORIGINS, SETTINGS), ORIGINS)
    return e.select("unique_id", "origin", "h", F.round("pred", 2).alias("pred"), F.round("ae", 2).alias("ae"))


def _global(spark, d):
    panel = settle(I.dense(spark, d))
    return panel, M.fit_at_origins(panel, "unique_id", ORIGINS)


def _with_actuals(forecasts, panel):
    actual = panel.select("unique_id", "q", F.col("y").alias("actual"))
    return forecasts.join(actual, ["unique_id", "q"], "left").filter("actual is not null or error is not null").select(
        "unique_id", "origin", "h", "actual", F.round("pred", 2).alias("pred"), "error")


@register("global_gbt_fit")
def global_gbt_fit(spark, d):
    """What each origin's model uses, and how many rounds its held-back quarters allowed."""
    return M.gains_at(_global(spark, d)[1], spark).withColumn("gain", F.round("gain", 6))


@register("global_gbt_recursive")
def global_gbt_recursive(spark, d):
    panel, models = _global(spark, d)
    return _with_actuals(M.forecast_at(models, panel, "unique_id", ORIGINS), panel)


@register("global_gbt_leaderboard")
def global_gbt_leaderboard(spark, d):
    """The boosted model of each origin beside the baselines and the fitted models, in one error table."""
    panel, models = _global(spark, d)
    known = B.backtest_errors(panel, "unique_id", ORIGINS).unionByName(B.fitted_errors(panel, "unique_id", ORIGINS))
    return E.panel_leaderboard(known.unionByName(B.global_errors(models, panel, "unique_id", ORIGINS)), "unique_id")


@register(
    "global_unforecast",
    """SELECT entity, CAST(origin AS VARCHAR) AS origin, CASE WHEN k IS NULL THEN 'no value at the origin' ELSE 'needs 8 changes, has ' || k END AS error
    FROM (SELECT e.entity, o.origin, a.k FROM (SELECT DISTINCT entity FROM gappy) e CROSS JOIN origins o LEFT JOIN (
      SELECT entity, ds, row_number() OVER (PARTITION BY entity ORDER BY q) - 1 AS k FROM gappy) a ON a.entity = e.entity AND a.ds = o.origin)
    WHERE k IS NULL OR k < 8""",
    ("gappy", "origins"),
)
def global_unforecast(spark, d):
    """Short series with gaps: which of them a boosted model cannot forecast at an origin, and why."""
    return M.states_at(I.gappy(spark, d), "entity", ORIGINS).filter("error is not null").select("entity", "origin", "error")


@register("scenario_apply_transfer")
def scenario_apply_transfer(spark, d):
    """The models of the supplier panel applied to the series of another panel: revenue by part type."""
    _, models = _global(spark, d)
    part = I.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    from tidemark.functions.calendar import quarter_end_of_index, quarter_index

    other = settle(
        I.table(spark, d, "lineitem").join(part, "l_partkey")
        .groupBy(F.col("p_type").alias("unique_id"), quarter_index(F.col("l_shipdate")).alias("q"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("y"))
        .withColumn("ds", quarter_end_of_index(F.col("q")))
    )
    return _with_actuals(M.forecast_at(models, other, "unique_id", ORIGINS), other)
