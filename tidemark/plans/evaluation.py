"""Queries over forecast errors: metrics, scores, leaderboards, tests and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import diagnostics as D
from tidemark.operators import evaluate as E
from tidemark.operators import forecast as B
from tidemark.operators import models as M
from tidemark.operators import monitor as N
from tidemark.operators import profile as R
from tidemark.operators import resample as Q
from tidemark.operators import significance as T
from tidemark.plans import inputs as I
from tidemark.plans.catalog import near, register
from tidemark.plans.forecasts import KEY, all_errors, all_folds, errors, hold, residuals
from tidemark.plans.inputs import CTES

MODELS = [*B.BASELINES, *M.FITTED]


def full_sql(src: str, keys: str, order: str) -> str:
    """Every metric of one group, straight from the definitions."""
    return f"""SELECT {keys}, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e*e)), 4) AS rmse, round(avg(e*e), 4) AS mse,
    round(avg(abs(e)) / avg(actual) * 100, 3) AS mae_pct, round(sqrt(avg(e*e)) / avg(actual) * 100, 3) AS rmse_pct,
    round(avg(e*e) / pow(avg(actual), 2) * 100, 4) AS mse_pct,
    round(avg(CASE WHEN actual <> 0 THEN abs(e / actual) END) * 100, 3) AS mape,
    round(avg(abs(e) / ((abs(actual) + abs(pred)) / 2)) * 100, 3) AS smape,
    round(avg(CASE WHEN actual <> a1 AND pred <> p1 THEN CASE WHEN sign(actual - a1) = sign(pred - p1) THEN 1.0 ELSE 0.0 END END) * 100, 2) AS direction_accuracy,
    round(avg(pred - actual) / avg(actual) * 100, 3) AS bias_pct,
    round(CASE WHEN count(*) > 2 THEN sqrt(avg(CASE WHEN a1 IS NOT NULL THEN e*e END)) / sqrt(avg((actual-a1)*(actual-a1))) END, 4) AS theil_u,
    round(1 - sum(e*e) / (var_pop(actual) * count(*)), 4) AS r2,
    round(CASE WHEN count(*) > 2 THEN 1 - (sum(e*e) / (var_pop(actual) * count(*))) * (count(*) - 1) / (count(*) - 2) END, 4) AS adjusted_r2
    FROM (SELECT *, actual - pred AS e, lag(actual) OVER (PARTITION BY {keys} ORDER BY {order}) AS a1,
    lag(pred) OVER (PARTITION BY {keys} ORDER BY {order}) AS p1 FROM {src}) GROUP BY {keys}"""


_STAB = "round(least(100, greatest(0, 100 - 50 * stddev_pop(residual) / (avg(abs(residual)) + 1e-9))), 2)"


def _norm(c: str, up: bool) -> str:
    lo, hi = f"min({c}) OVER (PARTITION BY unique_id)", f"max({c}) OVER (PARTITION BY unique_id)"
    x = f"({c} - {lo}) / ({hi} - {lo})"
    return f"CASE WHEN {hi} = {lo} THEN 1.0 ELSE {x if up else '1 - ' + x} END"


CTES |= {
    "metrics": (full_sql("hold", "unique_id, model", "h"), ("hold",)),
    "stab": (f"SELECT unique_id, model, {_STAB} AS stability FROM resids GROUP BY 1, 2", ("resids",)),
    "board0": (
        f"""SELECT m.*, s.stability, round((0.35 * {_norm('mape', False)} + 0.25 * {_norm('rmse_pct', False)}
        + 0.20 * {_norm('mae_pct', False)} + 0.20 * {_norm('s.stability', True)}) * 100, 2) AS composite_score
        FROM (SELECT * FROM metrics) m JOIN (SELECT unique_id AS uid, model AS mod, stability FROM stab) s
        ON m.unique_id = s.uid AND m.model = s.mod""", ("metrics", "stab")),
    "board": (
        """SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY composite_score DESC, model) AS rank,
        row_number() OVER (PARTITION BY unique_id ORDER BY composite_score DESC, model) = 1 AS recommended FROM board0""", ("board0",)),
    "mase": (
        """SELECT unique_id, origin, model, avg(ae) / max(scale) AS mase FROM errs GROUP BY 1, 2, 3 HAVING max(scale) > 0""", ("errs",)),
    "maseall": (
        """SELECT unique_id, origin, model, avg(ae) / max(scale) AS mase FROM errsall GROUP BY 1, 2, 3 HAVING max(scale) > 0""", ("errsall",)),
    "cvmall": (full_sql("cvfcall", "unique_id, fold, model", "step"), ("cvfcall",)),
    "cvsall": (
        """SELECT unique_id, model, round(avg(mape), 3) AS cv_mape_mean, round(stddev_samp(mape), 3) AS cv_mape_std,
        round(avg(rmse_pct), 3) AS cv_rmse_pct_mean, round(avg(r2), 4) AS cv_r2_mean,
        round(avg(direction_accuracy), 2) AS cv_direction_mean, count(*) AS cv_folds FROM cvmall GROUP BY 1, 2""", ("cvmall",)),
    "cvm": (full_sql("cvfc", "unique_id, fold, model", "step"), ("cvfc",)),
    "cvs": (
        """SELECT unique_id, model, round(avg(mape), 3) AS cv_mape_mean, round(stddev_samp(mape), 3) AS cv_mape_std,
        round(avg(rmse_pct), 3) AS cv_rmse_pct_mean, round(avg(r2), 4) AS cv_r2_mean,
        round(avg(direction_accuracy), 2) AS cv_direction_mean, count(*) AS cv_folds FROM cvm GROUP BY 1, 2""", ("cvm",)),
    # Student's t tail for n - 1 degrees of freedom as a finite sum, odd and even case.
    "dm": (
        """SELECT unique_id, model, n, dm_stat, 1 - CASE WHEN (n - 1) % 2 = 1 THEN 2 / pi() * (th + sin(th) * cos(th) * coalesce(list_sum(list_transform(
        range(0, (n - 2) // 2), lambda k: sqrt(pi()) / 2 * gamma(k + 1) / gamma(k + 1.5) * pow(cos(th), 2 * k))), 0))
        ELSE sin(th) * list_sum(list_transform(range(0, (n - 1) // 2), lambda k: gamma(k + 0.5) / gamma(k + 1) / sqrt(pi()) * pow(cos(th), 2 * k))) END AS p_value FROM (
        SELECT *, atan(abs(dm_stat) / sqrt(n - 1.0)) AS th FROM (
          SELECT a.unique_id, a.model, count(*) AS n, avg(pow(a.actual - a.pred, 2) - pow(b.actual - b.pred, 2)) /
          sqrt(var_pop(pow(a.actual - a.pred, 2) - pow(b.actual - b.pred, 2)) / count(*)) * sqrt((count(*) - 1.0) / count(*)) AS dm_stat
          FROM hold a JOIN hold b ON a.unique_id = b.unique_id AND a.h = b.h AND b.model = 'SeasonalNaive'
          WHERE a.model <> 'SeasonalNaive' GROUP BY 1, 2))""", ("hold",)),
}


def _full(spark, d):
    return E.full_metrics(hold(spark, d), KEY, "step")


def _board(spark, d):
    return E.model_leaderboard(hold(spark, d), residuals(spark, d), "unique_id", "step")


def _metric(name: str, *cols: str):
    # Squared levels are near 1e12: their fourth decimal is below double precision.
    digits = {"mse": 0, "rmse": 1, "mae": 1}
    shown = ", ".join(f"round({c}, {digits[c]}) AS {c}" if c in digits else c for c in cols)

    @register(name, f"SELECT unique_id, model, {shown} FROM metrics", ("metrics",))
    def run(spark, d):
        return _full(spark, d).select(*KEY, *[F.round(c, digits[c]).alias(c) if c in digits else c for c in cols])


_metric("mae_rmse_mse", "mae", "rmse", "mse", "mae_pct", "rmse_pct", "mse_pct")
_metric("mape", "mape")
_metric("smape", "smape")
_metric("bias_pct", "bias_pct")
_metric("theil_u", "theil_u")
_metric("r2", "r2", "adjusted_r2")
_metric("direction_accuracy", "direction_accuracy")
_metric(
    "full_metrics", "n", "mae", "rmse", "mse", "mae_pct", "rmse_pct", "mse_pct", "mape", "smape", "r2", "adjusted_r2",
    "direction_accuracy", "bias_pct", "theil_u",
)


@register("adjusted_r2", "SELECT unique_id, model, adjusted_r2 FROM metrics", ("metrics",))
def adjusted_r2(spark, d):
    return _full(spark, d).select(*KEY, "adjusted_r2")


@register("bias", "SELECT unique_id, model, round(avg(pred - actual) + 1e-7, 2) AS bias FROM hold GROUP BY 1, 2", ("hold",))
def bias(spark, d):
    return hold(spark, d).groupBy(*KEY).agg(F.round(E.bias() + 1e-7, 2).alias("bias"))


@register("stability", "SELECT unique_id, model, stability FROM stab", ("stab",))
def stability(spark, d):
    return E.residual_stability(residuals(spark, d), KEY)


@register(
    "mase",
    """SELECT h.unique_id, h.model, round(avg(abs(h.actual - h.pred)) / nullif(max(s.scale), 0), 6) AS mase FROM hold h
    JOIN hstate s ON h.unique_id = s.unique_id GROUP BY 1, 2""",
    ("hold", "hstate"),
)
def mase(spark, d):
    train = B.holdout(I.dense(spark, d), "unique_id").filter("is_train").select("unique_id", "q", "y")
    return E.mase_of(hold(spark, d), train, "unique_id", "q").select(*KEY, F.round("mase", 6).alias("mase"))


@register("composite_score", "SELECT unique_id, model, composite_score FROM board", ("board",))
def composite_score(spark, d):
    return _board(spark, d).select(*KEY, "composite_score")


@register("leaderboard_rank", "SELECT unique_id, model, rank, recommended FROM board", ("board",))
def leaderboard_rank(spark, d):
    return _board(spark, d).select(*KEY, "rank", "recommended")


@register(
    "model_leaderboard",
    "SELECT unique_id, model, rank, mape, rmse_pct, mae_pct, r2, stability, composite_score, recommended FROM board", ("board",),
)
def model_leaderboard(spark, d):
    return _board(spark, d).select(*KEY, "rank", "mape", "rmse_pct", "mae_pct", "r2", "stability", "composite_score", "recommended")


@register(
    "normalised_radar",
    "SELECT unique_id, model, "
    + ", ".join(f"round({_norm(c, False)}, 5) AS {c}_norm" for c in ("mape", "rmse_pct", "mae_pct")) + " FROM metrics",
    ("metrics",),
)
def normalised_radar(spark, d):
    r = E.normalised_radar(_full(spark, d), ["unique_id"], ["mape", "rmse_pct", "mae_pct"])
    return r.select(*KEY, *[F.round(f"{c}_norm", 5).alias(f"{c}_norm") for c in ("mape", "rmse_pct", "mae_pct")])


@register(
    "model_badges",
    """SELECT unique_id, model, concat_ws(', ', CASE WHEN rank = 1 THEN 'Production Candidate' END, CASE WHEN rank = 1 THEN 'Best Accuracy' END,
    CASE WHEN stability >= 75 THEN 'Most Stable' END, CASE WHEN mape >= 5 THEN 'Risky' END) AS badges FROM board""",
    ("board",),
)
def model_badges(spark, d):
    return _board(spark, d).select(*KEY, N.model_badges(F.col("rank"), F.col("stability"), F.col("mape")).alias("badges"))


@register(
    "leaderboard_insights",
    """SELECT unique_id, count(*) AS n_models, arg_min(model, rank) AS best_model, arg_min(model, (-stability, model)) AS stable_model,
    arg_min(model, (mape, model)) AS lowest_mape_model, arg_min(model, (-mape, model)) AS worst_model,
    round(max(mape) - min(mape), 5) AS mape_range, round(avg(mape), 5) AS mape_mean FROM board GROUP BY 1""",
    ("board",),
)
def leaderboard_insights(spark, d):
    t = E.leaderboard_insights(_board(spark, d), ["unique_id"])
    return t.withColumns({c: F.round(c, 5) for c in ("mape_range", "mape_mean")})


@register(
    "mape_tiers",
    """SELECT unique_id, CASE WHEN mape < 3 THEN 'excellent' WHEN mape < 6 THEN 'good' ELSE 'fair' END AS tier, count(*) AS n_models,
    string_agg(model, ', ' ORDER BY model) AS models FROM board WHERE mape IS NOT NULL GROUP BY 1, 2""",
    ("board",),
)
def mape_tiers(spark, d):
    return R.mape_tiers(_board(spark, d), ["unique_id"])


@register(
    "forecast_outlook",
    """SELECT unique_id, model, n_periods, round((first_pred / last_actual - 1) * 100, 6) AS vs_actual_pct,
    round((last_pred / first_pred - 1) * 100, 6) AS forecast_growth_pct FROM (
    SELECT unique_id, model, count(*) AS n_periods, arg_max(actual, h) AS last_actual, arg_min(pred, h) AS first_pred,
    arg_max(pred, h) AS last_pred FROM hold GROUP BY 1, 2)""",
    ("hold",),
)
def forecast_outlook(spark, d):
    o = R.forecast_outlook(hold(spark, d), KEY, "step")
    return o.select(*KEY, "n_periods", *[F.round(c, 6).alias(c) for c in ("vs_actual_pct", "forecast_growth_pct")])


@register(
    "holdout_worst_ape",
    "SELECT unique_id, model, round(max(abs((pred - actual) / actual)) * 100, 5) AS worst_ape_pct FROM hold GROUP BY 1, 2", ("hold",),
)
def holdout_worst_ape(spark, d):
    return R.holdout_worst_ape(hold(spark, d), KEY).select(*KEY, F.round("worst_ape_pct", 5).alias("worst_ape_pct"))


# Rolling-origin tables ------------------------------------------------------------------------------

@register(
    "baseline_leaderboard",
    """SELECT m.model, round(avg(m.mase), 4) AS mase_mean, round(median(m.mase), 4) AS mase_median,
    round(avg(CASE WHEN m.mase < b.mase THEN 1.0 ELSE 0.0 END), 4) AS share_beats_baseline, count(*) AS series_origins
    FROM mase m JOIN mase b ON m.unique_id = b.unique_id AND m.origin = b.origin AND b.model = 'SeasonalNaive' GROUP BY 1""",
    ("mase",),
)
def baseline_leaderboard(spark, d):
    """The leaderboard of the closed-form models alone: two shuffles, no Python."""
    return E.panel_leaderboard(errors(spark, d), "unique_id")


@register(
    "series_origin_mase",
    "SELECT unique_id, CAST(origin AS VARCHAR) AS origin, model, round(mase, 6) AS mase FROM maseall", ("maseall",),
)
def series_origin_mase(spark, d):
    m = E.series_origin_mase(all_errors(spark, d), "unique_id")
    return m.select("unique_id", "origin", "model", F.round("mase", 6).alias("mase"))


@register(
    "panel_leaderboard",
    """SELECT m.model, round(avg(m.mase), 4) AS mase_mean, round(median(m.mase), 4) AS mase_median,
    round(avg(CASE WHEN m.mase < b.mase THEN 1.0 ELSE 0.0 END), 4) AS share_beats_baseline, count(*) AS series_origins
    FROM maseall m JOIN maseall b ON m.unique_id = b.unique_id AND m.origin = b.origin AND b.model = 'SeasonalNaive' GROUP BY 1""",
    ("maseall",),
)
def panel_leaderboard(spark, d):
    return E.panel_leaderboard(all_errors(spark, d), "unique_id")


@register(
    "mase_by_origin",
    "SELECT CAST(origin AS VARCHAR) AS origin, "
    + ", ".join(f"round(avg(CASE WHEN model = '{m}' THEN mase END), 4) AS \"{m}\"" for m in MODELS) + " FROM maseall GROUP BY 1",
    ("maseall",),
)
def mase_by_origin(spark, d):
    return E.mase_by_origin(all_errors(spark, d), "unique_id", MODELS)


@register(
    "aggregate_ape",
    """SELECT model, round(avg(abs((p - a) / a)) * 100, 5) AS ape_pct, count(*) AS n_dates FROM (
    SELECT model, ds, sum(actual) AS a, sum(pred) AS p FROM errsall WHERE h = 1 GROUP BY 1, 2) GROUP BY 1""",
    ("errsall",),
)
def aggregate_ape(spark, d):
    a = E.aggregate_ape(all_errors(spark, d))
    return a.select("model", F.round("ape_pct", 5).alias("ape_pct"), "n_dates")


@register(
    "stress_window",
    """SELECT model, round(avg(CASE WHEN ds = DATE '2000-03-31' THEN ae / nullif(scale, 0) END), 5) AS stress,
    round(avg(CASE WHEN ds <> DATE '2000-03-31' THEN ae / nullif(scale, 0) END), 5) AS other FROM errsall WHERE h = 1 GROUP BY 1""",
    ("errsall",),
)
def stress_window(spark, d):
    s = E.stress_window(all_errors(spark, d), "2000-03-31")
    return s.select("model", F.round("stress", 5).alias("stress"), F.round("other", 5).alias("other"))


@register("paired_bootstrap")
def paired_bootstrap(spark, d):
    m = E.series_origin_mase(errors(spark, d), "unique_id")
    return Q.paired_bootstrap(m, "unique_id", "Naive", "SeasonalNaive")


@register(
    "paired_difference",
    """SELECT round(avg(dif), 6) AS mean_diff, count(*) AS entities FROM (
    SELECT unique_id, avg(CASE WHEN model = 'Naive' THEN mase END) - avg(CASE WHEN model = 'SeasonalNaive' THEN mase END) AS dif
    FROM mase GROUP BY 1)""",
    ("mase",),
)
def paired_difference(spark, d):
    m = E.series_origin_mase(errors(spark, d), "unique_id")
    p = Q.paired_bootstrap(m, "unique_id", "Naive", "SeasonalNaive", reps=20)
    return p.select(F.round("mean_diff", 6).alias("mean_diff"), "entities")


@register("paired_bootstrap_all")
def paired_bootstrap_all(spark, d):
    """Every model against the smoothing choice, in one job over shared draws."""
    m = E.series_origin_mase(all_errors(spark, d), "unique_id")
    return Q.paired_bootstrap_all(m, "unique_id", "SmoothingChoice")


@register(
    "paired_differences",
    """SELECT model, round(avg(dif), 6) AS mean_diff, count(*) AS entities FROM (
    SELECT m.unique_id, m.model, avg(m.mase) - any_value(b.base) AS dif FROM maseall m
    JOIN (SELECT unique_id, avg(mase) AS base FROM maseall WHERE model = 'SmoothingChoice' GROUP BY 1) b ON b.unique_id = m.unique_id
    WHERE m.model <> 'SmoothingChoice' GROUP BY 1, 2) GROUP BY 1""",
    ("maseall",),
)
def paired_differences(spark, d):
    m = E.series_origin_mase(all_errors(spark, d), "unique_id")
    p = Q.paired_bootstrap_all(m, "unique_id", "SmoothingChoice", reps=20)
    return p.select("model", F.round("mean_diff", 6).alias("mean_diff"), "entities")


def _cv(spark, d):
    folds = E.full_metrics(all_folds(spark, d), ["unique_id", "fold", "model"], "step")
    return E.cv_summary(folds, KEY)


_CV = ("cv_mape_mean", "cv_mape_std", "cv_rmse_pct_mean", "cv_r2_mean", "cv_direction_mean", "cv_folds")


@register("cv_summary", f"SELECT unique_id, model, {', '.join(_CV)} FROM cvsall", ("cvsall",))
def cv_summary(spark, d):
    return _cv(spark, d).select(*KEY, *_CV)


@register(
    "cv_health_label",
    """SELECT unique_id, model, CASE WHEN cv_mape_mean IS NULL THEN 'N/A' WHEN cv_mape_mean < 2 THEN 'Excellent' WHEN cv_mape_mean < 5 THEN 'Good'
    WHEN cv_mape_mean < 10 THEN 'Fair' ELSE 'Poor' END AS health FROM cvsall""",
    ("cvsall",),
)
def cv_health_label(spark, d):
    return _cv(spark, d).select(*KEY, R.cv_health("cv_mape_mean").alias("health"))


# Significance and residual diagnostics --------------------------------------------------------------

@register("diebold_mariano", "SELECT unique_id, model, n, round(dm_stat, 5) AS dm_stat FROM dm", ("dm",))
def diebold_mariano(spark, d):
    return T.dm_table(hold(spark, d), "unique_id", "step").select(*KEY, "n", F.round("dm_stat", 5).alias("dm_stat"))


@register(
    "dm_table",
    "SELECT unique_id, model, round(dm_stat, 3) AS dm_stat, round(p_value, 4) AS p_value, p_value < 0.05 AS significant_5pct, n FROM dm",
    ("dm",),
)
def dm_table(spark, d):
    t = T.dm_table(hold(spark, d), "unique_id", "step")
    return t.select(*KEY, F.round("dm_stat", 3).alias("dm_stat"), F.round("p_value", 4).alias("p_value"), "significant_5pct", "n")


CTES |= {
    "moments": (
        """SELECT unique_id, model, count(*) AS n, avg(residual) AS mu, avg(pow(residual - mean, 2)) AS m2, avg(pow(residual - mean, 3)) AS m3,
        avg(pow(residual - mean, 4)) AS m4 FROM (SELECT *, avg(residual) OVER (PARTITION BY unique_id, model) AS mean FROM resids) GROUP BY 1, 2""", ("resids",)),
    "jb": ("SELECT unique_id, model, n / 6.0 * (pow(m3, 2) / pow(m2, 3) + pow(m4 / pow(m2, 2) - 3, 2) / 4) AS jb FROM moments", ("moments",)),
    "rc": (
        """SELECT unique_id, model, row_number() OVER (PARTITION BY unique_id, model ORDER BY q) AS i,
        count(*) OVER (PARTITION BY unique_id, model) AS n, residual - avg(residual) OVER (PARTITION BY unique_id, model) AS e FROM resids""", ("resids",)),
    "lb": (
        """SELECT unique_id, model, n, n * (n + 2) * sum(r * r / (n - k)) AS q_stat FROM (
        SELECT a.unique_id, a.model, a.n, k.k, sum(a.e * b.e) / max(v.ss) AS r FROM rc a JOIN (SELECT unnest(generate_series(1, 10)) AS k) k ON true
        JOIN rc b ON a.unique_id = b.unique_id AND a.model = b.model AND b.i = a.i - k.k
        JOIN (SELECT unique_id, model, sum(e * e) AS ss FROM rc GROUP BY 1, 2) v ON v.unique_id = a.unique_id AND v.model = a.model
        WHERE a.n > 10 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""", ("rc",)),
}


@register(
    "jarque_bera",
    "SELECT unique_id, model, round(jb, 5) AS jb, round(exp(-jb / 2), 6) AS p_value, exp(-jb / 2) > 0.05 AS normal FROM jb", ("jb",),
)
def jarque_bera(spark, d):
    t = T.jarque_bera(residuals(spark, d), KEY, "residual")
    return t.select(*KEY, F.round("jb", 5).alias("jb"), F.round("p_value", 6).alias("p_value"), "normal")


@register(
    "ljung_box",
    """SELECT unique_id, model, n, round(q_stat, 5) AS q_stat, round(exp(-q_stat/2) * (1 + q_stat/2 + pow(q_stat/2, 2)/2 + pow(q_stat/2, 3)/6 + pow(q_stat/2, 4)/24), 6) AS p_value
    FROM lb""",
    ("lb",),
)
def ljung_box(spark, d):
    t = T.ljung_box(residuals(spark, d), KEY, "q", "residual")
    return t.select(*KEY, "n", F.round("q_stat", 5).alias("q_stat"), F.round("p_value", 6).alias("p_value"))


@register(
    "residual_stats",
    """SELECT r.unique_id, r.model, count(*) AS n, round(avg(residual) + 1e-7, 2) AS mean, round(stddev_pop(residual) + 1e-7, 2) AS std, round(min(residual) + 1e-7, 3) AS min,
    round(max(residual) + 1e-7, 3) AS max, round(max(m3) / pow(max(m2), 1.5), 5) AS skewness, round(max(m4) / pow(max(m2), 2) - 3, 5) AS kurtosis,
    round(quantile_cont(residual, 0.25) + 1e-7, 2) AS q25, round(quantile_cont(residual, 0.75) + 1e-7, 2) AS q75
    FROM resids r JOIN moments m ON r.unique_id = m.unique_id AND r.model = m.model GROUP BY 1, 2""",
    ("resids", "moments"),
)
def residual_stats(spark, d):
    t = T.residual_stats(residuals(spark, d), KEY, "residual")
    digits = {"mean": 2, "std": 2, "min": 3, "max": 3, "q25": 2, "q75": 2}
    shape = [F.round(c, 5).alias(c) for c in ("skewness", "kurtosis")]
    return t.select(*KEY, "n", *[near(c, k) for c, k in digits.items()], *shape)


def _residual_arrays(spark, d):
    return D.series_arrays(residuals(spark, d), KEY, "q", "residual")


def _sweep(cols: tuple[str, ...], by: str, keys: str) -> str:
    """Take the projection on column ``by`` out of the other columns, per group (one Gram-Schmidt step)."""
    over = f"OVER (PARTITION BY {keys})"
    return ", ".join(f"{c} - {by} * coalesce(sum({c} * {by}) {over} / nullif(sum({by} * {by}) {over}, 0), 0) AS {c}" for c in cols)


CTES |= {
    "arch0": (
        """SELECT * FROM (SELECT unique_id, model, count(*) OVER (PARTITION BY unique_id, model) AS m, s AS y, lag(s, 1) OVER w AS l1, lag(s, 2) OVER w AS l2,
        lag(s, 3) OVER w AS l3, lag(s, 4) OVER w AS l4 FROM (SELECT *, residual * residual AS s FROM resids)
        WINDOW w AS (PARTITION BY unique_id, model ORDER BY q)) WHERE l4 IS NOT NULL AND m > 8""", ("resids",)),
    "arch1": (
        "SELECT unique_id, model, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY unique_id, model) AS {c}" for c in ("y", "l1", "l2", "l3", "l4")) + " FROM arch0",
        ("arch0",)),
    "arch2": (f"SELECT unique_id, model, y, l1, {_sweep(('l2', 'l3', 'l4'), 'l1', 'unique_id, model')} FROM arch1", ("arch1",)),
    "arch3": (f"SELECT unique_id, model, y, l1, l2, {_sweep(('l3', 'l4'), 'l2', 'unique_id, model')} FROM arch2", ("arch2",)),
    "arch4": (f"SELECT unique_id, model, y, l1, l2, l3, {_sweep(('l4',), 'l3', 'unique_id, model')} FROM arch3", ("arch3",)),
    "arch": (
        "SELECT unique_id, model, count(*) * (" + " + ".join(f"coalesce(pow(sum(y * {c}), 2) / nullif(sum({c} * {c}), 0), 0)" for c in ("l1", "l2", "l3", "l4"))
        + ") / nullif(sum(y * y), 0) AS lm FROM arch4 GROUP BY 1, 2", ("arch4",)),
    # Levels (d = -1) and the log series differenced 0, 1 and 2 times, each as its own series.
    "adfin": (
        """SELECT *, row_number() OVER (PARTITION BY unique_id, d ORDER BY q) AS pos, count(*) OVER (PARTITION BY unique_id, d) AS n FROM (
        SELECT unique_id, q, -1 AS d, y AS v FROM dense UNION ALL SELECT unique_id, q, 0, ln(y) FROM dense
        UNION ALL SELECT unique_id, q, 1, dlog FROM dl UNION ALL SELECT unique_id, q, 2, dlog - lag(dlog) OVER (PARTITION BY unique_id ORDER BY q) FROM dl) WHERE v IS NOT NULL""",
        ("dense", "dl")),
    "adf0": (
        """SELECT unique_id, d, lags, y, x, CASE WHEN lags >= 1 THEN l1 ELSE 0 END AS l1, CASE WHEN lags >= 2 THEN l2 ELSE 0 END AS l2, CASE WHEN lags >= 3 THEN l3 ELSE 0 END AS l3
        FROM (SELECT *, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, lag(y, 3) OVER w AS l3 FROM (
          SELECT unique_id, d, pos, n, v - lag(v) OVER p AS y, lag(v) OVER p AS x, CAST(floor(pow(n - 1, 1.0 / 3) + 1e-12) AS BIGINT) AS lags FROM adfin
          WINDOW p AS (PARTITION BY unique_id, d ORDER BY pos)) WINDOW w AS (PARTITION BY unique_id, d ORDER BY pos)) WHERE pos > lags + 1 AND n >= 8""", ("adfin",)),
    "adf1": (
        "SELECT unique_id, d, lags, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY unique_id, d) AS {c}" for c in ("y", "x", "l1", "l2", "l3")) + " FROM adf0", ("adf0",)),
    "adf2": (f"SELECT unique_id, d, lags, l1, {_sweep(('y', 'x', 'l2', 'l3'), 'l1', 'unique_id, d')} FROM adf1", ("adf1",)),
    "adf3": (f"SELECT unique_id, d, lags, l2, {_sweep(('y', 'x', 'l3'), 'l2', 'unique_id, d')} FROM adf2", ("adf2",)),
    "adf4": (f"SELECT unique_id, d, lags, l3, {_sweep(('y', 'x'), 'l3', 'unique_id, d')} FROM adf3", ("adf3",)),
    "adf": (
        """SELECT *, -3.43035 - 6.5393 / m - 16.786 / pow(m, 2) - 79.433 / pow(m, 3) AS c1, -2.86154 - 2.8903 / m - 4.234 / pow(m, 2) - 40.040 / pow(m, 3) AS c5,
        beta / sqrt((syy - beta * beta * sxx) / (m - 2 - lags) / sxx) AS stat FROM (
        SELECT unique_id, d, max(lags) AS lags, count(*) AS m, sum(x * y) / sum(x * x) AS beta, sum(x * x) AS sxx, sum(y * y) AS syy FROM adf4 GROUP BY 1, 2)""", ("adf4",)),
}


@register(
    "arch_lm",
    """SELECT unique_id, model, round(lm, 4) AS arch_stat, round(exp(-lm / 2) * (1 + lm / 2), 4) AS arch_p, exp(-lm / 2) * (1 + lm / 2) > 0.05 AS no_arch FROM arch""",
    ("arch",),
)
def arch_lm(spark, d):
    t = D.arch_lm(_residual_arrays(spark, d))
    return t.select(*KEY, F.round("arch_stat", 4).alias("arch_stat"), F.round("arch_p", 4).alias("arch_p"), "no_arch")


@register("shapiro_wilk")
def shapiro_wilk(spark, d):
    t = D.shapiro_wilk(_residual_arrays(spark, d))
    return t.select(*KEY, F.round("shapiro_w", 4).alias("shapiro_w"), F.round("shapiro_p", 4).alias("shapiro_p"), "shapiro_normal")


@register(
    "adf_screen",
    """SELECT unique_id, round(stat, 4) AS adf_stat, round(c1, 4) AS critical_1, round(c5, 4) AS critical_5, lags AS lags_used, stat <= c5 AS stationary
    FROM adf WHERE d = -1""",
    ("adf",),
)
def adf_screen(spark, d):
    t = D.adf_screen(D.series_arrays(I.dense(spark, d), ["unique_id"], "q", "y"))
    return t.select("unique_id", *[F.round(c, 4).alias(c) for c in ("adf_stat", "critical_1", "critical_5")], "lags_used", "stationary")


@register(
    "select_differencing",
    """SELECT unique_id, coalesce(min(CASE WHEN stat <= c5 THEN d END), 2) AS d FROM adf WHERE d >= 0 GROUP BY 1""", ("adf",),
)
def select_differencing(spark, d):
    return D.select_differencing(D.series_arrays(I.dense(spark, d), ["unique_id"], "q", "y")).select("unique_id", "d")


@register("health_score")
def health_score(spark, d):
    """Share of passed residual tests per series and model; tests that could not run are not counted."""
    r = residuals(spark, d)
    tests = (
        D.shapiro_wilk(D.arch_lm(_residual_arrays(spark, d))).drop("values")
        .join(T.jarque_bera(r, KEY, "residual").select(*KEY, "normal"), KEY)
        .join(T.ljung_box(r, KEY, "q", "residual").select(*KEY, "no_autocorrelation"), KEY, "left")
    )
    score, label = T.health([F.col(c) for c in ("shapiro_normal", "normal", "no_autocorrelation", "no_arch")])
    return tests.select(*KEY, score.alias("health_score"), label.alias("health_label"))


@register(
    "health_score_closed_form",
    """SELECT j.unique_id, j.model, round((CASE WHEN exp(-jb/2) > 0.05 THEN 1 ELSE 0 END + CASE WHEN l.p > 0.05 THEN 1 ELSE 0 END) * 100.0
    / (1 + CASE WHEN l.p IS NOT NULL THEN 1 ELSE 0 END), 1) AS health_score FROM jb j LEFT JOIN (SELECT unique_id, model,
    exp(-q_stat/2) * (1 + q_stat/2 + pow(q_stat/2, 2)/2 + pow(q_stat/2, 3)/6 + pow(q_stat/2, 4)/24) AS p FROM lb) l
    ON j.unique_id = l.unique_id AND j.model = l.model""",
    ("jb", "lb"),
)
def health_score_closed_form(spark, d):
    r = residuals(spark, d)
    t = T.jarque_bera(r, KEY, "residual").select(*KEY, "normal").join(
        T.ljung_box(r, KEY, "q", "residual").select(*KEY, "no_autocorrelation"), KEY, "left"
    )
    return t.select(*KEY, T.health([F.col("normal"), F.col("no_autocorrelation")])[0].alias("health_score"))
