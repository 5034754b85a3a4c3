"""Queries over the monitors: anomalies, drift, confidence, ensembles, status rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluate as E
from tidemark.operators import features as S
from tidemark.operators import forecast as B
from tidemark.operators import monitor as N
from tidemark.plans import inputs as I
from tidemark.plans.catalog import near, register
from tidemark.plans.evaluation import full_sql
from tidemark.plans.forecasts import KEY, Run, hold, residuals
from tidemark.plans.inputs import CTES
from tidemark.session import settle

_ROLL = "OVER (PARTITION BY unique_id ORDER BY q ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
_ONE = "OVER (PARTITION BY unique_id)"

CTES |= {
    "flags": (
        f"""SELECT unique_id, q, ds, y, y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) AS iqr,
        abs((y - avg(y) {_ONE}) / (stddev_samp(y) {_ONE} + 1e-9)) > 2.5 AS zscore,
        coalesce(count(y) {_ROLL} >= 3 AND abs((y - avg(y) {_ROLL}) / CASE WHEN stddev_samp(y) {_ROLL} = 0 THEN 1e-9 ELSE stddev_samp(y) {_ROLL} END) > 2.0, false) AS rolling
        FROM (SELECT *, quantile_cont(y, 0.25) {_ONE} AS q1, quantile_cont(y, 0.75) {_ONE} AS q3 FROM dense)""", ("dense",)),
    "voted": (
        """SELECT *, CAST(iqr AS INTEGER) + CAST(zscore AS INTEGER) + CAST(rolling AS INTEGER) AS votes,
        concat_ws(', ', CASE WHEN iqr THEN 'iqr' END, CASE WHEN zscore THEN 'zscore' END, CASE WHEN rolling THEN 'rolling' END) AS methods,
        iqr AND zscore AND rolling AS consensus FROM flags""", ("flags",)),
    # Live residuals: one-step errors of each model on the holdout rows.
    "ref": (
        """SELECT unique_id, model, avg(residual) AS mu, CASE WHEN stddev_pop(residual) = 0 THEN 1 ELSE stddev_pop(residual) END AS sd
        FROM resids GROUP BY 1, 2""", ("resids",)),
    "live": (
        "SELECT h.unique_id, h.model, h.h AS i, (h.actual - h.pred) AS residual, (h.actual - h.pred - r.mu) / r.sd AS z, r.mu, r.sd FROM hold h "
        "JOIN ref r ON h.unique_id = r.unique_id AND h.model = r.model", ("hold", "ref")),
    "cus": (
        """SELECT unique_id, model, max(greatest(up, dn)) AS cusum_max FROM (
        SELECT unique_id, model, i, cu - least(min(cu) OVER w, 0) AS up, cd - least(min(cd) OVER w, 0) AS dn FROM (
          SELECT *, sum(CASE WHEN i = 1 THEN 0 ELSE z - 0.5 END) OVER w AS cu, sum(CASE WHEN i = 1 THEN 0 ELSE -z - 0.5 END) OVER w AS cd
          FROM live WINDOW w AS (PARTITION BY unique_id, model ORDER BY i ROWS UNBOUNDED PRECEDING))
        WINDOW w AS (PARTITION BY unique_id, model ORDER BY i ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2""", ("live",)),
    "shift": ("SELECT unique_id, model, abs(avg(residual) - max(mu)) / max(sd) AS residual_z FROM live GROUP BY 1, 2", ("live",)),
    "kg": (
        """SELECT unique_id, pos > n_train AS is_live, ln(y) - ln(lag(y) OVER (PARTITION BY unique_id ORDER BY q)) AS g FROM num""", ("num",)),
    "kg2": ("SELECT * FROM kg WHERE g IS NOT NULL", ("kg",)),
    "ks": (
        """SELECT unique_id, max(abs(ft - fl)) AS d, max(n1) AS n1, max(n2) AS n2 FROM (
        SELECT v.unique_id, v.g, count(*) FILTER (WHERE NOT k.is_live AND k.g <= v.g) / CAST(count(*) FILTER (WHERE NOT k.is_live) AS DOUBLE) AS ft,
        count(*) FILTER (WHERE k.is_live AND k.g <= v.g) / CAST(count(*) FILTER (WHERE k.is_live) AS DOUBLE) AS fl,
        count(*) FILTER (WHERE NOT k.is_live) AS n1, count(*) FILTER (WHERE k.is_live) AS n2
        FROM kg2 v JOIN kg2 k ON v.unique_id = k.unique_id GROUP BY 1, 2) GROUP BY 1""", ("kg2",)),
    "kst": ("SELECT DISTINCT n1, n2, CAST(round(d * n1 * n2) AS BIGINT) AS steps FROM ks WHERE n1 > 0 AND n2 > 0 AND NOT isnan(d)", ("ks",)),
    "kspaths": (
        """SELECT n1, n2, steps, 0 AS cell, list_transform(range(0, n2 + 1), lambda j: 0::DOUBLE) AS col FROM kst
        UNION ALL SELECT n1, n2, steps, cell + 1, list_transform(col, lambda v, k: CASE WHEN k <> j + 1 THEN v WHEN cell = 0 THEN 1
          WHEN abs(i * n2 - j * n1) >= steps THEN 0 ELSE (CASE WHEN i > 0 THEN col[j + 1] * i / (i + j) ELSE 0 END) + (CASE WHEN j > 0 THEN col[j] * j / (i + j) ELSE 0 END) END)
        FROM (SELECT *, cell // (n2 + 1) AS i, cell % (n2 + 1) AS j FROM kspaths WHERE cell < (n1 + 1) * (n2 + 1))""", ("kst",)),
    "ksp": (
        """SELECT ks.*, CASE WHEN steps <= 0 THEN 1.0 ELSE least(1, greatest(0, 1 - col[ks.n2 + 1])) END AS p FROM ks LEFT JOIN kspaths t
        ON t.n1 = ks.n1 AND t.n2 = ks.n2 AND t.steps = CAST(round(ks.d * ks.n1 * ks.n2) AS BIGINT) AND cell = (t.n1 + 1) * (t.n2 + 1)""", ("ks", "kspaths")),
    "drift": (
        """SELECT c.unique_id, c.model, k.d, k.p < 0.05 AS ks_drift, c.cusum_max, c.cusum_max > 4 AS cusum_signal, s.residual_z,
        s.residual_z > 3 AS residual_drift, CAST(k.p < 0.05 AS INTEGER) + CAST(c.cusum_max > 4 AS INTEGER) + CAST(s.residual_z > 3 AS INTEGER) AS alerts
        FROM cus c JOIN shift s ON c.unique_id = s.unique_id AND c.model = s.model JOIN ksp k ON k.unique_id = c.unique_id""", ("cus", "shift", "ksp")),
    "conf": (
        """SELECT unique_id, model, step, m AS mape_score, s AS stability_score, h AS horizon_score, c AS ci_score, p AS drift_penalty,
        round(t, 1) AS confidence_score, CASE WHEN t >= 80 THEN 'Very High' WHEN t >= 65 THEN 'High' WHEN t >= 45 THEN 'Medium'
        WHEN t >= 25 THEN 'Low' ELSE 'Very Low' END AS confidence_label FROM (
        SELECT *, round(least(100, greatest(0, m + s + h + c - p)), 6) AS t FROM (
          SELECT f.unique_id, f.model, f.h AS step, round(least(40, greatest(0, 40 * exp(-0.07 * greatest(b.mape, 0)))), 2) AS m,
          round(b.stability * 0.30 + 1e-9, 2) AS s, round(least(20, greatest(5, 20 * exp(-0.18 * (f.h - 1)))), 2) AS h,
          round(CASE WHEN f.pred <= 0 THEN 5.0 ELSE least(10, greatest(0, 10 * exp(-2.5 * (f.upper - f.lower) / abs(f.pred)))) END, 2) AS c,
          CAST(CASE WHEN d.alerts > 0 THEN 15 ELSE 0 END AS DOUBLE) AS p
          FROM hold f JOIN board b ON f.unique_id = b.unique_id AND f.model = b.model
          JOIN drift d ON f.unique_id = d.unique_id AND f.model = d.model))""", ("hold", "board", "drift")),
    # Ensemble weights come from the cross-validation folds inside the training part of each series.
    "wbase": (
        """SELECT unique_id, model, cv_mape_mean AS mape, cv_rmse_pct_mean AS rmse_pct,
        row_number() OVER (PARTITION BY unique_id ORDER BY cv_mape_mean, model) AS mape_rank FROM cvs""", ("cvs",)),
    "weights": (
        """SELECT unique_id, model, mape_rank, round(1 / greatest(mape, 0.01) / sum(1 / greatest(mape, 0.01)) OVER (PARTITION BY unique_id), 4) AS weight
        FROM wbase WHERE mape_rank <= 3""", ("wbase",)),
    "ens": (
        """SELECT h.unique_id, h.h AS step, max(h.actual) AS actual, sum(h.pred * w.weight) AS pred, stddev_pop(h.pred) AS sd
        FROM hold h JOIN weights w ON h.unique_id = w.unique_id AND h.model = w.model GROUP BY 1, 2""", ("hold", "weights")),
    "ensm": ("SELECT *, pred - 1.96 * sd AS lower, pred + 1.96 * sd AS upper FROM ens", ("ens",)),
}


def _report(spark, d, methods=N.DETECTORS):
    return N.detect_anomalies(I.dense(spark, d), "unique_id", "q", "y", methods)


for _m in N.DETECTORS:
    def _detector(method):
        @register(f"anomaly_{method}", f"SELECT unique_id, q, {method} FROM flags", ("flags",))
        def run(spark, d):
            return _report(spark, d, [method]).select("unique_id", "q", method)

    _detector(_m)


@register("anomaly_votes", "SELECT unique_id, q, votes, methods FROM voted WHERE votes >= 1", ("voted",))
def anomaly_votes(spark, d):
    return N.flagged_periods(_report(spark, d)).select("unique_id", "q", "votes", "methods")


@register("detect_anomalies", "SELECT unique_id, q, y, iqr, zscore, rolling, votes, methods, consensus FROM voted", ("voted",))
def detect_anomalies(spark, d):
    return _report(spark, d, ["iqr", "zscore", "rolling", "not_a_detector"]).drop("ds")


@register(
    "anomaly_severity",
    "SELECT unique_id, CAST(ds AS VARCHAR) AS ds, votes, CASE WHEN votes >= 2 THEN 'High' ELSE 'Medium' END AS severity FROM voted WHERE votes >= 1",
    ("voted",),
)
def anomaly_severity(spark, d):
    return N.flagged_periods(_report(spark, d)).select("unique_id", "ds", "votes", "severity")


@register(
    "anomaly_rates",
    "SELECT unique_id, "
    + ", ".join(f"round(avg(CAST({m} AS INTEGER)) * 100, 2) AS {m}_rate" for m in N.DETECTORS)
    + ", count(*) FILTER (WHERE consensus) AS consensus_periods, count(*) AS n FROM voted GROUP BY 1",
    ("voted",),
)
def anomaly_rates(spark, d):
    return N.anomaly_rates(_report(spark, d), "unique_id")


@register("anomaly_consensus", "SELECT unique_id, q FROM voted WHERE consensus", ("voted",))
def anomaly_consensus(spark, d):
    return _report(spark, d).filter("consensus").select("unique_id", "q")


def _live(forecasts):
    return forecasts.select(*KEY, F.col("step").alias("i"), (F.col("actual") - F.col("pred")).alias("residual"))


def _reference(table):
    return N.reference_moments(table, KEY)


@register("cusum", "SELECT unique_id, model, round(cusum_max, 5) AS cusum_max, cusum_max > 4 AS cusum_signal FROM cus", ("cus",))
def cusum(spark, d):
    c = N.cusum(_live(hold(spark, d)), _reference(residuals(spark, d)), KEY, "i")
    return c.select(*KEY, F.round("cusum_max", 5).alias("cusum_max"), "cusum_signal")


@register("residual_shift", "SELECT unique_id, model, round(residual_z, 5) AS residual_z, residual_z > 3 AS residual_drift FROM shift", ("shift",))
def residual_shift(spark, d):
    s = N.residual_shift(_live(hold(spark, d)), _reference(residuals(spark, d)), KEY)
    return s.select(*KEY, F.round("residual_z", 5).alias("residual_z"), "residual_drift")


def _ks(panel):
    split = S.chronological_split(panel, "unique_id", "q")
    growth = N.log_growth(split, "unique_id", "q", "y").withColumn("is_live", ~F.col("is_train"))
    return N.ks_two_sample(growth, ["unique_id"], "growth", "is_live")


@register("ks_two_sample", "SELECT unique_id, round(d, 8) AS ks_statistic, n1 AS n_train, n2 AS n_live, round(p, 6) AS ks_p_value FROM ksp", ("ksp",))
def ks_two_sample(spark, d):
    k = _ks(I.dense(spark, d))
    return k.select("unique_id", F.round("ks_statistic", 8).alias("ks_statistic"), "n_train", "n_live", F.round("ks_p_value", 6).alias("ks_p_value"))


@register("ks_exact_p", "SELECT unique_id, round(d, 6) AS ks_statistic, round(p, 6) AS ks_p_exact FROM ksp", ("ksp",))
def ks_exact_p(spark, d):
    k = N.ks_exact_p(_ks(I.dense(spark, d)))
    return k.select("unique_id", F.round("ks_statistic", 6).alias("ks_statistic"), F.round("ks_p_exact", 6).alias("ks_p_exact"))


def _drift(run):
    live, ref = _live(run.hold), _reference(run.residuals)
    per_model = _ks(run.panel).join(ref.select(*KEY), "unique_id")
    return N.drift_report(per_model, N.cusum(live, ref, KEY, "i"), N.residual_shift(live, ref, KEY), KEY)


_SEVERITY = "CASE alerts WHEN 0 THEN 'None' WHEN 1 THEN 'Mild' WHEN 2 THEN 'Moderate' ELSE 'Severe' END"


@register(
    "drift_report",
    f"""SELECT unique_id, model, round(d, 8) AS ks_statistic, ks_drift, round(cusum_max, 5) AS cusum_max, cusum_signal,
    round(residual_z, 5) AS residual_z, residual_drift, alerts > 0 AS overall_drift, {_SEVERITY} AS severity FROM drift""",
    ("drift",),
)
def drift_report(spark, d):
    r = _drift(Run(spark, d))
    return r.select(
        *KEY, F.round("ks_statistic", 8).alias("ks_statistic"), "ks_drift", F.round("cusum_max", 5).alias("cusum_max"), "cusum_signal",
        F.round("residual_z", 5).alias("residual_z"), "residual_drift", "overall_drift", "severity",
    )


@register("model_health_score", "SELECT unique_id, model, round(100.0 - 25.0 * alerts, 1)::DOUBLE AS model_health_score FROM drift", ("drift",))
def model_health_score(spark, d):
    return _drift(Run(spark, d)).select(*KEY, "model_health_score")


CTES["allseries"] = (
    """SELECT unique_id, model FROM (SELECT unique_id FROM dense UNION SELECT CAST(entity AS VARCHAR) FROM gappy),
    (VALUES ('Naive'), ('SeasonalNaive'), ('Drift'), ('ARDrift')) m(model) GROUP BY 1, 2""", ("dense", "gappy"))


@register(
    "drift_payload",
    f"""SELECT a.unique_id, a.model, coalesce(d.alerts > 0, false) AS drift_detected, CASE WHEN d.alerts IS NULL THEN 'Unavailable' ELSE {_SEVERITY} END AS drift_type,
    round(d.d, 8) AS test_statistic, coalesce(d.cusum_signal, false) AS cusum_signal, coalesce(d.residual_drift, false) AS residual_drift,
    (100.0 - 25.0 * d.alerts)::DOUBLE AS model_health_score FROM allseries a LEFT JOIN drift d ON a.unique_id = d.unique_id AND a.model = d.model""",
    ("allseries", "drift"),
)
def drift_payload(spark, d):
    """Customers have no report: they get the safe default."""
    every = I.dense(spark, d).select("unique_id").union(I.gappy(spark, d).select(F.col("entity").cast("string"))).distinct()
    wanted = every.withColumn("model", F.explode(F.array(*[F.lit(m) for m in B.BASELINES])))
    p = N.drift_payload(wanted, _drift(Run(spark, d)), KEY)
    return p.withColumn("test_statistic", F.round("test_statistic", 8))


def _board(run):
    return E.model_leaderboard(run.hold, run.residuals, "unique_id", "step")


def _status(run):
    """One row per series and model: error, rank and drift, built once for all that is read from it."""
    board = _board(run).select(*KEY, "mape", "stability", "recommended")
    return settle(board.join(_drift(run).select(*KEY, F.col("overall_drift").alias("drift_detected")), KEY, "left"))


def _confidence(run, status=None):
    quality = _status(run) if status is None else status
    return N.confidence_scores(run.hold, quality.filter("drift_detected is not null").select(*KEY, "mape", "stability", "drift_detected"), KEY)


_CONF = ("mape_score", "stability_score", "horizon_score", "ci_score", "drift_penalty", "confidence_score", "confidence_label")


@register("confidence_score", f"SELECT unique_id, model, step, {', '.join(_CONF)} FROM conf", ("conf",))
def confidence_score(spark, d):
    return _confidence(Run(spark, d))


@register(
    "confidence_summary",
    """SELECT unique_id, model, round(avg(confidence_score), 5) AS confidence_mean, min(confidence_score) AS confidence_min,
    max(confidence_score) AS confidence_max FROM conf GROUP BY 1, 2""",
    ("conf",),
)
def confidence_summary(spark, d):
    c = N.confidence_summary(_confidence(Run(spark, d)), KEY)
    return c.withColumn("confidence_mean", F.round("confidence_mean", 5))


@register(
    "confidence_bucket",
    """SELECT unique_id, model, step, CASE WHEN confidence_score >= 75 THEN 'High' WHEN confidence_score >= 45 THEN 'Medium' ELSE 'Low' END AS bucket FROM conf""",
    ("conf",),
)
def confidence_bucket(spark, d):
    return _confidence(Run(spark, d)).select(*KEY, "step", N.dashboard_confidence(F.col("confidence_score")).alias("bucket"))


@register(
    "risk_status",
    """SELECT c.unique_id, c.model, c.step, CASE WHEN d.alerts > 0 THEN 'Elevated' WHEN confidence_score >= 70 THEN 'Stable'
    WHEN confidence_score >= 45 THEN 'Watch' ELSE 'Elevated' END AS risk FROM conf c JOIN drift d ON c.unique_id = d.unique_id AND c.model = d.model""",
    ("conf", "drift"),
)
def risk_status(spark, d):
    c = _confidence(Run(spark, d))
    return c.select(*KEY, "step", N.risk_status(F.col("confidence_score"), F.col("drift_penalty") > 0).alias("risk"))


# Ensembles --------------------------------------------------------------------------------------------

def _quality(panel):
    folds = E.full_metrics(B.cv_forecasts(panel, "unique_id"), ["unique_id", "fold", "model"], "step")
    return E.cv_summary(folds, KEY).select(*KEY, F.col("cv_mape_mean").alias("mape"), F.col("cv_rmse_pct_mean").alias("rmse_pct"))


@register("ensemble_topk", "SELECT unique_id, model, mape_rank FROM wbase WHERE mape_rank <= 3", ("wbase",))
def ensemble_topk(spark, d):
    return N.ensemble_weights(_quality(I.dense(spark, d)), "unique_id", top_k=3).select("unique_id", "model", "mape_rank")


def _share(raw: str) -> str:
    return f"round({raw} / sum({raw}) OVER (PARTITION BY unique_id), 4)"


@register(
    "ensemble_weights",
    "SELECT w.unique_id, w.model, w.weight AS inverse_mape, o.inverse_rmse, o.by_rank, o.equal FROM weights w JOIN (SELECT unique_id, model, "
    f"{_share('1 / greatest(rmse_pct, 0.01)')} AS inverse_rmse, {_share('1.0 / mape_rank')} AS by_rank, {_share('1.0')} AS equal "
    "FROM wbase WHERE mape_rank <= 3) o ON w.unique_id = o.unique_id AND w.model = o.model",
    ("weights", "wbase"),
)
def ensemble_weights(spark, d):
    q = settle(_quality(I.dense(spark, d)))
    out = None
    for strategy, name in (("inverse_mape", "inverse_mape"), ("inverse_rmse", "inverse_rmse"), ("rank", "by_rank"), ("equal", "equal")):
        w = N.ensemble_weights(q, "unique_id", strategy, 3).select(*KEY, F.col("weight").alias(name))
        out = w if out is None else out.join(w, KEY)
    return out


def _ensemble(panel, forecasts):
    return N.ensemble_forecast(forecasts, N.ensemble_weights(_quality(panel), "unique_id", top_k=3), "unique_id", "step")


@register(
    "ensemble_forecast",
    "SELECT unique_id, step, actual, round(pred + 1e-7, 2) AS pred, round(lower + 1e-7, 2) AS lower, round(upper + 1e-7, 2) AS upper FROM ensm", ("ensm",),
)
def ensemble_forecast(spark, d):
    return _ensemble(I.dense(spark, d), hold(spark, d)).select("unique_id", "step", "actual", *[near(c, 2) for c in ("pred", "lower", "upper")])


CTES["ensmetrics"] = (
    full_sql("ensm", "unique_id", "step"), ("ensm",))


@register(
    "ensemble_metrics",
    "SELECT unique_id, mape, smape, mae_pct, rmse_pct, r2, direction_accuracy, bias_pct, theil_u FROM ensmetrics", ("ensmetrics",),
)
def ensemble_metrics(spark, d):
    m = E.full_metrics(_ensemble(I.dense(spark, d), hold(spark, d)), ["unique_id"], "step")
    return m.select("unique_id", "mape", "smape", "mae_pct", "rmse_pct", "r2", "direction_accuracy", "bias_pct", "theil_u")


@register(
    "forecast_lookup_join",
    """SELECT h.unique_id, h.h AS step, h.actual, round(max(CASE WHEN h.model = 'Naive' THEN h.pred END), 4) AS naive, round(max(e.pred), 2) AS ensemble,
    round(coalesce(max(e.lower), max(CASE WHEN h.model = 'Naive' THEN h.lower END)), 2) AS lower_ci,
    round(coalesce(max(e.upper), max(CASE WHEN h.model = 'Naive' THEN h.upper END)), 2) AS upper_ci
    FROM hold h LEFT JOIN (SELECT * FROM ensm WHERE step <= 4) e ON h.unique_id = e.unique_id AND h.h = e.step GROUP BY 1, 2, 3""",
    ("hold", "ensm"),
)
def forecast_lookup_join(spark, d):
    """Forecast rows with the ensemble beside them; its band falls back to the model's own interval."""
    ens = _ensemble(I.dense(spark, d), hold(spark, d)).filter(F.col("step") <= 4).select(
        "unique_id", "step", F.col("pred").alias("ensemble"), F.col("lower").alias("e_lower"), F.col("upper").alias("e_upper")
    )
    base = hold(spark, d).filter(F.col("model") == "Naive")
    return base.join(ens, ["unique_id", "step"], "left").select(
        "unique_id", "step", "actual", F.round("pred", 4).alias("naive"), F.round("ensemble", 2).alias("ensemble"),
        F.round(F.coalesce("e_lower", "lower"), 2).alias("lower_ci"), F.round(F.coalesce("e_upper", "upper"), 2).alias("upper_ci"),
    )


@register(
    "kpi_snapshot",
    """SELECT l.unique_id, l.current_level, CAST(l.latest_ds AS VARCHAR) AS latest_ds, round(e.v, 2) AS forecast_value,
    round((e.v / l.current_level - 1) * 100, 2) AS growth_pct, b.model AS best_model, b.mape AS best_mape, c.s AS confidence_score,
    CASE WHEN d.alerts > 0 THEN 'Elevated' WHEN c.s IS NULL THEN 'Unknown' WHEN c.s >= 70 THEN 'Stable' WHEN c.s >= 45 THEN 'Watch' ELSE 'Elevated' END AS risk
    FROM (SELECT unique_id, arg_max(y, q) AS current_level, max(ds) AS latest_ds FROM dense GROUP BY 1) l
    LEFT JOIN (SELECT unique_id, arg_max(pred, step) AS v FROM ensm GROUP BY 1) e ON e.unique_id = l.unique_id
    LEFT JOIN board b ON b.unique_id = l.unique_id AND b.recommended
    LEFT JOIN (SELECT unique_id, model, arg_max(confidence_score, step) AS s FROM conf GROUP BY 1, 2) c ON c.unique_id = l.unique_id AND c.model = b.model
    LEFT JOIN drift d ON d.unique_id = l.unique_id AND d.model = b.model""",
    ("dense", "ensm", "board", "conf", "drift"),
)
def kpi_snapshot(spark, d):
    run = Run(spark, d)
    status = _status(run)
    drift = status.filter("drift_detected is not null").select(*KEY, "drift_detected")
    levels = run.panel.withColumn("step", F.col("q"))
    k = N.kpi_snapshot(
        levels, _ensemble(run.panel, run.hold), status, _confidence(run, status), drift, "unique_id", "step", run.hold
    )
    return k.select(
        "unique_id", "current_level", "latest_ds", F.round("forecast_value", 2).alias("forecast_value"), "growth_pct",
        "best_model", "best_mape", "confidence_score", "risk",
    )
