"""Queries over single series: lags, rolling statistics, exogenous handling, decomposition, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.frames import with_period_columns
from tidemark.functions import calendar as cal
from tidemark.operators import diagnostics as D
from tidemark.operators import features as S
from tidemark.operators import guards as G
from tidemark.operators import profile as R
from tidemark.operators import significance as T
from tidemark.plans import inputs as I
from tidemark.plans.catalog import near, register
from tidemark.plans.inputs import CTES

W = "OVER (PARTITION BY unique_id ORDER BY q)"


def rolling(agg: str, n: int, part: str = "unique_id") -> str:
    over = f"OVER (PARTITION BY {part} ORDER BY q ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(y) {over} = {n} THEN {agg} {over} END"


CTES |= {
    "num": (
        """SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY q) AS pos,
        count(*) OVER (PARTITION BY unique_id) AS n,
        CAST(floor(count(*) OVER (PARTITION BY unique_id) * 0.8) AS BIGINT) AS n_train FROM dense""", ("dense",)),
    "dl": (f"SELECT *, ln(y) - ln(lag(y) {W}) AS dlog FROM dense", ("dense",)),
    "growth": (f"SELECT *, (y - lag(y, 4) {W}) / lag(y, 4) {W} * 100 AS yoy_growth FROM dense", ("dense",)),
    "withmacro": (
        "SELECT d.unique_id, d.ds, d.q, d.y, m.rate, m.orders_n FROM dense d LEFT JOIN macro m ON d.q = m.q", ("dense", "macro")),
    "exog": (
        """SELECT w.*, n.pos <= n.n_train AS is_train FROM withmacro w JOIN num n
        ON w.unique_id = n.unique_id AND w.q = n.q""", ("withmacro", "num")),
    "exofill1": (
        """SELECT unique_id, q, is_train, CASE WHEN is_train THEN coalesce(
        last_value(rate IGNORE NULLS) OVER (PARTITION BY unique_id, is_train ORDER BY q ROWS UNBOUNDED PRECEDING),
        first_value(rate IGNORE NULLS) OVER (PARTITION BY unique_id, is_train ORDER BY q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        ELSE last_value(rate IGNORE NULLS) OVER (PARTITION BY unique_id, is_train ORDER BY q ROWS UNBOUNDED PRECEDING) END AS rate
        FROM exog""", ("exog",)),
    "exofill": (
        """SELECT unique_id, q, is_train, coalesce(rate, avg(CASE WHEN is_train THEN rate END) OVER (PARTITION BY unique_id), 0.0)
        AS rate FROM exofill1""", ("exofill1",)),
}


def _macro(spark, d):
    joined = with_period_columns(I.dense(spark, d), I.macro(spark, d), "q", ["rate", "orders_n"])
    return joined.select("unique_id", "ds", "q", "y", "rate", "orders_n")


@register(
    "macro_join",
    "SELECT unique_id, CAST(ds AS VARCHAR) AS ds, y, rate, orders_n FROM withmacro", ("withmacro",),
)
def macro_join(spark, d):
    return _macro(spark, d).select("unique_id", "ds", "y", "rate", "orders_n")


@register(
    "positional_lags",
    f"SELECT unique_id, q, lag(y, 1) {W} AS y_t1, lag(y, 4) {W} AS y_t4, lag(y, 8) {W} AS y_t8 FROM dense", ("dense",),
)
def positional_lags(spark, d):
    return S.positional_lags(I.dense(spark, d), "unique_id", "q", "y", [1, 4, 8]).select("unique_id", "q", "y_t1", "y_t4", "y_t8")


@register("yoy_growth", "SELECT unique_id, q, round(yoy_growth, 6) AS yoy_growth FROM growth", ("growth",))
def yoy_growth(spark, d):
    g = S.growth_pct(I.dense(spark, d), "unique_id", "q", "y")
    return g.select("unique_id", "q", F.round("yoy_growth", 6).alias("yoy_growth"))


@register(
    "rolling_mean",
    f"""SELECT unique_id, q, round({rolling('avg(y)', 4)}, 7) AS y_mean_4,
    round({rolling('avg(y)', 8)}, 7) AS y_mean_8 FROM dense""",
    ("dense",),
)
def rolling_mean(spark, d):
    r = S.rolling_mean(I.dense(spark, d), "unique_id", "q", "y", (4, 8))
    return r.select("unique_id", "q", F.round("y_mean_4", 7).alias("y_mean_4"), F.round("y_mean_8", 7).alias("y_mean_8"))


@register(
    "rolling_volatility",
    f"SELECT unique_id, q, round({rolling('stddev_samp(y)', 4)}, 2) AS y_vol_4 FROM dense", ("dense",),
)
def rolling_volatility(spark, d):
    r = S.rolling_volatility(I.dense(spark, d), "unique_id", "q", "y", 4)
    return r.select("unique_id", "q", F.round("y_vol_4", 2).alias("y_vol_4"))


@register(
    "interaction_feature",
    f"""SELECT w.unique_id, w.q, round(w.rate * g.yoy_growth, 4) AS rate_x_growth FROM withmacro w
    JOIN growth g ON w.unique_id = g.unique_id AND w.q = g.q""",
    ("withmacro", "growth"),
)
def interaction_feature(spark, d):
    g = S.growth_pct(_macro(spark, d), "unique_id", "q", "y")
    return S.interaction(g, "rate", "yoy_growth", "x").select("unique_id", "q", F.round("x", 4).alias("rate_x_growth"))


@register(
    "quarter_dummies",
    "SELECT unique_id, q, "
    + ", ".join(f"CASE WHEN quarter(ds) = {k} THEN 1 ELSE 0 END AS q{k}" for k in range(1, 5)) + " FROM dense",
    ("dense",),
)
def quarter_dummies(spark, d):
    return S.quarter_dummies(I.dense(spark, d), "ds").select("unique_id", "q", "q1", "q2", "q3", "q4")


@register(
    "lagged_exog",
    f"""SELECT unique_id, q, lag(rate, 6) {W} AS rate, CAST(lag(ds, 6) {W} AS VARCHAR) AS known_at FROM withmacro""",
    ("withmacro",),
)
def lagged_exog(spark, d):
    return S.lagged_exog(_macro(spark, d), "unique_id", "q", ["rate"], 6).select("unique_id", "q", "rate", "known_at")


def _exog(spark, d):
    return S.chronological_split(_macro(spark, d), "unique_id", "q")


def _filled(spark, d):
    return S.fill_exog(_exog(spark, d), "unique_id", "q", ["rate"], "is_train")


@register("fill_exog", "SELECT unique_id, q, round(rate, 6) AS rate FROM exofill", ("exofill",))
def fill_exog(spark, d):
    return _filled(spark, d).select("unique_id", "q", F.round("rate", 6).alias("rate"))


@register(
    "scale_train_only",
    """SELECT unique_id, q, round((rate - avg(CASE WHEN is_train THEN rate END) OVER p) /
    (CASE WHEN stddev_pop(CASE WHEN is_train THEN rate END) OVER p = 0 THEN 1
     ELSE stddev_pop(CASE WHEN is_train THEN rate END) OVER p END), 5) AS rate
    FROM exofill WINDOW p AS (PARTITION BY unique_id)""",
    ("exofill",),
)
def scale_train_only(spark, d):
    s = S.scale_by_train(_filled(spark, d), "unique_id", ["rate"], F.col("is_train"))
    return s.select("unique_id", "q", F.round("rate", 5).alias("rate"))


@register(
    "scale_complete_rows",
    """SELECT w.unique_id, w.q, round(CASE WHEN rate IS NOT NULL AND y IS NOT NULL THEN (rate - m) / s ELSE rate END, 5) AS rate,
    round(CASE WHEN rate IS NOT NULL AND y IS NOT NULL THEN (y - my) / sy ELSE y END, 4) AS y FROM withmacro w,
    (SELECT avg(rate) AS m, stddev_pop(rate) AS s, avg(y) AS my, stddev_pop(y) AS sy FROM withmacro
     WHERE rate IS NOT NULL AND y IS NOT NULL)""",
    ("withmacro",),
)
def scale_complete_rows(spark, d):
    s = S.scale_complete_rows(_macro(spark, d), ["rate", "y"])
    return s.select("unique_id", "q", F.round("rate", 5).alias("rate"), F.round("y", 4).alias("y"))


@register(
    "difference_lag_features",
    "SELECT unique_id, q, round(dlog, 8) AS dlog, "
    + ", ".join(f"round(lag(dlog, {k}) {W}, 8) AS dlog_l{k}" for k in range(1, 9))
    + ", "
    + ", ".join(f"round({rolling('avg(y)', k)}, 8) AS dlog_mean_{k}" for k in (4, 8))
    + f" FROM (SELECT *, lag(dlog) {W} AS y FROM (SELECT unique_id, q, dlog FROM dl))",
    ("dl",),
)
def difference_lag_features(spark, d):
    f = S.log_diff_features(I.dense(spark, d), "unique_id", "q", "y")
    cols = ["dlog", *[f"dlog_l{k}" for k in range(1, 9)], "dlog_mean_4", "dlog_mean_8"]
    return f.select("unique_id", "q", *[F.round(c, 8).alias(c) for c in cols])


@register("chronological_split", "SELECT unique_id, q, pos <= n_train AS is_train FROM num", ("num",))
def chronological_split(spark, d):
    return S.chronological_split(I.dense(spark, d), "unique_id", "q").select("unique_id", "q", "is_train")


@register(
    "prepend_last_train",
    "SELECT unique_id, q, y, pos <= n_train AS is_train FROM num WHERE pos >= n_train", ("num",),
)
def prepend_last_train(spark, d):
    from tidemark.operators.monitor import live_with_last_train

    split = S.chronological_split(I.dense(spark, d), "unique_id", "q")
    return live_with_last_train(split, "unique_id", "q").select("unique_id", "q", "y", "is_train")


CTES |= {
    "trend": (
        f"""SELECT *, 0.125*lag(y,2) {W} + 0.25*lag(y,1) {W} + 0.25*y + 0.25*lead(y,1) {W} + 0.125*lead(y,2) {W} AS trend
        FROM dense""", ("dense",)),
    "phases": ("SELECT unique_id, quarter(ds) AS ph, avg(y - trend) AS raw FROM trend GROUP BY 1, 2", ("trend",)),
}


@register(
    "seasonal_decompose",
    """SELECT t.unique_id, t.q, round(t.trend + 1e-7, 2) AS trend, round(p.raw - c.centre + 1e-7, 2) AS seasonal,
    round(t.y - t.trend - (p.raw - c.centre) + 1e-7, 2) AS resid FROM trend t
    JOIN phases p ON t.unique_id = p.unique_id AND quarter(t.ds) = p.ph
    JOIN (SELECT unique_id, avg(raw) AS centre FROM phases GROUP BY 1) c ON t.unique_id = c.unique_id""",
    ("trend", "phases"),
)
def seasonal_decompose(spark, d):
    s = S.seasonal_decompose(I.dense(spark, d), "unique_id", "q", "y", F.quarter("ds"))
    return s.select("unique_id", "q", *[near(c, 2) for c in ("trend", "seasonal", "resid")])


@register(
    "acf",
    """SELECT k.lag, c.unique_id, round(sum(c.e * l.e) / max(c.ss), 6) AS acf, round(1.96 / sqrt(max(c.n)), 8) AS band
    FROM (SELECT unique_id, pos, n, y - avg(y) OVER (PARTITION BY unique_id) AS e,
          var_pop(y) OVER (PARTITION BY unique_id) * n AS ss FROM num) c
    JOIN (SELECT unnest(generate_series(1, 15)) AS lag) k ON k.lag <= c.n // 2 - 1
    JOIN (SELECT unique_id, pos, y - avg(y) OVER (PARTITION BY unique_id) AS e FROM num) l
    ON l.unique_id = c.unique_id AND l.pos = c.pos - k.lag GROUP BY 1, 2""",
    ("num",),
)
def acf(spark, d):
    a = T.autocorrelations(I.dense(spark, d), ["unique_id"], "q", "y")
    return a.select("unique_id", "lag", F.round("acf", 6).alias("acf"), F.round("band", 8).alias("band"))


CTES |= {
    "acfs": (
        """SELECT unique_id, list(r ORDER BY lag) AS r FROM (SELECT c.unique_id, k.lag, sum(c.e * l.e) / max(c.ss) AS r
        FROM (SELECT unique_id, pos, n, y - avg(y) OVER (PARTITION BY unique_id) AS e, var_pop(y) OVER (PARTITION BY unique_id) * n AS ss FROM num) c
        JOIN (SELECT unnest(generate_series(1, 15)) AS lag) k ON k.lag <= c.n // 2 - 1
        JOIN (SELECT unique_id, pos, y - avg(y) OVER (PARTITION BY unique_id) AS e FROM num) l ON l.unique_id = c.unique_id AND l.pos = c.pos - k.lag
        GROUP BY 1, 2) GROUP BY 1""", ("num",)),
    "levinson": (
        """SELECT unique_id, r, 1 AS k, [r[1]] AS phi, r[1] AS pacf FROM acfs
        UNION ALL SELECT unique_id, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - fresh * phi[k + 1 - j]), fresh), fresh FROM (
          SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j])))
          / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS fresh FROM levinson WHERE k < len(r))""", ("acfs",)),
}


@register("pacf", "SELECT unique_id, k AS lag, round(pacf, 6) AS pacf FROM levinson", ("levinson",))
def pacf(spark, d):
    arrays = D.series_arrays(I.dense(spark, d), ["unique_id"], "q", "y")
    return D.partial_autocorrelations(arrays, ["unique_id"]).select("unique_id", "lag", F.round("pacf", 6).alias("pacf"))


@register(
    "poly_trend",
    """SELECT n.unique_id, n.q, round(c0 + c1*x + c2*x*x, 2) AS trend FROM
    (SELECT unique_id, q, pos - (n + 1) / 2.0 AS x FROM num) n JOIN (
      SELECT unique_id, (x4*sy - x2*sx2y) / (n*x4 - x2*x2) AS c0, sxy / x2 AS c1, (n*sx2y - x2*sy) / (n*x4 - x2*x2) AS c2 FROM (
        SELECT unique_id, CAST(count(*) AS DOUBLE) AS n, sum(x*x) AS x2, sum(x*x*x*x) AS x4, sum(y) AS sy, sum(x*y) AS sxy, sum(x*x*y) AS sx2y
        FROM (SELECT unique_id, y, CAST(pos - (n + 1) / 2.0 AS DOUBLE) AS x FROM num) GROUP BY 1)) c ON n.unique_id = c.unique_id""",
    ("num",),
)
def poly_trend(spark, d):
    p = S.quadratic_trend(I.dense(spark, d), "unique_id", "q", "y")
    return p.select("unique_id", "q", F.round("trend", 2).alias("trend"))


@register("qq_points")
def qq_points(spark, d):
    growth = S.log_diff_features(I.dense(spark, d), "unique_id", "q", "y", 1, ())
    arrays = D.series_arrays(growth, ["unique_id"], "q", "dlog")
    p = D.normal_quantiles(arrays, ["unique_id"])
    return p.select("unique_id", "pos", *[F.round(c, 6).alias(c) for c in ("theoretical", "ordered", "line_slope", "line_intercept")])


@register(
    "series_kpis",
    """SELECT k.*, s.best_quarter, s.worst_quarter FROM (
      SELECT unique_id, arg_min(y, q) AS first_value, arg_max(y, q) AS latest_value, count(y) AS n,
      round(stddev_samp(y) / avg(y) * 100, 6) AS variation_pct,
      CAST(arg_max(ds, (y, -q)) AS VARCHAR) AS peak_ds, CAST(arg_min(ds, (y, q)) AS VARCHAR) AS trough_ds,
      round((arg_max(y, q) / arg_min(y, q) - 1) * 100, 6) AS total_growth_pct,
      round((pow(arg_max(y, q) / arg_min(y, q), 1 / greatest(count(y) / 4.0, 1.0)) - 1) * 100, 6) AS cagr_pct
      FROM dense GROUP BY 1) k JOIN (
      SELECT unique_id, arg_max(k, m) AS best_quarter, arg_min(k, m) AS worst_quarter FROM (
        SELECT unique_id, quarter(ds) AS k, avg(y) AS m FROM dense GROUP BY 1, 2) GROUP BY 1) s ON k.unique_id = s.unique_id""",
    ("dense",),
)
def series_kpis(spark, d):
    k = R.series_kpis(I.dense(spark, d), "unique_id", "q")
    return k.select(
        "unique_id", "first_value", "latest_value", "n", F.round("variation_pct", 6).alias("variation_pct"), "peak_ds", "trough_ds",
        F.round("total_growth_pct", 6).alias("total_growth_pct"), F.round("cagr_pct", 6).alias("cagr_pct"), "best_quarter", "worst_quarter",
    )


@register(
    "describe_series",
    """SELECT unique_id, count(y) AS n, round(avg(y) + 1e-7, 3) AS mean, round(stddev_samp(y) + 1e-7, 2) AS std, min(y) AS min,
    round(quantile_cont(y, 0.25), 6) AS q25, round(quantile_cont(y, 0.5), 6) AS median, round(quantile_cont(y, 0.75), 6) AS q75, max(y) AS max FROM dense GROUP BY 1""",
    ("dense",),
)
def describe_series(spark, d):
    s = R.describe_series(I.dense(spark, d), "unique_id")
    q = [F.round(c, 6).alias(c) for c in ("q25", "median", "q75")]
    return s.select("unique_id", "n", near("mean", 3), near("std", 2), "min", "max", *q)


_MISSING = ("part_a", "part_n", "part_r", "whole")


@register(
    "missing_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct FROM components"
        for c in _MISSING),
    ("components",),
)
def missing_profile(spark, d):
    m = R.missing_profile(I.components(spark, d), _MISSING)
    return m.select("column_name", "n_missing", F.round("missing_pct", 6).alias("missing_pct"))


@register(
    "growth_pivot",
    "SELECT year(ds) AS year, "
    + ", ".join(f"round(avg(CASE WHEN quarter(ds) = {k} THEN yoy_growth END), 6) AS q{k}" for k in range(1, 5))
    + " FROM growth GROUP BY 1",
    ("growth",),
)
def growth_pivot(spark, d):
    g = S.growth_pct(I.dense(spark, d), "unique_id", "q", "y").withColumn("qtr", F.quarter("ds"))
    p = R.growth_pivot(g)
    return p.select("year", *[F.round(f"q{k}", 6).alias(f"q{k}") for k in range(1, 5)])


@register(
    "histogram_density",
    """SELECT grp, bin, count(*) AS count, round((lo + (bin + 0.5) * w), 6) AS centre, round(count(*) / (n * w), 6) AS density,
    round(exp(-0.5 * pow((lo + (bin + 0.5) * w - mu) / sd, 2)) / (sd * sqrt(2 * pi())), 6) AS normal_density FROM (
      SELECT g.grp, least(CAST(floor((g.dlog - s.lo) / s.w) AS BIGINT), 14) AS bin, s.* EXCLUDE (grp) FROM
      (SELECT quarter(ds) AS grp, dlog FROM dl WHERE dlog IS NOT NULL) g JOIN
      (SELECT quarter(ds) AS grp, min(dlog) AS lo, (max(dlog) - min(dlog)) / 15 AS w, count(dlog) AS n, avg(dlog) AS mu,
       stddev_pop(dlog) AS sd FROM dl WHERE dlog IS NOT NULL GROUP BY 1) s ON g.grp = s.grp)
    GROUP BY grp, bin, lo, w, n, mu, sd""",
    ("dl",),
)
def histogram_density(spark, d):
    g = S.log_diff_features(I.dense(spark, d), "unique_id", "q", "y", 1, ()).withColumn("grp", F.quarter("ds"))
    h = R.histogram_density(g.filter(F.col("dlog").isNotNull()).select("grp", "dlog"), ["grp"], "dlog", few_groups=True)
    return h.select("grp", "bin", "count", *[F.round(c, 6).alias(c) for c in ("centre", "density", "normal_density")])


@register(
    "temporal_split_guard",
    """SELECT unique_id, CAST(max(CASE WHEN pos <= n_train THEN ds END) AS VARCHAR) AS train_end,
    CAST(min(CASE WHEN pos > n_train THEN ds END) AS VARCHAR) AS test_start,
    max(CASE WHEN pos <= n_train THEN ds END) < min(CASE WHEN pos > n_train THEN ds END) AS ok FROM num GROUP BY 1""",
    ("num",),
)
def temporal_split_guard(spark, d):
    split = S.chronological_split(I.dense(spark, d), "unique_id", "q")
    return G.temporal_split_table(split, ["unique_id"], "ds", F.col("is_train"))


@register(
    "features_known_guard",
    f"""SELECT l.unique_id, CAST(max(l.known_at) AS VARCHAR) AS latest_stamp,
    count(*) FILTER (WHERE l.known_at > o.train_end) AS late_rows, count(*) FILTER (WHERE l.known_at > o.train_end) = 0 AS ok FROM
    (SELECT unique_id, q, lag(ds, 6) {W} AS known_at FROM withmacro) l JOIN
    (SELECT unique_id, max(CASE WHEN pos = n_train THEN ds END) AS train_end FROM num GROUP BY 1) o ON l.unique_id = o.unique_id GROUP BY 1""",
    ("withmacro", "num"),
)
def features_known_guard(spark, d):
    from pyspark.sql import Window

    lagged = S.lagged_exog(_exog(spark, d), "unique_id", "q", ["rate"], 6)
    end = F.max(F.when(F.col("is_train"), F.col("ds"))).over(Window.partitionBy("unique_id"))
    return G.features_known_table(lagged.withColumn("train_end", end), ["unique_id"], "known_at", F.col("train_end"))


@register(
    "validate_series",
    "SELECT entity, count(*) AS n, count(y) AS n_known, count(y) >= 8 AS valid FROM summed GROUP BY 1", ("summed",),
)
def validate_series(spark, d):
    from tidemark.operators.panel import component_sum

    return G.validate_series(component_sum(I.components(spark, d), ["part_a", "part_n"]), "entity", "y", 8)


@register("sample_entities", "SELECT unique_id FROM dense GROUP BY 1 ORDER BY md5(unique_id || ':42'), unique_id LIMIT 20", ("dense",))
def sample_entities(spark, d):
    """A seeded sample of entities: hashed order, so the same ids under any partitioning."""
    ids = I.dense(spark, d).select("unique_id").distinct()
    return ids.orderBy(F.md5(F.concat("unique_id", F.lit(":42"))), "unique_id").limit(20)


@register("quarter_end", "SELECT o_orderkey, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS VARCHAR) AS quarter_end FROM orders")
def quarter_end(spark, d):
    return I.table(spark, d, "orders").select("o_orderkey", cal.quarter_end(F.col("o_orderdate")).alias("quarter_end"))
