"""Forecasters against brute force, and one series alone against the same series among many."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import quarter_end_of_index
from tidemark.operators import diagnostics as D
from tidemark.operators import features as S
from tidemark.operators import forecast as B
from tidemark.operators import models as M
from tidemark.operators import runs as U

START = 1995 * 4


def panel(spark, series):
    rows = [(s, START + i, float(v)) for s, values in series.items() for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "unique_id string, q int, y double").withColumn("ds", quarter_end_of_index(F.col("q")))


def walk(seed, n=28):
    rng = np.random.default_rng(seed)
    return np.exp(8 + np.cumsum(rng.normal(0.02, 0.05, n)) + 0.1 * np.sin(np.arange(n) * np.pi / 2))


def brute_ar(y, steps):
    d = np.diff(np.log(y))
    phi, c = np.polyfit(d[:-1], d[1:], 1)
    out, level, last = [], np.log(y[-1]), d[-1]
    for _ in range(steps):
        last = c + phi * last
        level += last
        out.append(np.exp(level))
    return out


def test_baselines_at_an_origin(spark):
    y = walk(1)
    got = B.backtest_errors(panel(spark, {"a": y}), "unique_id", ["1999-12-31"])
    table = {(r.model, r.h): r for r in got.collect()}
    train = y[:20]
    slope = (train[-1] - train[0]) / 19
    scale = np.abs(train[4:] - train[:-4]).mean()
    ar = brute_ar(train, 4)
    for h in range(1, 5):
        assert table["Naive", h].pred == pytest.approx(train[-1])
        assert table["SeasonalNaive", h].pred == pytest.approx(train[16 + h - 1])
        assert table["Drift", h].pred == pytest.approx(train[-1] + slope * h)
        assert table["ARDrift", h].pred == pytest.approx(ar[h - 1])
        assert table["Naive", h].actual == pytest.approx(y[19 + h])
        assert table["Naive", h].scale == pytest.approx(scale)
    assert table["Naive", 1].ds == dt.date(2000, 3, 31)


def test_activity_and_missing_actuals(spark):
    full, gone = list(walk(2)), list(walk(3))
    gone[19] = None          # does not report at the origin
    late = [None] * 10 + list(walk(4, 18))   # too little history
    hole = list(walk(5))
    hole[21] = None          # no actual two quarters ahead
    got = B.backtest_errors(panel(spark, {"full": full, "gone": gone, "late": late, "hole": hole}), "unique_id", ["1999-12-31"], models=["Naive"])
    assert sorted((r.unique_id, r.h) for r in got.collect()) == [("full", h) for h in (1, 2, 3, 4)] + [("hole", h) for h in (1, 3, 4)]


def test_one_series_equals_itself_among_many(spark):
    many = {str(k): walk(k) for k in range(12)}
    origins = ["1999-12-31", "2000-06-30"]
    alone = B.backtest_errors(panel(spark, {"7": many["7"]}), "unique_id", origins).collect()
    among = B.backtest_errors(panel(spark, many).repartition(9), "unique_id", origins).filter("unique_id = '7'").collect()
    assert sorted(alone) == sorted(among)


def test_no_future_row_changes_a_forecast(spark):
    y = walk(6)
    shocked = np.concatenate([y[:20], y[20:] * 100])
    preds = [
        sorted((r.model, r.h, r.pred, r.scale) for r in B.backtest_errors(panel(spark, {"a": v}), "unique_id", ["1999-12-31"]).collect())
        for v in (y, shocked)
    ]
    assert preds[0] == preds[1]


def test_fan_out_matches_states(spark):
    p = panel(spark, {str(k): walk(k) for k in range(3)})
    fan = B.fan_out(p, "unique_id", ["1999-12-31", "2000-12-31"])
    n = {(r.unique_id, r.origin): r.n for r in fan.filter("role = 'train'").groupBy("unique_id", "origin").agg(F.count("*").alias("n")).collect()}
    st = {(r.unique_id, r.origin): r.state.n for r in B.origin_states(p, "unique_id", ["1999-12-31", "2000-12-31"]).collect()}
    assert n == st and len(n) == 6


def test_cv_folds(spark):
    folds = B.cv_forecasts(panel(spark, {"a": walk(1, 32)}), "unique_id", models=["Naive"]).collect()
    assert sorted({(r.fold, r.n_train) for r in folds}) == [(3, 17), (4, 22), (5, 27)]  # two folds train too little
    assert all(sum(r.fold == f for r in folds) == 5 for f in (3, 4, 5))


def test_holdout_intervals(spark):
    y = walk(8, 20)
    got = {(r.model, r.step): r for r in B.holdout_forecasts(panel(spark, {"a": y}), "unique_id").collect()}
    sd = np.diff(y[:16]).std(ddof=1)
    assert got["Naive", 3].upper - got["Naive", 3].pred == pytest.approx(1.96 * sd * np.sqrt(3))


def test_tuning_origins_stay_apart(spark):
    assert B.origin_table(spark, ["2000-12-31"], ["1999-12-31"]).count() == 2
    with pytest.raises(ValueError):
        B.origin_table(spark, ["2000-12-31"], ["2000-12-31"])


def fitted(spark, series, model, **kw):
    arrays = D.series_arrays(panel(spark, series), ["unique_id"], "q", "y")
    return {(r.unique_id, r.h): r for r in M.fit_arrays(arrays, ["unique_id"], model, **kw).collect()}


def test_holt_winters_continues_a_seasonal_trend(spark):
    t = np.arange(32)
    y = 100 + 2 * t + np.tile([5.0, -3, 8, -10], 8)
    got = fitted(spark, {"a": y}, "HoltWinters")
    want = 100 + 2 * np.arange(32, 36) + np.array([5.0, -3, 8, -10])
    assert [got["a", h].pred for h in (1, 2, 3, 4)] == pytest.approx(list(want), rel=0.02)
    assert got["a", 1].lower <= got["a", 1].pred <= got["a", 1].upper


def test_theta_matches_a_loop(spark):
    y = walk(9)
    best = None
    for a in np.linspace(0.05, 0.95, 19):
        level, sse = y[0], 0.0
        for t in range(1, len(y)):
            if t >= 4:
                sse += (y[t] - level) ** 2
            level = a * y[t] + (1 - a) * level
        if best is None or sse < best[0]:
            best = (sse, a, level)
    _, a, level = best
    half = np.polyfit(np.arange(len(y)), y, 1)[0] / 2
    want = [level + half * (h - 1 + (1 - (1 - a) ** len(y)) / a) for h in (1, 2, 3, 4)]
    got = fitted(spark, {"a": y, "b": walk(10)}, "Theta")
    assert [got["a", h].pred for h in (1, 2, 3, 4)] == pytest.approx(want)


def test_choice_and_batches(spark):
    trend = {"line": 10 + 3.0 * np.arange(28), "short": [1.0, 2.0, 3.0]}
    got = fitted(spark, trend | {str(k): walk(k) for k in range(5)}, "SmoothingChoice")
    assert [got["line", h].pred for h in (1, 2)] == pytest.approx([94, 97], rel=1e-6)
    assert got["short", 0].error and got["short", 0].pred is None  # reported, not raised


def test_user_fitter_and_failure(spark):
    def last(y, horizon):
        return np.repeat(y[:, -1:], horizon, axis=1), np.zeros(len(y))

    def broken(y, horizon):
        raise RuntimeError("no fit")

    assert fitted(spark, {"a": walk(1)}, "Mine", fitter=last)["a", 4].pred == pytest.approx(walk(1)[-1])
    assert "no fit" in fitted(spark, {"a": walk(1)}, "Mine", fitter=broken)["a", 0].error


def test_global_model_learns_a_shared_pattern(spark):
    cycle = np.tile([1.0, 1.2, 0.9, 1.05], 8)
    p = panel(spark, {str(k): (100 + k) * cycle * np.exp(0.01 * np.arange(32)) for k in range(20)}).cache()
    model = M.fit_global(p, "unique_id", "2001-12-31", max_iter=20)
    f = M.forecast_global(model, p, "unique_id", "2001-12-31").join(p.select("unique_id", "q", "y"), ["unique_id", "q"])
    ape = f.agg(F.avg(F.abs(F.col("pred") / F.col("y") - 1))).first()[0]
    assert f.count() == 80 and ape < 0.05


def global_panel(spark):
    cycle = np.tile([1.0, 1.2, 0.9, 1.05], 8)
    series = {str(k): list((100 + k) * cycle * np.exp(0.01 * np.arange(32))) for k in range(20)}
    series |= {"young": [None] * 23 + list(5.0 * cycle[:9]), "gone": list(7.0 * cycle[:20]) + [None] * 12, "zero": list(3.0 * cycle[:25]) + [0.0] + list(cycle[:6])}
    return panel(spark, series).cache()


def test_boosted_models_at_every_origin(spark):
    """A model per origin; what cannot be forecast is named; no value after an origin is used."""
    p, origins = global_panel(spark), ["1999-12-31", "2001-12-31"]
    models = M.fit_at_origins(p, "unique_id", origins, max_iter=30, least_rows=5)
    assert list(models) == origins and all(1 <= m.getNumTrees <= 30 for m in models.values())
    rows = M.forecast_at(models, p, "unique_id", origins).collect()
    got = {(r.unique_id, str(r.origin), r.h): r for r in rows}
    assert len(got) == len(rows) and {k[0] for k in got} == {r.unique_id for r in p.select("unique_id").distinct().collect()}
    assert got["young", origins[0], 0].error == "no value at the origin" == got["gone", origins[1], 0].error
    assert got["young", origins[1], 0].error == "needs 8 changes, has 4" and got["zero", origins[1], 0].error.startswith("needs 8 changes, has ")
    actual = {(r.unique_id, r.q): r.y for r in p.collect()}
    assert all(r.pred == pytest.approx(actual[r.unique_id, r.q], rel=0.06) for r in rows if r.h > 0 and r.unique_id.isdigit())
    changed = p.withColumn("y", F.when(F.col("ds") > F.lit(origins[0]).cast("date"), F.col("y") * 3).otherwise(F.col("y")))
    again = M.forecast_at(M.fit_at_origins(changed, "unique_id", origins[:1], max_iter=30, least_rows=5), changed, "unique_id").collect()
    first = {(i, h): r.pred for (i, o, h), r in got.items() if o == origins[0] and h}
    assert {(r.unique_id, r.h): r.pred for r in again if r.h} == pytest.approx(first) and len(first) == 22 * 4


def test_origins_without_rows_get_no_model(spark):
    p = global_panel(spark)
    models = M.fit_at_origins(p, "unique_id", ["1994-12-31", "2001-12-31"], max_iter=3, least_rows=5)
    assert list(models) == ["2001-12-31"]
    rows = M.forecast_at(models, p, "unique_id", ["1994-12-31", "2001-12-31"]).filter("origin = '1994-12-31'").collect()
    assert len(rows) == 23 and {r.h for r in rows} == {0} and all(r.error for r in rows)
    assert M.forecast_at({}, p, "unique_id", ["2001-12-31"]).count() == 23
    errors = B.global_errors(models, p, "unique_id", ["1994-12-31", "2001-12-31"])
    assert errors.columns == B.backtest_errors(p, "unique_id", ["2001-12-31"]).columns and errors.count() == 80


def test_boosting_deals_rows_into_few_tasks(spark):
    """Each level of each tree is a job: however finely the panel is cut, its tasks follow the cores."""
    p = global_panel(spark)
    settings = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    sc = spark.sparkContext
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sc.setJobGroup("boosting", "")
        models = M.fit_at_origins(p, "unique_id", ["1999-12-31", "2001-12-31"], max_iter=2, least_rows=5)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = sc.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("boosting")]
    stages = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
    tasks = [s.numTasks for s in stages if s and "RandomForest" in s.name]
    assert len(models) == 2 and tasks and max(tasks) <= M.parts_of(1000, sc.defaultParallelism)
    assert M.parts_of(10, 12) == 6 and M.parts_of(40_000_000, 12) == 20


def test_exog_never_flows_from_test_to_train(spark):
    rows = [("a", i, v, i < 4) for i, v in enumerate([None, 2.0, None, 4.0, None, 8.0, None])]
    df = spark.createDataFrame(rows, "s string, q int, x double, train boolean")
    got = [r.x for r in S.fill_exog(df, "s", "q", ["x"], "train").orderBy("q").collect()]
    assert got == [2, 2, 2, 4, 2.5, 8, 8]  # the first test row takes the train mean, not the value before it
    empty = S.fill_exog(df.withColumn("x", F.lit(None).cast("double")), "s", "q", ["x"], "train")
    assert {r.x for r in empty.collect()} == {0.0}


def test_scaler_uses_train_only(spark):
    df = spark.createDataFrame([("a", float(v), i < 4) for i, v in enumerate([1, 2, 3, 4, 100])], "s string, x double, train boolean")
    z = S.scale_by_train(df, "s", ["x"], F.col("train"))
    train = np.array([r.x for r in z.filter("train").collect()])
    assert train.mean() == pytest.approx(0) and train.std() == pytest.approx(1)
    assert z.filter("not train").first().x > 10


def test_split_fraction(spark):
    with pytest.raises(ValueError):
        S.chronological_split(panel(spark, {"a": walk(1)}), "unique_id", "q", 1.0)
    s = S.chronological_split(panel(spark, {"a": walk(1, 11)}), "unique_id", "q")
    assert s.filter("is_train").count() == 8 and s.filter("not is_train").agg(F.min("pos")).first()[0] == 9


def test_merge_runs_guard(spark):
    a = spark.createDataFrame([("x", 1, "m1", 1.0), ("y", 1, "m1", 2.0)], "id string, o int, model string, ae double")
    b = a.withColumn("model", F.lit("m2"))
    cols = ["id", "o", "model", "ae"]
    assert U.merge_runs_guarded(a, b, ["id", "o"], cols).count() == 4
    stale = U.merge_runs_guarded(a, b.filter("id = 'x'"), ["id", "o"], cols).collect()
    assert {r.model for r in stale} == {"m1"} and len(stale) == 2


def test_one_failing_series_does_not_void_its_batch(spark):
    def picky(matrix, horizon):
        if (matrix == 13).any():
            raise ValueError("thirteen")
        return np.repeat(matrix[:, -1:], horizon, axis=1), np.zeros(len(matrix))

    arrays = spark.createDataFrame([("a", [1.0] * 8), ("b", [13.0] * 8), ("c", [2.0] * 8), ("d", [1.0])], "unique_id string, values array<double>").coalesce(1)
    got = {(r.unique_id, r.h): (r.pred, r.error) for r in M.fit_arrays(arrays, ["unique_id"], "Picky", 2, fitter=picky).collect()}
    assert got[("a", 2)] == (1.0, None) and got[("c", 1)] == (2.0, None) and got[("b", 0)] == (None, "thirteen") and ("d", 0) in got
