"""Fitted models at many ends in one pass, in folds, tuned and frozen, and compared by shared draws."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_forecast import START, panel, walk
from tidemark.operators import forecast as B
from tidemark.operators import models as M
from tidemark.operators import resample as Q

ORIGINS = ["1998-12-31", "1999-12-31", "2000-06-30"]


@pytest.mark.parametrize("model", list(M.ROLLING))
def test_one_pass_leaves_what_copies_would(model):
    y = np.stack([walk(k, 30) for k in range(6)])
    ends = [8, 11, 16, 29, 30]
    for end, (fc, rmse) in zip(ends, M.ROLLING[model](y, ends, 5)):
        (alone, error), = M.ROLLING[model](y[:, :end], [end], 5)
        np.testing.assert_allclose(fc, alone, rtol=1e-12)
        np.testing.assert_allclose(rmse, error, rtol=1e-12)


def test_later_values_change_no_state():
    y = np.stack([walk(k, 30) for k in range(3)])
    other = y.copy()
    other[:, 20:] *= 3
    for model in M.ROLLING:
        a, b = (M.ROLLING[model](v, [12, 20], 4) for v in (y, other))
        for (fa, ra), (fb, rb) in zip(a, b):
            assert (fa == fb).all() and (ra == rb).all()


def test_errors_at_origins_against_a_loop(spark):
    series = {s: walk(k) for k, s in enumerate("abc")}
    series["gap"] = [v if i not in (21, 22) else None for i, v in enumerate(walk(9))]
    series["late"] = [None] * 10 + list(walk(11, 18))
    got = {(r.unique_id, str(r.origin), r.h, r.model): r for r in B.fitted_errors(panel(spark, series), "unique_id", ORIGINS).collect()}
    count = 0
    for s, values in series.items():
        known = [(i, v) for i, v in enumerate(values) if v is not None]
        for o in ORIGINS:
            at = int(o[:4]) * 4 + (int(o[5:7]) - 1) // 3 - START
            train = np.array([v for i, v in known if i <= at])
            if len(train) < 16 or (at, values[at]) not in known:
                continue
            for m in M.FITTED:
                fc = M.FITTERS[m](train[None, :], 4)[0][0]
                for h in range(1, 5):
                    actual = values[at + h] if at + h < len(values) else None
                    if actual is None:
                        assert (s, o, h, m) not in got
                        continue
                    r = got[s, o, h, m]
                    count += 1
                    assert r.pred == pytest.approx(fc[h - 1]) and r.actual == pytest.approx(actual) and r.ae == pytest.approx(abs(actual - fc[h - 1]))
                    assert r.scale == pytest.approx(np.abs(train[4:] - train[:-4]).mean())
    assert len(got) == count > 50


def test_the_panel_is_not_copied_per_origin(spark):
    rows = panel(spark, {"a": walk(1), "b": walk(2)})
    assert B.origin_arrays(rows, "unique_id", ORIGINS).count() == 2
    plan = B.fitted_errors(rows, "unique_id", ORIGINS, models=["Theta"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Generate explode") == 1


def test_folds_of_any_fitter(spark):
    def last(y, horizon):
        return np.repeat(y[:, -1:], horizon, axis=1), np.zeros(len(y))

    def picky(y, horizon):
        if y.shape[1] > 20:
            raise ValueError("no more than 20")
        return last(y, horizon)

    series = {s: walk(k) for k, s in enumerate("ab")}
    rows = panel(spark, series)
    fitters = {"Last": M.rolled(last), "Picky": M.rolled(picky)}
    got = B.cv_fitted(rows, "unique_id", min_train=8, models=["Last", "Picky", "HoltWinters"], fitters=fitters).collect()
    naive = {(r.unique_id, r.fold, r.step): r for r in B.cv_forecasts(rows, "unique_id", min_train=8, models=["Naive"]).collect()}
    for r in got:
        if r.model == "Last":
            n = naive[r.unique_id, r.fold, r.step]
            assert (r.pred, r.actual, r.ds, r.n_train) == (n.pred, n.actual, n.ds, n.n_train)
        if r.model == "Picky":
            assert (r.error == "no more than 20" and r.step == 0 and r.pred is None) == (r.n_train > 20)
        assert r.error is not None or r.seconds >= 0
    assert sum(r.model == "Last" for r in got) == len(naive)
    failed = [(r.unique_id, r.fold) for r in got if r.model == "Picky" and r.error]
    assert len(failed) == len(set(failed)) == 2 * sum(e > 20 for e in (8, 12, 16, 20, 24))


def test_regressors_end_with_the_training_part(spark):
    def follows(y, horizon, x):
        assert x.shape == (len(y), 2, y.shape[1])
        return np.repeat(x[:, 1, -1:], horizon, axis=1), np.zeros(len(y))

    n = 20
    rows = spark.createDataFrame([("a", [float(i) for i in range(n)], [[0.0] * n, [100.0 + i for i in range(n)]], [10, 15], 3)],
                                 "k string, values array<double>, x array<array<double>>, ends array<int>, horizon int")
    got = {(r.end, r.h): (r.pred, r.error) for r in M.fit_rolling(rows, ["k"], "Follows", M.rolled(follows), regressors="x").collect()}
    assert got == {(e, h): (100.0 + e - 1, None) for e in (10, 15) for h in (1, 2, 3)}


def test_memory_follows_a_piece_of_a_batch(spark):
    """However many equal series a batch holds, a fitter sees a piece of them, and every series keeps its own forecasts."""
    def seen(y, horizon):
        return np.stack([y[:, -1], np.full(len(y), float(len(y)))], axis=1)[:, :horizon], np.zeros(len(y))

    n = 2 * M.AT_ONCE + 7
    rows = spark.createDataFrame([(k, [float(k)] * (8 + k % 2), [8], 2) for k in range(n)], "k int, values array<double>, ends array<int>, horizon int")
    got = {(r.k, r.h): r.pred for r in M.fit_rolling(rows.coalesce(1), ["k"], "Seen", M.rolled(seen)).collect()}
    assert {k: v for (k, h), v in got.items() if h == 1} == {k: float(k) for k in range(n)}
    assert max(v for (_, h), v in got.items() if h == 2) <= M.AT_ONCE


def test_settings_are_chosen_on_tuning_origins_only(spark):
    series = {f"s{k}": walk(k) for k in range(5)}
    tuning, settings = ["1998-06-30", "1998-12-31"], ["SimpleSmoothing", "HoltWinters", "Theta"]
    chosen = B.tune(panel(spark, series), "unique_id", tuning, ["1999-12-31"], settings)
    rows = {r.model: r for r in chosen.collect()}
    loop = {}
    for m in settings:
        scaled = []
        for y in series.values():
            for end in (14, 16):
                fc = M.ROLLING[m](y[None, :end], [end], 4)[0][0][0]
                scaled.append(np.abs(fc - y[end : end + 4]).mean() / np.abs(y[4:end] - y[: end - 4]).mean())
        loop[m] = np.mean(scaled)
        assert rows[m].mase_mean == pytest.approx(loop[m]) and rows[m].series_origins == 10
    assert [m for m in settings if rows[m].chosen] == [min(loop, key=loop.get)]
    # What comes after the tuning horizon plays no part.
    other = {k: np.r_[v[:20], v[20:] * 5] for k, v in series.items()}
    again = {r.model: r.mase_mean for r in B.tune(panel(spark, other), "unique_id", tuning, ["1999-12-31"], settings).collect()}
    assert again == {m: r.mase_mean for m, r in rows.items()}
    frozen = B.frozen_errors(panel(spark, series), "unique_id", chosen, ["1999-12-31"]).collect()
    straight = B.fitted_errors(panel(spark, series), "unique_id", ["1999-12-31"], models=[min(loop, key=loop.get)]).collect()
    assert {r.model for r in frozen} == {"Tuned"} and sorted((r.unique_id, r.h, r.pred) for r in frozen) == sorted((r.unique_id, r.h, r.pred) for r in straight)


def test_guards_of_tuning(spark):
    rows = panel(spark, {"a": walk(1)})
    with pytest.raises(ValueError, match="must not be reported"):
        B.tune(rows, "unique_id", ["1998-12-31"], ["1998-12-31"], ["Theta"])
    settings = B.tune(rows, "unique_id", ["1998-12-31"], ["1999-12-31"], ["Theta"])
    with pytest.raises(ValueError, match="not after"):
        B.frozen_errors(rows, "unique_id", settings, ["1998-12-31"])
    with pytest.raises(ValueError, match="not after"):
        B.frozen_errors(rows, "unique_id", settings, ["1998-09-30", "1999-12-31"])


# Shared draws -------------------------------------------------------------------------------------

def scaled(spark, entities, models, seed=1, gaps=()):
    rng = np.random.default_rng(seed)
    rows = [(f"e{e:04d}", dt.date(2000, 1, o + 1), m, float(rng.gamma(2) + k)) for e in range(entities) for o in range(2) for k, m in enumerate(models) if (e, m) not in gaps]
    return spark.createDataFrame(rows, "id string, origin date, model string, mase double"), rows


def test_draws_of_blocks_are_one_multinomial_draw():
    sizes = np.array([5, 0, 12, 3, 7, 40, 1])
    draws = np.stack([Q.block_draws(sizes, b, 4000, 3) for b in range(len(sizes))])
    assert (draws.sum(axis=0) == sizes.sum()).all() and (draws[1] == 0).all()
    np.testing.assert_allclose(draws.mean(axis=1), sizes, rtol=0.06)
    p = sizes / sizes.sum()
    np.testing.assert_allclose(draws.var(axis=1), sizes.sum() * p * (1 - p), rtol=0.12, atol=1e-9)


def test_all_pairs_equal_a_loop_over_pairs(spark):
    gaps = {(k, "c") for k in range(10)}
    table, rows = scaled(spark, 60, ["a", "b", "c"], gaps=gaps)
    got = {r.model: r for r in Q.paired_bootstrap_all(table, "id", "a", reps=500, rows=25).collect()}
    for m in ("b", "c"):
        d = {}
        for e, _, model, v in rows:
            d.setdefault(e, {}).setdefault(model, []).append(v)
        diffs = np.array([np.mean(x[m]) - np.mean(x["a"]) for x in d.values() if m in x])
        r = got[m]
        assert r.entities == len(diffs) and r.mean_diff == pytest.approx(diffs.mean())
        rng = np.random.default_rng(0)
        boots = [diffs[rng.integers(0, len(diffs), len(diffs))].mean() for _ in range(4000)]
        width = np.quantile(boots, 0.975) - np.quantile(boots, 0.025)
        assert r.ci_hi - r.ci_lo == pytest.approx(width, rel=0.2) and r.ci_lo < r.mean_diff < r.ci_hi
        # The same draws whatever other pairs are asked for.
        alone = Q.paired_bootstrap_all(table.filter(F.col("model").isin("a", m)), "id", "a", reps=500, rows=25).collect()[0]
        assert (alone.ci_lo, alone.ci_hi) == pytest.approx((r.ci_lo, r.ci_hi))


def test_shared_draws_do_not_depend_on_partitioning(spark):
    table, _ = scaled(spark, 40, ["a", "b"])
    one, two = (sorted(map(tuple, Q.paired_bootstrap_all(t, "id", "a", reps=100, rows=7).collect())) for t in (table, table.repartition(7)))
    assert [r[0] for r in one] == [r[0] for r in two] == ["b"] and one[0][1:] == pytest.approx(two[0][1:])
