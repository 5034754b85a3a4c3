"""Metrics, scores and tests against hand-computed or brute-force numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import distributions as X
from tidemark.operators import diagnostics as D
from tidemark.operators import evaluate as E
from tidemark.operators import guards as G
from tidemark.operators import significance as T


def frame(spark, actual, pred, key="m"):
    return spark.createDataFrame([(key, i, float(a), float(p)) for i, (a, p) in enumerate(zip(actual, pred))],
                                 "model string, i int, actual double, pred double")


def metrics(spark, actual, pred, **kw):
    return E.full_metrics(frame(spark, actual, pred), ["model"], "i", **kw).first()


ACTUAL = [100, 110, 105, 120, 115, 130, 125, 140]


def test_metric_vector(spark):
    pred = [a + (2 if i % 2 else -2) for i, a in enumerate(ACTUAL)]
    m = metrics(spark, ACTUAL, pred)
    assert m.mae == 2 and m.rmse == 2 and m.mse == 4
    assert m.mape == round(float(np.mean([2 / a for a in ACTUAL]) * 100), 3)
    assert 0 < m.smape < 10
    sst = ((np.array(ACTUAL) - np.mean(ACTUAL)) ** 2).sum()
    assert m.r2 == round(1 - 32 / sst, 4)
    step = np.diff(ACTUAL)
    assert m.theil_u == round(2 / math.sqrt((step**2).mean()), 4)


@pytest.mark.parametrize("actual,pred,bias", [([100] * 3, [110] * 3, 10), ([100] * 3, [90] * 3, -10)])
def test_bias(spark, actual, pred, bias):
    assert metrics(spark, actual, pred).bias_pct == bias


def test_zero_actuals_are_skipped(spark):
    m = metrics(spark, [0, 100], [5, 110])
    assert m.mape == 10 and metrics(spark, [0, 0], [1, 1]).mape is None
    assert metrics(spark, [0, 0], [1, 1]).mae_pct == 100  # mean zero counts as one


@pytest.mark.parametrize("actual,pred,expected", [
    ([1, 2, 1, 3], [1, 2, 1, 3], 100), ([1, 2, 1, 3], [3, 1, 2, 0], 0), ([1], [1], None), ([2, 2, 2], [1, 2, 3], None),
])
def test_direction(spark, actual, pred, expected):
    assert metrics(spark, actual, pred).direction_accuracy == expected


def test_r2_edges(spark):
    assert metrics(spark, [5, 5], [5, 5]).r2 == 1 and metrics(spark, [5, 5], [4, 6]).r2 == 0
    assert metrics(spark, [1, 2, 3], [1, 2, 4], n_features=3).adjusted_r2 is None


def test_stability(spark):
    r = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("a", 2.0), ("b", 3.0), ("b", 3.0)], "model string, residual double")
    got = {x.model: x.stability for x in E.residual_stability(r, ["model"]).collect()}
    v = np.array([1, -1, 2.0])
    assert got["a"] == round(100 - 50 * v.std() / (np.abs(v).mean() + 1e-9), 2) and got["b"] == 100


def test_mase(spark):
    train = spark.createDataFrame([("s", i, float(i + 1)) for i in range(8)], "s string, i int, y double")
    fc = spark.createDataFrame([("s", "m", 9.0, 11.0), ("s", "m", 10.0, 10.0)], "s string, model string, actual double, pred double")
    assert E.mase_of(fc, train, "s", "i").first().mase == 0.25
    assert E.mase_of(fc, train.filter("i < 2"), "s", "i").first().mase is None


def test_composite_equal_models_get_full_weight(spark):
    df = spark.createDataFrame([("s", m, 5.0, 6.0, 7.0, 80.0) for m in "ab"], "s string, model string, mape double, rmse_pct double, mae_pct double, stability double")
    assert [r.composite_score for r in E.composite(df, ["s"]).collect()] == [100.0, 100.0]
    ranks = {r.model: (r.rank, r.recommended) for r in E.ranked(E.composite(df, ["s"]), ["s"]).collect()}
    assert ranks == {"a": (1, True), "b": (2, False)}


def test_composite_hand(spark):
    df = spark.createDataFrame([("s", "a", 1.0, 4.0, 2.0, 50.0), ("s", "b", 3.0, 2.0, 2.0, 90.0)],
                               "s string, model string, mape double, rmse_pct double, mae_pct double, stability double")
    got = {r.model: r.composite_score for r in E.composite(df, ["s"]).collect()}
    assert got == {"a": 55.0, "b": 65.0}  # 35 + 20 and 25 + 20 + 20


def test_leaderboard_median_and_share(spark):
    rows = []
    for s in range(7):
        for m, ae in (("SeasonalNaive", 2.0), ("Naive", float(s))):
            rows.append((str(s), 1, m, ae, 2.0 if s else 0.0))  # series 0 has no usable scale
    e = spark.createDataFrame(rows, "unique_id string, origin int, model string, ae double, scale double")
    got = {r.model: r for r in E.panel_leaderboard(e, "unique_id").collect()}
    assert got["Naive"].mase_mean == 1.75 and got["Naive"].mase_median == 1.75
    assert got["Naive"].share_beats_baseline == round(1 / 6, 4) and got["Naive"].series_origins == 6
    assert got["SeasonalNaive"].share_beats_baseline == 0


def dm(spark, e1, e2, h=1):
    df = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(e1, e2))], "k string, i int, a double, b double")
    return T.diebold_mariano(df, ["k"], "i", "a", "b", h).first()


def test_diebold_mariano(spark):
    same = dm(spark, [1, 2, 3], [1, 2, 3])
    assert (same.dm_stat, same.p_value) == (0.0, 1.0)
    better = dm(spark, [0.1, -0.1] * 10, [1.0, -1.2] * 10)
    assert better.dm_stat < 0 and better.p_value < 0.05
    assert dm(spark, [1, 1, 1], [2, 2, 2]).dm_stat is None  # constant difference: no variance


def test_diebold_mariano_long_horizon(spark):
    rng = np.random.default_rng(3)
    a, b, h = rng.normal(size=25), rng.normal(size=25) * 1.3, 3
    d = a**2 - b**2
    c, n = d - d.mean(), 25
    g = [float(c[k:] @ c[: n - k]) / n for k in range(h)]
    want = d.mean() / math.sqrt((g[0] + 2 * sum(g[1:])) / n) * math.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    assert dm(spark, a, b, h).dm_stat == pytest.approx(want)


@pytest.mark.parametrize("t", [0.3, 2.0, 3.5])
@pytest.mark.parametrize("df", [1, 2, 3, 4, 5, 10, 19, 30])
def test_student_tail(spark, t, df):
    # The density integrated between -t and t.
    x = np.linspace(-t, t, 200_001)
    const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    inside = np.trapezoid(const * (1 + x**2 / df) ** (-(df + 1) / 2), x)
    row = spark.range(1).select(X.student_two_sided(F.lit(t), F.lit(df)).alias("p")).first()
    assert row.p == pytest.approx(1 - inside, abs=1e-8)


@pytest.mark.parametrize("x,df,p", [(5.991465, 2, 0.05), (9.487729, 4, 0.05), (18.307038, 10, 0.05)])
def test_chi2_tail(spark, x, df, p):
    assert spark.range(1).select(X.chi2_tail(F.lit(x), df).alias("p")).first().p == pytest.approx(p, abs=1e-6)


def noise(spark, n=40, seed=5, key="k"):
    v = np.random.default_rng(seed).normal(size=n)
    return v, spark.createDataFrame([(key, i, float(x)) for i, x in enumerate(v)], "k string, i int, x double")


def test_acf_and_pacf_brute_force(spark):
    v, df = noise(spark)
    c = v - v.mean()
    r = [float(c[k:] @ c[: len(c) - k]) / float(c @ c) for k in range(16)]
    got = {x.lag: x.acf for x in T.autocorrelations(df, ["k"], "i", "x").collect()}
    assert len(got) == 15 and all(got[k] == pytest.approx(r[k]) for k in got)
    pacf = {x.lag: x.pacf for x in D.partial_autocorrelations(D.series_arrays(df, ["k"], "i", "x"), ["k"]).collect()}
    for k in (1, 2, 5):  # last coefficient of the Yule-Walker system of order k
        system = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert pacf[k] == pytest.approx(np.linalg.solve(system, r[1 : k + 1])[-1])


def test_arch_brute_force(spark):
    v, df = noise(spark, 60)
    s = v**2
    design = np.column_stack([np.ones(56)] + [s[4 - k : 60 - k] for k in range(1, 5)])
    beta = np.linalg.lstsq(design, s[4:], rcond=None)[0]
    fit = design @ beta
    want = 56 * (1 - ((s[4:] - fit) ** 2).sum() / ((s[4:] - s[4:].mean()) ** 2).sum())
    got = D.arch_lm(D.series_arrays(df, ["k"], "i", "x")).first()
    assert got.arch_stat == pytest.approx(want) and got.no_arch
    short = D.arch_lm(D.series_arrays(df.filter("i < 6"), ["k"], "i", "x")).first()
    assert short.arch_stat is None and short.no_arch is None


def test_shapiro_reference_values(spark):
    # Published example: weights of 11 men, W = 0.79 and p below 0.01.
    v = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(v)], "k string, i int, x double")
    got = D.shapiro_wilk(D.series_arrays(df, ["k"], "i", "x")).first()
    assert got.shapiro_w == pytest.approx(0.7888, abs=2e-3) and got.shapiro_p == pytest.approx(0.0067, abs=2e-3)
    _, normal = noise(spark, 50)
    assert D.shapiro_wilk(D.series_arrays(normal, ["k"], "i", "x")).first().shapiro_normal


def test_adf_and_differencing(spark):
    """Size near 5% on random walks, high power on noise; walks mostly need one difference."""
    rows = []
    for seed in range(200):
        v = np.random.default_rng(seed).normal(size=80)
        for kind, x in (("noise", 100 + v), ("walk", np.exp(5 + 0.05 * np.cumsum(v)))):
            rows += [(kind, seed, i, float(y), math.log(y)) for i, y in enumerate(x)]
    df = spark.createDataFrame(rows, "kind string, seed int, i int, x double, logx double")
    screen = D.adf_screen(D.series_arrays(df, ["kind", "seed"], "i", "logx"))
    share = {r.kind: r.s for r in screen.groupBy("kind").agg(F.avg(F.col("stationary").cast("int")).alias("s")).collect()}
    assert share["noise"] > 0.9 and share["walk"] < 0.1
    d = D.select_differencing(D.series_arrays(df, ["kind", "seed"], "i", "x"))
    count = {(r.kind, r.d): r["count"] for r in d.groupBy("kind", "d").count().collect()}
    assert count["noise", 0] > 180 and count["walk", 1] > 160


def test_health_counts_only_tests_that_ran(spark):
    df = spark.createDataFrame([(True, False, None, True), (None, None, None, None)], "a boolean, b boolean, c boolean, d boolean")
    score, label = T.health([F.col(c) for c in "abcd"])
    got = [(r.s, r.l) for r in df.select(score.alias("s"), label.alias("l")).collect()]
    assert got == [(66.7, "Good"), (0.0, "Poor")]


def test_white_noise_passes(spark):
    _, df = noise(spark, 60, 2)
    assert T.jarque_bera(df, ["k"], "x").first().normal
    assert T.ljung_box(df, ["k"], "i", "x").first().no_autocorrelation
    assert T.ljung_box(df.filter("i < 10"), ["k"], "i", "x").count() == 0


SPLIT = "k string, ds int, train boolean"


def test_temporal_guard(spark):
    ok = spark.createDataFrame([("a", i, i < 6) for i in range(8)], SPLIT)
    G.assert_temporal_split(ok, ["k"], "ds", F.col("train"))
    assert G.temporal_split_table(ok, ["k"], "ds", F.col("train")).first().ok
    overlap = ok.union(spark.createDataFrame([("a", 7, True)], SPLIT))
    with pytest.raises(G.LeakageError):
        G.assert_temporal_split(overlap, ["k"], "ds", F.col("train"))
    with pytest.raises(G.LeakageError):
        G.assert_temporal_split(ok, ["k"], "ds", ~F.col("train"))
    for empty in (ok.filter("train"), ok.filter("not train"), ok.limit(0)):
        with pytest.raises(ValueError):
            G.assert_temporal_split(empty, ["k"], "ds", F.col("train"))


def test_features_known_guard(spark):
    df = spark.createDataFrame([("a", 3), ("a", 5)], "k string, stamp int")
    G.assert_features_known(df, "stamp", F.lit(5))
    with pytest.raises(G.LeakageError):
        G.assert_features_known(df, "stamp", F.lit(4))
    assert G.features_known_table(df, ["k"], "stamp", F.lit(4)).first().late_rows == 1


def test_normal_quantiles(spark):
    from statistics import NormalDist

    v, df = noise(spark, 12)
    got = D.normal_quantiles(D.series_arrays(df, ["k"], "i", "x"), ["k"]).orderBy("pos").collect()
    t = [NormalDist().inv_cdf((i + 0.5) / 12) for i in range(12)]
    assert [r.theoretical for r in got] == pytest.approx(t) and [r.ordered for r in got] == pytest.approx(sorted(v))
    slope, intercept = np.polyfit(t, np.sort(v), 1)
    assert got[0].line_slope == pytest.approx(slope) and got[0].line_intercept == pytest.approx(intercept)


def test_batched_tests_do_not_depend_on_the_batch(spark):
    """Series of many lengths together, each alone, and none at all."""
    rng = np.random.default_rng(4)
    made = {k: list(np.exp(rng.normal(0, 1, k % 13 + 1 + 20 * (k % 2)))) for k in range(40)} | {90: [3.0] * 20, 91: [], 92: [0.0, -1.0] * 9}
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in made.items()], "k int, values array<double>")
    tests = (D.arch_lm, D.shapiro_wilk, D.adf_screen, D.select_differencing, lambda a: D.partial_autocorrelations(a, ["k"]))
    for test in tests:
        whole = sorted(test(df.coalesce(1)).drop("values").collect(), key=str)
        apart = sorted(test(df.repartition(40, "k")).drop("values").collect(), key=str)
        assert len(whole) == len(apart) and test(df.limit(0)).collect() == []
        for a, b in zip(whole, apart):
            assert all(x == y or x == pytest.approx(y, rel=1e-9, abs=1e-12) for x, y in zip(a, b))
    constant = {r.k: r for r in D.shapiro_wilk(df).collect()}
    assert constant[90].shapiro_w is None and constant[91].shapiro_w is None and constant[92].shapiro_w > 0
