"""Monitors against loops and hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import monitor as N


def series(spark, values, key="s"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "s string, i int, y double")


def report(spark, values, methods=N.DETECTORS):
    return N.detect_anomalies(series(spark, values), "s", "i", "y", methods)


def test_detectors_against_loops(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=60)
    v[[10, 40]] = [6, -7]
    got = report(spark, v).orderBy("i").collect()
    q1, q3 = np.quantile(v, [0.25, 0.75])
    for i, r in enumerate(got):
        assert r.iqr == (v[i] < q1 - 1.5 * (q3 - q1) or v[i] > q3 + 1.5 * (q3 - q1))
        assert r.zscore == (abs((v[i] - v.mean()) / (v.std(ddof=1) + 1e-9)) > 2.5)
        w = v[max(0, i - 5) : i + 1]
        assert r.rolling == (len(w) >= 3 and abs((v[i] - w.mean()) / w.std(ddof=1)) > 2)
    assert got[10].votes >= 2 and "iqr, zscore" in got[10].methods


def test_five_points_never_trip_the_rolling_detector(spark):
    assert report(spark, [1, 1, 1, 1, 1000]).filter("rolling").count() == 0
    assert report(spark, [1, 1, 1, 1, 1, 1000]).filter("rolling").count() == 1


def test_nulls_dropped_and_unknown_methods_skipped(spark):
    r = report(spark, [1, None, 2, 3], ["iqr", "nonsense"])
    assert r.count() == 3 and "nonsense" not in r.columns
    assert report(spark, [5, 5, 5, 5]).filter("votes > 0").count() == 0


def test_severity_and_rates(spark):
    v = [10.0, 11, 9, 10, 11, 9, 10, 11, 9, 10, 11, 200]
    r = report(spark, v)
    assert [x.severity for x in N.flagged_periods(r).collect()] == ["High"]
    assert N.anomaly_rates(r, "s").first().iqr_rate == round(100 / 12, 2)


def loop_cusum(z, k=0.5):
    pos, neg, out = 0.0, 0.0, [(0.0, 0.0)]
    for x in z[1:]:
        pos, neg = max(0, pos + x - k), max(0, neg - x - k)
        out.append((pos, neg))
    return out


def test_cusum_first_value_ignored(spark):
    df = spark.createDataFrame([("s", i, float(z)) for i, z in enumerate([9, 1, 1, 1, 1])], "s string, i int, z double")
    assert [r.cusum_pos for r in N.cusum_path(df, ["s"], "i", "z").orderBy("i").collect()] == [0, 0.5, 1, 1.5, 2]


def test_cusum_equals_the_loop(spark):
    rng = np.random.default_rng(8)
    z = {str(k): rng.normal(0.2, 1.2, 25) for k in range(40)}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in z.items() for i, x in enumerate(v)], "s string, i int, z double")
    for r in N.cusum_path(df, ["s"], "i", "z").collect():
        assert (r.cusum_pos, r.cusum_neg) == pytest.approx(loop_cusum(z[r.s])[r.i], abs=1e-9)


def ks(spark, train, live):
    rows = [("s", float(x), False) for x in train] + [("s", float(x), True) for x in live]
    return N.ks_exact_p(N.ks_two_sample(spark.createDataFrame(rows, "s string, x double, live boolean"), ["s"], "x", "live")).first()


def test_ks_statistic_and_exact_p(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=9), rng.normal(0.8, 1, 6)
    got = ks(spark, a, b)
    grid = np.concatenate([a, b])
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert got.ks_statistic == pytest.approx(want)
    # All ways to label the pooled sample.
    from itertools import combinations

    pooled, hits, total = np.sort(grid), 0, 0
    for pick in combinations(range(15), 6):
        mask = np.zeros(15, bool)
        mask[list(pick)] = True
        gap = np.abs(np.cumsum(~mask) / 9 - np.cumsum(mask) / 6).max()
        hits, total = hits + (gap >= want - 1e-12), total + 1
    assert got.ks_p_exact == pytest.approx(hits / total) and len(pooled) == 15


def test_ks_published_value(spark):
    # 31 training and 7 live growth values with statistic 0.2212 have p 0.8845.
    df = spark.createDataFrame([(48 / 217, 31, 7), (48 / 217, 31, 7), (None, 31, 0), (1.0, 2, 2)], "ks_statistic double, n_train long, n_live long")
    got = sorted((r.ks_p_exact for r in N.ks_exact_p(df).collect()), key=lambda p: -1 if p is None else p)
    assert got[0] is None and got[1] == pytest.approx(1 / 3) and got[2:] == [pytest.approx(0.8845, abs=5e-5)] * 2
    assert round(48 / 217, 4) == 0.2212


def test_ks_one_live_value_and_ties(spark):
    assert 0 <= ks(spark, [1, 1, 2, 2], [2]).ks_statistic <= 1
    assert ks(spark, [1, 2, 3], [1, 2, 3]).ks_statistic == 0


def growth_gap(spark, drop):
    level, rows = 100.0, []
    for i in range(30):
        level *= 1.03 if i % 2 else 1.01
        rows.append(("s", i, level * (0.7 if drop and i >= 26 else 1.0), i < 26))
    split = spark.createDataFrame(rows, "s string, i int, y double, is_train boolean")
    g = N.log_growth(split, "s", "i", "y").withColumn("is_live", ~F.col("is_train"))
    return N.ks_two_sample(g, ["s"], "growth", "is_live").first().ks_statistic


def test_a_drop_at_the_boundary_raises_the_statistic(spark):
    assert growth_gap(spark, True) > growth_gap(spark, False)


def test_shift_and_report(spark):
    ref = N.reference_moments(spark.createDataFrame([("s", x) for x in (-1.0, 1.0, -1.0, 1.0)], "s string, residual double"), ["s"])
    live = spark.createDataFrame([("s", i, 5.0) for i in range(4)], "s string, i int, residual double")
    shift = N.residual_shift(live, ref, ["s"])
    assert shift.first().residual_z == 5 and shift.first().residual_drift
    cus = N.cusum(live, ref, ["s"], "i")
    assert cus.first().cusum_max == pytest.approx(13.5) and cus.first().cusum_signal
    rows = [("s", float(x), False) for x in range(20)] + [("s", 50.0 + x, True) for x in range(8)]
    k = N.ks_two_sample(spark.createDataFrame(rows, "s string, x double, live boolean"), ["s"], "x", "live")
    r = N.drift_report(k, cus, shift, ["s"]).first()
    assert (r.alerts, r.severity, r.model_health_score) == (3, "Severe", 25.0)
    flat = N.reference_moments(spark.createDataFrame([("s", 0.0)], "s string, residual double"), ["s"])
    assert flat.first().ref_std == 1


def test_payload_without_a_report(spark):
    every = spark.createDataFrame([("s",)], "s string")
    none = spark.createDataFrame([], "s string, overall_drift boolean, severity string, ks_statistic double, cusum_signal boolean, residual_drift boolean, model_health_score double")
    r = N.drift_payload(every, none, ["s"]).first()
    assert r.drift_detected is False and r.drift_type == "Unavailable" and r.model_health_score is None


def confidence(spark, step, pred, lower, upper, mape=5.0, stability=80.0, drift=False):
    f = spark.createDataFrame([("s", step, pred, lower, upper)], "s string, step int, pred double, lower double, upper double")
    q = spark.createDataFrame([("s", mape, stability, drift)], "s string, mape double, stability double, drift_detected boolean")
    return N.confidence_scores(f, q, ["s"]).first()


def test_confidence_by_hand(spark):
    r = confidence(spark, 2, 100.0, 90.0, 110.0)
    parts = [round(40 * math.exp(-0.35), 2), 24.0, round(20 * math.exp(-0.18), 2), round(10 * math.exp(-0.5), 2)]
    assert [r.mape_score, r.stability_score, r.horizon_score, r.ci_score] == parts
    assert r.confidence_score == pytest.approx(round(sum(parts), 1)) and r.confidence_label == "High"
    assert confidence(spark, 2, 100.0, 90.0, 110.0, drift=True).confidence_score == pytest.approx(round(sum(parts) - 15, 1))
    assert confidence(spark, 30, 100.0, None, None).horizon_score == 5
    assert confidence(spark, 1, 100.0, None, None).ci_score == round(10 * math.exp(-0.5), 2)  # band of 10% each way
    assert confidence(spark, 1, -4.0, -5.0, -3.0).ci_score == 5


@pytest.mark.parametrize("score,label", [(80, "Very High"), (79.9, "High"), (65, "High"), (45, "Medium"), (25, "Low"), (24.9, "Very Low")])
def test_confidence_labels(spark, score, label):
    assert spark.range(1).select(N.confidence_label(F.lit(float(score))).alias("l")).first().l == label


def test_ensemble_by_hand(spark):
    q = spark.createDataFrame([("s", "a", 2.0, 1.0), ("s", "b", 4.0, 1.0), ("s", "c", None, 1.0)], "s string, model string, mape double, rmse_pct double")
    w = {r.model: r.weight for r in N.ensemble_weights(q, "s", "inverse_mape", 2).collect()}
    assert w == {"a": 0.6667, "b": 0.3333}
    assert {r.weight for r in N.ensemble_weights(q, "s", "equal").collect()} == {0.3333}
    rank = {r.model: r.weight for r in N.ensemble_weights(q, "s", "rank").collect()}
    assert rank == {"a": 0.5455, "b": 0.2727, "c": 0.1818}
    f = spark.createDataFrame([("s", 1, "a", 10.0, 9.0), ("s", 1, "b", 16.0, 9.0)], "s string, step int, model string, pred double, actual double")
    e = N.ensemble_forecast(f, N.ensemble_weights(q, "s", "equal", 2), "s", "step").first()
    assert e.pred == 13 and e.upper == pytest.approx(13 + 1.96 * 3) and e.actual == 9


@pytest.mark.parametrize("score,drift,status", [(90, True, "Elevated"), (None, False, "Unknown"), (70, False, "Stable"), (45, False, "Watch"), (44, None, "Elevated")])
def test_risk(spark, score, drift, status):
    df = spark.createDataFrame([(None if score is None else float(score), drift)], "score double, drift boolean")
    assert df.select(N.risk_status(F.col("score"), F.col("drift")).alias("r")).first().r == status


def test_status_falls_back_to_the_best_then_the_first_model(spark):
    levels = spark.createDataFrame([(s, 1, 10.0) for s in "abcd"], "s string, step int, y double").withColumn("ds", F.lit("2020-03-31").cast("date"))
    ensemble = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 20.0)], "s string, step int, pred double")
    board = spark.createDataFrame([(s, m, 1.0, m == "m2") for s in "abc" for m in ("m1", "m2")], "s string, model string, mape double, recommended boolean")
    forecasts = spark.createDataFrame(
        [("a", "m2", 2, 99.0), ("b", "m1", 2, 11.0), ("b", "m2", 1, 1.0), ("b", "m2", 2, 15.0), ("c", "m3", 2, 13.0), ("c", "m1", 1, 12.0), ("c", "m2", 1, None)],
        "s string, model string, step int, pred double",
    )
    none = spark.createDataFrame([], "s string, model string, step int, confidence_score double")
    drift = spark.createDataFrame([], "s string, model string, drift_detected boolean")
    got = {r.s: (r.forecast_value, r.growth_pct) for r in N.kpi_snapshot(levels, ensemble, board, none, drift, "s", "step", forecasts).collect()}
    assert got == {"a": (20.0, 100.0), "b": (15.0, 50.0), "c": (12.0, 20.0), "d": (None, None)}
