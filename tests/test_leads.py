"""Labels, lags, rank metrics and bootstrap intervals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ranking import exact_quantiles, global_rank, running_sums
from tidemark.operators import leads as L
from tidemark.operators import resample as Q

FLAGS = ["savings", "current", "payroll", "eaccount"]


def customers(spark):
    rows = [
        (1, 1, None, 0, 0, 0), (1, 2, 0, 1, 0, 0), (1, 3, 0, 1, 0, 0),
        (2, 1, 1, 0, 0, 0), (2, 2, 1, 0, 0, 0), (2, 3, 1, 0, 0, 0),
        (3, 1, 0, 0, 1, 0), (3, 2, 0, 0, None, 0), (3, 3, 0, 0, 1, 0),
        (4, 1, 0, 0, 0, 0), (4, 3, 0, 0, 0, 1),
    ]
    return L.flag_fill(spark.createDataFrame(rows, "id int, m int, savings tinyint, current tinyint, payroll tinyint, eaccount tinyint"), FLAGS)


def test_adds_never_holds(spark):
    got = {(r.id, r.m): r.added for r in L.next_period_adds(customers(spark), "id", "m", FLAGS).collect()}
    assert got == {(1, 1): 1, (1, 2): 0, (2, 1): 0, (2, 2): 0, (3, 1): 0, (3, 2): 1}  # 4 skips a period: no rows


def test_lags_are_calendar_exact(spark):
    f = {(r.id, r.m): r for r in L.calendar_lags(customers(spark), "id", "m", {"current": [1, 2]}).collect()}
    assert f[1, 3].current_l1 == 1 and f[1, 3].current_l2 == 0
    assert f[4, 3].current_l1 is None and f[4, 3].current_l2 == 0


def test_features_and_reopening(spark):
    f = L.build_features(customers(spark), "id", "m", FLAGS, ["payroll"]).withColumn("re", L.reopened(["payroll"]))
    got = {(r.id, r.m): r for r in f.collect()}
    assert got[3, 2].re and not got[3, 1].re and not got[2, 2].re
    assert got[1, 2].n_products == 1 and got[1, 2].n_products_change == 1 and got[1, 2].n_added_last == 1
    assert got[1, 1].new_customer == 1 and got[1, 2].new_customer == 0
    later = L.build_features(customers(spark), "id", "m", FLAGS, ["payroll"], first_period=2)
    assert {r.m for r in later.collect()} == {2} and later.filter("id = 3").first().payroll_l1 == 1


def ranked(spark, y, s):
    df = spark.createDataFrame([(i, float(b), int(a)) for i, (a, b) in enumerate(zip(y, s))], "id long, score double, label int")
    return L.rank_scores(df, "score", "label", "id")


def test_lift_by_hand(spark):
    r = ranked(spark, [1] + [0] * 8 + [1], range(10, 0, -1))
    assert L.lift_at(r, "label", (0.1,)).first().lift_10pct == 5.0


@pytest.mark.parametrize("n,top", [(25, 2), (35, 4), (4, 1), (10, 1)])
def test_half_even_top(spark, n, top):
    assert L.top_k(ranked(spark, [0] * n, range(n)), 0.1).count() == top


def test_random_scores_have_no_lift(spark):
    df = spark.range(200_000).select("id", F.rand(7).alias("score"), (F.rand(8) < 0.05).cast("int").alias("label"))
    lift = L.lift_at(L.rank_scores(df, "score", "label", "id"), "label", (0.1,)).first().lift_10pct
    assert lift == pytest.approx(1, abs=0.1)


def test_gain_sizes(spark):
    g = L.gains_table(ranked(spark, [1, 0] * 6 + [1], range(13, 0, -1)), "label").orderBy("decile").collect()
    assert [r.customers for r in g] == [2, 2, 2, 1, 1, 1, 1, 1, 1, 1]
    assert g[-1].cumulative_share == 1 and sum(r.adds for r in g) == 7
    front = L.capacity_frontier(L.gains_table(ranked(spark, [1, 0] * 6 + [1], range(13, 0, -1)), "label")).orderBy("decile").collect()
    assert front[-1].contacted == 13 and front[-1].lift == 1


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def brute_ap(y, s):
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        total += (recall - last) * precision
        last = recall
    return total


def test_auc_and_precision_with_ties(spark):
    rng = np.random.default_rng(1)
    s = rng.integers(0, 12, 400)
    y = (rng.random(400) < 0.1 + s / 30).astype(int)
    m = L.score_metrics(ranked(spark, y, s), "score", "label").first()
    assert m.roc_auc == pytest.approx(brute_auc(y, s)) and m.average_precision == pytest.approx(brute_ap(y, s))


def test_one_score_for_all(spark):
    m = L.score_metrics(ranked(spark, [1, 0, 1, 0], [3, 3, 3, 3]), "score", "label").first()
    assert m.roc_auc == 0.5 and m.average_precision == 0.5


def test_rank_spreads_a_hot_group(spark):
    # One group holds nearly all rows, and half of them share a score.
    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("g"),
                                    F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("s"))
    got = global_rank(df, [F.desc("s"), F.asc("id")], ["g"])
    pdf = got.toPandas().sort_values(["g", "s", "id"], ascending=[True, False, True])
    want = pdf.groupby("g").cumcount() + 1
    assert (pdf["rank"].to_numpy() == want.to_numpy()).all()
    assert dict(pdf.groupby("g")["rank_total"].max()) == {"a": 19_800, "b": 200}


def test_running_sums_with_missing_group(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("x", 1, 5)], "g string, o int, v int")
    got = {(r.g, r.o): (r.c, r.c_total) for r in running_sums(df, ["g"], [F.col("o")], {"c": "v"}).collect()}
    assert got == {(None, 1): (2, 5), (None, 2): (5, 5), ("x", 1): (5, 5)}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=5000), 2)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(x)) for i, x in enumerate(v)] + [("a", None)], "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"lo": 0.025, "mid": 0.5, "hi": 0.975}).collect()}
    for g, values in (("a", [x for i, x in enumerate(v) if i % 3]), ("b", [x for i, x in enumerate(v) if not i % 3])):
        assert [got[g].lo, got[g].mid, got[g].hi] == pytest.approx(list(np.quantile(values, [0.025, 0.5, 0.975])))


def interval(spark, n, seed=1, parts=4):
    rng = np.random.default_rng(0)
    s = rng.random(n)
    y = (rng.random(n) < 0.02 + 0.2 * s**4).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "id long, score double, label int")
    out = Q.poisson_lift_interval(df.repartition(parts), "score", "label", "id", reps=400, seed=seed).first()
    order = np.argsort(-s, kind="stable")
    return out, y[order], s


def test_poisson_interval_brackets_and_repeats(spark):
    a, y, _ = interval(spark, 8000)
    b, _, _ = interval(spark, 8000, parts=7)
    assert (a.lift_lo, a.lift_hi) == (b.lift_lo, b.lift_hi)
    point = y[:800].mean() / y.mean()
    assert a.lift_lo < point < a.lift_hi
    c, _, _ = interval(spark, 8000, seed=2)
    assert c.lift_lo != a.lift_lo


def test_poisson_interval_close_to_row_weights(spark):
    got, y, _ = interval(spark, 6000)
    rng = np.random.default_rng(9)
    lifts = []
    for _ in range(400):
        w = rng.poisson(1.0, len(y)).astype(float)
        cw = np.cumsum(w)
        top = np.searchsorted(cw, 0.1 * cw[-1]) + 1
        lifts.append((w[:top] @ y[:top] / cw[top - 1]) / (w @ y / cw[-1]))
    lo, hi = np.quantile(lifts, [0.025, 0.975])
    assert got.lift_lo == pytest.approx(lo, rel=0.06) and got.lift_hi == pytest.approx(hi, rel=0.06)


@pytest.mark.parametrize("n", [500, 5_000, 50_000])
def test_poisson_interval_is_the_row_loop_at_any_size(spark, n):
    got, y, _ = interval(spark, n)
    rank = np.arange(1, n + 1)
    reach = 10 * np.sqrt(0.1 * n) + 10
    place = np.maximum(np.floor(0.1 * n - reach), np.minimum(np.ceil(0.1 * n + reach), rank))
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    size, hits = np.diff(np.r_[starts, n]), np.add.reduceat(y, starts)
    lifts = []
    for rep in range(400):
        # The same draws as weights of single rows: a folded bin's draw stands for the sum over its rows.
        rng = np.random.default_rng([1, rep])
        pos = rng.poisson(hits)
        w = pos + rng.poisson(size - hits)
        total, seen, found = w.sum(), 0, 0
        for x, p in zip(w, pos):
            seen, found = seen + x, found + p
            if seen >= 0.1 * total:
                break
        if pos.sum():
            lifts.append(found / seen / (pos.sum() / total))
    assert (got.lift_lo, got.lift_hi) == pytest.approx(tuple(np.quantile(lifts, [0.025, 0.975])), rel=1e-9)
    assert size[place[starts] == np.round(0.1 * n)].tolist() == [1]


def test_paired_bootstrap_draws_entities_with_replacement(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(0.1, 1.0, 60)
    rows = [(f"{i:02d}", 1, "a", 1.0 + float(x)) for i, x in enumerate(d)] + [(f"{i:02d}", 1, "b", 1.0) for i in range(60)]
    m = spark.createDataFrame(rows, "id string, origin int, model string, mase double")
    got = Q.paired_bootstrap(m, "id", "a", "b", reps=4000, rows=7).first()
    means = d[rng.integers(0, 60, (20_000, 60))].mean(axis=1)
    assert (got.ci_lo, got.ci_hi) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=0.02)
    none = Q.paired_bootstrap(m.limit(0), "id", "a", "b", reps=10).first()
    assert none.entities == 0 and none.ci_lo is None


def test_paired_bootstrap(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(0.3, 1.0, 500)
    rows = [(str(i), 1, "a", 1.0 + float(x)) for i, x in enumerate(d)] + [(str(i), 1, "b", 1.0) for i in range(500)]
    m = spark.createDataFrame(rows, "id string, origin int, model string, mase double")
    got = Q.paired_bootstrap(m, "id", "a", "b").first()
    again = Q.paired_bootstrap(m.repartition(11), "id", "a", "b").first()
    # Same weights under any partitioning; only the order of the float sums may differ.
    assert tuple(again) == pytest.approx(tuple(got), rel=1e-12)
    assert got.entities == 500 and got.mean_diff == pytest.approx(d.mean())
    half = 1.96 * d.std() / np.sqrt(500)
    assert got.ci_lo == pytest.approx(d.mean() - half, abs=0.02) and got.ci_hi == pytest.approx(d.mean() + half, abs=0.02)


def test_negative_sample(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 50 == 0).cast("int").alias("label"))
    s = L.negative_sample(df, "label", ["id"])
    assert s.filter("label = 1").count() == 400 and {r.weight for r in s.select("weight").distinct().collect()} == {1.0, 10.0}
    assert s.filter("label = 0").count() == pytest.approx(1960, rel=0.1)
    assert s.repartition(9).exceptAll(L.negative_sample(df.repartition(3), "label", ["id"])).isEmpty()


def test_period_split_order(spark):
    df = spark.range(10).select(F.col("id").cast("int").alias("m"))
    assert {r.role for r in L.period_split(df, "m", (1, 4), 5, 6).collect()} == {"train", "valid", "test"}
    with pytest.raises(ValueError):
        L.period_split(df, "m", (1, 5), 5, 6)


def test_models_find_the_signal(spark):
    df = spark.range(3000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 5 == 0).alias("v")).withColumn(
        "label", (F.rand(3) < F.col("a") * 0.6).cast("int")).withColumn("weight", F.lit(1.0)).cache()
    for scores in (
        L.logistic_scores(df, df, ["a", "b"], "label"),
        L.boosted_scores(L.boosted_model(df, ["a", "b"], "label", "v", max_iter=5, depth=3), df, ["a", "b"]),
    ):
        r = L.rank_scores(scores, "score", "label", "id")
        assert L.roc_auc(L.by_threshold(r, "score", "label")).first().roc_auc > 0.65


def test_every_pair_of_roles_is_guarded(spark):
    from tidemark.operators import guards as G

    make = lambda *rows: spark.createDataFrame(rows, "day int, role string")
    order = ["train", "valid", "test"]
    G.assert_ordered_roles(make((1, "train"), (2, "valid"), (3, "test")), "day", "role", order)
    with pytest.raises(G.LeakageError, match="valid ends 3 but test starts 3"):
        G.assert_ordered_roles(make((1, "train"), (3, "valid"), (3, "test")), "day", "role", order)
    with pytest.raises(ValueError, match="test has no rows"):
        G.assert_ordered_roles(make((1, "train"), (2, "valid")), "day", "role", order)


def test_thresholds_equal_those_of_ranked_rows(spark):
    rows = [(i, float(i * 7 % 5), i * 3 % 4 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, s double, y boolean").withColumn("y", F.col("y").cast("int"))
    columns = ["s", "n", "p", "upto", "pos_upto", "pos_total", "total"]
    ranked = L.by_threshold(L.rank_scores(df, "s", "y", "id"), "s", "y").select(columns)
    assert sorted(map(tuple, L.thresholds(df, "s", "y").select(columns).collect())) == sorted(map(tuple, ranked.collect()))


def test_profiles_codes_and_rates(spark):
    df = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (None, 11)], "id int, day int")
    profile = spark.createDataFrame([(1, "b", 5.0), (2, None, None), (4, "a", 1.0), (None, "z", 9.0)], "id int, seg string, bal double")
    got = {r.id: r for r in L.with_profile(df, profile, "id", ["bal"]).collect()}
    assert len(got) == 4 and (got[1].seg, got[1].bal_missing, got[2].bal_missing) == ("b", 0, 1)
    assert got[3].seg is None and got[3].bal_missing == 1 and got[None].seg is None  # no profile, no id: nulls
    with pytest.raises(Exception, match="duplicate key"):
        L.with_profile(df, profile.unionByName(profile), "id").collect()
    codes = {r.seg: r.code for r in L.with_codes(profile, {"seg": "code"}).collect()}
    assert codes == {"a": 1, "b": 2, "z": 3, None: None}
    assert L.with_codes(profile.limit(0), {"seg": "code"}).collect() == []
    with pytest.raises(Exception, match="more than 2"):
        L.with_codes(profile, {"seg": "code"}, most=2).collect()
    train = spark.createDataFrame([(1.0, 1), (1.0, 0), (2.0, 1), (2.0, 1)], "s double, y int")
    test = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1), (None, 1)], "s double, y int")
    assert {r.s: r.p for r in L.score_rates(train, test, "s", "y").collect()} == {1.0: 0.5, 2.0: 1.0, 3.0: 0.75, None: 0.75}


def test_boosted_rounds_end_on_the_validation_period(spark):
    df = spark.range(600).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 3 == 0).alias("v")).withColumn(
        "label", (F.rand(3) < 0.5).cast("int")).withColumn("weight", F.lit(1.0)).cache()
    assert L.boosted_model(df, ["a", "b"], "label", "v").getNumTrees < 20  # nothing to learn: far from 400
