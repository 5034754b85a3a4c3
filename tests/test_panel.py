"""Panel build on hand-made entities: identities, segments, merger cuts, totals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import guards as G
from tidemark.operators import panel as P

EVENTS = "change_code int, survivor_id long, acquirer_id long, out_id long, effective_date date"
QUARTERS = [
    d for y in range(2001, 2027) for d in (dt.date(y, 3, 31), dt.date(y, 6, 30), dt.date(y, 9, 30), dt.date(y, 12, 31))
    if d <= dt.date(2026, 6, 30)
]


def panel(spark, series):
    rows = [(e, QUARTERS[i], float(v)) for e, values in series.items() for i, v in enumerate(values) if v is not None]
    df = spark.createDataFrame(rows, "entity long, ds date, y double")
    return df.withColumn("q", cal.quarter_index(F.col("ds")))


def events(spark, *rows):
    return spark.createDataFrame([r for r in rows], EVENTS)


def kept(spark, series, history=(), **rules):
    out = P.build_panel(panel(spark, series), events(spark, *history), "entity", **rules)
    return {(r.unique_id): (r.n, r.a, r.b) for r in out.groupBy("unique_id").agg(
        F.count("*").alias("n"), F.min("ds").alias("a"), F.max("ds").alias("b")).collect()}


def summary(spark, series, history=(), **rules):
    return P.panel_summary(panel(spark, series), events(spark, *history), "entity", **rules).first()


def test_calendar(spark):
    ends = [r.ds for r in cal.quarter_spine(spark, "2001-03-31", "2026-06-30").orderBy("ds").collect()]
    assert len(ends) == 102 and ends[1] == dt.date(2001, 6, 30)
    assert ends == QUARTERS


def test_component_sum_and_identity(spark):
    df = spark.createDataFrame(
        [(10.0, 20.0, 30.0, 60.0), (1.0, 2.0, 3.0, 7.0), (1.0, 2.0, 3.0, 11.0), (1.0, None, 3.0, 4.0)], "a double, b double, c double, whole double"
    ).withColumn("rest", F.lit(0.0))
    y = P.component_sum(df, ["a", "b", "c"])
    assert [r.y for r in y.collect()] == [60.0, 6.0, 6.0, None]
    ok = [r.ok for r in y.select(P.identity_holds(F.col("y"), F.col("whole"), F.col("rest"), 1).alias("ok")).collect()]
    assert ok == [True, True, False, False]
    rate = P.identity_hit_rate(y, "y", "whole", "rest", [1.0]).first()
    assert rate.rate_all == 0.5 and rate.rate_known == pytest.approx(2 / 3)


def test_short_and_failed_entities(spark):
    got = kept(spark, {1: [100 + i for i in range(102)], 2: [100] * 52, 3: [5] * 20}, min_periods=40)
    assert set(got) == {"1", "2"} and got["2"][0] == 52  # the failed entity stays
    s = summary(spark, {1: [100] * 102, 2: [100] * 52, 3: [5] * 20}, min_periods=40)
    assert s.entities_too_short == 1 and s.panel_entities == 2


def test_extreme_break(spark):
    got = kept(spark, {1: [1000] * 50 + [5000] * 52}, min_periods=40)
    assert got["1"][0] == 52 and got["1"][2] == QUARTERS[-1]
    assert summary(spark, {1: [1000] * 50 + [5000] * 52}, min_periods=40).breaks == 1


def test_non_positive_row_opens_a_gap(spark):
    values = [100.0] * 102
    values[30] = 0.0
    assert kept(spark, {1: values}, min_periods=40)["1"][0] == 71
    s = summary(spark, {1: values}, min_periods=40)
    assert (s.rows_not_positive, s.gaps) == (1, 1)


MERGERS = (
    (223, 1, None, 2, dt.date(2015, 5, 1)),
    (223, 1, None, 3, dt.date(2020, 2, 15)),
)
SIZES = {1: [10_000] * 102, 2: [4_000] * 57, 3: [100] * 76}


@pytest.mark.parametrize("share,minimum,first,last,cuts", [
    (0.05, 40, dt.date(2015, 6, 30), dt.date(2026, 6, 30), 1),
    (0.0, 40, dt.date(2001, 3, 31), dt.date(2015, 3, 31), 2),
    (0.0, 20, dt.date(2020, 3, 31), dt.date(2026, 6, 30), 2),
])
def test_material_mergers(spark, share, minimum, first, last, cuts):
    rules = {"min_periods": minimum, "min_share": share}
    assert kept(spark, SIZES, MERGERS, **rules)["1"][1:] == (first, last)
    assert summary(spark, SIZES, MERGERS, **rules).mergers == cuts


def test_unknown_sizes_and_other_codes(spark):
    history = [
        (211, None, 1, 9, dt.date(2010, 5, 1)),   # absorbed entity never reported: material
        (150, 1, None, 2, dt.date(2012, 5, 1)),   # not an absorbing code
        (211, 1, None, 1, dt.date(2013, 5, 1)),   # absorbs itself
        (211, 1, None, None, dt.date(2014, 5, 1)),
    ]
    cuts = P.merger_cuts(panel(spark, SIZES), events(spark, *history), "entity", 0.1).collect()
    assert [(r.entity, r.q) for r in cuts] == [(1, 2010 * 4 + 1)]


def test_absorbed_in_one_quarter_are_summed(spark):
    history = [(223, 1, None, e, dt.date(2015, 5, 1)) for e in (2, 3)]
    sizes = {1: [10_000] * 102, 2: [600] * 57, 3: [500] * 57}
    assert P.merger_cuts(panel(spark, sizes), events(spark, *history), "entity", 0.1).count() == 1
    assert P.merger_cuts(panel(spark, sizes), events(spark, history[0]), "entity", 0.1).count() == 0


def test_no_events(spark):
    assert kept(spark, {1: [100.0] * 50}, min_periods=40)["1"][0] == 50


def test_totals_keep_missing_rows(spark):
    df = spark.createDataFrame([(1, 100.0), (1, -5.0), (2, 200.0), (3, None)], "ds int, y double")
    got = {r.ds: (r.y, r.n_entities) for r in P.period_totals(df, "ds", ["y"]).collect()}
    assert got == {1: (95.0, 2), 2: (200.0, 1), 3: (0.0, 1)}


def test_result_does_not_depend_on_partitioning(spark):
    base = panel(spark, SIZES)
    one = P.build_panel(base.coalesce(1), events(spark, *MERGERS), "entity", min_share=0.05)
    many = P.build_panel(base.orderBy(F.rand(1)).repartition(13), events(spark, *MERGERS), "entity", min_share=0.05)
    assert sorted(one.collect()) == sorted(many.collect())


def test_require_unique(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "entity int, q int, y double")
    assert G.require_unique(df, ["entity", "q"]).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        G.require_unique(df.union(df), ["entity", "q"]).collect()


@pytest.mark.parametrize("date,expected", [
    ("2024-12-31", "Q3FY25"), ("2025-03-31", "Q4FY25"), ("2024-06-30", "Q1FY25"), ("2009-09-30", "Q2FY10"),
])
def test_fiscal_quarter(spark, date, expected):
    row = spark.range(1).select(cal.fiscal_quarter(F.lit(date).cast("date")).alias("f")).first()
    assert row.f == expected


def test_reporting_quarter_is_strictly_before(spark):
    rows = spark.createDataFrame([("2019-06-30",), ("2019-07-01",), ("2019-05-16",)], "d string").select(
        cal.reporting_quarter_end(F.to_date("d")).alias("q")).collect()
    assert [r.q for r in rows] == [dt.date(2019, 3, 31), dt.date(2019, 6, 30), dt.date(2019, 3, 31)]


def test_period_columns_join_like_a_left_join(spark):
    from tidemark.functions.frames import with_period_columns

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "s string, q int")
    periods = spark.createDataFrame([(1, 1.5, "x"), (3, 2.5, "y"), (None, 0.0, "z")], "q int, rate double, name string")
    got = {(r.s, r.q): (r.rate, r.name) for r in with_period_columns(rows, periods, "q", ["rate", "name"]).collect()}
    assert got == {("a", 1): (1.5, "x"), ("a", 2): (None, None), ("b", None): (None, None)}
    with pytest.raises(Exception, match="more than 2 periods"):
        with_period_columns(rows, spark.range(5).selectExpr("cast(id as int) q", "1.0 rate"), "q", ["rate"], most=2).collect()
    with pytest.raises(Exception, match="(?i)duplicate"):
        with_period_columns(rows, periods.union(periods), "q", ["rate"]).collect()


def test_blank_spans_by_hand(spark):
    rows = [("a", 10, 1.0, None), ("a", 11, None, 2.0), ("a", 13, 3.0, None), ("b", 12, 5.0, 5.0), ("c", 14, None, None)]
    df = spark.createDataFrame(rows, "e string, q int, x double, y double")
    got = sorted((r.e, r.figure, r.from_q, r.to_q, r.periods) for r in P.blank_spans(df, "e", ["x", "y"]).collect())
    assert got == [
        ("a", "x", 11, 12, 2), ("a", "x", 14, 14, 1), ("a", "y", 10, 10, 1), ("a", "y", 12, 14, 3), ("b", "x", 10, 11, 2), ("b", "x", 13, 14, 2),
        ("b", "y", 10, 11, 2), ("b", "y", 13, 14, 2), ("c", "x", 10, 14, 5), ("c", "y", 10, 14, 5),
    ]
    assert P.blank_spans(df.limit(0), "e", ["x"]).collect() == []
    assert [tuple(r) for r in P.blank_spans(df.filter("e = 'b'"), "e", ["x"], calendar=(12, 13)).collect()] == [("b", "x", 13, 13, 1)]


def test_whole_quarters():
    from datetime import date

    from tidemark.functions.calendar import whole_quarters

    assert whole_quarters("1997-01-01", "1999-12-31") == (date(1997, 1, 1), date(1999, 12, 31))
    assert whole_quarters("1997-02-15", "1999-12-30") == (date(1997, 1, 1), date(1999, 9, 30))
    first, last = whole_quarters("1997-02-15", "1997-03-01")  # no quarter ends in between
    assert last < first
