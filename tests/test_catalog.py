"""Registered queries against the same tables in another engine, plus what every plan must hold to.

TIDEMARK_ALL=1 runs every query; the default is one or two of each family.
"""

import os
import re

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

FAMILIES = (
    "identity_hit_rate", "industry_totals", "merger_cuts", "build_panel", "panel_summary", "missing_periods", "acf",
    "fill_exog", "difference_lag_features", "scale_complete_rows", "origin_fanout", "backtest_score", "timeseries_cv",
    "merge_runs_guarded", "panel_leaderboard", "model_leaderboard", "dm_table", "ljung_box", "anomaly_votes", "drift_report",
    "ensemble_forecast", "kpi_snapshot", "build_features", "gains_table", "lift_by_segment", "score_metrics", "extract_fields",
    "line_scan", "assemble_rows", "collate_provenance", "land_by_period", "ingest_lenient_csv", "dedupe_reconcile", "export_json",
    "stream_period_totals",
)
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("TIDEMARK_ALL") else FAMILIES)
def test_same_as_sql(spark, sf_dir, con, name):
    difference = compare(QUERIES[name](spark, sf_dir), con, SQL[name])
    assert difference is None, difference


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"model", "mase_mean", "mase_median", "share_beats_baseline", "series_origins"} and df.count() == 4


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 200


CHEAP = [
    "build_panel", "panel_summary", "backtest_score", "scale_complete_rows", "merge_runs_guarded", "model_leaderboard", "acf",
    "build_features", "line_scan", "extract_fields", "missing_periods", "validation_origins", "histogram_density",
]


@pytest.mark.parametrize("name", CHEAP)
def test_no_cross_join_and_no_single_task_window(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert not re.search(r"Window[^\n]*\n\W*Sort[^\n]*\n\W*Exchange SinglePartition", plan)


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = QUERIES["scan_lazy"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_backtest_shuffles_once_per_grouping(spark, sf_dir):
    # One shuffle to (series, quarter) sums and one to series, for nine origins and four models.
    plan = QUERIES["backtest_score"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name", ["macro_join", "interaction_feature", "lagged_exog", "fill_exog", "scale_train_only", "align_common_index"])
def test_no_series_rows_are_shuffled_on_the_quarter(spark, sf_dir, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    main = plan.split("Subquery")[0]
    assert not re.search(r"hashpartitioning\(q#\d+, \d+\)", main) and "SortMergeJoin" not in main
