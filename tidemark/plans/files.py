"""Queries over sources and sinks: each writes what Spark derives from the tables and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import evaluate as E
from tidemark.plans import inputs as I
from tidemark.plans.catalog import register
from tidemark.plans.forecasts import KEY, hold, residuals
from tidemark.plans.inputs import CTES
from tidemark.session import shared_dir
from tidemark.sources import readers as R
from tidemark.sources import sinks as S


def fresh_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


PANEL_SCHEMA = T.StructType([
    T.StructField("entity", T.LongType()), T.StructField("q", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in ("part_a", "part_n", "part_r", "whole")],
    T.StructField("period", T.StringType()),
])
_PANEL_SQL = "SELECT entity, q, part_a, part_n, part_r, whole, strftime(ds, '%Y%m%d') AS period FROM components"


def _panel(spark, d):
    return I.components(spark, d).withColumn("period", F.date_format("ds", "yyyyMMdd")).drop("ds")


@register("scan_panel_files", _PANEL_SQL, ("components",))
def scan_panel_files(spark, d):
    path = S.write_parquet(_panel(spark, d), fresh_path(spark, "panel"), ["period"])
    return R.scan_panel_files(spark, path, PANEL_SCHEMA)


@register("land_by_period", _PANEL_SQL, ("components",))
def land_by_period(spark, d):
    """Early periods land first; the second run adds the rest and leaves the first alone."""
    path, panel = fresh_path(spark, "landing"), _panel(spark, d)
    S.land_by_period(panel.filter(F.col("period") <= "19981231"), path, "period")
    landed = S.land_by_period(panel, path, "period")
    return landed.withColumn("period", F.col("period").cast("string"))


@register(
    "scan_lazy",
    """SELECT l_returnflag, count(*) AS n, round(sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE, 2) AS quantity FROM lineitem
    WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY 1""",
)
def scan_lazy(spark, d):
    """Three columns and one date range reach the file scan."""
    ship = F.col("l_shipdate")
    return (
        I.table(spark, d, "lineitem")
        .filter((ship >= F.lit("1998-01-01").cast("timestamp_ntz")) & (ship < F.lit("1999-01-01").cast("timestamp_ntz")))
        .groupBy("l_returnflag")
        .agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double"), 2).alias("quantity"))
    )


RAW_COLUMNS = ("snapshot", "customer", "age", "code", "income", "tiny", "start", "segment", "junk")


def _raw_text(spark, d):
    """Customers as dirty text: padded numbers, NA marks, two spellings of a code, bad dates, overflow."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    return I.table(spark, d, "customer").select(
        F.lit("2016-01-28").alias("snapshot"),
        F.concat(F.lit("  "), c.cast("string")).alias("customer"),
        F.when(n == 3, "     NA").otherwise(F.concat(F.lit(" "), (n + 18).cast("string"))).alias("age"),
        F.concat((n % 4).cast("string"), F.when(c % 2 == 0, ".0").otherwise("")).alias("code"),
        F.when(n == 7, "").otherwise(F.col("c_acctbal").cast("string")).alias("income"),
        c.cast("string").alias("tiny"),
        F.when(n == 5, "not a date").otherwise("2015-08-10").alias("start"),
        F.col("c_mktsegment").alias("segment"),
        F.lit("x").alias("junk"),
    )


@register(
    "ingest_lenient_csv",
    """SELECT '2016-01-28' AS snapshot, c_custkey AS customer, CASE WHEN c_nationkey <> 3 THEN c_nationkey + 18 END AS age,
    CAST(c_nationkey % 4 AS VARCHAR) AS code, CASE WHEN c_nationkey <> 7 THEN c_acctbal END AS income,
    CASE WHEN c_custkey <= 127 THEN c_custkey END AS tiny, CASE WHEN c_nationkey <> 5 THEN '2015-08-10' END AS start, c_mktsegment AS segment FROM customer""",
)
def ingest_lenient_csv(spark, d):
    path = fresh_path(spark, "raw-csv")
    _raw_text(spark, d).write.option("header", True).option("emptyValue", "").csv(path)
    typed = R.ingest_lenient_csv(
        spark, path, RAW_COLUMNS, strict={"customer": "int", "snapshot": "date"},
        lenient={"age": "smallint", "income": "double", "tiny": "tinyint", "start": "date"}, codes=("code",), drop=("junk",),
    )
    return R.scan_panel_files(spark, S.write_parquet(typed, fresh_path(spark, "typed")), typed.schema)


@register(
    "load_series_csv",
    """SELECT 'labels' AS layout, unique_id AS series, CAST(ds AS VARCHAR) AS ds, y FROM dense
    UNION ALL SELECT 'dates', unique_id, CAST(ds AS VARCHAR), y FROM dense""",
    ("dense",),
)
def load_series_csv(spark, d):
    """The same series in both layouts; the loader tells them apart by the header."""
    from tidemark.functions.calendar import quarter_label

    p = I.dense(spark, d)
    paths = {"labels": fresh_path(spark, "series"), "dates": fresh_path(spark, "series")}
    p.select(F.col("unique_id").alias(" Series"), quarter_label(F.col("ds")).alias(" Quarter_Year "), F.col("y").alias("Amount ")).write.option(
        "header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(paths["labels"])
    p.select(F.col("ds").alias("quarter_end"), F.col("unique_id").alias("series"), F.col("y").alias("level")).write.option("header", True).csv(paths["dates"])
    layouts = {"quarter_end": ("series", "level"), "Quarter_Year": ("Series", "Amount")}
    parts = [R.load_series_csv(spark, path, layouts).select(F.lit(k).alias("layout"), "series", "ds", "y") for k, path in paths.items()]
    return parts[0].unionByName(parts[1])


@register(
    "read_optional",
    """SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'Overdrawn' ELSE 'Unavailable' END AS status, 'Unavailable' AS other FROM supplier""",
)
def read_optional(spark, d):
    """Two artifacts: one was written for some suppliers, the other never; where there is nothing, the default stands."""
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("status", T.StringType())])
    suppliers, there = I.table(spark, d, "supplier"), fresh_path(spark, "status")
    suppliers.filter("s_acctbal < 0").select("s_suppkey", F.lit("Overdrawn").alias("status")).write.option("header", True).csv(there)
    found = R.read_optional(spark, there, schema)
    gone = R.read_optional(spark, fresh_path(spark, "missing"), schema).withColumnRenamed("status", "other")
    return suppliers.select("s_suppkey").join(found, "s_suppkey", "left").join(gone, "s_suppkey", "left").select(
        "s_suppkey", *[F.coalesce(c, F.lit("Unavailable")).alias(c) for c in ("status", "other")]
    )


CTES["firsts"] = (
    """SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""", ())


@register(
    "dedupe_reconcile",
    """SELECT f.event_type, n, declared, n = declared AS reconciled FROM (SELECT event_type, count(*) AS n FROM firsts GROUP BY 1) f
    JOIN (SELECT event_type, count(DISTINCT user_id) + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS declared FROM events GROUP BY 1) e
    ON f.event_type = e.event_type""",
    ("firsts",),
)
def dedupe_reconcile(spark, d):
    """First event per user and type against a declared number of users per type, which is wrong for one type."""
    e = I.table(spark, d, "events")
    kept = R.dedupe_first(e.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    off_by_one = F.when(F.col("event_type") == "click", 1).otherwise(0)
    declared = e.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("*").alias("declared"))
    declared = declared.withColumn("declared", F.col("declared") + off_by_one)
    return R.reconcile(kept, ["event_type"], declared, "declared", strict=False).select("event_type", "n", "declared", "reconciled")


@register("dedupe_first", "SELECT user_id, event_type, event_id FROM firsts", ("firsts",))
def dedupe_first(spark, d):
    e = I.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return R.dedupe_first(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@register("sink_parquet", "SELECT unique_id, q, y FROM dense", ("dense",))
def sink_parquet(spark, d):
    path = S.write_parquet(I.dense(spark, d).drop("ds"), fresh_path(spark, "sink"))
    return S.stored(spark, path)


@register("sink_csv_rounded", "SELECT unique_id, q, round_even(y, 1) AS y FROM dense", ("dense",))
def sink_csv_rounded(spark, d):
    path = S.write_csv_rounded(I.dense(spark, d).drop("ds"), fresh_path(spark, "csv"), {"y": 1})
    return spark.read.schema("unique_id string, q int, y double").option("header", True).csv(path)


def _board(spark, d):
    return E.model_leaderboard(hold(spark, d), residuals(spark, d), "unique_id", "step")


@register(
    "export_json",
    """SELECT unique_id, model, '{"rank":' || rank || ',"mape":' || mape || ',"ratio":null,"recommended":' || CASE WHEN recommended THEN 'true' ELSE 'false' END || '}' AS document
    FROM board""",
    ("board",),
)
def export_json(spark, d):
    """Leaderboard rows as documents; a NaN and an infinity come out as null."""
    bad = F.when(F.col("rank") == 1, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    b = _board(spark, d).select(*KEY, "rank", "mape", bad.alias("ratio"), "recommended")
    path = S.export_json(b, fresh_path(spark, "json"))
    # The document is what stands in the written line after its keys, so a field that was left out would be missing here.
    body = F.concat(F.lit("{"), F.regexp_extract("value", r'("rank":.*)$', 1))
    return spark.read.text(path).select(*[F.get_json_object("value", f"$.{k}").alias(k) for k in KEY], body.alias("document"))


@register(
    "run_manifest",
    "SELECT count(*) AS n_rows, CAST(min(ds) AS VARCHAR) AS period_start, CAST(max(ds) AS VARCHAR) AS period_end FROM dense", ("dense",),
)
def run_manifest(spark, d):
    path = fresh_path(spark, "runs")
    S.append_run(S.run_manifest(I.dense(spark, d), "ds", {"season": "4", "horizon": "4"}), path)
    return S.stored(spark, path).select("n_rows", "period_start", "period_end")


@register("run_fingerprint")
def run_fingerprint(spark, d):
    m = S.run_manifest(I.dense(spark, d), "ds", {"season": "4"})
    return m.select("n_rows", "fingerprint")


@register(
    "registry_best",
    "SELECT unique_id, arg_min(model, (mape, model)) AS best_model, min(mape) AS best_mape, count(*) AS n_models FROM board WHERE mape IS NOT NULL GROUP BY 1",
    ("board",),
)
def registry_best(spark, d):
    return S.registry_best(_board(spark, d), ["unique_id"], "mape")


@register(
    "manifest_counts",
    """SELECT l.unique_id, CAST(l.a AS VARCHAR) AS data_start, CAST(l.b AS VARCHAR) AS data_end, l.n AS row_count, b.m AS model_count, b.best_model, b.best_mape FROM
    (SELECT unique_id, min(ds) AS a, max(ds) AS b, count(*) AS n FROM dense GROUP BY 1) l LEFT JOIN
    (SELECT unique_id, count(*) AS m, arg_min(model, rank) AS best_model, arg_min(mape, rank) AS best_mape FROM board GROUP BY 1) b ON l.unique_id = b.unique_id""",
    ("dense", "board"),
)
def manifest_counts(spark, d):
    return S.manifest_counts(I.dense(spark, d), _board(spark, d), "unique_id")
