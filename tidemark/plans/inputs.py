"""Operator inputs derived from the star-schema tables, each as a Spark plan and as the equivalent SQL.

Every input is reduced to one row per (entity, period) by a combinable aggregate before anything else
touches it. Money is summed in whole units of its last decimal, as BIGINT: exact in any order, and on the
primitive path of the aggregation where a wide DECIMAL would not be. An overflow fails the job.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import day_index, quarter_end_of_index, quarter_index, whole_quarters

EVENT_FLAGS = ("click", "error", "purchase", "signup", "view")
TARGETS = ("purchase", "signup")
ORIGINS = tuple(f"{y}-{md}" for y in (1998, 1999, 2000) for md in ("03-31", "06-30", "09-30", "12-31"))[3:]
TUNING = ("1997-12-31", "1998-06-30")


def units(amount: Column, decimals: int) -> Column:
    return F.rint(amount * 10.0**decimals).cast("long")


def money_sum(amount: Column, decimals: int) -> Column:
    return F.sum(units(amount, decimals)) / F.lit(10.0**decimals)


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dense(spark: SparkSession, d: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Supplier x quarter revenue: long series without gaps.

    Only quarters ending from ``since`` to ``until``, if both are given: a range of ship dates, which the scan takes.
    """
    items = table(spark, d, "lineitem")
    if since and until:
        first, last = whole_quarters(since, until)
        items = items.filter((F.col("l_shipdate") >= F.lit(first)) & (F.col("l_shipdate") < F.lit(last + timedelta(days=1))))
    return (
        items
        .groupBy(F.col("l_suppkey").cast("string").alias("unique_id"), quarter_index(F.col("l_shipdate")).alias("q"))
        .agg(money_sum(revenue(), 4).alias("y"))
        .select("unique_id", quarter_end_of_index(F.col("q")).alias("ds"), "q", "y")
    )


def gappy(spark: SparkSession, d: str) -> DataFrame:
    """Customer x quarter orders: short series with many gaps."""
    return (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("entity"), quarter_index(F.col("o_orderdate")).alias("q"))
        .agg(money_sum(F.col("o_totalprice"), 2).alias("y"))
        .select("entity", quarter_end_of_index(F.col("q")).alias("ds"), "q", "y")
    )


def components(spark: SparkSession, d: str) -> DataFrame:
    """Part x quarter revenue by return flag, with the total rounded to whole units; parts are often missing."""
    def part(flag: str):
        return money_sum(F.when(F.col("l_returnflag") == flag, revenue()), 4).alias(f"part_{flag.lower()}")

    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_partkey").alias("entity"), quarter_index(F.col("l_shipdate")).alias("q"))
        .agg(part("A"), part("N"), part("R"), F.round(money_sum(revenue(), 4), 0).alias("whole"))
        .select("entity", quarter_end_of_index(F.col("q")).alias("ds"), "q", "part_a", "part_n", "part_r", "whole")
    )


def history(spark: SparkSession, d: str) -> DataFrame:
    """One structure event per customer; codes, parties and dates follow from its columns."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    codes = (211, 213, 216, 217, 221, 222, 223, 224, 810, 811, 150, 999)
    survivor = c - c % 3
    return table(spark, d, "customer").select(
        c.alias("event_id"),
        F.element_at(F.array(*[F.lit(k) for k in codes]), (n % 12 + 1).cast("int")).alias("change_code"),
        F.when(n % 2 == 0, survivor).alias("survivor_id"),
        survivor.alias("acquirer_id"),
        c.alias("out_id"),
        F.date_add(F.lit("1995-06-01").cast("date"), (n * 90).cast("int")).alias("effective_date"),
    )


def customer_days(spark: SparkSession, d: str) -> DataFrame:
    """User x day with one nullable flag per event type; the period is the day number."""
    ds = F.col("ts").cast("date")
    return (
        table(spark, d, "events")
        .groupBy("user_id", ds.alias("ds"))
        .agg(*[F.max(F.when(F.col("event_type") == t, 1)).cast("tinyint").alias(t) for t in EVENT_FLAGS])
        .withColumn("day", day_index(F.col("ds")))
    )


def demographics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"),
    )


def event_days(spark: SparkSession, d: str) -> DataFrame:
    """Event type x day totals, the macro-like exogenous table."""
    return (
        table(spark, d, "events")
        .groupBy("event_type", F.col("ts").cast("date").alias("ds"))
        .agg(money_sum(F.col("value"), 4).alias("y"), F.count("*").alias("n"))
        .withColumn("day", day_index(F.col("ds")))
    )


def macro(spark: SparkSession, d: str) -> DataFrame:
    """Quarter-level indicators from all orders, known only from the second quarter of each year on."""
    return (
        table(spark, d, "orders")
        .groupBy(quarter_index(F.col("o_orderdate")).alias("q"))
        .agg(
            F.count("*").cast("double").alias("orders_n"),
            money_sum(F.col("o_totalprice"), 2).alias("orders_value"),
        )
        .withColumn("rate", F.when(F.col("q") % 4 != 0, F.round(F.col("orders_value") / F.col("orders_n") / 1000, 6)))
    )


# The same inputs in SQL, by name and what they need ---------------------------------------------

_QEND = "CAST(last_day(make_date(CAST(floor(q/4) AS BIGINT), CAST((q%4)*3+3 AS BIGINT), 1)) AS DATE)"
_REV = "CAST(l_extendedprice*(1-l_discount) AS DECIMAL(18,4))"


def _q(c: str) -> str:
    return f"CAST(year({c})*4+quarter({c})-1 AS INTEGER)"


CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "dense": (
        f"""SELECT unique_id, {_QEND} AS ds, q, y FROM (SELECT CAST(l_suppkey AS VARCHAR) AS unique_id,
        {_q('l_shipdate')} AS q, CAST(sum({_REV}) AS DOUBLE) AS y FROM lineitem GROUP BY 1, 2)""", ()),
    "gappy": (
        f"""SELECT entity, {_QEND} AS ds, q, y FROM (SELECT o_custkey AS entity, {_q('o_orderdate')} AS q,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y FROM orders GROUP BY 1, 2)""", ()),
    "components": (
        f"""SELECT entity, {_QEND} AS ds, q, part_a, part_n, part_r, whole FROM (SELECT l_partkey AS entity,
        {_q('l_shipdate')} AS q,
        CAST(sum(CASE WHEN l_returnflag='A' THEN {_REV} END) AS DOUBLE) AS part_a,
        CAST(sum(CASE WHEN l_returnflag='N' THEN {_REV} END) AS DOUBLE) AS part_n,
        CAST(sum(CASE WHEN l_returnflag='R' THEN {_REV} END) AS DOUBLE) AS part_r,
        CAST(CAST(sum({_REV}) AS DECIMAL(28,0)) AS DOUBLE) AS whole FROM lineitem GROUP BY 1, 2)""", ()),
    "history": (
        """SELECT c_custkey AS event_id,
        list_extract([211,213,216,217,221,222,223,224,810,811,150,999], c_nationkey % 12 + 1) AS change_code,
        CASE WHEN c_nationkey % 2 = 0 THEN c_custkey - c_custkey % 3 END AS survivor_id,
        c_custkey - c_custkey % 3 AS acquirer_id, c_custkey AS out_id,
        DATE '1995-06-01' + CAST(c_nationkey*90 AS INTEGER) AS effective_date FROM customer""", ()),
    "cdays": (
        "SELECT user_id, CAST(ts AS DATE) AS ds, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, "
        + ", ".join(f"max(CASE WHEN event_type='{t}' THEN 1 END) AS {t}" for t in EVENT_FLAGS)
        + " FROM events GROUP BY 1, 2, 3", ()),
    "filled": (
        "SELECT user_id, ds, day, " + ", ".join(f"coalesce({t},0) AS {t}" for t in EVENT_FLAGS) + " FROM cdays", ("cdays",)),
    "demo": (
        "SELECT c_custkey AS user_id, c_mktsegment AS segment, c_acctbal AS acctbal, c_nationkey AS nation FROM customer", ()),
    "edays": (
        """SELECT event_type, CAST(ts AS DATE) AS ds, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
        CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS y, count(*) AS n FROM events GROUP BY 1, 2, 3""", ()),
    "macro": (
        f"""SELECT q, orders_n, orders_value, CASE WHEN q % 4 <> 0 THEN round(orders_value/orders_n/1000, 6) END AS rate FROM (
        SELECT {_q('o_orderdate')} AS q, CAST(count(*) AS DOUBLE) AS orders_n,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS orders_value FROM orders GROUP BY 1)""", ()),
}


def with_ctes(body: str, *needs: str) -> str:
    """``WITH`` clause of everything the body needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for dep in CTES[name][1]:
                add(dep)
            order.append(name)

    for n in needs:
        add(n)
    # RECURSIVE only permits self-reference; plain expressions are unaffected.
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTES[n][0]})" for n in order) + " " + body if order else body
