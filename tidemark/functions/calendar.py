"""Period arithmetic. Quarters are dated at their last day and counted by ``4 * year + quarter - 1``."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quarter_index(ds: Column) -> Column:
    return (F.year(ds) * 4 + F.quarter(ds) - 1).cast("int")


def month_index(ds: Column) -> Column:
    return (F.year(ds) * 12 + F.month(ds)).cast("int")


def day_index(ds: Column) -> Column:
    return F.datediff(ds, F.lit("1970-01-01").cast("date"))


def quarter_end(ds: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(ds, "quarter"), 2))


def whole_quarters(since: str, until: str) -> tuple[date, date]:
    """First and last day of the quarters that end from ``since`` to ``until``; last before first where there is none."""
    first, last = date.fromisoformat(since), date.fromisoformat(until) + timedelta(days=1)
    return date(first.year, first.month - (first.month - 1) % 3, 1), date(last.year, last.month - (last.month - 1) % 3, 1) - timedelta(days=1)


def quarter_end_of_index(q: Column) -> Column:
    return F.last_day(F.make_date(F.floor(q / 4).cast("int"), (F.pmod(q, F.lit(4)) * 3 + 3).cast("int"), F.lit(1)))


def quarter_label(ds: Column, gap: str = "") -> Column:
    return F.concat(F.year(ds).cast("string"), F.lit(f"{gap}Q"), F.quarter(ds).cast("string"))


def fiscal_quarter(ds: Column) -> Column:
    """April to March years, named by the year they end in: March 2025 is ``Q4FY25``."""
    year = F.year(ds) + (F.month(ds) > 3).cast("int")
    return F.concat(
        F.lit("Q"),
        ((F.quarter(ds) + 2) % 4 + 1).cast("string"),
        F.lit("FY"),
        F.lpad((year % 100).cast("string"), 2, "0"),
    )


def reporting_quarter_end(filed: Column) -> Column:
    """The last quarter end strictly before the filing date."""
    return F.last_day(F.add_months(F.trunc(filed, "quarter"), -1))


def horizon_quarters(ds: Column, origin: Column) -> Column:
    return quarter_index(ds) - quarter_index(origin)


def utc_instant(local: Column) -> Column:
    """A zone-less timestamp read as UTC, whatever the session's zone (event time must be an instant)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), local))


def utc_date(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))


def quarter_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every quarter end between two dates, both included."""
    return (
        spark.range(1)
        .select(
            F.explode(
                F.sequence(
                    F.trunc(F.lit(start).cast("date"), "quarter"),
                    F.lit(end).cast("date"),
                    F.expr("interval 3 months"),
                )
            ).alias("first_day")
        )
        .select(quarter_end(F.col("first_day")).alias("ds"))
        .filter(F.col("ds").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    )
