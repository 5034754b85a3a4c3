"""Streaming queries over the event table; each must give what the batch form gives, to the last row."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import functions as F

from tidemark.functions.calendar import utc_date, utc_instant
from tidemark.plans import inputs as I
from tidemark.plans.catalog import register
from tidemark.plans.inputs import CTES
from tidemark.session import settle, shared_dir
from tidemark.streaming import jobs as J

LATENESS = "1 hour"
REFERENCE_END = "2024-01-11"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Pieces of the event table that arrive one after the other.
ARRIVALS = 4

CTES |= {
    "sz": (
        f"""SELECT c.event_type, c.ds, (c.y - r.mu) / r.sd AS z, row_number() OVER (PARTITION BY c.event_type ORDER BY c.ds) AS n FROM edays c JOIN (
        SELECT event_type, avg(y) AS mu, stddev_pop(y) AS sd FROM edays WHERE ds < DATE '{REFERENCE_END}' GROUP BY 1) r ON c.event_type = r.event_type""", ("edays",)),
}


@contextmanager
def rocks(spark) -> Iterator[None]:
    """The state store that processors with state need, for the streams started inside only."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def arriving(spark, d, late: bool) -> tuple[str, object]:
    """A source folder that the event table arrives in piece by piece, and its schema.

    In order of time, or ``late``: the newest piece first, and a tenth of the rows once more with the last.
    """
    rows = I.table(spark, d, "events").withColumn("ts", utc_instant(F.col("ts")))
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    path = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    piece = F.least(F.lit(ARRIVALS - 1), F.floor((F.unix_micros("ts") - F.lit(low or 0)) / F.lit(((high or 0) - (low or 0)) / ARRIVALS + 1)))
    for k in range(ARRIVALS - 1, -1, -1) if late else range(ARRIVALS):
        rows.filter(piece == k).write.mode("append").parquet(path)
    if late:
        rows.filter(F.col("event_id") % 10 == 0).write.mode("append").parquet(path)
    return path, rows.schema


def source(spark, path, schema, files: int | None = 2):
    # A few files at a time, so state, restarts and order matter as they do in a running stream.
    return J.read_files(spark, path, schema, files_per_batch=files)


def place(spark) -> tuple[str, str]:
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/data", f"{base}/checkpoint"


@register("stream_incremental_land", "SELECT event_id, user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def stream_incremental_land(spark, d):
    """Pieces arrive newest first, some rows twice, and the stream is started twice: every row lands once."""
    path, schema = arriving(spark, d, late=True)
    out, checkpoint = place(spark)
    stream = source(spark, path, schema).select("event_id", "user_id", "event_type", utc_date(F.col("ts")).alias("day"))
    J.land_once(stream, ["event_id", "day"], out, checkpoint, ["day"])
    I.table(spark, d, "events").withColumn("ts", utc_instant(F.col("ts"))).filter(F.col("event_id") % 10 == 1).write.mode("append").parquet(path)
    return J.land_once(stream, ["event_id", "day"], out, checkpoint, ["day"])


_TOTALS = "SELECT event_type, CAST(ds AS VARCHAR) AS day, round(y, 4) AS total, n FROM edays"


def shown(totals):
    return totals.select("event_type", utc_date(F.col("period_start")).alias("day"), F.round("total", 4).alias("total"), "n")


@register("stream_period_totals", _TOTALS, ("edays",))
def stream_period_totals(spark, d):
    """Windows are emitted as they close; the last ones when the stream is drained and started again."""
    path, schema = arriving(spark, d, late=False)
    totals = J.period_totals(source(spark, path, schema), "ts", "value", ["event_type"], "1 day", LATENESS)
    out, checkpoint = place(spark)
    J.run_to_table(totals, out, checkpoint)
    J.drain(path, schema, spark, "ts", LATENESS, "1 day")
    return shown(J.run_to_table(totals, out, checkpoint))


@register("stream_period_totals_late", _TOTALS, ("edays",))
def stream_period_totals_late(spark, d):
    """Rows days behind the newest still count: every change of a window is written, the newest one is read."""
    path, schema = arriving(spark, d, late=True)
    events = source(spark, path, schema)
    out, checkpoint = place(spark)
    once = J.land_once(events, ["event_id"], out, checkpoint)
    folder = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    once.write.parquet(folder)
    totals = J.running_totals(source(spark, folder, schema), "ts", "value", ["event_type"])
    return shown(J.run_updates(totals, ["period_start", "event_type"], *place(spark)))


@register(
    "stream_cusum_monitor",
    """SELECT event_type AS key, CAST(ds AS VARCHAR) AS day, n, round(cu - least(min(cu) OVER w, 0), 6) AS cusum_pos, round(cd - least(min(cd) OVER w, 0), 6) AS cusum_neg FROM (
    SELECT *, sum(CASE WHEN n = 1 THEN 0 ELSE z - 0.5 END) OVER w AS cu, sum(CASE WHEN n = 1 THEN 0 ELSE -z - 0.5 END) OVER w AS cd FROM sz
    WINDOW w AS (PARTITION BY event_type ORDER BY ds ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY event_type ORDER BY ds ROWS UNBOUNDED PRECEDING)""",
    ("sz",),
)
def stream_cusum_monitor(spark, d):
    """The chart of every day up to the last; reference moments are settled before the stream starts."""
    reference = settle(
        I.event_days(spark, d).filter(F.col("ds") < F.lit(REFERENCE_END).cast("date"))
        .groupBy("event_type").agg(F.avg("y").alias("ref_mean"), F.stddev_pop("y").alias("ref_std"))
    )
    path, schema = arriving(spark, d, late=False)
    totals = J.period_totals(source(spark, path, schema, None), "ts", "value", ["event_type"], "1 day", LATENESS)
    chart = J.cusum_monitor(totals, "event_type", reference)
    out, checkpoint = place(spark)
    with rocks(spark):
        J.run_to_table(chart, out, checkpoint)
        J.drain(path, schema, spark, "ts", LATENESS, "1 day")
        rows = J.run_to_table(chart, out, checkpoint)
    return rows.select(
        "key", utc_date(F.col("period_start")).alias("day"), "n", F.round("cusum_pos", 6).alias("cusum_pos"),
        F.round("cusum_neg", 6).alias("cusum_neg"),
    )
