"""Structured Streaming forms of landing, period totals and CUSUM monitoring.

Each takes a streaming DataFrame and returns a streaming DataFrame; ``run_to_table`` drives one through
everything currently available and hands back what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.session import shared_dir


def read_files(spark: SparkSession, path: str, schema: T.StructType, name_glob: str = "*.parquet",
               files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, out: str | None = None, checkpoint: str | None = None, mode: str = "append",
                 partition_by: list[str] | None = None) -> DataFrame:
    """Process everything available into a parquet table and read it back.

    With the same ``out`` and ``checkpoint`` a later call takes up where this one stopped.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out, checkpoint = out or f"{base}/data", checkpoint or f"{base}/checkpoint"
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def landed(stream: DataFrame, keys: list[str], ts: str, lateness: str = "1 hour") -> DataFrame:
    """Drop repeats of a key that arrive within the lateness bound."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def land_once(stream: DataFrame, keys: list[str], out: str, checkpoint: str, partition_by: list[str] | None = None) -> DataFrame:
    """Land every key once, however late and in whatever order its rows come, and read the table back.

    A batch writes a folder of its own: its keys less those that other batches have landed. A batch that is run
    again, after a failure or a restart, replaces its folder with the same rows. Of rows of one batch that repeat a
    key the smallest stays, across batches the first landed. Null keys count as equal. No state is kept beside the
    table, so nothing grows with the keys but what has landed.
    """
    spark, run = stream.sparkSession, uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex[:8]
    rest = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.StringType())])

    def earlier() -> DataFrame | None:
        try:
            return spark.read.schema(schema).option("basePath", out).parquet(out)
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" in str(exc):
                return None
            raise

    def write(batch: DataFrame, batch_id: int) -> None:
        own = f"{run}-{batch_id}"
        rows = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__rest")).select(*keys, "__rest.*") if rest else batch.distinct()
        there = earlier()
        if there is not None:
            # The columns that name folders are compared as well: only the folders a batch touches are read.
            known = there.filter(F.col("batch") != own).select(*[F.col(k).alias(f"__{k}") for k in keys])
            same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
            rows = rows.join(known, same, "left_anti")
        writer = rows.select(*stream.columns).write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{out}/batch={own}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    landed_rows = earlier()
    return spark.createDataFrame([], stream.schema) if landed_rows is None else landed_rows.select(*stream.columns)


def drain(source: str, schema: T.StructType, spark: SparkSession, ts: str, lateness: str = "1 hour", period: str = "1 day") -> None:
    """Put a marker row into a source folder: all null, with an event time that closes every window seen so far.

    The next run over the folder, with the checkpoint of the last one, emits what was still open. To be called when
    no more rows are to come; ``period_totals`` keeps markers out of the results.
    """
    last = spark.read.schema(schema).parquet(source).agg(F.max(ts).alias("last"))
    close = F.expr(f"last + INTERVAL '{period}' + INTERVAL '{period}' + INTERVAL '{lateness}'")
    row = last.filter("last is not null").select(*[close.cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    row.coalesce(1).write.mode("append").parquet(source)


def running_totals(stream: DataFrame, ts: str, value: str, keys: list[str], period: str = "1 day") -> DataFrame:
    """Sum and count per window and key with no bound on lateness, for ``run_updates``: no row is ever dropped.

    State is one row per window and key, bounded by the calendar and the keys.
    """
    return (
        stream.groupBy(F.window(ts, period).alias("w"), *keys)
        .agg(F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("total"), F.count("*").alias("n"))
        .select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), *keys, "total", "n")
    )


def run_updates(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Process everything available in update mode and return the newest row of every key.

    A batch writes the rows it changed as a folder named by its number, replaced if the batch is run again.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).option("basePath", out).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r")).select(*keys, "__r.*").select(*stream.columns)


def period_totals(stream: DataFrame, ts: str, value: str, keys: list[str], period: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Sum and count per closed window and key; a window is emitted once, when the watermark passes it.

    Markers of ``drain``, rows whose keys are all null, move the watermark and are not counted.
    """
    return (
        stream.withWatermark(ts, lateness)
        # Naming the event time keeps the filter above the watermark, which a marker has to reach.
        .filter(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull() | F.col(ts).isNull())
        .groupBy(F.window(ts, period).alias("w"), *keys)
        .agg(F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("total"), F.count("*").alias("n"))
        .select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), *keys, "total", "n")
    )


CUSUM_SCHEMA = "key string, period_start timestamp, n long, cusum_pos double, cusum_neg double, cusum_max double, alert boolean"


class CusumProcessor(StatefulProcessor):
    """Running two-sided CUSUM per key. State is four numbers, so memory grows with keys, not rows."""

    def __init__(self, slack: float = 0.5, limit: float = 4.0) -> None:
        self.slack, self.limit = slack, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chart = handle.getValueState("chart", "n long, pos double, neg double, peak double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, pos, neg, peak = self.chart.get() if self.chart.exists() else (0, 0.0, 0.0, 0.0)
        # Rows of one key in one batch are one row per closed period: sort them by event time.
        batch = pd.concat(list(rows)).sort_values("period_start", kind="stable")
        out = []
        for start, z in zip(batch["period_start"], batch["z"]):
            n += 1
            if n > 1:  # the first value only opens the chart
                pos, neg = max(0.0, pos + z - self.slack), max(0.0, neg - z - self.slack)
            peak = max(peak, pos, neg)
            out.append((key[0], start, n, pos, neg, peak, peak > self.limit))
        self.chart.update((n, pos, neg, peak))
        columns = ["key", "period_start", "n", "cusum_pos", "cusum_neg", "cusum_max", "alert"]
        yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass


def cusum_monitor(totals: DataFrame, key: str, reference: DataFrame, slack: float = 0.5, limit: float = 4.0) -> DataFrame:
    """CUSUM of streaming period totals against reference moments ``(key, ref_mean, ref_std)``."""
    z = (F.col("total") - F.col("ref_mean")) / F.col("ref_std")
    # A plain equality would put "key is not null" below the watermark, out of reach of the marker of a drained stream.
    known = reference.withColumnRenamed(key, "__key")
    scored = totals.join(known, F.col(key).eqNullSafe(F.col("__key"))).select(F.col(key).cast("string").alias("key"), "period_start", z.alias("z"))
    return scored.groupBy("key").transformWithStateInPandas(
        statefulProcessor=CusumProcessor(slack, limit), outputStructType=T._parse_datatype_string(CUSUM_SCHEMA),
        outputMode="Append", timeMode="None",
    )
