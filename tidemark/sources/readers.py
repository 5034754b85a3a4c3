"""Typed readers. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import quarter_end


def scan_panel_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All period files under a folder in the declared schema; fails if there are none."""
    return spark.read.schema(schema).parquet(path)


def ingest_lenient_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    strict: Mapping[str, str],
    lenient: Mapping[str, str],
    codes: Sequence[str] = (),
    drop: Iterable[str] = (),
) -> DataFrame:
    """Read every column as text, strip and cast. Strict columns fail the job on bad input, lenient ones
    become NULL, code columns lose a trailing ``.0``."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", True).csv(path)

    def typed(c: str) -> Column:
        trimmed = F.trim(F.col(c))
        if c in strict:
            return trimmed.cast(strict[c]).alias(c)
        if c in lenient:
            return trimmed.try_cast(lenient[c]).alias(c)
        if c in codes:
            return F.regexp_replace(trimmed, r"\.0$", "").alias(c)
        return F.col(c).alias(c)

    skip = set(drop)
    return raw.select(*[typed(c) for c in columns if c not in skip])


def load_series_csv(spark: SparkSession, path: str, layouts: Mapping[str, Sequence[str]]) -> DataFrame:
    """Series CSV in one of two layouts told apart by the header: quarter labels with an amount, or
    quarter-end dates with a level. Header names are stripped. Returns (series, ds, y).

    ``layouts`` maps the period column of a layout to (series column, value column).
    """
    raw = spark.read.option("header", True).csv(path)  # header only: all columns stay text
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    for period, (series, value) in layouts.items():
        if period in raw.columns:
            parsed = quarter_end(
                F.make_date(
                    F.regexp_extract(period, r"(\d{4})", 1).cast("int"),
                    (F.regexp_extract(period, r"Q(\d)", 1).try_cast("int") * 3).cast("int"),
                    F.lit(1),
                )
                if period != "quarter_end"
                else F.to_date(F.trim(period))
            )
            return raw.select(F.col(series).alias("series"), parsed.alias("ds"), F.trim(value).try_cast("double").alias("y"))
    raise ValueError(f"none of the period columns {list(layouts)} in {raw.columns}")


def read_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """An artifact that may be missing: an empty table of the declared schema then. Malformed JSON rows
    come back as no rows."""
    try:
        reader = spark.read.schema(schema)
        if fmt == "json":
            return reader.option("mode", "DROPMALFORMED").json(path)
        return reader.option("header", True).format(fmt).load(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in an explicit order. ``min_by`` combines before the shuffle, so a key with a
    third of the rows costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def reconcile(df: DataFrame, keys: Sequence[str], declared: DataFrame, expected: str, strict: bool = True) -> DataFrame:
    """Row count per key against a declared total; fails the job on a mismatch when strict."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = declared.join(counts, list(keys), "full").withColumn("n", F.coalesce("n", F.lit(0)))
    ok = F.coalesce(F.col("n") == F.col(expected), F.lit(False))
    if strict:
        ok = F.when(ok, True).otherwise(F.raise_error(F.lit("row count differs from the declared total")).cast("boolean"))
    return joined.withColumn("reconciled", ok)

