"""Writers, run records and model registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import finite


def by_folder(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of one folder together before a partitioned write, so a folder gets few files.

    A rebalance rather than a repartition: the runtime splits a folder that holds a large share.
    """
    return df.hint("rebalance", *columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    df = by_folder(df, partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def land_by_period(df: DataFrame, path: str, period: str, force: bool = False) -> DataFrame:
    """Land rows one folder per period; periods already there are skipped unless ``force``.

    Only the periods written are replaced, and a failed run leaves earlier ones as they were.
    """
    spark = df.sparkSession
    if not force:
        try:
            # Partition folders answer this without reading a file.
            there = spark.read.parquet(path).select(F.col(period).cast(df.schema[period].dataType).alias(period)).distinct()
            df = df.join(there, period, "left_anti")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
                raise
    by_folder(df, [period]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)
    return spark.read.parquet(path)


def rounded(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    return df.withColumns({c: F.bround(F.col(c), d) for c, d in digits.items()})


def write_csv_rounded(df: DataFrame, path: str, digits: Mapping[str, int]) -> str:
    rounded(df, digits).write.mode("overwrite").option("header", True).csv(path)
    return path


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating column."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: finite(F.col(c)) for c in floats})


def json_documents(df: DataFrame, keys: Sequence[str], out: str = "document") -> DataFrame:
    safe = json_safe(df)
    body = F.struct(*[c for c in safe.columns if c not in keys])
    return safe.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias(out))


def export_json(df: DataFrame, path: str) -> str:
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def run_manifest(df: DataFrame, period: str, config: Mapping[str, str]) -> DataFrame:
    """One provenance row: rows, period range, content fingerprint, settings and time.

    The fingerprint adds row hashes in 38 decimal digits, so it ignores row order but not duplicates.
    """
    row_hash = F.xxhash64(*df.columns).cast("decimal(38,0)")
    settings: Column = F.create_map(*[F.lit(v) for kv in sorted(config.items()) for v in kv])
    return df.agg(
        F.count("*").alias("n_rows"),
        F.min(period).alias("period_start"),
        F.max(period).alias("period_end"),
        F.sum(row_hash).cast("string").alias("fingerprint"),
    ).select("*", settings.alias("config"), F.current_timestamp().alias("recorded_at"))


def append_run(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("append").parquet(path)


def registry_best(metrics: DataFrame, keys: Sequence[str], metric: str, lower_is_better: bool = True) -> DataFrame:
    """Best model per key; a missing metric never wins, the name breaks ties."""
    signed = F.col(metric) if lower_is_better else -F.col(metric)
    return metrics.filter(F.col(metric).isNotNull()).groupBy(*keys).agg(
        F.min_by("model", F.struct(signed, F.col("model"))).alias("best_model"),
        (F.min(metric) if lower_is_better else F.max(metric)).alias(f"best_{metric}"),
        F.count("*").alias("n_models"),
    )


def manifest_counts(levels: DataFrame, board: DataFrame, series: str) -> DataFrame:
    """Data range, rows, models and best model per series."""
    data = levels.groupBy(series).agg(
        F.min("ds").alias("data_start"), F.max("ds").alias("data_end"), F.count("*").alias("row_count")
    )
    models = board.groupBy(series).agg(
        F.count("*").alias("model_count"), F.min_by("model", "rank").alias("best_model"), F.min_by("mape", "rank").alias("best_mape")
    )
    return data.join(models, series, "left")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
