"""Backward as-of lookup without a range join.

Probes and history are stacked and walked once per key, so the work is one shuffle on the key and
the task size is the number of periods of that key plus its probes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_backward(
    probes: DataFrame,
    history: DataFrame,
    key: tuple[str, str],
    time: tuple[str, str],
    values: Mapping[str, str],
) -> DataFrame:
    """Attach to each probe the history values of the last period at or before the probe's period.

    ``key`` and ``time`` name the (probe, history) columns; ``values`` maps output to history column.
    History must hold one row per (key, period). Probes without a match get NULL.
    """
    probe_key, hist_key = key
    probe_time, hist_time = time
    # Probes of one key and period share the answer: look each pair up once.
    wanted = probes.select(F.col(probe_key).alias("__k"), F.col(probe_time).alias("__t")).distinct()
    stacked = history.select(
        F.col(hist_key).alias("__k"),
        F.col(hist_time).alias("__t"),
        F.lit(0).alias("__side"),
        F.struct(*[F.col(c).alias(o) for o, c in values.items()]).alias("__v"),
    ).unionByName(wanted.select("__k", "__t", F.lit(1).alias("__side")), allowMissingColumns=True)
    walk = W.partitionBy("__k").orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    found = (
        stacked.withColumn("__last", F.last("__v", ignorenulls=True).over(walk))
        .filter(F.col("__side") == 1)
        .select("__k", "__t", *[F.col(f"__last.{o}").alias(o) for o in values])
    )
    return (
        probes.join(found, (F.col(probe_key) == F.col("__k")) & (F.col(probe_time) == F.col("__t")), "left")
        .drop("__k", "__t")
    )
