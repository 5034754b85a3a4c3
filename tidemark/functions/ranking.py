"""Ranks, running sums and quantiles over groups that do not fit in one task.

A window without partition keys, or partitioned by a handful of model names, runs in as many
tasks as it has keys. Here rows are range-partitioned on (group, order) instead, each sorted
partition is summed on its own, and the few per-partition totals (one row per range partition and
group, whatever the number of rows) are added up and joined back.
A hot group is spread over as many partitions as its rows need.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import settle

_ROW = "__row"
_PART = "__part"


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, str],
) -> DataFrame:
    """Add, for each ``out -> column`` in ``sums``, the inclusive running sum within the group
    as ``out`` and the group total as ``out_total``.

    ``order`` must be a total order within the group. The sorted rows are settled in the shared
    folder because partition numbers are only meaningful for one execution of the sort.
    """
    group = list(group)
    tagged = settle(
        df.orderBy(*group, *order).withColumn(_ROW, F.monotonically_increasing_id())
    ).withColumn(_PART, F.shiftright(F.col(_ROW), 33))

    totals = tagged.groupBy(*group, _PART).agg(
        *[F.sum(c).alias(f"__t_{out}") for out, c in sums.items()]
    )
    across = W.partitionBy(*group)
    before = across.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"__g_{g}") for g in group],
        F.col(_PART).alias("__p"),
        *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__b_{o}") for o in sums],
        *[F.sum(f"__t_{o}").over(across).alias(f"{o}_total") for o in sums],
    )
    within = W.partitionBy(_PART, *group).orderBy(_ROW).rowsBetween(W.unboundedPreceding, 0)
    match = F.col(_PART) == F.col("__p")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    out = tagged.select(
        "*", *[F.sum(c).over(within).alias(f"__w_{o}") for o, c in sums.items()]
    ).join(offsets, match)
    return out.select(
        *df.columns,
        *[(F.col(f"__b_{o}") + F.col(f"__w_{o}")).alias(o) for o in sums],
        *[f"{o}_total" for o in sums],
    )


def global_rank(
    df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), out: str = "rank"
) -> DataFrame:
    """Row number (from 1) in a total order, with the group size as ``<out>_total``."""
    return running_sums(df.withColumn("__one", F.lit(1).cast("long")), group, order, {out: "__one"}).drop("__one")


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Linear-interpolated exact quantiles of one column over groups of any size.

    Equal values are counted before they are sorted, so the shuffle carries distinct values.
    """
    group = list(group)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n"))
    ranked = running_sums(counts, group, [F.col(value)], {"__upto": "__n"})
    ranked = ranked.withColumn("__from", F.col("__upto") - F.col("__n"))

    def at(position: Column) -> Column:
        hit = (F.col("__from") <= position) & (position < F.col("__upto"))
        return F.max(F.when(hit, F.col(value)))

    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__upto_total") - 1)
        aggs += [
            at(F.floor(pos)).alias(f"__lo_{name}"),
            at(F.ceil(pos)).alias(f"__hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"__f_{name}"),
        ]
    out = ranked.groupBy(*group).agg(*aggs)
    return out.select(
        *group,
        *[
            (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}")).alias(n)
            for n in probs
        ],
    )
