"""Bootstrap intervals whose cost does not follow rows x replicates through a shuffle.

Random weights are drawn per block from a generator seeded by (seed, block), so the same data give the
same interval under any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import side_by_side
from tidemark.functions.ranking import global_rank
from tidemark.session import settle


#: Ranks kept one by one on either side of the cut, in standard deviations of where weights can move it.
BAND = 10


def ranked_bins(scored: DataFrame, score: str, label: str, tie: str, k: float) -> DataFrame:
    """Rank by score once. Rows around the cut at share ``k`` stay single; those far above it fold into one
    bin of (rows, positives) and those far below into another.

    The weights of n rows move the cut by about the root of k n ranks, so beyond ``BAND`` times that a row's place
    never matters, at any table size; some multiples of the root of the rows remain.
    """
    ranked = global_rank(scored.select(score, label, tie), [F.desc(score), F.asc(tie)])
    cut = F.col("rank_total") * F.lit(k)
    reach = BAND * F.sqrt(cut) + BAND
    place = F.greatest(F.floor(cut - reach), F.least(F.ceil(cut + reach), F.col("rank")))
    return ranked.groupBy(place.cast("long").alias("bin")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("n_pos")
    )


def poisson_lift_interval(
    scored: DataFrame, score: str, label: str, tie: str, k: float = 0.1, reps: int = 1000,
    seed: int = 42, alpha: float = 0.05,
) -> DataFrame:
    """Percentile interval of lift at the top ``k`` under Poisson(1) row weights.

    The sum of n Poisson(1) weights is Poisson(n), so a folded bin needs two draws per replicate whatever its
    size, and the cut always falls on a single row. The bins travel as one row of arrays and the replicates
    are spread over tasks, so nothing of size bins x replicates is shuffled.
    """
    folded = F.array_sort(F.collect_list(F.struct("bin", "n", "n_pos")))
    packed = ranked_bins(scored, score, label, tie, k).agg(folded.alias("b")).select(
        F.transform("b", lambda s: s["n"]).alias("n"), F.transform("b", lambda s: s["n_pos"]).alias("n_pos")
    )
    tasks = -(-reps // 25)
    blocks = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks, "block")

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, n, n_pos in zip(pdf["block"], pdf["n"], pdf["n_pos"]):
                n, n_pos = np.asarray(n), np.asarray(n_pos)
                lifts = [_weighted_lift(n, n_pos, k, np.random.default_rng([seed, rep])) for rep in range(block, reps, tasks)]
                yield pd.DataFrame({"lift": np.array(lifts, dtype=float)})

    lifts = blocks.mapInPandas(replicate, "lift double").filter(~F.isnan("lift"))
    return lifts.agg(
        F.percentile("lift", alpha / 2).alias("lift_lo"),
        F.percentile("lift", 1 - alpha / 2).alias("lift_hi"),
        F.count("lift").alias("reps"),
    )


def _weighted_lift(n: np.ndarray, n_pos: np.ndarray, k: float, rng: np.random.Generator) -> float:
    """Lift of one replicate over bins ordered from the best score down; the row at the cut counts whole."""
    if not len(n):
        return float("nan")
    pos = rng.poisson(n_pos)
    weight = pos + rng.poisson(n - n_pos)
    upto = np.cumsum(weight)
    at = int(np.searchsorted(upto, k * upto[-1]))
    if not pos.sum() or not upto[at]:
        return float("nan")
    return float(pos[: at + 1].sum() / upto[at] / (pos.sum() / upto[-1]))


def paired_bootstrap(
    mase: DataFrame, series: str, a: str, b: str, reps: int = 2000, seed: int = 42, alpha: float = 0.05, rows: int = 1000,
) -> DataFrame:
    """Mean per-entity difference of two models' scaled errors with a percentile interval.

    A replicate draws as many entities as there are, with replacement: first how many fall to each block of
    about ``rows`` entities (one multinomial draw), then which ones inside the block. A block returns one
    partial sum per replicate. With more than a thousand blocks' worth of entities the blocks grow instead, so
    the table of draws per block stays small enough to send to every task.
    """
    def of(m: str) -> Column:
        return F.avg(F.when(F.col("model") == m, F.col("mase")))

    per = (
        mase.filter(F.col("model").isin(a, b))
        .groupBy(series)
        .agg((of(a) - of(b)).alias("d"))
        .filter(F.col("d").isNotNull())
    )
    entities = per.count()
    blocks = min(max(1, -(-entities // rows)), 1000)
    per = per.withColumn("block", F.pmod(F.xxhash64(series), F.lit(blocks)).cast("int"))
    sizes = np.zeros(blocks, dtype="int64")
    for r in per.groupBy("block").count().collect():
        sizes[r["block"]] = r["count"]
    draws = per.sparkSession.sparkContext.broadcast(
        np.random.default_rng(seed).multinomial(entities, sizes / max(entities, 1), size=reps) if entities else np.zeros((reps, blocks), dtype="int64")
    )

    def weigh(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(series, kind="stable")["d"].to_numpy()
        rng = np.random.default_rng([seed, int(key[0])])
        wd = [d[rng.integers(0, len(d), n)].sum() for n in draws.value[:, int(key[0])]]
        return pd.DataFrame({"rep": np.arange(reps), "wd": wd})

    parts = per.groupBy("block").applyInPandas(weigh, "rep long, wd double")
    means = parts.groupBy("rep").agg((F.sum("wd") / F.lit(float(max(entities, 1)))).alias("m"))
    interval = means.agg(
        F.percentile("m", alpha / 2).alias("ci_lo"), F.percentile("m", 1 - alpha / 2).alias("ci_hi")
    )
    point = per.agg(F.avg("d").alias("mean_diff"), F.count("*").alias("entities"))
    return side_by_side(point, interval)


def _halves(block: int, blocks: int) -> Iterator[tuple[int, int, int, bool]]:
    """(low, middle, high, whether the block lies above the middle) of each halving of 0..blocks on the way to one block."""
    low, high = 0, blocks
    while high - low > 1:
        middle = (low + high) // 2
        above = block >= middle
        yield low, middle, high, above
        low, high = (middle, high) if above else (low, middle)


def block_draws(sizes: np.ndarray, block: int, reps: int, seed: int) -> np.ndarray:
    """How many of all entities each replicate draws from one block: its part of one multinomial draw.

    The draws of a range of blocks are split between its halves by a binomial draw that is seeded by the range, so
    every block finds its own number alone and those of all blocks add up.
    """
    upto = np.concatenate([[0], np.cumsum(sizes)])
    n = np.full(reps, upto[-1], dtype="int64")
    for low, middle, high, above in _halves(block, len(sizes)):
        whole = upto[high] - upto[low]
        share = (upto[middle] - upto[low]) / whole if whole else 0.0
        left = np.random.default_rng([seed, low, high]).binomial(n, share)
        n = n - left if above else left
    return n


def paired_bootstrap_all(
    mase: DataFrame, series: str, baseline: str, reps: int = 2000, seed: int = 42, alpha: float = 0.05, rows: int = 1000,
) -> DataFrame:
    """Every model against ``baseline``: (model, mean_diff, ci_lo, ci_hi, entities), percentile intervals of the mean difference.

    All pairs see the same replicates: entities are drawn once, as many as there are, with replacement, and each
    block of about ``rows`` entities returns one vector of sums, and of how many drawn entities have the pair, per
    replicate and model. A block finds its share of the draws by itself, so blocks do not grow with the entities and
    only their sizes are sent to tasks (8 bytes per ``rows`` entities). Entities without the baseline take no part.
    """
    of = mase.groupBy(series).agg(
        F.avg(F.when(F.col("model") == baseline, F.col("mase"))).alias("__base"), F.collect_list(F.struct("model", "mase")).alias("__m")
    ).filter("__base is not null")
    blocks = max(1, -(-of.count() // rows))
    block = F.pmod(F.xxhash64(series), F.lit(blocks)).cast("int").alias("block")
    per = settle(of.select(F.col(series).cast("string").alias("id"), block, "__base", F.explode("__m").alias("m")).groupBy("block", "id", "m.model").agg(
        (F.avg("m.mase") - F.first("__base")).alias("d")
    ))
    sizes = np.zeros(blocks, dtype="int64")
    for r in per.groupBy("block").agg(F.countDistinct("id").alias("n")).toLocalIterator():
        sizes[r["block"]] = r["n"]
    shared = per.sparkSession.sparkContext.broadcast(sizes)

    def weigh(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # Entities in rows, models in columns; a missing model leaves a gap.
        table = pdf.pivot(index="id", columns="model", values="d").sort_index()
        d, has = table.fillna(0.0).to_numpy(), table.notna().to_numpy()
        rng = np.random.default_rng([seed, 1, int(key[0])])
        sums, counts = [], []
        for n in block_draws(shared.value, int(key[0]), reps, seed):
            drawn = np.bincount(rng.integers(0, len(d), n), minlength=len(d))
            sums.append(drawn @ d)
            counts.append(drawn @ has)
        out = [pd.DataFrame({"model": m, "rep": np.arange(reps), "wd": np.array(sums)[:, k], "n": np.array(counts)[:, k]}) for k, m in enumerate(table.columns)]
        return pd.concat(out)

    parts = per.groupBy("block").applyInPandas(weigh, "model string, rep long, wd double, n long")
    means = parts.groupBy("model", "rep").agg(F.try_divide(F.sum("wd"), F.sum("n")).alias("m"))
    intervals = means.groupBy("model").agg(F.percentile("m", alpha / 2).alias("ci_lo"), F.percentile("m", 1 - alpha / 2).alias("ci_hi"))
    points = per.groupBy(F.col("model").alias("__model")).agg(F.avg("d").alias("mean_diff"), F.count("*").alias("entities"))
    return intervals.filter(F.col("model") != baseline).join(points, F.col("model") == F.col("__model")).select("model", "mean_diff", "ci_lo", "ci_hi", "entities")
