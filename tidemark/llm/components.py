"""Connected components of a graph whose edges and components may have any size.

Alternating large-star and small-star steps: every node learns the smallest node around it and hands it to its
larger (then smaller) neighbours, until each component is a star around its smallest node. A step is a
combinable minimum per node and a join; each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its smallest node.

    Loops and repeated edges do no harm; nodes without edges do not appear.
    """
    a, b = F.col("a"), F.col("b")
    now = stored(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, a == F.col("k")).filter(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        near = large.join(least, a == F.col("k"))
        small = near.select(a, F.col("m").alias("b")).unionByName(near.filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")))
        now = stored(small.distinct(), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(a.alias("node"), b.alias("component")).unionByName(now.select(b.alias("node"), b.alias("component")).distinct())
