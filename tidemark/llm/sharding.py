"""Sharding by weighted rendezvous hashing of stable record keys.

Each shard draws an exponential number for a record, from a digest of key and shard, divided by the shard's
weight; the smallest draw takes the record. A shard's share is its weight's share. Draws do not depend on
the other shards, so a new shard takes records only into itself, and a removed one gives only its own away.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import global_rank
from tidemark.llm.common import uniform


def draw(key: Column, shard: int, weight: float) -> Column:
    return -F.log(uniform(key, shard)) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float], first: Column | None = None) -> Column:
    """(draw, shard) of the shard that takes the key; shards of weight 0 take nothing."""
    draws = [F.struct(draw(key, i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not draws:
        raise ValueError("no shard has a positive weight")
    return F.array_min(F.array(*draws))


def assign(df: DataFrame, key: str, weights: Sequence[float], added: Sequence[float] = ()) -> DataFrame:
    """Add ``shard`` and, where weights of further shards are given, ``grown_shard``.

    A null key is a key of its own. Equal keys go to one shard.
    """
    best = df.withColumn("__best", rendezvous(F.col(key), weights))
    out = best.withColumn("shard", F.col("__best.shard"))
    if added:
        more = [
            F.struct(draw(F.col(key), len(weights) + i, w).alias("draw"), F.lit(len(weights) + i).alias("shard"))
            for i, w in enumerate(added) if w > 0
        ]
        out = out.withColumn("grown_shard", F.array_min(F.array(F.col("__best"), *more))["shard"])
    return out.drop("__best")


def shard_documents(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text plus 16), text_crc32, law, shard, slot, grown_shard of every row.

    ``slot`` counts from 0 within a shard in the order of doc_id; a shard's rows are numbered over as many
    tasks as they need. Null texts have no bytes; null ids are one key; repeated rows take slots of their own.
    """
    weights = list(weights or [1.0] * shards)
    raw = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw).cast("long") + 16).alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
    )
    placed = assign(narrow, "doc_id", weights, added=[weights[-1]])
    ranked = global_rank(placed, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], ["shard"], "slot")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("slot") - 1).alias("slot"), "grown_shard",
    )
