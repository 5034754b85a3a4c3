"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document draws an exponential key divided by its quality weight. Within a source documents are taken in
the order of their keys until the token budget is met, which is weighted sampling without replacement.
Whole epochs come first: a target of 1.4 times the source takes every document once and then draws 0.4.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ranking import running_sums
from tidemark.llm.common import uniform, word_count

#: Runs of symbols that mark junk; a document's quality weight falls with their number per word.
SYMBOLS = "[#*$%&|<>!]+"


def quality_weight(text: Column, size: Column) -> Column:
    """1 for text without runs of symbols, less the more of them there are per word."""
    runs = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))
    return F.lit(1.0) / (F.lit(1.0) + runs / F.greatest(size, F.lit(1)))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size) with the target of each source.

    Sources by code point, null last, weigh ``weights``, repeating; they share ``percent`` of all words by
    weight. A target stops at ``most`` times its source, the excess is shared again by weight. Sources that
    stop are a prefix in the order of size over weight, so two running sums replace the repeated sharing.
    The table has one row per source, which is all that the windows without keys see.
    """
    everything = W.orderBy(F.col("source").isNull(), "source")
    which = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int"))
    table = sizes.select("source", "source_size", which.cast("long").alias("w"))
    whole = W.partitionBy()
    cap = F.col("source_size") * most
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    table = table.withColumn("cap", cap).select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.sum("w").over(whole).alias("w_all"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    left = F.col("total") * percent / 100 - F.col("cap_before")
    stops = F.col("cap") * (F.col("w_all") - F.col("w_before")) <= left * F.col("w")
    table = table.withColumn("stops", stops)
    capped = F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(whole), F.lit(0))
    w_open = F.sum(F.when(~F.col("stops"), F.col("w"))).over(whole)
    share = (F.col("total") * percent / 100 - capped) * F.col("w") / w_open
    return table.select("source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 7,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken (words, repeats counted) of every document.

    Every document is taken ``epochs`` times; then documents in key order are taken once more as long as the
    middle of the document lies within the rest of the budget, so a source misses its target by half a
    document at most. Keys depend on doc_id and seed alone, so reruns agree; ties go to the smaller id.
    A source may hold any share of the rows: the order and its sums are spread over tasks. A null source is
    a source of its own; null and empty texts have size 0 and are taken for nothing.
    """
    size = word_count(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), F.col(text).alias("__text"))
    weight = quality if quality is not None else quality_weight(F.col("__text"), F.col("size"))
    keyed = rows.select("doc_id", "source", "size", (-F.log(uniform(F.col("doc_id"), seed)) / weight).alias("__key"))
    summed = running_sums(keyed, ["source"], [F.col("__key"), F.col("doc_id"), F.col("size")], {"__upto": "size"})
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, percent, most).withColumnRenamed("source", "__source")
    out = summed.join(targets, F.col("source").eqNullSafe(F.col("__source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    middle = F.col("__upto") - F.col("size") / 2
    once_more = (F.col("size") > 0) & (middle <= rest) & (F.col("epochs") < most)
    out = out.withColumn("epochs", epochs.cast("long"))
    copies = F.col("epochs") + once_more.cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * copies).alias("taken"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **kw: object) -> DataFrame:
    """The mix as rows, all columns as they were: each document as often as it is taken.

    Rows that agree in id, source and size share a decision.
    """
    plan = mix(docs, doc_id=doc_id, text=text, source=source, **kw).filter("taken > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), (F.col("taken") / F.col("size")).cast("int").alias("times")
    ).dropDuplicates(["__id", "__source", "__size"])
    tagged = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("n"))
    match = F.col("id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("n") == F.col("__size"))
    return tagged.join(plan, match).select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
