"""Hard negatives out of Hilbert-ordered Parquet blocks that zone maps let an anchor skip.

* Candidates are put in the order of (label, Hilbert curve over the widest dimensions) and cut into zones, one per
  range partition; a zone is written as blocks of some hundred rows, a row of the table each: packed ids, labels
  and vectors, with the smallest and largest value of every dimension and label (zone map). A last row per zone maps
  the whole zone.
* For an anchor, interval arithmetic over a map bounds every inner product with the rows behind it from both sides.
  Zones that cannot hold a positive among the first ``k`` (the bounds alone guarantee as many better ones), or no
  score inside any of the anchor's windows, are never joined to it; blocks of a joined zone are skipped likewise.
* Anchors travel packed, in groups; each group meets a zone's blocks in one task that holds one block and the best
  so far. What tasks found is ranked once more over the zones.

Only the maps of the zones are collected and broadcast: at most ``ZONES`` rows, whatever the table's size.
Scores are exact integers: products run in doubles where these cannot round, else in integers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Zones at most; rows a zone has before there are more zones; rows of a block; anchors of a group.
ZONES, ZONE, BLOCK, PACK = 512, 4_096, 512, 1_024
#: Dimensions the curve runs through, and steps per dimension as a power of two.
DIMENSIONS, BITS = 8, 4
POSITIVES, NEGATIVES = 5, 3
#: Stands for no score; products that no long holds stop above it.
LEAST = -(2**63)
#: Window of a negative's score in percent of the positive's.
LOW, HIGH = 50, 95


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cell numbers (below 2^bits) along the Hilbert curve through all dimensions.

    Level by level from the coarsest: a set bit mirrors the finer bits of the first axis, a clear one swaps them with
    that axis; then the bits are read off as a Gray code.
    """
    x = cells.astype("uint64").T.copy()
    top = np.uint64(1 << (bits - 1))
    level = top
    while level > 1:
        below = level - np.uint64(1)
        for axis in range(len(x)):
            mirrored = (x[axis] & level) > 0
            swap = np.where(mirrored, np.uint64(0), (x[0] ^ x[axis]) & below)
            x[0] = np.where(mirrored, x[0] ^ below, x[0] ^ swap)
            x[axis] ^= swap
        level >>= np.uint64(1)
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    level = top
    while level > 1:
        flip = np.where(x[-1] & level, flip ^ (level - np.uint64(1)), flip)
        level >>= np.uint64(1)
    x ^= flip
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            place = place << np.uint64(1) | (x[axis] >> np.uint64(bit)) & np.uint64(1)
    return place.astype("int64")


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), "int64")
    top = max(abs(int(x.min())), abs(int(x.max()))) * max(abs(int(y.min())), abs(int(y.max()))) * x.shape[1]
    if top < 2**53:
        return (x.astype("float64") @ y.T.astype("float64")).astype("int64")
    if top < 2**63:
        return x @ y.T
    exact = x.astype(object) @ y.astype(object).T
    return np.clip(exact, LEAST + 1, 2**63 - 1).astype("int64")


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``low`` and ``high`` of each zone."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    both = np.concatenate([plus, minus], axis=1)  # a positive component is least with the low end, a negative one with the high
    return products(both, np.concatenate([low, high], axis=1)), products(both, np.concatenate([high, low], axis=1))


def integer_rows(table: DataFrame, is_anchor: Column, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(id, label, x, anchor) of the rows that take part: label turned for ids divisible by 7, components floor(256 x)."""
    x = F.col(embedding)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = table.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~odd)
    key, own = F.col(vec_id).cast("long"), F.col(label).cast("long")
    turned = F.when(key % 7 == 0, (own + 1) % 10).otherwise(own)
    whole = F.transform(x, lambda v: F.floor(256 * v.cast("double")))
    return rows.select(key.alias("id"), turned.alias("label"), whole.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
    out = np.zeros((len(vectors), dims), "int64")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("int64")
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), place] = flat
    return out


def zoned(rows: DataFrame) -> tuple[DataFrame, int]:
    """The blocks and zone maps of a stored table (row, id, label, x), and the number of dimensions."""
    count, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    per = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("wide"))
    axes = [tuple(r) for r in per.orderBy(F.desc("wide"), "k").limit(DIMENSIONS).collect()]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(3), dims)
            cells = [np.clip((x[:, k] - mean) / (4 * wide or 1.0) + 0.5, 0, 1) * (2**BITS - 1) for k, mean, wide in axes]
            place = hilbert(np.rint(np.column_stack(cells)), BITS) if cells else np.zeros(len(x), "int64")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=["row", "id", "label", "x", "place"])

    order = ("label", "place", "id", "row")
    ordered = rows.select("row", "id", "label", "x").mapInArrow(keyed, "row long, id long, label long, x array<long>, place long")
    ordered = ordered.repartitionByRange(max(1, min(ZONES, -(-count // ZONE))), *order).sortWithinPartitions(*order)
    packs = ("rows", "ids", "labels", "vectors", "low", "high")
    schema = pa.schema([(k, pa.int64()) for k in ("zone", "block", "n", "label_lo", "label_hi")] + [(k, pa.binary()) for k in packs])

    def entry(zone: int, block: int, n: int, labels: tuple[int, int], arrays: list[np.ndarray]) -> pa.RecordBatch:
        values = [zone, block, n, *labels, *[a.tobytes() for a in arrays]]
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, values))], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zone, block, total, whole = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                row, ids, labels = (part.column(k).to_numpy() for k in range(3))
                x = matrix(part.column(3), dims)
                by_id = np.lexsort((row, ids))  # the first of equal scores has the smallest id
                low, high, lo, hi = x.min(axis=0), x.max(axis=0), int(labels.min()), int(labels.max())
                yield entry(zone, block, len(ids), (lo, hi), [row[by_id], ids[by_id], labels[by_id], x[by_id], low, high])
                block, total = block + 1, total + len(ids)
                whole = (low, high, lo, hi) if whole is None else (np.minimum(whole[0], low), np.maximum(whole[1], high), min(whole[2], lo), max(whole[3], hi))
        if whole is not None:
            yield entry(zone, -1, total, whole[2:], [np.zeros(0, "int64")] * 4 + list(whole[:2]))

    types = "zone long, block long, n long, label_lo long, label_hi long, " + ", ".join(f"{k} binary" for k in packs)
    return stored(ordered.select("row", "id", "label", "x").mapInArrow(cut, types), "blocks"), dims


class Maps:
    """The zone maps: at most ``ZONES`` of them, or as many as the session's least number of shuffle partitions."""

    def __init__(self, blocks: DataFrame, dims: int):
        rows = blocks.filter("block = -1").select("zone", "n", "label_lo", "label_hi", "low", "high").orderBy("zone").collect()
        self.zone, self.n, self.lo, self.hi = (np.array([r[k] for r in rows], "int64") for k in range(4))
        self.low, self.high = (np.array([np.frombuffer(r[k], "int64") for r in rows], "int64").reshape(len(rows), dims) for k in (4, 5))

    def with_positives(self, x: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
        """Which zones (columns) may hold one of an anchor's (rows) first ``k`` rows of the same label but itself."""
        least, most = bounds(x, self.low, self.high)
        may = (self.lo <= labels[:, None]) & (labels[:, None] <= self.hi)
        pure = may & (self.lo == self.hi)
        # Best guaranteed scores first: where k + 1 rows are guaranteed, k others are.
        order = np.argsort(-np.where(pure, least, LEAST + 1), axis=1, kind="stable")
        sure = np.cumsum(np.where(np.take_along_axis(pure, order, 1), self.n[order], 0), axis=1)
        enough = sure > k
        first = np.argmax(enough, axis=1)
        floor = np.where(enough.any(axis=1), np.take_along_axis(least, np.take_along_axis(order, first[:, None], 1), 1)[:, 0], LEAST)
        return may & (most >= floor[:, None])

    def with_windows(self, x: np.ndarray, labels: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Which zones may hold a row of another label whose score lies in a window of the anchor."""
        least, most = bounds(x, self.low, self.high)
        other = ~((self.lo == labels[:, None]) & (self.hi == labels[:, None]))
        return other & meets(least, most, windows)


def meets(least: np.ndarray, most: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether the bounds (anchors x zones) overlap any window (anchors x windows x 2) that is not empty."""
    some = np.zeros(least.shape, bool)
    for k in range(windows.shape[1]):
        low, high = windows[:, k, :1], windows[:, k, 1:]
        some |= (least <= high) & (most >= low) & (low <= high)
    return some


def window_of(score: int) -> tuple[int, int]:
    """Integers n with LOW * score <= 100 n <= HIGH * score; a window without any has its ends swapped."""
    return -(-LOW * score // 100), HIGH * score // 100


def windows_of(scores: pa.Array) -> np.ndarray:
    """(anchors x POSITIVES x 2) windows of the positives' scores; those without a positive are empty."""
    out = np.tile(np.array([1, 0], "int64"), (len(scores), POSITIVES, 1))
    for a, own in enumerate(scores.to_pylist()):
        for k, score in enumerate(own):
            out[a, k] = window_of(score)
    return out


def best_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of the greatest allowed score of each row, then of the second, to the ``k``-th; the first column of equals."""
    left = np.where(allowed, scores, LEAST)
    for _ in range(min(k, scores.shape[1])):
        at = left.argmax(axis=1)
        rows = np.flatnonzero(left[np.arange(len(at)), at] > LEAST)
        yield rows, at[rows]
        left[rows, at[rows]] = LEAST


PACKED = ("rows", "labels", "vectors", "windows")


def groups_of(anchors: DataFrame, dims: int, maps: Maps, positives: bool) -> DataFrame:
    """(zone, rows, labels, vectors, windows), stored: packed groups of the anchors (row, label, x, scores), each with a zone it must read."""
    shared = anchors.sparkSession.sparkContext.broadcast(maps)
    schema = pa.schema([("zone", pa.int64())] + [(k, pa.binary()) for k in PACKED])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                rows, labels, x, windows = part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), dims), windows_of(part.column(3))
                need = known.with_positives(x, labels, POSITIVES) if positives else known.with_windows(x, labels, windows)
                for k in np.flatnonzero(need.any(axis=0)):
                    packs = [a[need[:, k]].tobytes() for a in (rows, labels, x, windows)]
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [int(known.zone[k]), *packs]))], schema=schema)

    types = "zone long, " + ", ".join(f"{k} binary" for k in PACKED)
    return stored(anchors.select("row", "label", "x", "scores").mapInArrow(each, types), "reads")


def searched(anchors: DataFrame, blocks: DataFrame, dims: int, maps: Maps, positives: bool) -> DataFrame:
    """(row, slot, id, score): for each anchor (slot 0), or each of its windows (slots), the best rows of every zone it must read.

    Positives have the anchor's label, negatives another one and a score in the window. Only zones that some anchor
    must read are read.
    """
    k = POSITIVES if positives else NEGATIVES
    groups = groups_of(anchors, dims, maps, positives).select("zone", *[F.col(c).alias(f"anchor_{c}") for c in PACKED])
    zones = [r.zone for r in groups.select("zone").distinct().collect()]  # one number a zone
    data = blocks.filter((F.col("block") >= 0) & F.col("zone").isin(zones)).withColumnRenamed("zone", "__zone")
    met = groups.join(data.hint("merge"), F.col("zone") == F.col("__zone"))
    met = met.select(*[f"anchor_{c}" for c in PACKED], "label_lo", "label_hi", "low", "high", "rows", "ids", "labels", "vectors")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, np.zeros((0, 4), "int64")
        for batch in batches:
            for j in range(batch.num_rows):
                values = [batch.column(c)[j].as_py() for c in range(12)]
                # A group's blocks of a zone follow each other; in any order the result is the same, only longer.
                if values[0] != at:
                    yield as_rows(best)
                    at, best = values[0], best[:0]
                lo, hi = values[4:6]
                own, labels, x, windows, low, high, rows, ids, theirs, others = (np.frombuffer(v, "int64") for v in values[:4] + values[6:])
                x, windows = x.reshape(len(own), dims), windows.reshape(len(own), POSITIVES, 2)
                if positives:
                    need = (lo <= labels) & (labels <= hi)
                else:
                    least, most = bounds(x, low[None, :], high[None, :])
                    need = meets(least, most, windows)[:, 0] & ~((labels == lo) & (labels == hi))
                if not need.any():
                    continue
                own, labels, windows = own[need], labels[need], windows[need]
                scores = products(x[need], others.reshape(len(ids), dims))
                same = theirs[None, :] == labels[:, None]
                if positives:
                    choices = [same & (rows[None, :] != own[:, None])]
                else:
                    choices = [~same & (scores >= windows[:, w, :1]) & (scores <= windows[:, w, 1:]) for w in range(POSITIVES)]
                found = [best]
                for slot, allowed in enumerate(choices):
                    for a, b in best_of(scores, allowed, k):
                        found.append(np.column_stack([own[a], np.full(len(a), slot), ids[b], scores[a, b]]))
                best = first_of(np.concatenate(found), k)
        yield as_rows(best)

    return met.mapInArrow(each, "row long, slot long, id long, score long")


def first_of(found: np.ndarray, k: int) -> np.ndarray:
    """Of (row, slot, id, score) the ``k`` best of each row and slot: greatest score, then smallest id."""
    found = found[np.lexsort((found[:, 2], ~found[:, 3], found[:, 1], found[:, 0]))]
    starts = np.flatnonzero(np.r_[True, (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0)][: len(found)])
    rank = np.arange(len(found)) - np.repeat(starts, np.diff(np.r_[starts, len(found)]))
    return found[rank < k]


def as_rows(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[:, c]) for c in range(4)], names=["row", "slot", "id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each row and slot over all zones, numbered from 1; a group has at most ``k`` rows per zone."""
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(table: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows that ``is_anchor`` picks.

    Rows with a null id, label or vector, or any null or infinite or undefined component, take no part. Each row
    counts for itself, also where ids or whole rows repeat: all copies but the anchor's own row may be its positives.
    Shorter vectors count as ending in zeros. Ties go to the smaller id. Scores that no long holds stop at its ends.
    An anchor without positives, or a positive without negatives, gives no rows; an empty table gives none. Other
    columns are ignored.
    """
    rows = integer_rows(table, is_anchor, vec_id, embedding, label).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "vectors")
    blocks, dims = zoned(rows)
    maps = Maps(blocks, dims)
    chosen = rows.filter("anchor").select("row", "id", "label", "x")
    anchors = stored(chosen.repartition(max(1, -(-chosen.count() // PACK))), "anchors")
    best = ranked(searched(anchors.withColumn("scores", F.array().cast("array<long>")), blocks, dims, maps, True), POSITIVES)
    best = stored(best.select("row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = F.transform(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))), lambda s: s.positive_score)
    known = anchors.join(best.groupBy(F.col("row").alias("__row")).agg(scores.alias("scores")), F.col("row") == F.col("__row")).drop("__row")
    found = ranked(searched(known, blocks, dims, maps, False), NEGATIVES)
    found = found.select(F.col("row").alias("__row"), (F.col("slot") + 1).alias("__slot"), F.col("rank").cast("int").alias("place"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = best.join(found, (F.col("row") == F.col("__row")) & (F.col("rank") == F.col("__slot"))).drop("__row")
    out = out.join(anchors.select(F.col("row").alias("__row"), F.col("id").alias("anchor_id")), F.col("row") == F.col("__row"))
    return out.select("anchor_id", "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", "negative_score")
