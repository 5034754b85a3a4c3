"""Exact Jaccard self-join of word shingle sets, with skipping by set relations.

* Documents of equal sets are one class. Links are sought between classes only.
* Answer level: minhash buckets give every set a lead. What a set verified against its lead links to among the
  lead's other sets is derived from the shingles in which each differs from the lead; such pairs are never formed.
  Where only components are asked for, pairs of sets that leads connect are left out instead.
* Index level: of each set the rarest shingles that its threshold asks for are indexed (prefix). A shingle's
  list is ordered by set size and cut into blocks; whole blocks are skipped by the size and by what can still
  overlap after the shingle's position. Entries of frequent shingles bring a folded bitmap of parities along, so
  pairs of a large family that are proved too different are never formed.
* Candidates that the whole bitmap proves too different go; the others are verified on whole sets. Frequent shingles only come last in the order of a set, which is any
  fixed order; nothing is left out for being frequent.

Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sized, stored
from tidemark.llm.components import components

WIDTH = 5
BANDS = 8
#: Shingles found this often in one of ``SAMPLE_OF`` documents come last in the order; at most so many are listed.
SAMPLE_OF, FREQUENT, LISTED = 16, 6, 200_000
#: Sets a lead is compared with in one group of a task; entries of a list that are skipped together.
GROUP, BLOCK = 1_000, 64
#: Octets of a bitmap that an entry of a frequent shingle's list brings along.
RIDE = 64

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "uint64")


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit numbers over all bits, another way for each seed."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of all five-word shingles; of fewer words, one hash of the whole sequence.

    Bytes are split at the six ASCII blanks, and lower() of bytes touches A-Z alone.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "uint64")
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), "uint64", len(words))
    width = min(WIDTH, len(h))
    total = np.full(len(h) - width + 1, width, "uint64")
    for k in range(width):
        total += h[k : len(h) - width + 1 + k] * _ODD[k]
    return np.unique(mixed(total))


def fingerprint(members: np.ndarray) -> bytes:
    return np.array([mixed(members, 101).sum(), mixed(members, 102).sum()], "uint64").tobytes()


def prefix_length(n: int) -> int:
    """Shingles of a set of ``n`` of which any set it links to shares one: all but 80% of it, and one."""
    return n - (4 * n + 4) // 5 + 1


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= 80 * (len(x) + len(y) - shared)


def parities(members: np.ndarray) -> bytes:
    """For each of two to four slots per element, whether an odd number of elements falls there, as bits.

    Slots in which two sets differ are at most as many as elements in which they differ.
    """
    bits = max(64, 1 << (2 * len(members) - 1).bit_length())
    return np.packbits((np.bincount((mixed(members, 202) & np.uint64(bits - 1)).astype("int64"), minlength=bits) & 1).astype(bool)).tobytes()


def can_link(n_x: int, x: bytes, n_y: int, y: bytes) -> bool:
    """False only where the parities prove that the sets differ in more than a ninth of both sizes together."""
    u, v = np.frombuffer(x, "uint8"), np.frombuffer(y, "uint8")
    while len(u) != len(v):
        u, v = (u, v) if len(u) > len(v) else (v, u)
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    return 9 * int(np.bitwise_count(u ^ v).sum()) <= n_x + n_y


class Order:
    """The order of shingles in every set: by hash, and the listed frequent ones last, rarest first."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        at = np.argsort(shingles)
        self.shingles, self.counts = shingles[at], counts[at]
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.shingles & np.uint64((1 << 20) - 1)).astype("int64")] = True

    def lists(self, members: np.ndarray) -> np.ndarray:
        """Which of the shingles are listed."""
        hit = self.some[(members & np.uint64((1 << 20) - 1)).astype("int64")]
        if len(self.shingles):
            where = np.minimum(np.searchsorted(self.shingles, members[hit]), len(self.shingles) - 1)
            hit[hit] = self.shingles[where] == members[hit]
        return hit

    def first(self, members: np.ndarray, n: int) -> np.ndarray:
        maybe = np.flatnonzero(self.some[(members & np.uint64((1 << 20) - 1)).astype("int64")])
        if not len(maybe):
            return members[:n]
        where = np.minimum(np.searchsorted(self.shingles, members[maybe]), len(self.shingles) - 1)
        hit = self.shingles[where] == members[maybe]
        last = maybe[hit][np.lexsort((members[maybe][hit], self.counts[where[hit]]))]
        rest = np.ones(len(members), bool)
        rest[last] = False
        return np.concatenate([members[rest], members[last]])[:n]


def frequent_shingles(docs: DataFrame) -> Order:
    """Shingles that are frequent among every ``SAMPLE_OF``-th document by hash of the id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set(t) for t in batch.column(0).slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view("int64"))], names=["shingle"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("shingles")), F.lit(SAMPLE_OF)) == 0).select("text").mapInArrow(each, "shingle long")
    counted = some.groupBy("shingle").count().filter(F.col("count") >= FREQUENT)
    rows = counted.orderBy(F.desc("count"), "shingle").limit(LISTED).toArrow()
    return Order(rows.column("shingle").to_numpy().view("uint64"), rows.column("count").to_numpy())


def described(docs: DataFrame, order: Order) -> DataFrame:
    """Per row: doc_id, n, fingerprint of the set, minhashes, and the indexed prefix as packed 64-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fingerprint", pa.binary()), ("minhashes", pa.list_(pa.int64())), ("prefix", pa.binary()), ("parity", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, prints, mins, prefixes, odd = [], [], [], [], []
                for text in batch.column(1):
                    s = shingle_set(text.as_py())
                    sizes.append(len(s))
                    prints.append(fingerprint(s))
                    mins.append([int(mixed(s, k).min().view("int64")) for k in range(BANDS)] if len(s) else [])
                    prefixes.append(shared.value.first(s, prefix_length(len(s))).tobytes() if len(s) else b"")
                    odd.append(parities(s) if len(s) else b"")
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(mins, schema.field(3).type), pa.array(prefixes, pa.binary()), pa.array(odd, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, n long, fingerprint binary, minhashes array<long>, prefix binary, parity binary")


def lead_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a set and the first set of each of its minhash buckets, where sizes allow a link."""
    bands = classes.select("doc_id", "n", F.posexplode("minhashes").alias("band", "value"))
    first = F.min(F.struct("doc_id", "n"))
    leads = bands.groupBy("band", "value").agg(first.alias("lead"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    leads = leads.select(F.col("band").alias("__band"), F.col("value").alias("__value"), "lead")
    near = bands.join(leads, (F.col("band") == F.col("__band")) & (F.col("value") == F.col("__value")))
    m = F.col("lead.n")
    return near.filter((F.col("doc_id") != F.col("lead.doc_id")) & (5 * F.least("n", m) >= 4 * F.greatest("n", m))).select(
        F.col("doc_id").alias("a"), F.col("lead.doc_id").alias("b")
    ).distinct()


def candidate_pairs(classes: DataFrame, clusters: DataFrame, order: Order) -> DataFrame:
    """Pairs (a, b), a > b, of different clusters that share an indexed shingle and may link there."""
    rows = classes.join(clusters, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n", F.coalesce("component", "doc_id").alias("cluster"), "prefix", "parity"
    )
    shared = classes.sparkSession.sparkContext.broadcast(order)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                parts = [np.frombuffer(p.as_py(), "int64") for p in batch.column(3)]
                lengths = [len(p) for p in parts]
                place = np.concatenate([np.arange(k) for k in lengths]) if parts else np.zeros(0, "int64")
                ids, n, cluster = (np.repeat(batch.column(k).to_numpy(), lengths) for k in range(3))
                shingles = np.concatenate(parts)
                # Only entries of frequent shingles bring the bitmap; of the others the lists are short.
                listed = shared.value.lists(shingles.view("uint64"))
                ends = np.cumsum(lengths)
                bitmaps = [folded(p.as_py()) for p in batch.column(4)]
                octets = np.where(listed, np.repeat([len(b) for b in bitmaps], lengths), 0)
                data = b"".join([b * int(listed[e - k : e].sum()) for b, k, e in zip(bitmaps, lengths, ends)])
                offsets = np.concatenate([[0], np.cumsum(octets)]).astype("int32")
                bits = pa.Array.from_buffers(pa.binary(), len(shingles), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingles), pa.array(ids), pa.array(cluster), pa.array(n << 32 | place), bits], names=["shingle", "doc_id", "cluster", "n_place", "bits"]
                )

    lists = rows.mapInArrow(spread, "shingle long, doc_id long, cluster long, n_place long, bits binary")
    lists = lists.repartition("shingle").sortWithinPartitions("shingle", "n_place")
    return lists.mapInArrow(pairs_of_lists, "a long, b long").distinct()


def folded(parity: bytes) -> bytes:
    """The bitmap of fewer slots, ``RIDE`` octets at most: slots that fall together are added."""
    return np.bitwise_xor.reduce(np.frombuffer(parity, "uint8").reshape(-1, min(RIDE, len(parity))), axis=0).tobytes() if parity else b""


def bitmaps_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Octets of each bitmap, 0 for none, and the bitmaps as rows of ``RIDE`` octets."""
    offsets = np.frombuffer(column.buffers()[1], "int32")[column.offset : column.offset + len(column) + 1].astype("int64")
    octets, rows = np.diff(offsets), np.zeros((len(column), RIDE), "uint8")
    some = np.flatnonzero(octets)
    if len(some):
        data = np.frombuffer(column.buffers()[2], "uint8")
        for width in np.unique(octets[some]):
            at = some[octets[some] == width]
            rows[at, :width] = data[offsets[at][:, None] + np.arange(width)]
    return octets, rows


def not_excluded(n: np.ndarray, octets: np.ndarray, bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of entries ``x`` and ``y`` their bitmaps do not prove too different; see ``can_link``."""
    ok = np.ones(len(x), bool)
    kinds = octets[x] * (RIDE + 1) + octets[y]
    for kind in np.unique(kinds):
        wide, wider = divmod(int(kind), RIDE + 1)
        least = min(wide, wider)
        if least:
            at = np.flatnonzero(kinds == kind)
            u, v = (np.bitwise_xor.reduce(bits[side[at], :width].reshape(len(at), -1, least), axis=1) for side, width in ((x, wide), (y, wider)))
            ok[at] = 9 * np.bitwise_count(u ^ v).sum(axis=1, dtype="int64") <= n[x[at]] + n[y[at]]
    return ok


def pairs_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk lists sorted by shingle, size and place; a list may span batches."""
    rest = None
    for batch in batches:
        columns = [*(batch.column(k).to_numpy() for k in range(4)), *bitmaps_of(batch.column(4))]
        if rest is not None:
            columns = [np.concatenate(c) for c in zip(rest, columns)]
        if not len(columns[0]):
            continue
        open_from = np.searchsorted(columns[0], columns[0][-1])
        rest = [c[open_from:] for c in columns]
        yield as_pairs(pairs_of_runs(*[c[:open_from] for c in columns]))
    if rest is not None:
        yield as_pairs(pairs_of_runs(*rest))


def as_pairs(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def may_link(n_x: np.ndarray, place_x: np.ndarray, n_y: np.ndarray, place_y: np.ndarray) -> np.ndarray:
    """Whether sets whose first common shingle stands at these places can overlap enough."""
    needed = -(-4 * (n_x + n_y) // 9)
    return (5 * np.minimum(n_x, n_y) >= 4 * np.maximum(n_x, n_y)) & (np.minimum(n_x - place_x, n_y - place_y) >= needed)


def pairs_of_runs(shingle: np.ndarray, ids: np.ndarray, cluster: np.ndarray, n_place: np.ndarray, octets: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Candidate pairs of all whole lists of a batch. Short lists are compared side by side, long ones by blocks."""
    if not len(shingle):
        return np.zeros((0, 2), "int64")
    n, place = n_place >> 32, n_place & 0xFFFFFFFF
    starts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    lengths = np.diff(np.r_[starts, len(shingle)])
    left = np.repeat(starts + lengths, lengths) - np.arange(len(shingle)) - 1  # entries that follow in the list
    long = np.repeat(lengths > BLOCK, lengths)
    found = []
    at, step = np.flatnonzero((left > 0) & ~long), 1
    while len(at):
        to = at + step
        ok = (cluster[at] != cluster[to]) & may_link(n[at], place[at], n[to], place[to])
        x, y = at[ok], to[ok]
        fits = not_excluded(n, octets, bits, x, y)
        found.append(np.column_stack([ids[x[fits]], ids[y[fits]]]))
        step += 1
        at = at[(left[at] >= step) & (5 * n[at] >= 4 * n[np.minimum(to, len(n) - 1)])]
    for k in np.flatnonzero(lengths > BLOCK):
        part = slice(starts[k], starts[k] + lengths[k])
        found.append(pairs_by_blocks(ids[part], cluster[part], n[part], place[part], octets[part], bits[part]))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), "int64")
    return np.unique(np.sort(pairs, axis=1)[:, ::-1], axis=0)


def pairs_by_blocks(
    ids: np.ndarray, cluster: np.ndarray, n: np.ndarray, place: np.ndarray, octets: np.ndarray | None = None, bits: np.ndarray | None = None
) -> np.ndarray:
    """Candidate pairs of one long list. A block's header holds its sizes, most overlap left and lone cluster."""
    if octets is None or bits is None:
        octets, bits = np.zeros(len(ids), "int64"), np.zeros((len(ids), RIDE), "uint8")
    firsts = np.arange(0, len(ids), BLOCK)
    most = np.minimum.reduceat(n, firsts), np.maximum.reduceat(n, firsts)
    room = np.maximum.reduceat(n - place, firsts)
    lone = np.where(np.minimum.reduceat(cluster, firsts) == np.maximum.reduceat(cluster, firsts), cluster[firsts], -1)
    found = []
    for x in range(len(ids)):
        own = x // BLOCK
        least = 4 * n[x]
        needed = -(-4 * (n[x] + most[0][: own + 1]) // 9)
        open_ = (5 * most[1][: own + 1] >= least) & (room[: own + 1] >= needed) & (lone[: own + 1] != cluster[x]) & (n[x] - place[x] >= needed)
        others = []
        for k in np.flatnonzero(open_):
            part = slice(firsts[k], min(firsts[k] + BLOCK, x))
            ok = (cluster[part] != cluster[x]) & may_link(n[x], place[x], n[part], place[part])
            others.append(firsts[k] + np.flatnonzero(ok))
        other = np.concatenate(others) if others else np.zeros(0, "int64")
        if len(other):
            other = ids[other[not_excluded(n, octets, bits, np.full(len(other), x), other)]]
            found.append(np.column_stack([np.full(len(other), ids[x]), other]))
    return np.concatenate(found) if found else np.zeros((0, 2), "int64")


def plausible(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) less those that the parities of both sets exclude; some hundred bytes a set tell."""
    one = classes.select(F.col("doc_id").alias("x"), F.col("n").alias("n_x"), F.col("parity").alias("p_x"))
    two = classes.select(F.col("doc_id").alias("y"), F.col("n").alias("n_y"), F.col("parity").alias("p_y"))
    both = pairs.join(one, F.col("a") == F.col("x")).join(two, F.col("b") == F.col("y")).select("a", "b", "n_x", "p_x", "n_y", "p_y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_x, n_y = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            keep = [can_link(i, x.as_buffer(), j, y.as_buffer()) for i, x, j, y in zip(n_x, batch.column(3), n_y, batch.column(5))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long").distinct()


def sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, members) of the classes in the pairs (a, b), stored, made again from the texts of their representatives.

    Of an id with several texts only that of the class counts. A row that repeats id and text is here twice.
    """
    nodes = pairs.select("a").union(pairs.select("b")).distinct()
    ids = nodes.join(classes, F.col("a") == F.col("node")).select(F.col("rep").alias("__id"), F.col("node").alias("__node"), F.col("fingerprint").alias("__f"))
    texts = docs.join(sized(stored(ids, "ids")), F.col("doc_id") == F.col("__id")).select("__node", "__f", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingle_set(t.as_py()) for t in batch.column(2)]
                own = [fingerprint(x) == f.as_py() for x, f in zip(sets, batch.column(1))]
                made = pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "members"])
                yield made.filter(pa.array(own, pa.bool_()))

    return stored(texts.mapInArrow(make, "node long, members binary"), "sets")


def beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (b, part, a, members) of the pairs (a, b), sorted: in each part of a ``b`` first its own set, without ``a``.

    Each b meets its partners in parts of about a thousand, so a set with very many partners is spread over tasks.
    """
    groups = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups")).withColumnRenamed("b", "__b")
    keyed = pairs.join(groups, F.col("b") == F.col("__b")).select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).alias("part"))
    partners = keyed.join(sets, F.col("a") == F.col("node")).select("b", "part", F.col("a").alias("a"), "members")
    heads = keyed.select("b", "part").distinct().join(sets, F.col("b") == F.col("node")).select("b", "part", F.lit(None).cast("long").alias("a"), "members")
    return heads.unionByName(partners).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())


def with_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """(a, b, set of a, set of b) of the rows of ``beside``, a list per batch."""
    head = None
    for batch in batches:
        out = []
        for b, a, members in zip(batch.column("b").to_pylist(), batch.column("a").to_pylist(), batch.column("members")):
            own = np.frombuffer(members.as_py(), "uint64")
            if a is None:
                head = own
            else:
                out.append((a, b, own, head))
        yield out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b), a stored table, whose whole sets link."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in with_heads(batches):
            yield as_pairs(np.array([(a, b) for a, b, x, y in rows if linked(x, y)], "int64").reshape(-1, 2))

    return beside(pairs, sets).mapInArrow(compare, "a long, b long").distinct()


def contracted(links: np.ndarray) -> np.ndarray:
    """Links (a, b) that connect the same nodes, one fewer than a component has: union-find over the given ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for a, b in links.tolist():
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return np.array([(x, r) for x in list(parent) if (r := root(x)) != x], "int64").reshape(-1, 2)


def derived(homes: DataFrame, sets: DataFrame, every: bool) -> DataFrame:
    """Links (a, b), a > b, between sets of one lead, from what tells each of them from the lead.

    ``every`` link, or else those of each group contracted to a forest over the same sets.

    ``homes`` (node, component) names a lead that each set links to. Two sets differ where exactly one of them
    differs from the lead. Sets of a lead are dealt into blocks of about a thousand; each two blocks meet in a
    group of their own.
    """
    large = homes.groupBy("component").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    large = stored(large.select(F.col("component").alias("__c"), F.ceil(F.col("k") / GROUP).cast("int").alias("blocks")), "leads")
    within = stored(homes.join(large, F.col("component") == F.col("__c")).select(F.col("node").alias("a"), F.col("component").alias("b")), "within")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("differs", pa.binary())])

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in with_heads(batches):
            found = [(a, b, len(x), np.setxor1d(x, y, assume_unique=True).tobytes()) for a, b, x, y in rows]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in found], schema=schema)

    rows = beside(within, sets).mapInArrow(against, "a long, b long, n long, differs binary").join(large, F.col("b") == F.col("__c"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("a", F.lit("block")), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("b", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "a", "n", "differs")
    rows = rows.repartition("b", "one", "two").sortWithinPartitions("b", "one", "two")

    def answers(held: dict[int, dict[int, tuple[int, bytes]]]) -> pa.RecordBatch:
        links = links_of_blocks(*held.values())
        return as_pairs(links if every else contracted(links))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            for b, one, two, own, a, n, differs in zip(*[batch.column(k).to_pylist() for k in range(7)]):
                if (b, one, two) != key:
                    if held:
                        yield answers(held)
                    key, held = (b, one, two), {k: {} for k in (one, two)}
                held[own][a] = n, differs
        if held:
            yield answers(held)

    return rows.mapInArrow(meet, "a long, b long")


def links_of_blocks(*blocks: dict[int, tuple[int, bytes]]) -> np.ndarray:
    """Links inside one block, or between two, whose sets are given by size and what differs from their lead."""
    ids, n, apart, owner, differs = [], [], [], [], []
    for block in blocks:
        parts = [np.frombuffer(d, "uint64") for _, d in block.values()]
        ids.append(np.array(list(block), "int64"))
        n.append(np.array([k for k, _ in block.values()], "int64"))
        apart.append(np.array([len(p) for p in parts], "int64"))
        owner.append(np.repeat(np.arange(len(parts)), apart[-1]))
        differs.append(np.concatenate([np.zeros(0, "uint64"), *parts]))
    values, counts = np.unique(np.concatenate(differs), return_counts=True)
    common = values[counts > 1]
    alike = np.zeros((len(ids[0]), len(ids[-1])), "int64")
    for at in range(0, len(common), 4096):
        some, sides = common[at : at + 4096], []
        for k in range(len(blocks)):
            where = np.minimum(np.searchsorted(some, differs[k]), len(some) - 1)
            hit = some[where] == differs[k]
            side = np.zeros((len(ids[k]), len(some)), "float32")
            side[owner[k][hit], where[hit]] = 1.0
            sides.append(side)
        alike += (sides[0] @ sides[-1].T).astype("int64")
    d = apart[0][:, None] + apart[-1] - 2 * alike
    x, y = np.nonzero(9 * d <= n[0][:, None] + n[-1])
    a, b = ids[0][x], ids[-1][y]
    if len(blocks) == 1:
        a, b = a[a > b], b[a > b]
    return np.column_stack([np.maximum(a, b), np.minimum(a, b)])


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, fingerprint, rep, rep_row) of every class, and the rows with the node of theirs, null without words.

    The node is a hash by the first seed that gives no two classes the same. The representative is the row of
    the smallest id.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "row")).alias("f")
    found = stored(rows.filter("n > 0").groupBy("fingerprint", "n").agg(first), "classes")
    seed = 0
    while not found.groupBy(F.xxhash64("fingerprint", "n", F.lit(seed)).alias("node")).count().filter("count > 1").isEmpty():
        seed += 1
    node = F.xxhash64("fingerprint", "n", F.lit(seed))
    classes = found.select(node.alias("node"), "fingerprint", F.col("f.doc_id").alias("rep"), F.col("f.row").alias("rep_row"))
    return classes, rows.withColumn("node", F.when(F.col("n") > 0, node))


def joined(docs: DataFrame, whole: bool, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """``shingle_links`` if ``whole``; else without the links between sets that leads' links already connect.

    Without ``every`` the links derived within a lead's sets come contracted to forests.
    """
    order = frequent_shingles(docs)
    rows = stored(described(docs, order).withColumn("row", F.monotonically_increasing_id()), "described")
    classes, rows = classes_of(rows)
    reps = classes.select(F.col("node").alias("__node"), "rep", "rep_row")
    members = stored(rows.select("doc_id", "n", "node", "row").join(reps, F.col("node") == F.col("__node"), "left").drop("__node"), "members")
    others = stored(members.filter("n = 0 or doc_id is null or row != rep_row").select(F.col("row").alias("__row")), "copies")
    alone = rows.join(sized(others), F.col("row") == F.col("__row"), "left_anti").select(F.col("node").alias("doc_id"), "n", "minhashes", "prefix", "parity")
    near = stored(plausible(alone, lead_pairs(alone)), "lead-pairs")
    sets = sets_of(docs, classes, near)
    by_lead = stored(verified(near, sets), "lead-links")
    if whole:
        together = stored(by_lead.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "leads")
    else:
        together = stored(components(by_lead), "clusters")
    pairs = stored(plausible(alone, candidate_pairs(alone, together, order)), "pairs")
    links = by_lead.unionByName(verified(pairs, sets_of(docs, classes, pairs)))
    if whole:
        links = links.unionByName(derived(together, sets, every)).distinct()
    return members.select("doc_id", F.col("n").alias("n_shingles"), "node", "rep"), stored(links, "links")


def shingle_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join: (doc_id, n_shingles, node, rep) of every row, and each two nodes (a, b), a > b, that link.

    A node is a class of equal sets, null for a text without words; ``rep`` is its smallest doc_id. Rows of one
    node link with each other. There are as many links as the classes have, in a family of near copies the
    square of its size.
    """
    return joined(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), True)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Two documents link when their shingle sets overlap by 0.8 or more of their union; the component is the
    smallest doc_id reachable by links. A text without words has no shingles and links with nothing. Rows that
    repeat an id are one node with the links of each of its texts. A row without id takes the component of the
    documents of its own set, null if there are none. Other columns are ignored, an empty table gives no rows, texts
    are read whole at any length. Without ``whole`` the links that could only connect what is connected are not
    sought; components are the same.
    """
    members, links = joined(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), whole, every=False)
    # Classes that share an id are connected by it; a text without words goes with the others of its id.
    per_id = members.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("node").alias("k"), F.count(F.lit(1)).alias("rows")
    )
    shared = sized(stored(per_id.filter("lo < hi or k > 0 and k < rows").select("__id", "lo"), "shared"))
    by_id = members.join(shared, F.col("doc_id") == F.col("__id")).filter("node != lo").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    found = stored(components(links.unionByName(by_id)).withColumnRenamed("node", "__n"), "components")
    reps = members.filter("node is not null").select("node", "rep").distinct()
    smallest = found.join(reps, F.col("__n") == F.col("node")).groupBy(F.col("component").alias("__c")).agg(F.min("rep").alias("smallest"))
    named = found.join(smallest, F.col("component") == F.col("__c")).select("__n", "smallest")
    out = members.join(shared, F.col("doc_id") == F.col("__id"), "left").withColumn("node", F.coalesce("node", "lo"))
    out = out.join(named, F.col("node") == F.col("__n"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("smallest", "rep", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: that of the smallest doc_id.

    Rows without id stay. All columns are kept as they were.
    """
    found = jaccard_components(docs, doc_id, text, whole=False)
    gone = stored(found.filter("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    tagged = docs.select(F.struct("*").alias("doc"), F.col(doc_id).cast("long").alias("id"))
    return tagged.join(sized(gone), F.col("id") == F.col("gone"), "left_anti").select("doc.*")
