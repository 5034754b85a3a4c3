"""Near duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

* Signature: each element draws its own random order of the slots and one number per rank; slot by slot the smallest
  rank plus number of all elements stays. All elements take their first rank, then their second, and so on. What
  rank k leaves is below k + 1, so once every slot has been reached no later rank can change it and the set stops:
  after one to three ranks for a set of some hundred elements. Ranks of one element never share a slot, which lowers
  the variance of independent minhashes.
* Banding: sets that agree on all slots of a band meet in a bucket. With 24 bands of 4 slots a link at 0.85 is missed
  with probability (1 - 0.85^4)^24 = 2e-8, a closer one less.
* Verification in three rounds, on whole sets, each behind parity bitmaps that can only exclude pairs that cannot link.
  First every set meets the first set of each of its buckets. Only buckets that then still hold sets of two or
  more components are walked, and there only sets of different components meet; blocks of long buckets meet in
  tasks of their own. The first walk tries the closest sets of each two components, so that what belongs together
  becomes one component; the second walk tries all that is left. Pairs inside a component are never made: they
  could not change it.
* Grouping: union-find in each task contracts its links to a forest, alternating star steps join the forests.

Sets equal in all elements are one class and enter once. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sized, stored, words_of
from tidemark.llm.components import components

WIDTH, PERCENT = 3, 85
BANDS, SLOTS = 24, 4
#: Elements whose signatures are made side by side; sets of a bucket's block; a set meets so many others in one group.
CHUNK, BLOCK, GROUP = 100_000, 4_096, 1_000
#: Bits of the longest parity bitmap that rides along with a bucket's entries.
RIDE = 4_096

_UNSET = np.uint64(2**64 - 1)


def scattered(x: np.ndarray, seed: int) -> np.ndarray:
    """Numbers that look drawn anew for each seed; products wrap around."""
    x = (x ^ np.uint64((seed * 0xC2B2AE3D27D4EB4F + 0x27D4EB2F165667C5) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words, A-Z lower-cased; of fewer words one of them all."""
    words = words_of(None if text is None else text.translate(_LOWER) if not text.isascii() else text.lower())
    if not words:
        return np.zeros(0, "uint64")
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), "uint64", len(words))
    width = min(width, len(h))
    total = np.full(len(h) - width + 1, width, "uint64")
    for k in range(width):
        total = (total ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


_LOWER = {c: c + 32 for c in range(65, 91)}


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash of non-empty sets, one row each: (rank << 32 | number), the smallest of every slot."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    best = np.full((len(sets), slots), _UNSET)
    order = None  # each element's order of the slots, so far as ranks have drawn it
    for rank in range(slots):
        draw = scattered(flat, rank)
        place = rank + ((draw >> np.uint64(32)) * np.uint64(slots - rank) >> np.uint64(32)).astype("int64")
        if order is None:
            slot = place
        else:
            rows = np.arange(len(flat))
            slot = order[rows, place].astype("int64")
            order[rows, place] = order[:, rank]
        value = np.uint64(rank << 32) | (draw & np.uint64(0xFFFFFFFF))
        np.minimum.at(best.reshape(-1), owner * slots + slot, value)
        going = (best == _UNSET).any(axis=1)[owner]
        if not going.any():
            break
        flat, owner = flat[going], owner[going]
        if order is None:
            order = np.tile(np.arange(slots, dtype="uint16"), (len(flat), 1))
            order[np.arange(len(flat)), place[going]] = 0
        else:
            order = order[going]
    return best


def band_keys(signature: np.ndarray, bands: int = BANDS, slots: int = SLOTS) -> np.ndarray:
    """One hash per band of each signature, different between bands."""
    parts = signature.reshape(len(signature), bands, slots)
    key = np.tile(np.arange(1, bands + 1, dtype="uint64"), (len(signature), 1))
    for k in range(slots):
        key = scattered(key ^ parts[:, :, k], k + 1)
    return key.view("int64")


def fingerprint(members: np.ndarray) -> bytes:
    return np.array([scattered(members, 1001).sum(), scattered(members, 1002).sum()], "uint64").tobytes()


def parity_bits(members: np.ndarray) -> bytes:
    """Whether an odd number of elements falls into each of a power of two of places, two to four per element."""
    bits = max(64, 1 << (2 * len(members) - 1).bit_length())
    places = (scattered(members, 1003) & np.uint64(bits - 1)).astype("int64")
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(bool)).tobytes()


def folded(parity: np.ndarray, octets: int) -> np.ndarray:
    """The bitmap of fewer places, as made for them from the start: the places that fall together are added."""
    while len(parity) > octets:
        parity = parity[: len(parity) // 2] ^ parity[len(parity) // 2 :]
    return parity


def least_shared(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Elements that sets of ``n`` elements together share at least if they link."""
    return -(-percent * n // (100 + percent))


def may_link(n_x: int, x: bytes, n_y: int, y: bytes, percent: int) -> bool:
    """False only where sizes or parities prove too few common elements: places that differ are at most the elements that do."""
    n = n_x + n_y
    if min(n_x, n_y) < least_shared(n, percent):
        return False
    octets = min(len(x), len(y))
    u, v = folded(np.frombuffer(x, "uint8"), octets), folded(np.frombuffer(y, "uint8"), octets)
    return int(np.bitwise_count(u ^ v).sum()) <= n - 2 * least_shared(n, percent)


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether ``percent`` of the union of two sorted sets is shared."""
    short, long = (x, y) if len(x) < len(y) else (y, x)
    where = np.minimum(np.searchsorted(long, short), len(long) - 1)
    return int((long[where] == short).sum()) >= least_shared(len(x) + len(y), percent)


def described(docs: DataFrame, width: int, bands: int, slots: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, crumb): doc_id, crumb, n, fingerprint of the set, band keys and parities."""

    def chunks(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        at, size, held = 0, 0, []
        for k, text in enumerate(texts):
            members = shingles(text.as_py(), width)
            if held and size + len(members) > CHUNK:
                yield at, held
                at, size, held = k, 0, []
            held.append(members)
            size += len(members)
        if held:
            yield at, held

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in chunks(batch.column("text")):
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(signatures(full, bands * slots), bands, slots).tolist() if full else [])
                part = batch.slice(at, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("crumb"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([fingerprint(s) for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                        pa.array([parity_bits(s) if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "crumb", "n", "fingerprint", "bands", "parity"],
                )

    return docs.mapInArrow(each, "doc_id long, crumb long, n long, fingerprint binary, bands array<long>, parity binary")


def as_pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, "int64").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def plausible(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) less those that sizes and whole parities exclude."""
    one = classes.select(F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("parity").alias("p_x"))
    two = classes.select(F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("parity").alias("p_y"))
    both = pairs.distinct().join(one, F.col("a") == F.col("x")).join(two, F.col("b") == F.col("y")).select("a", "b", "n_x", "p_x", "n_y", "p_y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(k).to_pylist() for k in range(2, 6)]
            keep = [may_link(i, x, j, y, percent) for i, x, j, y in zip(*sides)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def whole_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(node, members) of the classes in the pairs, stored; made again from the text of one row of each."""
    nodes = pairs.select("a").union(pairs.select("b")).distinct()
    wanted = stored(
        nodes.join(classes, F.col("a") == F.col("node")).select(F.col("rep").alias("__id"), F.col("crumb").alias("__crumb"), "node"), "wanted"
    )
    found = docs.join(sized(wanted), (F.col("crumb") == F.col("__crumb")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("node", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                members = [shingles(t.as_py(), width).tobytes() for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(members, pa.binary())], names=["node", "members"])

    return stored(found.mapInArrow(make, "node long, members binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b), a stored table, whose whole sets link.

    A set b meets its partners in groups of about a thousand, in each of them once; so one with any number of
    partners is spread over tasks.
    """
    groups = pairs.groupBy(F.col("b").alias("__b")).agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    keyed = pairs.join(groups, F.col("b") == F.col("__b")).select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).alias("part"))
    partners = keyed.join(sets, F.col("a") == F.col("node")).select("b", "part", "a", "members")
    heads = keyed.select("b", "part").distinct().join(sets, F.col("b") == F.col("node")).select("b", "part", F.lit(None).cast("long").alias("a"), "members")
    rows = heads.unionByName(partners).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            found = []
            for b, a, members in zip(batch.column("b").to_pylist(), batch.column("a").to_pylist(), batch.column("members")):
                x = np.frombuffer(members.as_py(), "uint64")
                if a is None:
                    own = x
                elif links(x, own, percent):
                    found.append((a, b))
            yield as_pairs(found)

    return rows.mapInArrow(compare, "a long, b long").distinct()


def union_find(edges: DataFrame) -> DataFrame:
    """The links (a, b) of each task contracted to a forest over the same nodes: every node and its root."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        def forest() -> pa.RecordBatch:
            return as_pairs([(x, r) for x in list(parent) if (r := root(x)) != x])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
            if len(parent) > 500_000:  # bounded memory: hand on what there is and begin anew
                yield forest()
                parent.clear()
        yield forest()

    return edges.select("a", "b").mapInArrow(each, "a long, b long")


def regrouped(tagged: DataFrame, found: DataFrame) -> DataFrame:
    """The classes with the component that the links (a, b) make of theirs, the smallest one reachable."""
    ends = tagged.select(F.col("node").alias("__node"), "component")
    edges = found.join(ends.withColumnRenamed("component", "x"), F.col("a") == F.col("__node")).drop("__node")
    edges = edges.join(ends.withColumnRenamed("component", "y"), F.col("b") == F.col("__node")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    over = components(union_find(edges)).select(F.col("node").alias("__c"), F.col("component").alias("above"))
    return tagged.join(over, F.col("component") == F.col("__c"), "left").withColumn("component", F.coalesce("above", "component")).drop("__c", "above")


def first_of_bucket(entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set and the first set of each of its buckets."""
    met = entries.join(buckets.select(F.col("key").alias("__key"), "first"), F.col("key") == F.col("__key"))
    return met.filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))


def between_components(entries: DataFrame, buckets: DataFrame, classes: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that sizes and parities do not exclude.

    With ``closest`` one pair of each two components that meet in a group: the one most likely to link. A bucket is cut into blocks; every two blocks, and each block alone, meet in a group of their own.
    """
    labels = classes.select(F.col("node").alias("__node"), "component", "n", "parity")
    known = entries.join(buckets.select(F.col("key").alias("__key")), F.col("key") == F.col("__key"), "left_semi")
    tagged = stored(known.join(labels.select("__node", "component"), F.col("node") == F.col("__node")).select("key", "node", "component"), "tagged")
    mixed = tagged.groupBy(F.col("key").alias("__key")).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
    mixed = mixed.filter("lo < hi").select("__key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = tagged.join(mixed, F.col("key") == F.col("__key")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.join(labels.drop("component"), F.col("node") == F.col("__node"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node", "component", "n", "parity")
    rows = rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "own")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for key, one, two, own, *entry in zip(*[batch.column(k).to_pylist() for k in range(8)]):
                if (key, one, two) != at:
                    if held:
                        yield as_pairs(pairs_of_blocks(list(held.values()), percent, closest))
                    at, held = (key, one, two), {k: [] for k in (one, two)}
                held[own].append(entry)
        if held:
            yield as_pairs(pairs_of_blocks(list(held.values()), percent, closest))

    return rows.mapInArrow(walk, "a long, b long")


def pairs_of_blocks(blocks: list[list[tuple[int, int, int, bytes]]], percent: int, closest: bool = False) -> list[tuple[int, int]]:
    """(a, b) of the entries (node, component, n, parity) of one block, or of two with each other, that may link.

    With ``closest`` only the pair of each two components that differs least, as a share of what it may.
    """
    found = []
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    (node, component, n, octets, level), (node_, component_, n_, octets_, level_) = _side(blocks[0]), _side(blocks[-1])
    for k in range(len(node)):
        low = k + 1 if len(blocks) == 1 else 0
        total = n_[low:] + n[k]
        near = low + np.flatnonzero((component_[low:] != component[k]) & (np.minimum(n_[low:], n[k]) >= least_shared(total, percent)))
        for width in np.unique(octets_[near]):
            same = near[octets_[near] == width]
            least = int(min(width, octets[k]))
            total = n_[same] + n[k]
            differ = np.bitwise_count(level_(least)[same] ^ level(least)[k]).sum(axis=1, dtype="int64")
            allowed = total - 2 * least_shared(total, percent)
            fits = differ <= allowed
            same, share = same[fits], (differ[fits] + 1) / (allowed[fits] + 1)
            if closest:
                order = np.lexsort((share, component_[same]))
                firsts = np.unique(component_[same][order], return_index=True)[1]
                for x in order[firsts].tolist():
                    pair = (float(share[x]), int(node[k]), int(node_[same[x]]))
                    ends = (int(component[k]), int(component_[same[x]]))
                    key = (min(ends), max(ends))
                    best[key] = min(best.get(key, pair), pair)
            else:
                found += [(int(node[k]), x) for x in node_[same].tolist()]
    found += [(x, y) for _, x, y in best.values()]
    return [(max(pair), min(pair)) for pair in found]


def _side(block: list[tuple[int, int, int, bytes]]):
    """Columns of a block's entries, octets of their bitmaps as far as compared, and the bitmaps folded to some octets.

    Entries with fewer octets than asked for are left zero: they are never compared at that length.
    """
    parities = [folded(np.frombuffer(e[3], "uint8"), RIDE // 8) for e in block]
    octets = np.array([len(p) for p in parities], "int64")
    made: dict[int, np.ndarray] = {}

    def level(width: int) -> np.ndarray:
        if width not in made:
            made[width] = np.zeros((len(block), width), "uint8")
            for k in np.flatnonzero(octets >= width):
                made[width][k] = folded(parities[k], width)
        return made[width]

    return *(np.array([e[k] for e in block], "int64") for k in range(3)), octets, level


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, slots: int = SLOTS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    Two rows link when ``percent`` of the union of their shingle sets is shared; links are confirmed on whole sets.
    ``component_id`` is the smallest doc_id that links reach, the row's own included; a row is kept if it is that one.
    A text that is null or has no word has no shingles and links with nothing. Rows that repeat an id are documents
    of their own. A row without id takes part; its component is the smallest id it reaches, null if there is none,
    and it is kept only then. Other columns are ignored; an empty table gives no rows. Texts are read whole.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("crumb", F.xxhash64("text"))
    rows = stored(described(docs, width, bands, slots), "described")
    # One class per set; what it needs rides along, as it is the same in all its rows. The smallest id represents it.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "crumb")).alias("least")
    classes = rows.filter("n > 0").groupBy("fingerprint", "n").agg(least, F.first("bands").alias("bands"), F.first("parity").alias("parity"))
    classes = stored(
        classes.select(
            F.monotonically_increasing_id().alias("node"), "fingerprint", "n", F.col("least.doc_id").alias("rep"), F.col("least.crumb").alias("crumb"), "bands", "parity"
        ),
        "classes",
    )
    entries = classes.select("node", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last")
    buckets = stored(buckets.select("key", "first"), "buckets")

    def linked(pairs: DataFrame) -> DataFrame:
        near = stored(plausible(classes, pairs, percent), "near")
        return stored(verified(near, whole_sets(docs, classes, near, width), percent), "links")

    tagged = classes.drop("bands").withColumn("component", F.col("node"))
    tagged = stored(regrouped(tagged, linked(first_of_bucket(entries, buckets))), "grouped")
    for closest in (True, False):
        tagged = stored(regrouped(tagged, linked(between_components(entries, buckets, tagged, percent, closest))), "grouped")
    final = tagged.select("fingerprint", "n", "rep", "component")
    smallest = final.groupBy(F.col("component").alias("__c")).agg(F.min("rep").alias("component_id"))
    named = final.join(smallest, F.col("component") == F.col("__c")).select(F.col("fingerprint").alias("__f"), F.col("n").alias("__n"), "component_id")
    out = rows.select("doc_id", "n", "fingerprint").join(named, (F.col("fingerprint") == F.col("__f")) & (F.col("n") == F.col("__n")), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
