import collections
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from messy import documents, nothing, texts
from tidemark.llm import jaccard, quality
from tidemark.llm.common import read, stored
from tidemark.llm.components import components
from tidemark.llm.mixing import mix


def smallest_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = (text or "").encode().lower().split()
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = {k: shingles(t) for k, t in rows}
    ids = sorted(sets)
    edges = []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= 80 * (len(x) + len(y) - shared):
                    edges.append((a, b))
    return {k: (len(sets[k]), c) for k, c in smallest_of(ids, edges).items()}


def test_components_by_union_find(spark):
    r = random.Random(4)
    for size, count in ((30, 20), (200, 150), (60, 300)):
        edges = [(r.randrange(size), r.randrange(size)) for _ in range(count)] + [(size + i, size + i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(50)]
        got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        nodes = {n for a, b in edges if a != b for n in (a, b)}
        assert got == smallest_of(nodes, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def family(r, word, base, copies, edits):
    """Copies of a base with some words replaced: similar to the base, less so to each other."""
    out = [list(base)]
    for _ in range(copies):
        own = list(base)
        for at in r.sample(range(len(own)), edits):
            own[at] = word()
        out.append(own)
    return out


def corpus():
    r = random.Random(6)
    word = lambda: f"w{r.randrange(10**9)}"
    passage = [word() for _ in range(60)]
    made = []
    for edits in (0, 1, 2, 3, 4, 5):
        made += family(r, word, [word() for _ in range(150)], 12, edits)
    made += family(r, word, [word() for _ in range(160)], 120, 3)
    made += [[word() for _ in range(r.randrange(3, 90))] + passage for _ in range(150)]
    made += [passage[: r.randrange(4, 60)] for _ in range(60)] + [[word() for _ in range(r.randrange(1, 8))] for _ in range(40)]
    r.shuffle(made)
    return [(k, " ".join(ws).upper() if k % 3 == 0 else "\n".join(ws)) for k, ws in enumerate(made)]


def test_join_by_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_join_without_the_list_of_frequent_shingles_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "SAMPLE_OF", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "GROUP", 3)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_join_on_given_tables(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_join_of_messy_texts(spark):
    rows = jaccard.jaccard_components(documents(spark)).collect()
    assert len(rows) == len(texts())
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and [by[k].component_id for k in (1, 2, 3)] == [1, 2, 3]
    assert by[5].component_id == by[6].component_id == 4 and by[14].component_id == 7 and by[9].component_id == 7
    assert jaccard.jaccard_components(nothing(spark)).count() == 0
    kept = jaccard.keep_first(documents(spark))
    assert kept.columns == documents(spark).columns and not {5, 6, 14} & {r.doc_id for r in kept.collect()}


def test_blocks_and_runs_find_the_same_pairs():
    r = np.random.default_rng(1)
    n = np.sort(r.integers(5, 60, 300))
    place = np.minimum(r.integers(0, 8, 300), n // 5)
    order = np.argsort(n << 32 | place)
    n, place, cluster, ids = n[order], place[order], r.integers(0, 4, 300), np.arange(300)
    want = {(max(a, b), min(a, b)) for a in range(300) for b in range(a) if cluster[a] != cluster[b] and jaccard.may_link(n[a], place[a], n[b], place[b])}
    blocks = jaccard.pairs_by_blocks(ids, cluster, n, place)
    assert {(max(a, b), min(a, b)) for a, b in blocks.tolist()} == want


def test_parities_never_exclude_a_link():
    r = np.random.default_rng(3)
    for size in (1, 7, 90, 700):
        x = r.integers(0, 2**63, size).astype("uint64")
        for changed in range(0, size // 6 + 1, max(1, size // 30)):
            y = np.unique(np.concatenate([x[changed:], r.integers(0, 2**63, changed).astype("uint64")]))
            u = np.unique(x)
            if jaccard.linked(u, y):
                assert jaccard.can_link(len(u), jaccard.parities(u), len(y), jaccard.parities(y))
    far = jaccard.parities(r.integers(0, 2**63, 500).astype("uint64")), jaccard.parities(r.integers(0, 2**63, 450).astype("uint64"))
    assert not jaccard.can_link(500, far[0], 450, far[1])


def test_prefix_length():
    for n in range(1, 200):
        assert jaccard.prefix_length(n) == n - -(-4 * n // 5) + 1


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    good = {r.doc_id for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        after[name] = docs.collect()
        if name != "pack_sequences":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    assert {r.doc_id for r in after["quality_filter"]} == good
    first = {}
    for r in sorted(after["quality_filter"], key=lambda r: r.doc_id):
        first.setdefault(" ".join(("x" + (r.text or "") + "x").split()), r.doc_id)
    assert {r.doc_id for r in after["exact_dedup"]} == set(first.values())
    parts = brute_components([(r.doc_id, r.text) for r in after["exact_dedup"]])
    assert {r.doc_id for r in after["near_dedup"]} == {k for k, (_, c) in parts.items() if k == c}
    near = spark.createDataFrame(after["near_dedup"], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    times = {r.doc_id: r.taken // r["size"] for r in mix(near).collect() if r.taken}
    assert collections.Counter(r.doc_id for r in after["mix_sources"]) == times
    assert collections.Counter(r.doc_id for r in after["pack_sequences"] if r.piece == 0) == times
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in again) == collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in after["pack_sequences"])


@pytest.mark.parametrize("name", ["quality_filter", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"])
def test_stages_on_an_empty_table(spark, sf_dir, name):
    empty = read(spark, sf_dir, "documents").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, sf_dir).count() == 0


def brute_links(rows):
    """Links between distinct sets, each as a pair of frozensets."""
    sets = list({frozenset(s) for _, t in rows if (s := shingles(t))})
    return {frozenset((x, y)) for i, x in enumerate(sets) for y in sets[:i] if 100 * len(x & y) >= 80 * len(x | y)}


@pytest.mark.parametrize("group", [1000, 7])
def test_all_links_by_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    rows = corpus()
    members, links = jaccard.shingle_links(documents(spark, rows))
    sets = dict(rows)
    of = {r.node: frozenset(shingles(sets[r.doc_id])) for r in members.collect()}
    got = [frozenset((of[r.a], of[r.b])) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_links(rows)
    parts = {r.doc_id: r.component_id for whole in (True, False) for r in jaccard.jaccard_components(documents(spark, rows), whole=whole).collect()}
    assert parts == {k: c for k, (_, c) in brute_components(rows).items()}


def test_an_id_with_several_texts_has_the_links_of_each(spark):
    base = [f"w{i}" for i in range(100)]
    a, near, b, far = " ".join(base), " ".join([*base[:95], "x", "y"]), " ".join(base[::-1]), " ".join(base[::3])
    rows = [(5, a), (5, b), (3, b), (7, near), (15, ""), (15, far), (17, far + " x"), (14, far), (25, ""), (25, "alone"), (30, ""), (None, near)]
    for whole in (True, False):
        got = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in jaccard.jaccard_components(documents(spark, rows), whole=whole).collect()}
        assert got == {(5, True, 3), (3, True, 3), (7, True, 3), (15, False, 14), (15, True, 14), (17, True, 14), (14, True, 14), (25, False, 25), (25, True, 25), (30, False, 30), (None, True, 3)}
    assert {r.doc_id for r in jaccard.keep_first(documents(spark, rows)).collect()} == {3, 14, 25, 30, None}


def test_bitmaps_of_entries_exclude_no_link():
    rng = np.random.default_rng(8)
    sets = []
    for n in (6, 30, 90, 400, 1500):
        base = rng.integers(0, 2**63, n, dtype="uint64")
        for _ in range(12):
            own = base.copy()
            swap = rng.random(n) < rng.uniform(0, 0.12)
            own[swap] = rng.integers(0, 2**63, int(swap.sum()), dtype="uint64")
            sets.append(np.unique(own))
    packed = [jaccard.folded(jaccard.parities(s)) for s in sets]
    assert max(map(len, packed)) == jaccard.RIDE
    octets, bits = jaccard.bitmaps_of(pa.array([b"", *packed, b""], pa.binary()).slice(1, len(packed)))
    assert octets.tolist() == [len(p) for p in packed]
    n = np.array([len(s) for s in sets])
    x, y = np.triu_indices(len(sets), 1)
    kept = jaccard.not_excluded(n, octets, bits, x, y)
    linked = np.array([jaccard.linked(sets[a], sets[b]) for a, b in zip(x, y)])
    near = (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])) & ~linked  # others go by their sizes
    assert kept[linked].all() and linked.any() and kept[near].mean() < 0.8
    assert jaccard.not_excluded(n, np.zeros(len(n), "int64"), bits, x, y).all()


def test_contracted_links_connect_the_same():
    links = np.array([(5, 2), (9, 5), (9, 2), (7, 4), (8, 7), (8, 4)])
    assert sorted(map(tuple, jaccard.contracted(links).tolist())) == [(5, 2), (7, 4), (8, 4), (9, 2)]
    assert jaccard.contracted(np.zeros((0, 2), "int64")).shape == (0, 2)
