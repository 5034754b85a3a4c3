import collections
import itertools
import random

import numpy as np
import pytest

from messy import documents, nothing, texts
from oracle import compare, duck
from tidemark.llm import queries, superminhash
from tidemark.llm.common import words_of
from tidemark.llm.superminhash import folded, links, may_link, near_duplicates, parity_bits, scattered, shingles, signatures, union_find


def plain_set(text, width=3):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words_of(text)]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def plain_components(rows, width=3, percent=85):
    """Smallest id reachable of every row (id, text), by trying all pairs of distinct sets."""
    by_set = collections.defaultdict(list)
    for k, t in rows:
        by_set[plain_set(t, width)].append(k)
    sets = [s for s in by_set if s]
    group = {s: s for s in sets}

    def root(s):
        while group[s] is not s:
            s = group[s]
        return s

    for x, y in itertools.combinations(sets, 2):
        if 100 * len(x & y) >= percent * len(x | y):
            group[root(x)] = root(y)
    ids = collections.defaultdict(list)
    for s in sets:
        ids[root(s)] += [k for k in by_set[s] if k is not None]
    out = []
    for k, t in rows:
        s = plain_set(t, width)
        out.append((k, len(s), min(ids[root(s)], default=None) if s else k))
    return sorted(out, key=repr)


def plain_signature(members, slots):
    """One element after the other, each with its whole order of the slots."""
    best = [None] * slots
    for e in members.tolist():
        order = list(range(slots))
        for rank in range(slots):
            draw = int(scattered(np.array([e], "uint64"), rank)[0])
            place = rank + ((draw >> 32) * (slots - rank) >> 32)
            order[rank], order[place] = order[place], order[rank]
            value = rank << 32 | draw & 0xFFFFFFFF
            if best[order[rank]] is None or value < best[order[rank]]:
                best[order[rank]] = value
    return best


def test_early_stopping_changes_no_signature():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n, dtype="uint64") for n in (1, 2, 3, 7, 20, 60, 500)]
    got = signatures(sets, 24)
    for s, row in zip(sets, got):
        assert row.tolist() == plain_signature(s, 24)


def test_estimates_are_unbiased_and_vary_less_than_independent_ones():
    rng = np.random.default_rng(2)
    found = []
    for _ in range(400):
        x = rng.integers(0, 2**63, 30, dtype="uint64")
        both = signatures([x[:25], x[5:]], 96)  # 20 of 30
        found.append((both[0] == both[1]).mean())
    assert abs(np.mean(found) - 2 / 3) < 0.01
    assert np.var(found) < 0.75 * (2 / 3) * (1 / 3) / 96


def test_bitmaps_exclude_no_link():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.choice([3, 8, 40, 300, 1500])
        x = np.array(sorted(rng.sample(range(2**40), n)), "uint64")
        y = x.copy()
        y[rng.sample(range(n), rng.randrange(0, n // 10 + 1))] += np.uint64(1)
        y = np.unique(np.concatenate([y, np.array(rng.sample(range(2**40), rng.randrange(0, n // 10 + 1)), "uint64")]))
        if links(x, y, 85):
            assert may_link(len(x), parity_bits(x), len(y), parity_bits(y), 85)


def test_folding_is_making_fewer_places():
    x = np.arange(1000, dtype="uint64") * np.uint64(977)
    places = (scattered(x, 1003) & np.uint64(255)).astype("int64")
    assert folded(np.frombuffer(parity_bits(x), "uint8"), 32).tobytes() == np.packbits((np.bincount(places, minlength=256) & 1).astype(bool)).tobytes()


def family(seed, size, words, changed):
    """Copies of one text, each with some words of its own."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(5000)}" for _ in range(words)]
    for i in range(size):
        copy = list(base)
        for k in rng.sample(range(words), rng.randrange(changed + 1)):
            copy[k] = f"o{seed}x{i}x{k}"
        yield " ".join(copy)


def corpus():
    rng = random.Random(9)
    found = [t for seed, (size, words, changed) in enumerate([(60, 150, 7), (40, 40, 2), (30, 12, 1), (50, 400, 30), (5, 3, 1)]) for t in family(seed, size, words, changed)]
    # Chains: each links to the next only.
    chain = [f"c{k}" for k in range(100)]
    for i in range(20):
        found.append(" ".join(chain))
        chain = [*chain[5:], *(f"c{i}n{k}" for k in range(5))]
    found += [found[3]] * 40 + [found[70].upper()] * 5 + ["", " \n", "one", "One", "one two", "one two three"]
    rng.shuffle(found)
    return list(enumerate(found, 1))


def result(rows):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def test_components_by_brute_force(spark):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert result(got) == plain_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_buckets_in_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "BLOCK", 7)
    monkeypatch.setattr(superminhash, "GROUP", 3)
    rows = corpus()
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == plain_components(rows)


def test_other_widths_and_similarities(spark):
    rows = corpus()[::2]
    got = near_duplicates(spark.createDataFrame(rows, "key long, body string"), "key", "body", width=2, percent=90, bands=20, slots=5)
    assert result(got.collect()) == plain_components(rows, 2, 90)


def test_pairs_are_not_made_within_a_component(spark):
    """A family whose sets all link to each other makes as many candidates as it has sets, not their square."""
    rows = [(i, t) for i, t in enumerate(family(3, 400, 300, 3), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert {r.component_id for r in got} == {1}


def test_messy_rows(spark):
    got = near_duplicates(documents(spark)).collect()
    assert result(got) == plain_components(texts())
    assert {(r.doc_id, r.kept) for r in got if r.doc_id in (1, 2, 3)} == {(1, True), (2, True), (3, True)}
    assert all(r.kept == (r.component_id is None) for r in got if r.doc_id is None)


def test_empty_table(spark):
    assert near_duplicates(nothing(spark)).collect() == []


def test_union_find_contracts_links(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (4, 1), (9, 8), (7, 7)], "a long, b long").coalesce(1)
    assert sorted(tuple(r) for r in union_find(edges).collect()) == [(2, 1), (3, 1), (4, 1), (9, 8)]


@pytest.mark.parametrize("name", ["op11_superminhash"])
def test_query_against_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.SQL[name]) is None


def test_same_words_of_one_id_are_split_by_text():
    assert len(shingles("A b c d")) == 2 and shingles("A b").tolist() == shingles("a  B").tolist()
