import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from oracle import compare, duck
from tidemark.llm import negatives, queries
from tidemark.llm.negatives import Maps, best_of, bounds, hard_negatives, hilbert, matrix, products, window_of, zoned

SCHEMA = "vec_id long, embedding array<float>, label int, id long, row long, zone string, scores int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, "z", 1) for r in rows], SCHEMA)


def plain(rows, anchor=lambda k: k % 50 == 0):
    """Every anchor against every row."""
    kept = []
    for at, (k, v, label) in enumerate(rows):
        if k is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((at, k, (label + 1) % 10 if k % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for at, k, label, x in kept:
        if not anchor(k):
            continue
        scores = [(-sum(a * b for a, b in zip(x, y)), j, other) for i, j, other, y in kept if i != at]
        for p_score, p, _ in sorted(s for s in scores if s[2] == label)[:5]:
            fit = sorted((s, j) for s, j, other in scores if other != label and 50 * -p_score <= 100 * -s <= 95 * -p_score)[:3]
            out += [(k, p, rank, j, -p_score, -s) for rank, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def run(spark, rows):
    return got(hard_negatives(table(spark, rows), negatives.F.col("vec_id") % 50 == 0))


def random_rows(seed, n, dims, labels, clusters=0, wide=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, clusters), dims)) * (3 if clusters else 0)
    ids = rng.permutation(n * 2)[:n]
    return [(int(k), (centres[rng.integers(len(centres))] + rng.normal(size=dims) * wide).astype("float32").tolist(), int(rng.integers(labels))) for k in ids]


def test_curve_visits_every_cell_and_steps_to_a_neighbour():
    for dims, bits in ((2, 4), (3, 3), (4, 2), (1, 5)):
        cells = np.array(list(itertools.product(range(2**bits), repeat=dims)))
        place = hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_are_reached():
    rng = np.random.default_rng(5)
    x, low = rng.integers(-50, 50, (20, 3)), rng.integers(-50, 50, (4, 3))
    high = low + rng.integers(0, 9, (4, 3))
    least, most = bounds(x, low, high)
    for a, b in itertools.product(range(20), range(4)):
        corners = [sum(int(v) * c for v, c in zip(x[a], corner)) for corner in itertools.product(*zip(low[b].tolist(), high[b].tolist()))]
        assert (least[a, b], most[a, b]) == (min(corners), max(corners))


def test_products_are_exact_at_any_size():
    for top in (2**10, 2**29, 2**31, 2**40):
        x = np.random.default_rng(top).integers(-top, top, (4, 6))
        exact = [[max(-(2**63) + 1, min(2**63 - 1, sum(int(p) * int(q) for p, q in zip(a, b)))) for b in x] for a in x]
        assert products(x, x).tolist() == exact


def test_windows_are_whole_numbers():
    for score in [*range(-30, 500), 2**62]:
        low, high = window_of(score)
        for n in (low - 1, low, high, high + 1):
            assert (low <= n <= high) == (50 * score <= 100 * n <= 95 * score)


def test_best_of_takes_the_first_of_equals():
    scores = np.array([[5, 7, 7, 1], [3, 3, 3, 3]])
    found = [(r.tolist(), c.tolist()) for r, c in best_of(scores, np.array([[True, True, True, False], [False, True, False, True]]), 3)]
    assert found == [([0, 1], [1, 1]), ([0, 1], [2, 3]), ([0], [0])]


def test_short_vectors_end_in_zeros():
    assert matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int64())).slice(0, 3), 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]


@pytest.mark.parametrize("clusters,dims,labels", [(0, 6, 3), (6, 10, 4), (12, 3, 10)])
def test_by_brute_force_in_many_zones(spark, monkeypatch, clusters, dims, labels):
    monkeypatch.setattr(negatives, "ZONE", 60)
    rows = random_rows(clusters, 900, dims, labels, clusters, 0.4)
    assert run(spark, rows) == plain(rows)


def test_zone_maps_skip_zones_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ZONE", 100)
    rows = random_rows(3, 3000, 4, 2, 10, 0.05)
    data = negatives.integer_rows(table(spark, rows), negatives.F.lit(True), "vec_id", "embedding", "label").withColumn("row", negatives.F.monotonically_increasing_id()).cache()
    blocks, dims = zoned(data)
    maps = Maps(blocks, dims)
    some = data.limit(200).collect()
    x, labels = np.array([r.x for r in some]), np.array([r.label for r in some])
    assert len(maps.zone) >= 20 and maps.with_positives(x, labels, 5).mean() < 0.3


def test_ties_repeats_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.5], k % 3) for k in range(0, 60)] + [(50, [1.0, 0.5], 2)] * 3 + [(50, None, 1), (100, [nan, 1.0], 1), (100, [None, 1.0], 1), (None, [1.0, 1.0], 1)]
    rows += [(150, [inf, 1.0], 0), (200, [1.0, 0.5], None), (250, [], 1), (300, [0.0, 0.0], 1), (350, [-1.0, -0.5], 2), (400, [2.0], 1), (450, [0.7, 0.3, 9.0], 2)]
    rows += [(k, [0.75, 0.25], k % 3) for k in range(500, 530)]
    assert run(spark, rows) == plain(rows)


def test_empty_table_and_no_anchors(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert run(spark, [(50, [1.0], 1)]) == []


@pytest.mark.parametrize("name", ["op12_hilbert_zone_maps"])
def test_query_against_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.SQL[name]) is None
