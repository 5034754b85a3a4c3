import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from messy import documents, nothing, texts
from oracle import compare, duck
from tidemark.llm import queries
from tidemark.llm.common import words_of
from tidemark.llm.periods import collapsed, lag_scan, periodic_runs, runs_of, survivors


def plain_runs(words):
    """Every run by trying every period at every place."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = words[i : i + length]
                if not any(all(part[k] == part[k + d] for k in range(length - d)) for d in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abcdef"), max_size=80), max_size=4))
def test_small_alphabets_by_brute_force(lists):
    assert runs_of(lists) == [plain_runs(x) for x in lists]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(0, 30), st.integers(2, 9), st.integers(0, 39), st.randoms(use_true_random=False))
def test_planted_runs_by_brute_force(period, before, times, more, rng):
    root = [rng.choice("abcdefghij") for _ in range(period)]
    words = [rng.choice("abcxyz") for _ in range(before)] + (root * (times + 1))[: period * times + more % period] + [rng.choice("abcxyz") for _ in range(before)]
    assert runs_of([words]) == [plain_runs(words)]


def test_runs_within_runs():
    inner = ["a"] * 7 + ["b"]
    words = inner * 5
    assert runs_of([words])[0] == plain_runs(words)
    assert (0, 40, 8) in runs_of([words])[0] and (0, 7, 1) in runs_of([words])[0]


def test_splitting_keeps_every_run_and_cuts_rare_words():
    rng = random.Random(3)
    words = [f"w{rng.randrange(400)}" for _ in range(3000)]
    words[1000:1200] = [f"r{i % 50}" for i in range(200)]
    _, numbers = np.unique(words, return_inverse=True)
    left = survivors(numbers, np.zeros(len(words), "int64"))
    assert any(a <= 1000 and b >= 1200 for a, b in left)
    for a, b in left:
        part = numbers[a:b]
        assert np.bincount(part)[part].min() >= 4
    assert runs_of([words])[0] == plain_runs(words)


def test_long_periods_take_no_square_of_the_length():
    root = np.random.default_rng(1).integers(0, 50_000, 60_000)
    words = np.tile(root, 5)[:290_000]
    assert lag_scan(words) == [(0, 290_000, 60_000)]


def test_words_after_the_first_period_go():
    words = "x a b a b a b a b y".split()
    assert runs_of([words]) == [[(1, 8, 2)]]
    assert collapsed(words, [(1, 8, 2)]) == "x a b y"
    overlapping = "a a a a a a b a a a a a a b a a a a a a b a a a a a a b".split()
    runs = runs_of([overlapping])[0]
    drop = {k for s, n, q in runs for k in range(s + q, s + n)}
    assert collapsed(overlapping, runs) == " ".join(w for k, w in enumerate(overlapping) if k not in drop)


def test_messy_rows_keep_their_columns(spark):
    docs = documents(spark)
    rows = periodic_runs(docs).collect()
    assert len(rows) == len(texts())
    for r in rows:
        words = re.findall("[^\x20\x09-\x0d]+", r.doc.text or "")
        assert r.n_words == len(words) and set(r.doc.asDict()) == set(docs.columns)
        if len(words) < 1000:
            assert [(x.start, x.length, x.period) for x in r.runs] == plain_runs(words)
    by = {r.doc.doc_id: r for r in rows if r.doc.doc_id is not None}
    assert [tuple(x) for x in by[11].runs] == [(0, 6, 1)] and by[11].collapsed == "word"
    assert by[1].runs == [] and by[1].collapsed == "" and by[1].n_words == 0


def test_empty_table(spark):
    assert periodic_runs(nothing(spark)).collect() == []


@pytest.mark.parametrize("name", ["op13_frequency_splitting"])
def test_query_against_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.SQL[name]) is None


def test_query_against_plain_code(spark, sf_dir):
    import zlib

    texts_ = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    looped = 0
    for r in queries.QUERIES["op13_frequency_splitting"](spark, sf_dir).collect():
        words = words_of(texts_[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            looped += 1
        if n > 1500:
            continue
        runs = plain_runs(words)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        if runs:
            s, k, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, k, q, 1000 * k // q)
        else:
            assert r.start is r.length is r.period is r.exponent_milli is None
    assert looped > 5
