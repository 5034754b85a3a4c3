import collections
import functools
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from messy import documents, nothing, texts
from tidemark.llm import packing
from tidemark.llm.mixing import mix, mixed_rows, source_targets


@functools.cache
def plain_tokenizer():
    return Tokenizer.from_file(packing.vocabulary_path())


@pytest.fixture
def tokenizer():
    return plain_tokenizer()


def check_places(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_places_by_brute_force(spark, tokenizer):
    rows = packing.pack(documents(spark), capacity=64).collect()
    want = []
    for key, text in texts():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(key, at // 64, at, len(ids[at : at + 64]), zlib.crc32(np.asarray(ids[at : at + 64], "<u4").tobytes())) for at in range(0, len(ids), 64)]
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == collections.Counter(want)
    assert check_places(rows, 64) == math.ceil(sum(w[3] for w in want) / 64)
    again = packing.pack(documents(spark).repartition(7), capacity=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert packing.pack(nothing(spark)).count() == 0


def test_real_documents_come_within_one_sequence_of_the_bound(spark, sf_dir):
    rows = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert check_places(rows, 2048) <= math.ceil(sum(r.length for r in rows) / 2048) + 1


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_ids_are_the_tokenizers(text):
    assert packing.encoder(None)(text) == np.asarray(plain_tokenizer().encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "a", "Don't", " ", "\n", "e", "\u0301", "<|", "|>", "7"]), max_size=12))
def test_control_tokens_are_the_tokenizers_wherever_they_stand(parts):
    text = "".join(parts)
    assert packing.encoder(None)(text) == np.asarray(plain_tokenizer().encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_long_words_are_not_remembered():
    encode = packing.encoder(None)
    word = "q" * 5000
    assert encode(word) == np.asarray(plain_tokenizer().encode(word, add_special_tokens=False).ids, "<u4").tobytes()
    assert all(word not in known for known in packing._memory.values())


def test_every_piece_is_what_its_bytes_merge_to(tokenizer):
    # The reason why merging by tiktoken gives the tokenizer's own result.
    with open(packing.vocabulary_path()) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    whole = {k: v for k, v in vocabulary.items() if k.endswith("</w>")}
    assert all([t.id for t in tokenizer.model.tokenize(k.removesuffix("</w>"))] == [v] for k, v in whole.items())
    assert len(packing.merge_ranks(packing.vocabulary_path())) == len(vocabulary)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 9), max_size=9))
def test_plan_uses_every_piece_once(histogram):
    made = packing.plan(histogram, 24)
    used = collections.Counter()
    for chosen, times in made:
        assert sum(chosen) <= 24 and times > 0
        for x in chosen:
            used[x] += times
    assert used == collections.Counter(histogram)
    for length, rows in packing.places(made).items():
        assert rows[0, 0] == 0 and (np.diff(rows[:, 0]) > 0).all()


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.integers(1, 3), max_size=5), st.integers(0, 30))
def test_fullest_is_the_largest_sum_that_fits(available, room):
    sums = {0}
    for x, n in available.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    chosen = packing.fullest(available, room)
    assert sum(chosen) == max(s for s in sums if s <= room)
    assert all(chosen.count(x) <= available[x] for x in chosen)


def test_the_plan_does_not_grow_with_the_pieces():
    r = random.Random(1)
    histogram = {x: r.randint(1, 50) for x in range(1, 2049)}
    small = packing.plan(histogram)
    large = packing.plan({x: 1_000_000 * n for x, n in histogram.items()})
    assert len(large) <= 3 * 2048 and len(small) <= 3 * 2048


def brute_mix(rows, weights=(3, 1, 2), seed=7):
    size = {i: len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, (_, t, _) in enumerate(rows)}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size[i] for i, r in enumerate(rows) if r[2] == s) for s in sources}
    target, open_, left = {}, set(sources), 1.5 * sum(total.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] <= share * weight[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2 * total[s]
            left -= 2 * total[s]
        open_ -= full
    taken = {}
    for s in sources:
        own = [i for i, r in enumerate(rows) if r[2] == s]

        def key(i):
            k, t, _ = rows[i]
            u = (int(hashlib.md5(f"{'null' if k is None else k}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) * (1 + len(re.findall(r"[#*$%&|<>!]+", t or "")) / max(size[i], 1))

        epochs = int(target[s] / total[s]) if total[s] else 0
        upto = 0
        for i in sorted(own, key=lambda i: (key(i), rows[i][0] is not None, rows[i][0] or 0, size[i])):
            upto += size[i]
            more = size[i] > 0 and epochs < 2 and upto - size[i] / 2 <= target[s] - epochs * total[s]
            taken[i] = size[i] * (epochs + more)
    return [(rows[i][0], rows[i][2], size[i], total[rows[i][2]], round(target[rows[i][2]], 6), taken[i]) for i in range(len(rows))]


def mixed(df):
    return collections.Counter((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def test_mix_by_brute_force(spark, sf_dir):
    docs = documents(spark)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert mixed(mix(docs)) == collections.Counter(brute_mix(rows))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mix(docs)
    assert mixed(got) == collections.Counter(brute_mix(rows)) == mixed(mix(docs.repartition(5)))
    by = collections.defaultdict(list)
    for r in got.collect():
        assert r.taken <= 2 * r["size"]
        by[r.source].append(r)
    for parts in by.values():
        assert abs(sum(r.taken for r in parts) - parts[0].target) <= max(r["size"] for r in parts)


def test_mixed_rows_repeat_documents_as_planned(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    times = {r.doc_id: r.taken // r["size"] for r in mix(docs).collect() if r.taken}
    rows = mixed_rows(docs)
    assert rows.columns == docs.columns
    assert collections.Counter(r.doc_id for r in rows.collect()) == collections.Counter(times)
    assert mix(nothing(spark)).count() == 0 and mixed_rows(nothing(spark)).count() == 0
    assert mixed_rows(documents(spark)).columns == documents(spark).columns


def test_heavier_documents_come_first(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).selectExpr("id as doc_id", "'a b c' as text", "'s' as source")
    rows = mix(docs, percent=50, quality=F.when(F.col("doc_id") < 2000, 3.0).otherwise(1.0)).collect()
    taken = [r.doc_id for r in rows if r.taken]
    assert len(taken) == 2000 and 0.62 < sum(k < 2000 for k in taken) / 2000 < 0.78


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    assert got["a"] == 20.0 and got[None] == 10.0 and sum(got.values()) == pytest.approx(1.5 * 2015)
    assert got["c"] == pytest.approx(1995) and got["b"] == pytest.approx(997.5)


def test_workers_keep_no_words_after_a_task(spark):
    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(64)], "doc_id long, text string").repartition(8)
    assert packing.pieces(docs).count() == 64

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, packing._memory.values()))])], names=["n"])

    assert {r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()} == {0}
