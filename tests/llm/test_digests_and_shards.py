import collections
import hashlib
import math
import re
import zlib

import pytest

from messy import documents, nothing, texts
from oracle import compare, duck
from tidemark.llm import queries
from tidemark.llm.digests import DigestIndex, dedupe, dedupe_groups
from tidemark.llm.sharding import assign, shard_documents


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def test_groups_of_equal_texts(spark):
    rows = dedupe_groups(documents(spark)).collect()
    by = collections.defaultdict(list)
    for k, t in texts():
        by[hashlib.sha256(normal(t).encode()).hexdigest()].append(k)
    assert len(rows) == len(texts())
    for r in rows:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.doc_id in ids
        assert r.keep_id == min((k for k in ids if k is not None), default=None)
    kept = collections.Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept) == set(by) and set(kept.values()) == {1}


def test_kept_rows_have_all_columns_and_one_of_each_text(spark):
    docs = documents(spark)
    kept = dedupe(docs)
    assert kept.columns == docs.columns
    found = collections.Counter(normal(r.text) for r in kept.collect())
    assert set(found) == {normal(t) for _, t in texts()} and set(found.values()) == {1}


def test_a_second_batch_is_compared_with_the_index(spark):
    index = DigestIndex.create(spark, buckets=3)
    first = documents(spark, [(1, "a b"), (2, "c")])
    assert all(r.kept for r in dedupe_groups(first, index).collect())
    again = {r.doc_id: r for r in dedupe_groups(documents(spark, [(0, "a  b"), (5, "new"), (6, "new")]), index).collect()}
    assert not again[0].kept and again[0].keep_id == 1
    assert again[5].kept and not again[6].kept and again[6].keep_id == 5
    assert index.rows().count() == 3
    assert DigestIndex(spark, index.table)._bucket_count() == 3
    assert not any(r.kept for r in dedupe_groups(first, index).collect()) and index.rows().count() == 3


def test_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = DigestIndex.create(spark, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    dedupe_groups(documents(spark), index)
    batch = spark.range(5).selectExpr("sha2(cast(id as string), 256) digest").selectExpr("unhex(digest) digest").groupBy("digest").count()
    plan = batch.hint("merge").join(index.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan


def test_empty_tables(spark):
    assert dedupe_groups(nothing(spark)).count() == 0 and dedupe(nothing(spark)).count() == 0 and shard_documents(nothing(spark)).count() == 0


def draw(key, shard, weight=1.0):
    bits = int(hashlib.md5(f"{'null' if key is None else key}:{shard}".encode()).hexdigest()[:13], 16)
    return -math.log((bits + 0.5) / 2**52) / weight


def test_shards_by_brute_force(spark):
    rows = shard_documents(documents(spark), 7).collect()
    assert len(rows) == len(texts())
    for r in rows:
        assert r.shard == min(range(7), key=lambda s: draw(r.doc_id, s)) and r.grown_shard == min(range(8), key=lambda s: draw(r.doc_id, s))
        assert r.law == "key" and r.grown_shard in (r.shard, 7)
    for shard in range(7):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    want = collections.Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in texts())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_weights_set_the_shares_and_growth_moves_little(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    out = assign(keys, "k", [1.0, 2.0, 1.0, 0.0], added=[4.0])
    share = {r.shard: r["count"] / 20_000 for r in out.groupBy("shard").count().collect()}
    assert share == {0: pytest.approx(0.25, abs=0.02), 1: pytest.approx(0.5, abs=0.02), 2: pytest.approx(0.25, abs=0.02)}
    assert out.filter("shard != grown_shard and grown_shard != 4").count() == 0
    assert out.filter("shard != grown_shard").count() / 20_000 == pytest.approx(0.5, abs=0.02)
    with pytest.raises(ValueError):
        assign(keys, "k", [0.0])


@pytest.mark.parametrize("name", ["op10_digest_index", "op6_rendezvous_shards", "op4_source_mix", "op1_capture_index", "op2_rule_cascade", "op9_shingle_join"])
def test_same_as_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.SQL[name]) is None

