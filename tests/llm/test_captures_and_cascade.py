import base64
import collections
import hashlib
import io

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from messy import documents, nothing, texts
from oracle import compare, duck
from tidemark.llm import captures, cascade, queries
from tidemark.llm.common import stored

PAGES = [
    (1, "http://b.example.com/x?q=1", "<p>one</p>"), (2, "https://www.example.com/", "<p>one</p>"), (3, "http://a.example.com:8080/y", None),
    (4, None, ""), (5, "http://[bad", "ß" * 3), (6, "http://b.example.com/x?q=1", "\r\n\r\nWARC/1.1\r\n\r\n"), (7, "http://b.example.com/x?q=1", "<p>one</p>"),
    (7, "http://b.example.com/x?q=1", "<p>one</p>"), (None, "http://z.example", "alone"), (None, "http://z.example", "<p>one</p>"), (9, "http://long", "z" * 9_000_000),
]


def pages(spark, rows=PAGES):
    data = [(*r, "x", 1, 2, "k") for r in rows]
    return spark.createDataFrame(data, "page_id long, url string, html string, digest string, keeper long, n long, url_key string")


def test_records_come_back_and_revisits_refer_to_the_largest_page(spark):
    rows = captures.capture_histories(pages(spark)).collect()
    groups = collections.defaultdict(list)
    for k, _, h in PAGES:
        groups[h or ""].append(k)
    want = collections.Counter()
    for k, _, h in PAGES:
        body = (h or "").encode()
        keeper = max((x for x in groups[h or ""] if x is not None), default=None)
        revisit = len(groups[h or ""]) > 1 and keeper is not None and k != keeper
        want[k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    assert captures.capture_histories(pages(spark, [])).count() == 0


def test_short_payloads_are_all_responses(spark):
    rows = captures.capture_histories(pages(spark), least=100).collect()
    assert {r.record_type for r in rows} == {"response"}


def test_histories_are_in_global_order(spark, sf_dir):
    found = captures.capture_histories(spark.read.parquet(f"{sf_dir}/pages.parquet").union(spark.read.parquet(f"{sf_dir}/pages.parquet").limit(9)))
    rows = stored(found.withColumn("at", F.monotonically_increasing_id()), "order").orderBy("at").collect()
    keys = [(r.url_key, r.ts, -1 if r.page_id is None else r.page_id) for r in rows]
    assert keys == sorted(keys) and len(rows) > 50


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=12), max_size=9))
def test_loser_tree_merges_like_a_stable_sort(runs):
    tagged = [[(x, r, k) for k, x in enumerate(sorted(run))] for r, run in enumerate(runs)]
    merged = list(captures.loser_tree_merge(tagged, key=lambda row: row[0]))
    assert merged == sorted((row for run in tagged for row in run), key=lambda row: row[:1] + row[1:])


def test_record_round_trip():
    made = [captures.record(1, "http://a/ b\r\nX: y", b"abc\r\n\r\nWARC/1.1", None), captures.record(None, None, b"", None), captures.record(3, "u", b"abc", 1)]
    import gzip

    found = list(captures.records(io.BytesIO(b"".join(gzip.compress(m) for m in made))))
    assert [p for _, _, p in found] == [b"abc\r\n\r\nWARC/1.1", b"", b""]
    assert found[2][1]["WARC-Type"] == "revisit" and found[2][1]["X-Payload-Length"] == "3" and found[0][1]["WARC-Target-URI"] == "http://a/ b X: y"
    assert list(captures.records(io.BytesIO(b""))) == []


def test_url_keys():
    assert captures.url_key("https://www.Example.com:443/a?b=1#c") == "com,example)/a?b=1"
    assert captures.url_key("http://m.example.com:8080") == "com,example,m:8080)/" and captures.url_key(None) == ")/"


def test_counts_and_verdicts_on_messy_texts_equal_sql(spark):
    docs = documents(spark, [(k, t) for k, t in texts() if k is not None and k != 9 and "\x00" not in (t or "")])
    con = duck("/nowhere")
    table = docs.select("doc_id", "text").toArrow()
    con.register("documents", table)
    assert compare(cascade.judge(docs), con, queries.SQL["op2_rule_cascade"]) is None


def test_rows_are_judged_each_for_itself(spark):
    rows = cascade.judge(documents(spark)).collect()
    assert len(rows) == len(texts())
    by = {(r.doc_id): r for r in rows}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[7].n_words == 60 and by[7].n_repeat_words == 60 and by[7].base_failed
    assert by[11].n_repeat_words == 6 and by[18].n_dup_lines == 2 and by[13].n_symbols == 9
    assert cascade.judge(nothing(spark)).count() == 0


def test_a_filter_on_the_verdict_keeps_the_parts_apart(spark):
    found = cascade.judge(documents(spark)).filter("kept and n_repeat_words < 5 and n_dup_lines < 9")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") == 1 and found.count() >= 0


def test_rules_are_ordered_by_rejections_per_cost():
    rule = lambda name: cascade.Rule(name, None)
    made = [cascade.Measured(rule("dear"), 1.0, 0.5), cascade.Measured(rule("cheap"), 0.01, 0.1), cascade.Measured(rule("idle"), 0.001, 0.0), cascade.Measured(rule("a"), 0.02, 0.2)]
    assert [r.name for r in cascade.ordered(made)] == ["a", "cheap", "dear", "idle"]


def test_order_never_changes_the_verdict_and_later_rules_are_skipped(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = cascade.standard_rules()
    prepared = cascade.with_base(cascade.with_words(docs.select("doc_id", "text")))
    passes = lambda some: {r.doc_id for r in prepared.filter(cascade.first_failed(some).isNull()).collect()}
    assert passes(rules) == passes(rules[::-1])
    bomb = cascade.Rule("bomb", F.raise_error(F.lit("evaluated")).cast("boolean"))
    always = cascade.Rule("always", F.lit(True) & (F.col("n_words") >= 0))
    assert prepared.select(cascade.first_failed([always, bomb]).alias("r")).distinct().collect()[0].r == "always"


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = cascade.judge(docs).filter("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    assert {(r.quality, r.kept) for r in got} == {(1, True), (0, False)}


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.QUERIES["op2_rule_cascade"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_ids_beyond_doubles_stay_whole(spark):
    big = 2**60
    rows = [(big + 1, "http://a.b/1", "same"), (big + 3, "http://a.b/2", "same"), (None, "http://a.b/3", "same"), (big + 5, None, "alone"), (-big - 7, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {(r.page_id, r.url): (r.record_type, r.refers_to) for r in captures.capture_histories(pages).collect()}
    assert got == {
        (big + 1, "http://a.b/1"): ("revisit", big + 3), (big + 3, "http://a.b/2"): ("response", None), (None, "http://a.b/3"): ("revisit", big + 3),
        (big + 5, ""): ("response", None), (-big - 7, "u"): ("response", None),
    }


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert captures.capture_histories(empty).collect() == []
