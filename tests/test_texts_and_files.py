"""Text extraction, readers, writers and streams."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X
from tidemark.operators import extract as E
from tidemark.sources import readers as R
from tidemark.sources import sinks as S
from tidemark.streaming import jobs as J

PATTERNS = [E.Pattern("total", r"Total stood at Rs\.? ?([\d,.]*\d)"), E.Pattern("total", r"Total of ([\d,.]*\d)"),
            E.Pattern("ratio", r"ratio (?:was|is) (\d{2}\.\d{1,2})%")]


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "doc string, page int, text string")


def test_first_page_then_first_pattern(spark):
    df = pages(
        spark,
        ("a", 2, "Total stood at Rs 2,77,190 crore"),
        ("a", 1, "In words: Total of 1,234\nand later Total stood  at\nRs. 277,190"),
        ("a", 3, "the ratio was 35.50%"),
        ("b", 1, "nothing here"),
    )
    got = {(r.doc, r.field): (r.value, r.page) for r in E.extract_fields(df, "doc", "page", "text", PATTERNS).collect()}
    assert got == {("a", "total"): (277190.0, 1), ("a", "ratio"): (35.5, 3)}


def test_whole_text_is_read(spark):
    df = pages(spark, ("a", 1, "x " * 200_000 + "Total of 4,321"))
    assert E.extract_fields(df, "doc", "page", "text", PATTERNS).first().value == 4321


def test_line_scan_and_look_ahead(spark):
    df = pages(spark, ("a", 1, "Deposits 1,10,000 1,20,000\nSavings\n11,000 12,500 13%\nSavings\nAccount\n14,000\nDeposits none\n1st line’s end"))
    lines = E.page_lines(df, ["doc", "page"], "text")
    assert [r.line for r in lines.orderBy("line_no").collect()][0] == "Deposits 1,10,000 1,20,000"
    assert lines.filter("line_no = 7").first().line == "1st line's end"
    hits = E.scan_lines(lines, {"deposits": r"^Deposits "}, {"savings": r"^Savings$"})
    got = sorted((r.line_no, r.field, r.value) for r in hits.collect())
    assert got == [(0, "deposits", 120000.0), (1, "savings", 12500.0), (3, "savings", 14000.0)]


def hit(period, field, value, kind, filed, url, page=1):
    return (dt.date.fromisoformat(period), field, float(value), kind, dt.date.fromisoformat(filed), url, page)


HITS = "period date, field string, value double, kind string, filed date, url string, page long"


def test_source_precedence_flips_and_manual_wins(spark):
    hits = spark.createDataFrame([
        hit("2018-03-31", "x", 1, "press", "2018-05-01", "p"), hit("2018-03-31", "x", 2, "deck", "2018-05-20", "d"),
        hit("2019-06-30", "x", 3, "press", "2019-08-01", "p"), hit("2019-06-30", "x", 4, "deck", "2019-07-01", "d"),
        hit("2019-06-30", "y", 5, "deck", "2019-07-09", "d2"), hit("2019-06-30", "y", 6, "deck", "2019-07-01", "d", 4),
    ], HITS)
    manual = spark.createDataFrame([
        (dt.date(2018, 3, 31), "x", 9.0, "m", 7), (dt.date(2015, 3, 31), "x", 8.0, "m", 3)],
        "period date, field string, value double, url string, page long")
    rows = E.assemble_rows(hits, manual, "period", "2019-06-30")
    got = {(str(r.period), r.field): (r.value, r.url, r.page, r.manual) for r in rows.collect()}
    assert got == {
        ("2018-03-31", "x"): (9.0, "m", 7, True), ("2015-03-31", "x"): (8.0, "m", 3, True),
        ("2019-06-30", "x"): (3.0, "p", 1, False), ("2019-06-30", "y"): (6.0, "d", 4, False),
    }
    none = E.assemble_rows(hits, manual.limit(0), "period", "2019-06-30").filter("period = '2018-03-31'").first()
    assert none.value == 2  # before the flip the deck leads
    text = {str(r.period): (r.source_url, r.source_page) for r in E.collate_provenance(rows, "period").collect()}
    assert text["2019-06-30"] == ("d | p", "p.4 y | p.1 x")


def test_plausible_and_consistency(spark):
    hits = spark.createDataFrame([("a", 5.0), ("a", 50.0), ("b", 5.0)], "field string, value double")
    assert [r.value for r in E.plausible(hits, {"a": (1, 10), "b": (6, 9)}).collect()] == [5.0]
    with pytest.raises(Exception, match="no bounds for field b"):
        E.plausible(hits, {"a": (1, 10)}).collect()
    wide = spark.createDataFrame([(1, 10.0, 20.0, 33.0, 40.0, 50.0), (2, 10.0, 20.0, 31.0, 60.0, 50.0), (3, 10.0, 20.0, 30.0, 30.0, None)],
                                 "k int, ca double, sa double, whole double, dom double, world double")
    got = sorted((r.k, r.violation) for r in E.consistency_checks(wide, ["k"], "ca", "sa", "whole", "dom", "world").collect())
    assert got == [(1, "parts_do_not_add_up"), (2, "domestic_not_below_global"), (3, "whole_not_below_domestic")]


@pytest.mark.parametrize("text,found", [("is 1,77,190 crore", True), ("177,190", True), ("177190", True), ("1771,90", False)])
def test_verify_printed_forms(spark, text, found):
    v = spark.createDataFrame([("a", 177190.0)], "doc string, value double")
    p = spark.createDataFrame([("a", text)], "doc string, text string")
    assert E.verify_against_text(v, p, ["doc"], "value", "text").first().found is found


@pytest.mark.parametrize("text,found", [("is 1,234.5 crore", True), ("1234.5", True), ("1,234", False), ("12,34.5", False)])
def test_verify_amounts_with_decimals(spark, text, found):
    v = spark.createDataFrame([("a", 1234.5)], "doc string, value double")
    assert E.verify_against_text(v, spark.createDataFrame([("a", text)], "doc string, text string"), ["doc"], "value", "text").first().found is found


def test_last_group_is_the_current_value(spark):
    df = pages(spark, ("a", 1, "grew from Rs 1,000 to Rs 2,500 crore"), ("b", 1, "grew from Rs 1,000 this year"), ("c", 1, "Total of ,,, and Sum 7,000"))
    patterns = [E.Pattern("x", r"from Rs ([\d,]+)(?: to Rs ([\d,]+))?"), E.Pattern("x", r"Total of ([\d,]+)"), E.Pattern("x", r"Sum ([\d,]+)")]
    assert {r.doc: r.value for r in E.extract_fields(df, "doc", "page", "text", patterns).collect()} == {"a": 2500.0, "b": 1000.0, "c": 7000.0}


def test_number_formats(spark):
    df = spark.createDataFrame([(5,), (999,), (1000,), (177190,), (12345678,), (123456789,)], "n long")
    got = [r.s for r in df.select(X.indian_grouping(F.col("n")).alias("s")).collect()]
    assert got == ["5", "999", "1,000", "1,77,190", "1,23,45,678", "12,34,56,789"]
    money = spark.createDataFrame([(64500000.0,), (-1000000.0,)], "x double").select(X.rupees_in_crore(F.col("x")).alias("s")).collect()
    assert [r.s for r in money] == ["₹6.45 Cr", "−₹0.10 Cr"]


def test_select_filings(spark):
    df = spark.createDataFrame([("Press Release", "a.pdf"), ("Press Release", "transcript.pdf"), ("Other", "b.pdf"), (None, "c.pdf")], "desc string, url string")
    assert [r.url for r in E.select_filings(df, {"desc": "(?i)^press release"}, {"url": "(?i)transcript"}).collect()] == ["a.pdf"]


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def test_lenient_csv(spark, path):
    rows = [("2016-01-28", "  7", " 35", "1.0", "", "2015-08-10"), ("2016-01-28", "8", "     NA", "1", "12.5", "no date")]
    spark.createDataFrame(rows, "d string, id string, age string, code string, income string, start string").write.option("header", True).csv(path)
    args = (["d", "id", "age", "code", "income", "start"], {"id": "int", "d": "date"}, {"age": "smallint", "income": "double", "start": "date"}, ("code",))
    got = sorted(R.ingest_lenient_csv(spark, path, *args).collect(), key=lambda r: r.id)
    assert [tuple(r)[1:] for r in got] == [(7, 35, "1", None, dt.date(2015, 8, 10)), (8, None, "1", 12.5, None)]
    bad = path + "-bad"
    spark.createDataFrame([("2016-01-28", "x1", "1", "1", "1", "")], "d string, id string, age string, code string, income string, start string").write.option("header", True).csv(bad)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        R.ingest_lenient_csv(spark, bad, *args).collect()


def test_landing_skips_and_forces(spark, path):
    first = spark.createDataFrame([(1, 10), (2, 20)], "period int, v int")
    S.land_by_period(first, path, "period")
    again = spark.createDataFrame([(2, 99), (3, 30)], "period int, v int")
    assert sorted((r.period, r.v) for r in S.land_by_period(again, path, "period").collect()) == [(1, 10), (2, 20), (3, 30)]
    assert sorted((r.period, r.v) for r in S.land_by_period(again, path, "period", force=True).collect()) == [(1, 10), (2, 99), (3, 30)]


def test_optional_artifacts(spark, path):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert R.read_optional(spark, path, schema).count() == 0
    assert R.read_optional(spark, path, schema, "json").columns == ["a"]
    spark.createDataFrame([('{"a": 1}',), ("{broken",)], "v string").write.text(path)
    assert [r.a for r in R.read_optional(spark, path, schema, "json").collect()] == [1]


def test_dedupe_and_reconcile(spark):
    df = spark.createDataFrame([("x", 2, "late"), ("x", 1, "early"), ("y", 5, "only")], "k string, o int, v string")
    one = R.dedupe_first(df, ["k"], [F.col("o")])
    assert sorted((r.k, r.v) for r in one.collect()) == [("x", "early"), ("y", "only")]
    declared = spark.createDataFrame([("x", 1), ("y", 1)], "k string, total long")
    assert R.reconcile(one, ["k"], declared, "total").count() == 2
    with pytest.raises(Exception, match="declared total"):
        R.reconcile(df, ["k"], declared, "total").collect()
    assert R.reconcile(df, ["k"], declared, "total", strict=False).filter("not reconciled").count() == 1


def test_json_has_no_nan(spark, path):
    df = spark.createDataFrame([("a", float("nan"), 1.5), ("b", float("inf"), None)], "k string, x double, y double")
    docs = {r.k: r.document for r in S.json_documents(df, ["k"]).collect()}
    assert docs == {"a": '{"x":null,"y":1.5}', "b": '{"x":null,"y":null}'}
    S.export_json(df, path)
    assert spark.read.text(path).filter(F.col("value").contains("NaN") | F.col("value").contains("Inf")).count() == 0


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.range(50).select("id", F.lit("2020-01-01").alias("ds"))

    def print_of(df):
        return S.run_manifest(df, "ds", {"h": "4"}).first()

    assert print_of(a).fingerprint == print_of(a.repartition(7)).fingerprint
    assert print_of(a).fingerprint != print_of(a.union(a.limit(1))).fingerprint
    assert print_of(a).config == {"h": "4"} and print_of(a).n_rows == 50


def test_registry_best(spark):
    m = spark.createDataFrame([("s", "a", 3.0), ("s", "b", 1.0), ("s", "c", None)], "s string, model string, mape double")
    assert S.registry_best(m, ["s"], "mape").first().best_model == "b"
    assert S.registry_best(m, ["s"], "mape", lower_is_better=False).first().best_model == "a"


def minutes(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


EVENT = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType())])


def batches(spark, path, *groups):
    """One file per group, so each group arrives as its own micro-batch."""
    for g in groups:
        spark.createDataFrame(g, EVENT).coalesce(1).write.mode("append").parquet(path)
    return J.read_files(spark, path, EVENT, files_per_batch=1)


def test_stream_landing_drops_repeats_and_resumes(spark, path):
    out, checkpoint = path + "-out", path + "-cp"
    stream = batches(spark, path, [(1, "a", minutes(0), 1.0), (2, "a", minutes(1), 1.0)], [(1, "a", minutes(0), 1.0), (3, "a", minutes(2), 1.0)])
    got = J.run_to_table(J.landed(stream, ["id"], "ts"), out, checkpoint)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]
    stream = batches(spark, path, [(4, "a", minutes(3), 1.0), (2, "a", minutes(1), 1.0)])
    assert sorted(r.id for r in J.run_to_table(J.landed(stream, ["id"], "ts"), out, checkpoint).collect()) == [1, 2, 3, 4]


def test_stream_totals_and_cusum_equal_batch(spark, path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    values = [5.0, 1, 9, 2, 8, 7, 3, 6, 9, 9]
    rows = [(i, "k", minutes(60 * i + 5), float(v)) for i, v in enumerate(values)]
    stream = batches(spark, path, rows[:3], rows[3:4], rows[4:8], rows[8:])
    totals = J.period_totals(stream, "ts", "value", ["key"], "1 hour", "5 minutes")
    ref = spark.createDataFrame([("k", 5.0, 2.0)], "key string, ref_mean double, ref_std double")
    got = J.run_to_table(J.cusum_monitor(totals, "key", ref)).orderBy("n").collect()
    pos, want = 0.0, []
    for i, v in enumerate(values[: len(got)]):
        pos = 0.0 if i == 0 else max(0.0, pos + (v - 5) / 2 - 0.5)
        want.append(pos)
    assert len(got) >= 8 and [r.cusum_pos for r in got] == pytest.approx(want)


def test_a_drained_stream_equals_batch_to_the_last_window(spark, path):
    rows = [(i, k, minutes(20 * i), float(i % 7)) for i in range(40) for k in "ab"]
    stream = batches(spark, path, rows[:30], rows[30:50], rows[50:])
    totals = J.period_totals(stream, "ts", "value", ["key"], "1 hour", "5 minutes")
    out, checkpoint = path + "-out", path + "-cp"
    want = {}
    for _, k, t, v in rows:
        hour = t.replace(minute=0)
        total, n = want.get((k, hour), (0.0, 0))
        want[k, hour] = total + v, n + 1
    before = {(r.key, r.period_start): (r.total, r.n) for r in J.run_to_table(totals, out, checkpoint).collect()}
    assert len(before) < len(want) and all(want[k] == v for k, v in before.items())
    J.drain(path, EVENT, spark, "ts", "5 minutes", "1 hour")
    assert {(r.key, r.period_start): (r.total, r.n) for r in J.run_to_table(totals, out, checkpoint).collect()} == want


def test_landing_once_in_any_order_and_after_a_restart(spark, path):
    out, checkpoint = path + "-out", path + "-cp"
    late = [(9, "z", minutes(90_000), 1.0), (1, "a", minutes(0), 1.0)], [(2, "a", minutes(1), 2.0), (1, "a", minutes(0), 1.0), (2, "a", minutes(1), 1.5)]
    got = J.land_once(batches(spark, path, *late), ["id"], out, checkpoint).collect()
    assert sorted((r.id, r.value) for r in got) == [(1, 1.0), (2, 1.5), (9, 1.0)]
    again = batches(spark, path, [(3, "b", minutes(-5000), 3.0), (9, "other", minutes(0), 4.0), (None, "n", minutes(0), 5.0)], [(None, "n", minutes(0), 6.0)])
    got = J.land_once(again, ["id"], out, checkpoint).collect()
    assert sorted(((r.id or 0), r.value) for r in got) == [(0, 5.0), (1, 1.0), (2, 1.5), (3, 3.0), (9, 1.0)]


def test_a_batch_that_runs_again_lands_the_same(spark, path):
    out, checkpoint = path + "-out", path + "-cp"
    J.land_once(batches(spark, path, [(1, "a", minutes(0), 1.0)], [(2, "a", minutes(1), 1.0), (1, "a", minutes(0), 1.0)]), ["id"], out, checkpoint)
    # As after a failure between the write and the commit of the last batch.
    for name in ("1", ".1.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    got = J.land_once(J.read_files(spark, path, EVENT, files_per_batch=1), ["id"], out, checkpoint).collect()
    assert sorted(r.id for r in got) == [1, 2]


def test_late_rows_change_windows_already_written(spark, path):
    groups = [(1, "a", minutes(500), 1.0), (2, "a", minutes(510), 2.0)], [(3, "a", minutes(3), 4.0)], [(4, "a", minutes(505), 8.0), (5, "a", minutes(1), 16.0)]
    totals = J.running_totals(batches(spark, path, *groups), "ts", "value", ["key"], "1 hour")
    got = J.run_updates(totals, ["period_start", "key"], path + "-out", path + "-cp").collect()
    assert sorted((r.period_start, r.total, r.n) for r in got) == [(minutes(0), 20.0, 2), (minutes(480), 11.0, 3)]


def test_a_document_is_read_in_order(spark):
    pages = [
        ("a", 2, "CASA stood at 1,23,456\nCASA 9999 8888"),
        ("a", 1, "nothing here\nCASA 1111 2222\nCASA 3333 4444"),
        ("b", 1, "CASA 5555 6666\nthe CASA stood at\n  7,77,777 crore"),  # a sentence goes before a row, over line ends
        ("c", 1, "Savings\nx\n1,234 5,678"), ("c", 2, "Savings 4321"),
        ("d", 1, "Savings\nx\ny\n1234"),  # too far ahead
        ("e", 1, "Savings\n1234 5678\n9999"),  # the nearer line
        ("f", 1, None), ("f", 2, ""), (None, 1, "CASA 1212"),
    ]
    rules = [E.LineRule("casa", rf"^CASA {E.AMOUNT}"), E.LineRule("savings", r"^Savings \d"), E.LineRule("savings", "^Savings$", 2, r"^\d")]
    got = E.read_documents(spark.createDataFrame(pages, "d string, p int, t string"), "d", "p", "t", [E.Pattern("casa", rf"CASA stood at {E.AMOUNT}")], rules)
    assert {(r.d, r.field): (r.value, r.page, r.line_no) for r in got.collect()} == {
        ("a", "casa"): (2222.0, 1, 1), ("b", "casa"): (777777.0, 1, None), ("c", "savings"): (5678.0, 1, 0), ("e", "savings"): (5678.0, 1, 0),
        (None, "casa"): (1212.0, 1, 0),
    }


def test_histogram_by_map_equals_join(spark):
    from tidemark.operators import profile as R

    df = spark.range(500).select((F.col("id") % 3 % 2).alias("g"), F.rand(4).alias("x")).union(spark.sql("SELECT 2L, 5.0D UNION ALL SELECT 2L, 5.0D UNION ALL SELECT 1L, null"))
    joined, mapped = (sorted(map(tuple, R.histogram_density(df, ["g"], "x", few_groups=few).collect())) for few in (False, True))
    assert joined == mapped and sum(r[2] for r in mapped) == 502
