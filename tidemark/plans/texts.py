"""Queries over page text: filing selection, field extraction, assembly, provenance and checks.

Documents stand for filings: the filing date follows from the length, English ones are press releases.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.calendar import reporting_quarter_end
from tidemark.operators import extract as T
from tidemark.plans import inputs as I
from tidemark.plans.catalog import register
from tidemark.plans.inputs import CTES

# What is looked for in the pages, in order of preference within a field.
PATTERNS = (
    T.Pattern("area", r"\+1 \((\d{3})\) 555-\d{4}"),
    T.Pattern("area", r"\((\d{3})\)"),
    T.Pattern("card", r" (\d{16}) "),
    T.Pattern("card", r"(\d{13,16})"),
    T.Pattern("octet", r"\b(\d{1,3})\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
)
BOUNDS = {"area": (200.0, 700.0), "card": (4.2e15, 4.7e15), "octet": (1.0, 223.0)}
INCLUDE = r"(?i)token|555-\d{4}|\d{16}"
EXCLUDE = r"(?i)licen[sc]e|copyright"
ROWS = {"phone": r"555-\d{4}", "number": r"\d{13,}"}
LABELS = {"after_label": r"^\S+$"}
FLIP = "2019-06-30"


def _hit(field: str) -> str:
    options = [f"CASE WHEN regexp_matches(flat, '{p.regex}') THEN regexp_extract(flat, '{p.regex}', {p.group or 1}) END"
               for p in PATTERNS if p.field == field]
    return f"coalesce({', '.join(options)})"


_FIELDS = ("area", "card", "octet")

CTES |= {
    "filings": (
        """SELECT doc_id, source, text, 'doc-' || doc_id AS url, CASE WHEN lang = 'en' THEN 'press' ELSE 'deck' END AS kind,
        DATE '2015-01-01' + CAST(n_chars % 3650 AS INTEGER) AS filed FROM documents""", ()),
    "hits": (
        " UNION ALL ".join(
            f"SELECT doc_id, source, '{f}' AS field, TRY_CAST(replace({_hit(f)}, ',', '') AS DOUBLE) AS value FROM "
            "(SELECT *, regexp_replace(replace(text, '’', ''''), '\\s+', ' ', 'g') AS flat FROM documents)" for f in _FIELDS), ()),
    "found": (
        """SELECT h.doc_id, h.field, h.value, f.url, f.kind, f.filed,
        CAST(last_day(date_trunc('quarter', f.filed) - INTERVAL 1 MONTH) AS DATE) AS period FROM hits h JOIN filings f ON h.doc_id = f.doc_id
        WHERE value IS NOT NULL""", ("hits", "filings")),
    "plaus": (
        "SELECT * FROM found WHERE " + " OR ".join(f"(field = '{f}' AND value BETWEEN {lo} AND {hi})" for f, (lo, hi) in BOUNDS.items()), ("found",)),
    "manual": (
        """SELECT period, 'area' AS field, CAST(min(doc_id) AS DOUBLE) AS value, 'manual' AS url, CAST(0 AS BIGINT) AS page FROM (
        SELECT f.doc_id, CAST(last_day(date_trunc('quarter', f.filed) - INTERVAL 1 MONTH) AS DATE) AS period FROM filings f
        JOIN labels l ON l.doc_id = f.doc_id WHERE l.toxic = 1) GROUP BY 1""", ("filings",)),
    "chosen": (
        f"""SELECT period, field, value, url, doc_id AS page FROM (SELECT *, row_number() OVER (PARTITION BY period, field ORDER BY
        CASE WHEN period >= DATE '{FLIP}' THEN kind <> 'press' ELSE kind = 'press' END, filed, url, doc_id) AS r FROM plaus) WHERE r = 1""", ("plaus",)),
    "assembled": (
        """SELECT coalesce(c.period, m.period) AS period, coalesce(c.field, m.field) AS field, CASE WHEN m.value IS NOT NULL THEN m.value ELSE c.value END AS value,
        CASE WHEN m.value IS NOT NULL THEN m.url ELSE c.url END AS url, CASE WHEN m.value IS NOT NULL THEN m.page ELSE c.page END AS page,
        m.value IS NOT NULL AS manual FROM chosen c FULL OUTER JOIN manual m ON c.period = m.period AND c.field = m.field""", ("chosen", "manual")),
    "lines": (
        """SELECT doc_id, i - 1 AS line_no, trim(l[i]) AS line, trim(l[i + 1]) AS next_1, trim(l[i + 2]) AS next_2 FROM
        (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, string_split(replace(text, '’', ''''), chr(10)) AS l FROM documents))""", ()),
}


def filings(spark, d):
    return I.table(spark, d, "documents").select(
        "doc_id", "source", "text", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("lang") == "en", "press").otherwise("deck").alias("kind"),
        F.date_add(F.lit("2015-01-01").cast("date"), (F.col("n_chars") % 3650).cast("int")).alias("filed"),
    )


def found(spark, d):
    """Hits of every document with its filing columns and the quarter it reports on."""
    f = filings(spark, d)
    hits = T.extract_fields(f.withColumn("page", F.lit(0)), "doc_id", "page", "text", PATTERNS).drop("page")
    return hits.join(f.drop("text"), "doc_id").withColumn("period", reporting_quarter_end(F.col("filed"))).withColumn(
        "page", F.col("doc_id")
    )


def manual(spark, d):
    toxic = I.table(spark, d, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return (
        filings(spark, d).select("doc_id", reporting_quarter_end(F.col("filed")).alias("period")).join(toxic, "doc_id")
        .groupBy("period").agg(F.min("doc_id").cast("double").alias("value"))
        .select("period", F.lit("area").alias("field"), "value", F.lit("manual").alias("url"), F.lit(0).cast("long").alias("page"))
    )


def assembled(spark, d):
    return T.assemble_rows(T.plausible(found(spark, d), BOUNDS), manual(spark, d), "period", FLIP)


@register(
    "select_filings",
    f"SELECT doc_id, kind, CAST(filed AS VARCHAR) AS filed FROM filings WHERE regexp_matches(text, '{INCLUDE}') AND NOT regexp_matches(text, '{EXCLUDE}')",
    ("filings",),
)
def select_filings(spark, d):
    return T.select_filings(filings(spark, d), {"text": INCLUDE}, {"text": EXCLUDE}).select("doc_id", "kind", "filed")


@register(
    "extract_fields",
    """SELECT source, field, arg_min(value, doc_id) AS value, min(doc_id) AS page FROM hits WHERE value IS NOT NULL GROUP BY 1, 2""",
    ("hits",),
)
def extract_fields(spark, d):
    """First hit per source and field; a source may hold any share of the documents."""
    return T.extract_fields(I.table(spark, d, "documents"), "source", "doc_id", "text", PATTERNS)


@register("extract_per_document", "SELECT doc_id, field, value FROM found", ("found",))
def extract_per_document(spark, d):
    return found(spark, d).select("doc_id", "field", "value")


def _last(c: str) -> str:
    return f"TRY_CAST(replace(regexp_extract_all({c}, '{T.AMOUNT}', 1)[-1], ',', '') AS DOUBLE)"


_NUMROW = r"\d{4,}"


@register(
    "line_scan",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT doc_id, line_no, '{f}' AS field, {_last('line')} AS value FROM lines WHERE regexp_matches(line, '{p}')" for f, p in ROWS.items())
    + f""" UNION ALL SELECT doc_id, line_no, 'after_label', CASE WHEN regexp_matches(next_1, '{_NUMROW}') THEN {_last('next_1')}
    WHEN regexp_matches(next_2, '{_NUMROW}') THEN {_last('next_2')} END FROM lines WHERE regexp_matches(line, '{LABELS['after_label']}')) WHERE value IS NOT NULL""",
    ("lines",),
)
def line_scan(spark, d):
    lines = T.page_lines(I.table(spark, d, "documents"), ["doc_id"], "text")
    return T.scan_lines(lines, ROWS, LABELS, _NUMROW)


# Rows that stand in for a sentence that a page lacks, in order on one line.
RULES = (
    T.LineRule("card", r"\d{13,}"), T.LineRule("area", r"555-\d{4}"), T.LineRule("octet", LABELS["after_label"], 2, _NUMROW),
    T.LineRule("label", LABELS["after_label"], 2, _NUMROW),
)


def _rule_sql(k: int, r: T.LineRule) -> str:
    value = _last("line") if not r.ahead else (
        f"CASE WHEN regexp_matches(next_1, '{r.ahead_regex}') THEN {_last('next_1')} WHEN regexp_matches(next_2, '{r.ahead_regex}') THEN {_last('next_2')} END")
    return f"""SELECT source, l.doc_id, '{r.field}' AS field, {value} AS value, 1 AS kind, line_no, {k} AS rule FROM lines l JOIN documents d ON d.doc_id = l.doc_id
    WHERE regexp_matches(line, '{r.regex}')"""


@register(
    "read_documents",
    f"""SELECT source, field, value, doc_id AS page, CASE WHEN kind = 1 THEN line_no END AS line_no FROM (
    SELECT source, doc_id, field, value, 0 AS kind, -1 AS line_no, 0 AS rule FROM hits UNION ALL {" UNION ALL ".join(_rule_sql(k, r) for k, r in enumerate(RULES))}
    ) WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, field ORDER BY doc_id, kind, line_no, rule) = 1""",
    ("hits", "lines"),
)
def read_documents(spark, d):
    """Sentences, rows and look-ahead of a source's documents as one reading, first hit per field."""
    return T.read_documents(I.table(spark, d, "documents"), "source", "doc_id", "text", PATTERNS, RULES)


@register(
    "read_pages",
    f"""SELECT doc_id, field, value, CASE WHEN kind = 1 THEN line_no END AS line_no FROM (
    SELECT doc_id, field, value, 0 AS kind, -1 AS line_no, 0 AS rule FROM hits
    UNION ALL {" UNION ALL ".join("SELECT doc_id, field, value, kind, line_no, rule FROM (" + _rule_sql(k, r) + ")" for k, r in enumerate(RULES))}
    ) WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY kind, line_no, rule) = 1""",
    ("hits", "lines"),
)
def read_pages(spark, d):
    """The same with every document on its own."""
    docs = I.table(spark, d, "documents").withColumn("page", F.lit(0))
    return T.read_documents(docs, "doc_id", "page", "text", PATTERNS, RULES).select("doc_id", "field", "value", "line_no")


@register("plausibility_filter", "SELECT doc_id, field, value FROM plaus", ("plaus",))
def plausibility_filter(spark, d):
    return T.plausible(found(spark, d), BOUNDS).select("doc_id", "field", "value")


@register("assemble_rows", "SELECT CAST(period AS VARCHAR) AS period, field, value, url, page, manual FROM assembled", ("assembled",))
def assemble_rows(spark, d):
    return assembled(spark, d)


@register(
    "collate_provenance",
    """SELECT CAST(period AS VARCHAR) AS period, string_agg(url, ' | ' ORDER BY url) AS source_url, string_agg(t, ' | ' ORDER BY url) AS source_page FROM (
    SELECT period, url, string_agg('p.' || page || ' ' || f, '; ' ORDER BY page) AS t FROM (
      SELECT period, url, page, string_agg(field, ',' ORDER BY field) AS f FROM assembled GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""",
    ("assembled",),
)
def collate_provenance(spark, d):
    return T.collate_provenance(assembled(spark, d), "period")


@register(
    "consistency_checks",
    """SELECT entity, q, 'parts_do_not_add_up' AS violation FROM components WHERE abs(part_a + part_n - whole) > 2
    UNION ALL SELECT entity, q, 'domestic_not_below_global' FROM components WHERE part_r >= whole
    UNION ALL SELECT entity, q, 'whole_not_below_domestic' FROM components WHERE whole >= part_r""",
    ("components",),
)
def consistency_checks(spark, d):
    return T.consistency_checks(I.components(spark, d), ["entity", "q"], "part_a", "part_n", "whole", "part_r", "whole")


def _indian(n: str) -> str:
    s = f"CAST({n} AS VARCHAR)"
    pairs = f"reverse(rtrim(regexp_replace(reverse(left({s}, len({s}) - 3)), '(\\d\\d)', '\\1,', 'g'), ','))"
    return f"CASE WHEN len({s}) <= 3 THEN {s} ELSE {pairs} || ',' || right({s}, 3) END"


@register(
    "verify_against_text",
    f"""SELECT v.doc_id, v.field, v.value, contains(d.text, CAST(CAST(v.value AS BIGINT) AS VARCHAR)) OR contains(d.text, format('{{:,}}', CAST(v.value AS BIGINT)))
    OR contains(d.text, {_indian('CAST(v.value AS BIGINT)')}) OR contains(d.text, CAST(v.value AS BIGINT) || '.00') AS found FROM (
    SELECT doc_id, field, value FROM found UNION ALL SELECT doc_id, 'length', CAST(n_chars AS DOUBLE) FROM documents) v JOIN documents d ON v.doc_id = d.doc_id""",
    ("found",),
)
def verify_against_text(spark, d):
    docs = I.table(spark, d, "documents")
    lengths = docs.select("doc_id", F.lit("length").alias("field"), F.col("n_chars").cast("double").alias("value"))
    values = found(spark, d).select("doc_id", "field", "value").unionByName(lengths)
    return T.verify_against_text(values, docs.select("doc_id", "text"), ["doc_id"], "value", "text")


@register("format_indian_number", f"SELECT o_orderkey, {_indian('CAST(floor(o_totalprice * 37) AS BIGINT)')} AS label FROM orders")
def format_indian_number(spark, d):
    n = F.floor(F.col("o_totalprice") * 37)
    return I.table(spark, d, "orders").select("o_orderkey", X.indian_grouping(n).alias("label"))


@register("parse_indian_number", "SELECT o_orderkey, CAST(CAST(floor(o_totalprice * 37) AS BIGINT) AS DOUBLE) AS value FROM orders")
def parse_indian_number(spark, d):
    """Grouped text back to numbers."""
    n = F.floor(F.col("o_totalprice") * 37)
    return I.table(spark, d, "orders").select("o_orderkey", X.parse_grouped_number(X.indian_grouping(n)).alias("value"))


@register(
    "fmt_rupees",
    """SELECT o_orderkey, CASE WHEN x < 0 THEN '−' ELSE '' END || '₹' || printf('%.2f', abs(x) / 1e7) || ' Cr' AS label
    FROM (SELECT o_orderkey, o_totalprice * 1000.0 - 2e8 + 0.123 AS x FROM orders)""",
)
def fmt_rupees(spark, d):
    x = F.col("o_totalprice") * 1000.0 - 2e8 + 0.123
    return I.table(spark, d, "orders").select("o_orderkey", X.rupees_in_crore(x).alias("label"))
