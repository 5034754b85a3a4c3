"""Figures from page text: filing selection, field patterns, line scan, assembly and checks.

Patterns become column expressions over each page, so a page is read once for all fields, no pattern
table is joined, and the first hit of a document is a combinable ``min_by``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import flatten_spaces, parse_grouped_number, printed_forms

# Fixed value: an amount with Indian or western grouping, or bare with 4 to 7 digits.
AMOUNT = r"(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d{4,7}(?:\.\d+)?)"


@dataclass(frozen=True)
class Pattern:
    field: str
    regex: str
    group: int | None = None  # the last group that matched some text, so "from x to y" gives y


def select_filings(df: DataFrame, include: Mapping[str, str], exclude: Mapping[str, str]) -> DataFrame:
    """Rows matching any include pattern and no exclude pattern; patterns are per column."""
    wanted, unwanted = F.lit(False), F.lit(False)
    for c, p in include.items():
        wanted = wanted | F.coalesce(F.col(c).rlike(p), F.lit(False))
    for c, p in exclude.items():
        unwanted = unwanted | F.coalesce(F.col(c).rlike(p), F.lit(False))
    return df.filter(wanted & ~unwanted)


def group_of(text: Column, p: Pattern) -> Column:
    """Text of the pattern's group; no match and an empty group both give NULL."""
    groups = range(re.compile(p.regex).groups, 0, -1) if p.group is None else [p.group]
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p.regex, g), F.lit("")) for g in groups])


def extract_fields(pages: DataFrame, doc: str, page: str, text: str, patterns: Sequence[Pattern]) -> DataFrame:
    """Long table (doc, field, value, page): the hit on the earliest page, and there of the earliest pattern."""
    flat = flatten_spaces(F.col(text))
    fields = list(dict.fromkeys(p.field for p in patterns))
    hits = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                # The first pattern whose text is a number wins; one that does not parse blocks no other.
                F.coalesce(*[parse_grouped_number(group_of(F.col("__flat"), p)) for p in patterns if p.field == f]).alias("value"),
            )
            for f in fields
        ]
    )
    return first_per_document(
        pages.withColumn("__flat", flat).select(F.col(doc), F.col(page), F.explode(hits).alias("h")).select(
            doc, page, "h.field", "h.value"
        ),
        doc, page,
    )


def first_per_document(hits: DataFrame, doc: str, page: str) -> DataFrame:
    return (
        hits.filter(F.col("value").isNotNull())
        .groupBy(doc, "field")
        .agg(F.min_by("value", page).alias("value"), F.min(page).alias("page"))
    )


def page_lines(pages: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per line with the next two lines beside it, taken inside the page (no shuffle)."""
    lines = F.transform(F.split(F.replace(F.col(text), F.lit("’"), F.lit("'")), "\n"), lambda line: F.trim(line))
    split = pages.select(*keys, lines.alias("__l"))
    around = F.transform(
        "__l",
        lambda line, i: F.struct(
            line.alias("line"),
            F.get("__l", i + 1).alias("next_1"),
            F.get("__l", i + 2).alias("next_2"),
        ),
    )
    return split.select(*keys, F.posexplode(around).alias("line_no", "r")).select(*keys, "line_no", "r.*")


def last_amount(line: Column) -> Column:
    found = F.regexp_extract_all(line, F.lit(AMOUNT), F.lit(1))
    return parse_grouped_number(F.try_element_at(found, F.lit(-1)))


def scan_lines(lines: DataFrame, row_patterns: Mapping[str, str], label_patterns: Mapping[str, str] | None = None,
               number_row: str = rf"^{AMOUNT}") -> DataFrame:
    """Hits on rows: the last amount of a line that matches a row pattern, or of the first of the next two
    lines that is a number row when the line is a bare label."""
    options = []
    for f, p in row_patterns.items():
        options.append(F.struct(F.lit(f).alias("field"), F.when(F.col("line").rlike(p), last_amount(F.col("line"))).alias("value")))
    for f, p in (label_patterns or {}).items():
        ahead = F.when(F.col("next_1").rlike(number_row), last_amount(F.col("next_1"))).when(
            F.col("next_2").rlike(number_row), last_amount(F.col("next_2"))
        )
        options.append(F.struct(F.lit(f).alias("field"), F.when(F.col("line").rlike(p), ahead).alias("value")))
    keep = [c for c in lines.columns if c not in ("line", "next_1", "next_2")]
    return (
        lines.select(*keep, F.explode(F.array(*options)).alias("h"))
        .select(*keep, "h.field", "h.value")
        .filter(F.col("value").isNotNull())
    )


@dataclass(frozen=True)
class LineRule:
    """A line that matches ``regex`` gives its last amount; with ``ahead`` that of the first of so many next lines that matches ``ahead_regex``."""

    field: str
    regex: str
    ahead: int = 0
    ahead_regex: str = rf"^{AMOUNT}"


def read_documents(pages: DataFrame, doc: str, page: str, text: str, patterns: Sequence[Pattern], rules: Sequence[LineRule]) -> DataFrame:
    """One row per document and field: (doc, field, value, page, line_no), the first hit in reading order.

    Pages come in order; on a page sentences (patterns on the flattened text, the earlier pattern first) go before
    rows, and rows by line, on one line by rule. ``line_no`` is NULL for a sentence. A page is read once and looks
    ahead in its own lines; the choice is a combinable ``min_by`` on the whole order, so a document may hold any
    share of the pages. Null texts have no hits; fields without any give no row.
    """
    flat, lines = F.col("__flat"), F.col("__lines")
    fields = list(dict.fromkeys(p.field for p in patterns))

    def hit(field: str, value: Column, kind: int, line: Column, rule: int) -> Column:
        order = F.struct(F.lit(kind).alias("kind"), line.cast("int").alias("line"), F.lit(rule).alias("rule"))
        return F.struct(F.lit(field).alias("field"), value.alias("value"), order.alias("order"))

    def amount_of(rule: LineRule, line: Column, at: Column) -> Column:
        if not rule.ahead:
            return F.when(line.rlike(rule.regex), last_amount(line))
        below = F.lit(None).cast("double")
        for k in range(rule.ahead, 0, -1):
            # A line below that matches decides, even where its amount does not parse.
            below = F.when(F.get(lines, at + k).rlike(rule.ahead_regex), last_amount(F.get(lines, at + k))).otherwise(below)
        return F.when(line.rlike(rule.regex), below)

    sentences = [
        hit(f, F.coalesce(*[parse_grouped_number(group_of(flat, p)) for p in patterns if p.field == f]), 0, F.lit(-1), 0) for f in fields
    ]
    rows = F.flatten(F.transform(lines, lambda line, at: F.array(*[hit(r.field, amount_of(r, line, at), 1, at, k) for k, r in enumerate(rules)])))
    found = F.filter(F.concat(F.array(*sentences), rows) if rules else F.array(*sentences), lambda h: h["value"].isNotNull())
    plain = F.replace(F.col(text), F.lit("’"), F.lit("'"))
    ready = pages.select(F.col(doc), F.col(page), flatten_spaces(F.col(text)).alias("__flat"), F.transform(F.split(plain, "\n"), F.trim).alias("__lines"))
    hits = ready.select(doc, page, F.explode(found).alias("h")).select(doc, "h.field", F.struct(F.col(page).alias("page"), "h.order").alias("o"), "h.value")
    first = hits.groupBy(doc, "field").agg(F.min_by(F.struct("value", "o"), "o").alias("f"))
    line = F.col("f.o.order.line")
    return first.select(doc, "field", F.col("f.value").alias("value"), F.col("f.o.page").alias("page"), F.when(line >= 0, line).alias("line_no"))


def plausible(hits: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Keep values inside the bounds of their field. A field without bounds fails the job."""
    missing = F.raise_error(F.concat(F.lit("no bounds for field "), F.coalesce("field", F.lit("null")))).cast("boolean")
    ok = F.when(F.lit(False), F.lit(False))
    for f, (lo, hi) in bounds.items():
        ok = ok.when(F.col("field") == f, F.col("value").between(lo, hi))
    return hits.filter(ok.otherwise(missing))


def assemble_rows(hits: DataFrame, manual: DataFrame, period: str, flip: str, first_kind: str = "press") -> DataFrame:
    """One value per (period, field): ``first_kind`` sources lead from ``flip`` on and trail before it,
    then the earlier filing; a manual value always wins.

    ``hits`` has kind, filed, url, page, value. The choice is a combinable ``min_by`` on the precedence.
    """
    leads = F.col("kind") == first_kind
    late = F.when(F.col(period) >= F.lit(flip).cast("date"), ~leads).otherwise(leads)
    order = F.struct(late.cast("int").alias("a"), F.col("filed").alias("b"), F.col("url").alias("c"), F.col("page").alias("d"))
    found = hits.groupBy(period, "field").agg(
        F.min_by(F.struct("value", "url", "page"), order).alias("f")
    ).select(period, "field", F.col("f.value").alias("value"), F.col("f.url").alias("url"), F.col("f.page").alias("page"))
    m = manual.select(
        period, "field", F.col("value").alias("m_value"), F.col("url").alias("m_url"), F.col("page").alias("m_page")
    )
    use = F.col("m_value").isNotNull()
    return found.join(m, [period, "field"], "full").select(
        period, "field",
        F.when(use, F.col("m_value")).otherwise(F.col("value")).alias("value"),
        F.when(use, F.col("m_url")).otherwise(F.col("url")).alias("url"),
        F.when(use, F.col("m_page")).otherwise(F.col("page")).alias("page"),
        use.alias("manual"),
    )


def collate_provenance(rows: DataFrame, period: str) -> DataFrame:
    """``p.3 a,b; p.9 c | p.1 d`` per period. A period holds one row per field, so the lists are short."""
    by_page = rows.groupBy(period, "url", "page").agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("f"))
    by_url = by_page.groupBy(period, "url").agg(
        F.array_sort(F.collect_list(F.struct("page", F.concat(F.lit("p."), F.col("page").cast("string"), F.lit(" "), F.col("f")).alias("t")))).alias("l")
    ).select(period, "url", F.array_join(F.transform("l", lambda s: s["t"]), "; ").alias("t"))
    return by_url.groupBy(period).agg(F.array_sort(F.collect_list(F.struct("url", "t"))).alias("l")).select(
        period,
        F.array_join(F.transform("l", lambda s: s["url"]), " | ").alias("source_url"),
        F.array_join(F.transform("l", lambda s: s["t"]), " | ").alias("source_page"),
    )


def consistency_checks(wide: DataFrame, keys: Sequence[str], part_a: str, part_b: str, whole: str, domestic: str,
                       world: str, tol: float = 2.0) -> DataFrame:
    """Violations: parts not adding up, domestic not below global, whole not below domestic."""
    rules = {
        "parts_do_not_add_up": F.abs(F.col(part_a) + F.col(part_b) - F.col(whole)) > tol,
        "domestic_not_below_global": F.col(domestic) >= F.col(world),
        "whole_not_below_domestic": F.col(whole) >= F.col(domestic),
    }
    broken = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    return wide.select(*keys, F.explode(broken).alias("violation"))


def verify_against_text(values: DataFrame, pages: DataFrame, keys: Sequence[str], value: str, text: str) -> DataFrame:
    """Whether a value stands in its cited page in one of the printed forms."""
    joined = values.join(pages, list(keys), "left").withColumn("__forms", printed_forms(F.col(value)))
    found = F.exists("__forms", lambda f: F.contains(F.col(text), f))
    return joined.withColumn("found", F.coalesce(found, F.lit(False))).drop("__forms", text)

