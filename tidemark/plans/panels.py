"""Queries over the panel build: identities, totals, as-of joins, merger cuts, segments, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import panel as P
from tidemark.plans import inputs as I
from tidemark.plans.catalog import register
from tidemark.plans.inputs import CTES
from tidemark.session import settle

MIN_PERIODS, MIN_SHARE, MAX_DLOG = 3, 0.6, 1.0

CTES |= {
    "summed": ("SELECT *, part_a + part_n AS y FROM components", ("components",)),
    "ev": (
        """SELECT DISTINCT coalesce(survivor_id, acquirer_id) AS survivor, out_id AS absorbed,
        CAST(year(effective_date)*4+quarter(effective_date)-1 AS INTEGER) AS q FROM history
        WHERE change_code IN (211,213,216,217,221,222,223,224,810,811)
        AND coalesce(survivor_id, acquirer_id) <> out_id""", ("history",)),
    "sized": (
        """SELECT e.survivor, e.absorbed, e.q, e.q - 1 AS q_prev, o.y AS y_absorbed FROM ev e
        ASOF LEFT JOIN gappy o ON e.absorbed = o.entity AND e.q - 1 >= o.q""", ("ev", "gappy")),
    "perq": (
        """SELECT survivor, q, q_prev, coalesce(sum(y_absorbed), 0) AS y_absorbed,
        bool_or(y_absorbed IS NULL) AS unknown_absorbed FROM sized GROUP BY 1, 2, 3""", ("sized",)),
    "cuts": (
        f"""SELECT DISTINCT p.survivor AS entity, p.q FROM perq p ASOF LEFT JOIN gappy o
        ON p.survivor = o.entity AND p.q_prev >= o.q
        WHERE p.unknown_absorbed OR o.y IS NULL OR p.y_absorbed >= {MIN_SHARE} * o.y""", ("perq", "gappy")),
    "longer": (
        f"SELECT * FROM gappy WHERE entity IN (SELECT entity FROM gappy GROUP BY 1 HAVING count(*) >= {MIN_PERIODS})",
        ("gappy",)),
    "steps": (
        """SELECT l.*, c.entity IS NOT NULL AS merger_raw, l.q - lag(l.q) OVER w AS dq,
        abs(ln(l.y) - ln(lag(l.y) OVER w)) AS adlog, lag(l.q) OVER w IS NULL AS first
        FROM longer l LEFT JOIN cuts c ON l.entity = c.entity AND l.q = c.q
        WINDOW w AS (PARTITION BY l.entity ORDER BY l.q)""", ("longer", "cuts")),
    "flagged": (
        f"""SELECT *, NOT first AND dq <> 1 AS gap_cut, NOT first AND dq = 1 AND adlog > {MAX_DLOG} AS break_cut,
        NOT first AND merger_raw AS merger_cut FROM steps""", ("steps",)),
    "segs": (
        """SELECT * EXCLUDE (gap_cut, break_cut), coalesce(gap_cut, false) AS gap_cut, coalesce(break_cut, false) AS break_cut,
        CAST(sum(CASE WHEN first OR gap_cut OR break_cut OR merger_cut THEN 1 ELSE 0 END)
        OVER (PARTITION BY entity ORDER BY q ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM flagged""", ("flagged",)),
    "seglen": ("SELECT entity, seg, count(*) AS n, max(q) AS q_max FROM segs GROUP BY 1, 2", ("segs",)),
    "bestseg": (
        f"""SELECT entity, seg FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY q_max DESC) AS r
        FROM seglen WHERE n >= {MIN_PERIODS}) WHERE r = 1""", ("seglen",)),
}

RULES = {"min_periods": MIN_PERIODS, "max_abs_dlog": MAX_DLOG, "min_share": MIN_SHARE}


def _summed(spark, d):
    return P.component_sum(I.components(spark, d), ["part_a", "part_n"])


@register("component_sum", "SELECT entity, CAST(ds AS VARCHAR) AS ds, round(y, 4) AS y FROM summed", ("summed",))
def component_sum(spark, d):
    return _summed(spark, d).select("entity", "ds", F.round("y", 4).alias("y"))


@register(
    "identity_holds",
    """SELECT entity, CAST(ds AS VARCHAR) AS ds,
    coalesce(abs(y - (whole - part_r)) <= 0.25, false) AS ok FROM summed""",
    ("summed",),
)
def identity_holds(spark, d):
    ok = P.identity_holds(F.col("y"), F.col("whole"), F.col("part_r"), 0.25)
    return _summed(spark, d).select("entity", "ds", ok.alias("ok"))


@register(
    "identity_hit_rate",
    """SELECT t.tol, round(avg(CASE WHEN abs(y - (whole - part_r)) <= t.tol THEN 1.0 ELSE 0 END), 8) AS rate_all,
    round(avg(CASE WHEN y IS NULL THEN NULL WHEN abs(y - (whole - part_r)) <= t.tol THEN 1.0 ELSE 0 END), 8) AS rate_known,
    count(*) AS n_rows FROM summed, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE), (1.0::DOUBLE)) t(tol) GROUP BY 1""",
    ("summed",),
)
def identity_hit_rate(spark, d):
    r = P.identity_hit_rate(_summed(spark, d), "y", "whole", "part_r", [0.0, 0.1, 0.25, 1.0])
    return r.select("tol", F.round("rate_all", 8).alias("rate_all"), F.round("rate_known", 8).alias("rate_known"), "n_rows")


@register(
    "positive_filter",
    """SELECT count(*) FILTER (WHERE y > 0) AS kept, count(*) - count(*) FILTER (WHERE y > 0) AS dropped FROM summed""",
    ("summed",),
)
def positive_filter(spark, d):
    return P.positive_counts(_summed(spark, d))


@register(
    "period_range_filter",
    """SELECT unique_id, CAST(ds AS VARCHAR) AS ds, y FROM dense
    WHERE ds BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""",
    ("dense",),
)
def period_range_filter(spark, d):
    return I.dense(spark, d, "1997-01-01", "1999-12-31").select("unique_id", "ds", "y")


@register("merger_event_filter", "SELECT survivor, absorbed, q FROM ev", ("ev",))
def merger_event_filter(spark, d):
    return P.absorbing_events(I.history(spark, d))


@register(
    "quarter_index",
    """SELECT o_orderkey, CAST(year(o_orderdate)*4+quarter(o_orderdate)-1 AS BIGINT) AS q FROM orders""",
)
def quarter_index(spark, d):
    return I.table(spark, d, "orders").select("o_orderkey", cal.quarter_index(F.col("o_orderdate")).alias("q"))


@register("month_index", "SELECT o_orderkey, CAST(year(o_orderdate)*12+month(o_orderdate) AS BIGINT) AS m FROM orders")
def month_index(spark, d):
    return I.table(spark, d, "orders").select("o_orderkey", cal.month_index(F.col("o_orderdate")).alias("m"))


@register(
    "quarter_label",
    "SELECT o_orderkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label FROM orders",
)
def quarter_label(spark, d):
    return I.table(spark, d, "orders").select("o_orderkey", cal.quarter_label(F.col("o_orderdate")).alias("label"))


@register(
    "fiscal_quarter",
    """SELECT o_orderkey, 'Q' || CASE quarter(o_orderdate) WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 4 END || 'FY' ||
    lpad(CAST((year(o_orderdate) + CASE WHEN month(o_orderdate) > 3 THEN 1 ELSE 0 END) % 100 AS VARCHAR), 2, '0') AS label
    FROM orders""",
)
def fiscal_quarter(spark, d):
    return I.table(spark, d, "orders").select("o_orderkey", cal.fiscal_quarter(F.col("o_orderdate")).alias("label"))


@register(
    "assign_reporting_quarter",
    """SELECT o_orderkey, CAST(max(CAST(q.d AS DATE)) AS VARCHAR) AS quarter_end FROM orders
    JOIN (SELECT unnest(generate_series(DATE '1994-04-01', DATE '2002-01-01', INTERVAL 3 MONTH)) - INTERVAL 1 DAY AS d) q
    ON q.d < CAST(o_orderdate AS DATE) AND q.d >= CAST(o_orderdate AS DATE) - INTERVAL 93 DAY GROUP BY 1""",
)
def assign_reporting_quarter(spark, d):
    return I.table(spark, d, "orders").select(
        "o_orderkey", cal.reporting_quarter_end(F.col("o_orderdate")).alias("quarter_end")
    )


@register(
    "horizon_quarters",
    """SELECT unique_id, CAST(ds AS VARCHAR) AS ds, CAST(q - (1998*4+3) AS BIGINT) AS h FROM dense""",
    ("dense",),
)
def horizon_quarters(spark, d):
    origin = F.lit("1998-12-31").cast("date")
    return I.dense(spark, d).select("unique_id", "ds", cal.horizon_quarters(F.col("ds"), origin).alias("h"))


@register(
    "log_level",
    "SELECT unique_id, q, round(ln(y), 8) AS log_y FROM dense", ("dense",),
)
def log_level(spark, d):
    return I.dense(spark, d).select("unique_id", "q", F.round(F.ln("y"), 8).alias("log_y"))


@register("exp_level", "SELECT unique_id, q, round(exp(ln(y)), 4) AS level FROM dense", ("dense",))
def exp_level(spark, d):
    return I.dense(spark, d).select("unique_id", "q", F.round(F.exp(F.ln("y")), 4).alias("level"))


# Totals -----------------------------------------------------------------------------------------

_TOTALS = """SELECT ds, coalesce(sum(y), 0) AS y, coalesce(sum(part_a), 0) AS part_a,
    coalesce(sum(part_n), 0) AS part_n, coalesce(sum(part_r), 0) AS part_r, coalesce(sum(whole), 0) AS whole,
    count(*) AS n_entities FROM summed GROUP BY 1"""
CTES["totals"] = (_TOTALS, ("summed",))


def _totals(spark, d):
    return P.period_totals(_summed(spark, d), "ds", ["y", "part_a", "part_n", "part_r", "whole"])


@register(
    "industry_totals",
    """SELECT CAST(ds AS VARCHAR) AS ds, round(y, 4) AS y, round(part_a, 4) AS part_a, round(part_n, 4) AS part_n,
    round(part_r, 4) AS part_r, round(whole, 4) AS whole, n_entities FROM totals""",
    ("totals",),
)
def industry_totals(spark, d):
    t = _totals(spark, d)
    return t.select("ds", *[F.round(c, 4).alias(c) for c in ("y", "part_a", "part_n", "part_r", "whole")], "n_entities")


@register(
    "industry_change",
    """SELECT round(a.y, 4) AS level_start, round(b.y, 4) AS level_end, round(b.y - a.y, 4) AS change,
    round((b.y - a.y) / a.y * 100, 6) AS change_pct FROM totals a, totals b
    WHERE a.ds = DATE '1996-12-31' AND b.ds = DATE '2000-12-31'""",
    ("totals",),
)
def industry_change(spark, d):
    c = P.change_between(_totals(spark, d), "ds", "y", "1996-12-31", "2000-12-31")
    return c.select(*[F.round(x, 4).alias(x) for x in ("level_start", "level_end", "change")],
                    F.round("change_pct", 6).alias("change_pct"))


@register("entity_counts", "SELECT entity, count(*) AS n FROM gappy GROUP BY 1", ("gappy",))
def entity_counts(spark, d):
    return I.gappy(spark, d).groupBy("entity").agg(F.count("*").alias("n"))


@register("distinct_entities", "SELECT count(DISTINCT entity) AS entities, count(*) AS n_rows FROM gappy", ("gappy",))
def distinct_entities(spark, d):
    per = I.gappy(spark, d).groupBy("entity").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("entities"), F.sum("n").alias("n_rows"))


# As-of joins and merger cuts ----------------------------------------------------------------------

def _sized(spark, d):
    return P.absorbed_sizes(P.absorbing_events(I.history(spark, d)), I.gappy(spark, d), "entity")


@register("asof_target_size", "SELECT survivor, absorbed, q, y_absorbed FROM sized", ("sized",))
def asof_target_size(spark, d):
    return _sized(spark, d).select("survivor", "absorbed", "q", "y_absorbed")


@register("merger_per_quarter", "SELECT survivor, q, round(y_absorbed, 2) AS y_absorbed, unknown_absorbed FROM perq", ("perq",))
def merger_per_quarter(spark, d):
    return P.absorbed_per_quarter(_sized(spark, d)).select(
        "survivor", "q", F.round("y_absorbed", 2).alias("y_absorbed"), "unknown_absorbed"
    )


@register(
    "asof_survivor_size",
    """SELECT p.survivor, p.q, o.y AS y_survivor FROM perq p ASOF LEFT JOIN gappy o
    ON p.survivor = o.entity AND p.q_prev >= o.q""",
    ("perq", "gappy"),
)
def asof_survivor_size(spark, d):
    per = P.absorbed_per_quarter(_sized(spark, d))
    return P.survivor_sizes(per, I.gappy(spark, d), "entity").select("survivor", "q", "y_survivor")


def _cuts(spark, d):
    return P.merger_cuts(I.gappy(spark, d), I.history(spark, d), "entity", MIN_SHARE)


@register("merger_cuts", "SELECT entity, q FROM cuts", ("cuts",))
def merger_cuts(spark, d):
    return _cuts(spark, d)


@register(
    "attach_cuts",
    """SELECT g.entity, g.q, c.entity IS NOT NULL AS merger_cut FROM gappy g LEFT JOIN cuts c
    ON g.entity = c.entity AND g.q = c.q""",
    ("gappy", "cuts"),
)
def attach_cuts(spark, d):
    return P.attach_cuts(I.gappy(spark, d), _cuts(spark, d), "entity").select("entity", "q", "merger_cut")


@register("drop_short_entities", "SELECT entity, q, y FROM longer", ("longer",))
def drop_short_entities(spark, d):
    return P.long_enough(I.gappy(spark, d), "entity", MIN_PERIODS).select("entity", "q", "y")


# Segmentation ---------------------------------------------------------------------------------------

@register("step_features", "SELECT entity, q, first, dq, round(adlog, 8) AS adlog FROM steps", ("steps",))
def step_features(spark, d):
    s = P.step_features(P.long_enough(I.gappy(spark, d), "entity", MIN_PERIODS), "entity")
    return s.select("entity", "q", "first", "dq", F.round("adlog", 8).alias("adlog"))


def _segmented(spark, d):
    return P.segmented(I.gappy(spark, d), I.history(spark, d), "entity", **RULES)


@register("cut_flags", "SELECT entity, q, gap_cut, break_cut, merger_cut FROM segs", ("segs",))
def cut_flags(spark, d):
    return _segmented(spark, d).select("entity", "q", "gap_cut", "break_cut", "merger_cut")


@register("segmentize", "SELECT entity, q, seg FROM segs", ("segs",))
def segmentize(spark, d):
    return _segmented(spark, d).select("entity", "q", "seg")


@register("segment_lengths", "SELECT entity, seg, n, q_max FROM seglen", ("seglen",))
def segment_lengths(spark, d):
    return P.segment_lengths(_segmented(spark, d), "entity")


@register("latest_long_segment", "SELECT entity, seg FROM bestseg", ("bestseg",))
def latest_long_segment(spark, d):
    return _segmented(spark, d).filter("kept").groupBy("entity").agg(F.max("seg").alias("seg"))


@register(
    "keep_best_segment",
    "SELECT s.entity, s.q, s.seg FROM segs s JOIN bestseg b ON s.entity = b.entity AND s.seg = b.seg",
    ("segs", "bestseg"),
)
def keep_best_segment(spark, d):
    return _segmented(spark, d).filter("kept").select("entity", "q", "seg")


@register(
    "build_panel",
    """SELECT CAST(s.entity AS VARCHAR) AS unique_id, CAST(s.ds AS VARCHAR) AS ds, s.y FROM segs s
    JOIN bestseg b ON s.entity = b.entity AND s.seg = b.seg""",
    ("segs", "bestseg"),
)
def build_panel(spark, d):
    return P.build_panel(I.gappy(spark, d), I.history(spark, d), "entity", **RULES).select("unique_id", "ds", "y")


@register(
    "panel_summary",
    f"""SELECT (SELECT count(*) FROM gappy) AS rows_in, (SELECT count(DISTINCT entity) FROM gappy) AS entities_in,
    (SELECT count(*) FROM gappy WHERE NOT coalesce(y > 0, false)) AS rows_not_positive,
    (SELECT count(*) FROM (SELECT entity FROM gappy GROUP BY 1 HAVING count(*) FILTER (WHERE y > 0) = 0)) AS entities_never_positive,
    (SELECT count(*) FROM (SELECT entity FROM gappy WHERE y > 0 GROUP BY 1 HAVING count(*) < {MIN_PERIODS})) AS entities_too_short,
    (SELECT count(*) FROM kept) AS panel_rows, (SELECT count(DISTINCT entity) FROM kept) AS panel_entities,
    (SELECT count(DISTINCT entity) FROM segs) - (SELECT count(*) FROM bestseg) AS entities_without_segment,
    (SELECT count(*) FROM segs) - (SELECT count(*) FROM kept) AS rows_outside_segment,
    (SELECT count(*) FROM segs WHERE merger_cut) AS mergers,
    (SELECT count(*) FROM segs WHERE break_cut AND NOT merger_cut) AS breaks,
    (SELECT count(*) FROM segs WHERE gap_cut AND NOT merger_cut) AS gaps,
    (SELECT count(DISTINCT entity) FROM segs WHERE merger_cut) AS entities_with_merger,
    (SELECT count(DISTINCT entity) FROM segs WHERE break_cut) AS entities_with_break,
    (SELECT CAST(min(ds) AS VARCHAR) FROM kept) AS first_ds, (SELECT CAST(max(ds) AS VARCHAR) FROM kept) AS last_ds""",
    ("gappy", "segs", "bestseg", "kept"),
)
def panel_summary(spark, d):
    return P.panel_summary(I.gappy(spark, d), I.history(spark, d), "entity", **RULES)


CTES["kept"] = ("SELECT s.* FROM segs s JOIN bestseg b ON s.entity = b.entity AND s.seg = b.seg", ("segs", "bestseg"))


# Calendar coverage and set operations --------------------------------------------------------------

CTES["spine"] = (
    """SELECT q, CAST(last_day(make_date(CAST(floor(q/4) AS BIGINT), CAST((q%4)*3+3 AS BIGINT), 1)) AS DATE) AS ds
    FROM (SELECT unnest(range(lo, hi + 1)) AS q FROM (SELECT min(q) AS lo, max(q) AS hi FROM gappy))""", ("gappy",))


@register(
    "missing_periods",
    """SELECT e.entity, CAST(s.ds AS VARCHAR) AS ds FROM (SELECT DISTINCT entity FROM gappy) e, spine s
    WHERE NOT EXISTS (SELECT 1 FROM gappy g WHERE g.entity = e.entity AND g.ds = s.ds)""",
    ("gappy", "spine"),
)
def missing_periods(spark, d):
    """Quarters between the first and the last of the table in which an entity has no row: one array difference per entity."""
    rows = settle(I.gappy(spark, d).select("entity", "q"))
    lo, hi = P.calendar_range(rows) or (0, -1)
    have = rows.groupBy("entity").agg(F.collect_set("q").alias("have"))
    missing = F.array_except(F.array(*[F.lit(q).cast("int") for q in range(lo, hi + 1)]).cast("array<int>"), F.col("have").cast("array<int>"))
    return have.select("entity", F.explode(missing).alias("q")).select("entity", cal.quarter_end_of_index(F.col("q")).alias("ds"))


_FIGURES = ("part_a", "part_n", "part_r", "whole")


@register(
    "blank_spans",
    "SELECT entity, figure, min(q) AS from_q, max(q) AS to_q, count(*) AS periods FROM (SELECT *, q - row_number() OVER (PARTITION BY entity, figure ORDER BY q) AS island FROM ("
    + " UNION ALL ".join(
        f"""SELECT e.entity, '{f}' AS figure, s.q FROM (SELECT DISTINCT entity FROM components) e,
        (SELECT unnest(range(lo, hi + 1)) AS q FROM (SELECT min(q) AS lo, max(q) AS hi FROM components)) s
        LEFT JOIN components c ON c.entity = e.entity AND c.q = s.q WHERE c.{f} IS NULL""" for f in _FIGURES)
    + ")) GROUP BY entity, figure, island",
    ("components",),
)
def blank_spans(spark, d):
    """Spans without a value per entity and figure; the calendar is the table's own."""
    return P.blank_spans(settle(I.components(spark, d)), "entity", _FIGURES)


@register(
    "difference_periods",
    """SELECT CAST(CAST(last_day(CAST(m AS DATE) + INTERVAL 2 MONTH) AS DATE) AS VARCHAR) AS ds FROM
    (SELECT unnest(generate_series(DATE '1994-01-01', DATE '2002-10-01', INTERVAL 3 MONTH)) AS m)
    EXCEPT SELECT CAST(ds AS VARCHAR) FROM gappy""",
    ("gappy",),
)
def difference_periods(spark, d):
    """Expected quarter ends without any row."""
    seen = I.gappy(spark, d).select("ds").distinct()
    return cal.quarter_spine(spark, "1994-01-01", "2002-12-31").exceptAll(seen)


@register(
    "intersect_index",
    """SELECT CAST(entity AS BIGINT) AS entity, q FROM gappy INTERSECT SELECT entity, q FROM components""",
    ("gappy", "components"),
)
def intersect_index(spark, d):
    return I.gappy(spark, d).select("entity", "q").intersect(I.components(spark, d).select("entity", "q"))


@register(
    "distinct_events",
    "SELECT DISTINCT survivor_id, acquirer_id, change_code FROM history", ("history",),
)
def distinct_events(spark, d):
    return I.history(spark, d).select("survivor_id", "acquirer_id", "change_code").distinct()


@register(
    "union_files",
    """SELECT 'dense' AS origin, unique_id, q, y FROM dense
    UNION ALL SELECT 'gappy', CAST(entity AS VARCHAR), q, y FROM gappy""",
    ("dense", "gappy"),
)
def union_files(spark, d):
    g = I.gappy(spark, d).select(F.lit("gappy").alias("origin"), F.col("entity").cast("string").alias("unique_id"), "q", "y")
    return I.dense(spark, d).select(F.lit("dense").alias("origin"), "unique_id", "q", "y").unionByName(g)


@register(
    "set_equal_keys",
    """SELECT (SELECT count(*) FROM (SELECT entity, q FROM gappy EXCEPT SELECT entity, q FROM longer)) AS only_left,
    (SELECT count(*) FROM (SELECT entity, q FROM longer EXCEPT SELECT entity, q FROM gappy)) AS only_right,
    (SELECT count(*) FROM (SELECT entity, q FROM gappy EXCEPT SELECT entity, q FROM longer)) = 0
    AND (SELECT count(*) FROM (SELECT entity, q FROM longer EXCEPT SELECT entity, q FROM gappy)) = 0 AS same""",
    ("gappy", "longer"),
)
def set_equal_keys(spark, d):
    from tidemark.operators.runs import key_set_difference

    g = I.gappy(spark, d)
    return key_set_difference(g, P.long_enough(g, "entity", MIN_PERIODS), ["entity", "q"])
