"""Clean entity-by-quarter panels: identity checks, totals, merger cuts, segmentation.

Column contract: an entity id, a quarter-end date ``ds``, its index ``q`` and a level ``y``, one row
per (entity, quarter). Windows are partitioned by entity, so a task never holds more rows of one
entity than there are quarters in the calendar.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import quarter_index
from tidemark.functions.frames import side_by_side
from tidemark.functions.numeric import ratio, share, sum_or_zero, total_of
from tidemark.operators.asof import asof_backward

# Structure-change codes that move balances into a surviving entity.
ABSORBING_CODES = (211, 213, 216, 217, 221, 222, 223, 224, 810, 811)


def component_sum(df: DataFrame, parts: Sequence[str], out: str = "y") -> DataFrame:
    """Sum of components; a missing component makes the sum missing."""
    return df.withColumn(out, total_of(F.col(p) for p in parts))


def identity_holds(y: Column, whole: Column, rest: Column, tol: float) -> Column:
    return F.coalesce(F.abs(y - (whole - rest)) <= F.lit(float(tol)), F.lit(False))


def identity_hit_rate(df: DataFrame, y: str, whole: str, rest: str, tols: Iterable[float]) -> DataFrame:
    """Share of rows meeting the identity per tolerance, over all rows and over rows with a known sum."""
    tested = df.select(
        F.col(y).alias("y"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(float(t)).alias("tol"),
                        identity_holds(F.col(y), F.col(whole), F.col(rest), t).alias("ok"),
                    )
                    for t in tols
                ]
            )
        ).alias("t"),
    )
    return tested.groupBy(F.col("t.tol").alias("tol")).agg(
        share(F.col("t.ok")).alias("rate_all"),
        F.avg(F.when(F.col("y").isNotNull(), F.col("t.ok").cast("double"))).alias("rate_known"),
        F.count("*").alias("n_rows"),
    )


def positive_only(df: DataFrame, y: str = "y") -> DataFrame:
    return df.filter(F.col(y) > 0)


def positive_counts(df: DataFrame, y: str = "y") -> DataFrame:
    return df.agg(
        F.count_if(F.col(y) > 0).alias("kept"),
        (F.count("*") - F.count_if(F.col(y) > 0)).alias("dropped"),
    )


def period_totals(df: DataFrame, period: str, sums: Sequence[str], count: str = "n_entities") -> DataFrame:
    """Per-period sums over all reporters before any filtering; an all-null sum is zero."""
    return df.groupBy(period).agg(
        *[sum_or_zero(F.col(c)).alias(c) for c in sums], F.count("*").alias(count)
    )


def change_between(totals: DataFrame, period: str, y: str, start: str, end: str) -> DataFrame:
    """Level at two periods, change and percent change."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    levels = totals.filter(F.col(period).isin(start, end)).agg(
        F.max(F.when(F.col(period) == first, F.col(y))).alias("level_start"),
        F.max(F.when(F.col(period) == last, F.col(y))).alias("level_end"),
    )
    delta = F.col("level_end") - F.col("level_start")
    return levels.select(
        "*", delta.alias("change"), (ratio(delta, F.col("level_start")) * 100).alias("change_pct")
    )


def absorbing_events(
    history: DataFrame,
    code: str = "change_code",
    survivor: Sequence[str] = ("survivor_id", "acquirer_id"),
    absorbed: str = "out_id",
    effective: str = "effective_date",
    codes: Sequence[int] = ABSORBING_CODES,
) -> DataFrame:
    """Distinct (survivor, absorbed, q) of the events in which one entity takes over another."""
    return (
        history.filter(F.col(code).isin(*codes))
        .select(
            F.coalesce(*[F.col(c) for c in survivor]).alias("survivor"),
            F.col(absorbed).alias("absorbed"),
            quarter_index(F.col(effective)).alias("q"),
        )
        .filter(F.col("survivor") != F.col("absorbed"))
        .distinct()
    )


def absorbed_sizes(events: DataFrame, obs: DataFrame, entity: str) -> DataFrame:
    """Last level of the absorbed entity at or before the quarter preceding the event."""
    return asof_backward(
        events.withColumn("q_prev", F.col("q") - 1),
        obs, ("absorbed", entity), ("q_prev", "q"), {"y_absorbed": "y"},
    )


def absorbed_per_quarter(sized: DataFrame) -> DataFrame:
    return sized.groupBy("survivor", "q", "q_prev").agg(
        sum_or_zero(F.col("y_absorbed")).alias("y_absorbed"),
        F.bool_or(F.col("y_absorbed").isNull()).alias("unknown_absorbed"),
    )


def survivor_sizes(per_quarter: DataFrame, obs: DataFrame, entity: str) -> DataFrame:
    return asof_backward(
        per_quarter, obs, ("survivor", entity), ("q_prev", "q"), {"y_survivor": "y"}
    )


def merger_cuts(obs: DataFrame, history: DataFrame, entity: str, min_share: float = 0.10) -> DataFrame:
    """Quarters at which a survivor's series restarts: it took over at least ``min_share`` of its own
    size, or one of the sizes is unknown."""
    per_quarter = absorbed_per_quarter(absorbed_sizes(absorbing_events(history), obs, entity))
    sized = survivor_sizes(per_quarter, obs, entity)
    material = (
        F.col("unknown_absorbed")
        | F.col("y_survivor").isNull()
        | (F.col("y_absorbed") >= F.lit(float(min_share)) * F.col("y_survivor"))
    )
    return sized.filter(material).select(F.col("survivor").alias(entity), "q").distinct()


def attach_cuts(obs: DataFrame, cuts: DataFrame, entity: str) -> DataFrame:
    """Mark observations that fall on a cut.

    Cuts are stacked onto the observations and read by a window on the entity, the key everything after
    this is partitioned by: a join on (entity, q) would shuffle the observations once more.
    """
    stacked = obs.withColumn("__cut", F.lit(0)).unionByName(
        cuts.select(entity, "q", F.lit(1).alias("__cut")), allowMissingColumns=True
    )
    here = W.partitionBy(entity).orderBy("q").rangeBetween(0, 0)
    marked = stacked.withColumn("merger_cut", F.max("__cut").over(here) == 1)
    return marked.filter(F.col("__cut") == 0).drop("__cut")


def long_enough(df: DataFrame, entity: str, min_periods: int) -> DataFrame:
    """Keep entities with at least ``min_periods`` rows."""
    return (
        df.withColumn("__n", F.count("*").over(W.partitionBy(entity)))
        .filter(F.col("__n") >= min_periods)
        .drop("__n")
    )


def step_features(df: DataFrame, entity: str) -> DataFrame:
    """First-row flag, quarters since the previous row and absolute log change."""
    w = W.partitionBy(entity).orderBy("q")
    return (
        df.withColumn("dq", F.col("q") - F.lag("q").over(w))
        .withColumn("adlog", F.abs(F.ln("y") - F.ln(F.lag("y").over(w))))
        .withColumn("first", F.col("dq").isNull())
    )


def cut_flags(df: DataFrame, max_abs_dlog: float = 1.0) -> DataFrame:
    """Gap, break and merger cuts; the first row of an entity is never a cut."""
    later = ~F.col("first")
    return (
        df.withColumn("gap_cut", later & (F.col("dq") != 1))
        .withColumn("break_cut", later & (F.col("dq") == 1) & (F.col("adlog") > max_abs_dlog))
        .withColumn("merger_cut", later & F.col("merger_cut"))
        .fillna(False, ["gap_cut", "break_cut"])
    )


def segmentize(df: DataFrame, entity: str) -> DataFrame:
    """Segment number within the entity: one plus the cuts so far."""
    cut = F.col("gap_cut") | F.col("break_cut") | F.col("merger_cut")
    w = W.partitionBy(entity).orderBy("q").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("seg", F.sum((F.col("first") | cut).cast("int")).over(w).cast("int"))


def segment_lengths(df: DataFrame, entity: str) -> DataFrame:
    return df.groupBy(entity, "seg").agg(F.count("*").alias("n"), F.max("q").alias("q_max"))


def mark_best_segment(df: DataFrame, entity: str, min_periods: int) -> DataFrame:
    """``kept`` is true on the most recent segment with at least ``min_periods`` rows.

    Segment numbers grow with time, so the most recent one is the largest. Both windows are clustered
    by the entity the rows are already partitioned by.
    """
    n = F.count("*").over(W.partitionBy(entity, "seg"))
    best = F.max(F.when(F.col("__n") >= min_periods, F.col("seg"))).over(W.partitionBy(entity))
    return (
        df.withColumn("__n", n)
        .withColumn("kept", F.coalesce(best == F.col("seg"), F.lit(False)))
        .drop("__n")
    )


def segmented(
    raw: DataFrame,
    history: DataFrame,
    entity: str,
    min_periods: int = 40,
    max_abs_dlog: float = 1.0,
    min_share: float = 0.10,
) -> DataFrame:
    """Positive observations of long-enough entities with their cuts, segments and the ``kept`` flag."""
    obs = positive_only(raw)
    # Cuts look at every entity, also those dropped for being short: their sizes are needed.
    cuts = merger_cuts(obs, history, entity, min_share)
    flagged = cut_flags(
        step_features(long_enough(attach_cuts(obs, cuts, entity), entity, min_periods), entity), max_abs_dlog
    )
    return mark_best_segment(segmentize(flagged, entity), entity, min_periods)


def build_panel(raw: DataFrame, history: DataFrame, entity: str, **rules) -> DataFrame:
    """The clean panel ``(unique_id, ds, y)``. Entities that stop reporting stay in."""
    return (
        segmented(raw, history, entity, **rules)
        .filter("kept")
        .select(F.col(entity).cast("string").alias("unique_id"), "ds", "q", F.col("y").cast("double").alias("y"))
    )


def panel_summary(raw: DataFrame, history: DataFrame, entity: str, min_periods: int = 40, **rules) -> DataFrame:
    """One row: what came in, what was dropped and why, and the cuts (merger before break before gap)."""
    per_entity_raw = raw.groupBy(entity).agg(
        F.count("*").alias("n"), F.count_if(F.col("y") > 0).alias("n_pos")
    )
    incoming = per_entity_raw.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"),
        F.count("*").alias("entities_in"),
        F.coalesce(F.sum(F.col("n") - F.col("n_pos")), F.lit(0)).alias("rows_not_positive"),
        F.count_if(F.col("n_pos") == 0).alias("entities_never_positive"),
        F.count_if((F.col("n_pos") > 0) & (F.col("n_pos") < min_periods)).alias("entities_too_short"),
    )
    merger, brk, gap, kept = (F.col(c) for c in ("merger_cut", "break_cut", "gap_cut", "kept"))
    per_entity = segmented(raw, history, entity, min_periods=min_periods, **rules).groupBy(entity).agg(
        F.count("*").alias("n"),
        F.count_if(kept).alias("n_kept"),
        F.count_if(merger).alias("mergers"),
        F.count_if(brk).alias("breaks_any"),
        F.count_if(brk & ~merger).alias("breaks"),
        F.count_if(gap & ~merger).alias("gaps"),
        F.min(F.when(kept, F.col("ds"))).alias("first_ds"),
        F.max(F.when(kept, F.col("ds"))).alias("last_ds"),
    )

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).alias(c)

    outgoing = per_entity.agg(
        F.coalesce(F.sum("n_kept"), F.lit(0)).alias("panel_rows"),
        F.count_if(F.col("n_kept") > 0).alias("panel_entities"),
        F.count_if(F.col("n_kept") == 0).alias("entities_without_segment"),
        F.coalesce(F.sum(F.col("n") - F.col("n_kept")), F.lit(0)).alias("rows_outside_segment"),
        total("mergers"), total("breaks"), total("gaps"),
        F.count_if(F.col("mergers") > 0).alias("entities_with_merger"),
        F.count_if(F.col("breaks_any") > 0).alias("entities_with_break"),
        F.min("first_ds").alias("first_ds"),
        F.max("last_ds").alias("last_ds"),
    )
    return side_by_side(incoming, outgoing)


def calendar_range(df: DataFrame, q: str = "q") -> tuple[int, int] | None:
    """First and last period of a table: two numbers, or None where it is empty."""
    row = df.agg(F.min(q).alias("lo"), F.max(q).alias("hi")).first()
    return None if row.lo is None else (row.lo, row.hi)


def blank_spans(df: DataFrame, entity: str, figures: Sequence[str], q: str = "q", calendar: tuple[int, int] | None = None) -> DataFrame:
    """(entity, figure, from_q, to_q, periods): the longest spans of periods in which an entity has no value of a figure.

    A missing row and a NULL field are both blank. The calendar is that of the whole table unless given. One array of
    periods per entity and figure, bounded by the calendar; a span is what lies between two neighbours.
    """
    ends = calendar or calendar_range(df, q) or (0, -1)
    have = df.groupBy(entity).agg(*[F.array_sort(F.collect_set(F.when(F.col(f).isNotNull(), F.col(q)))).alias(f) for f in figures])
    pairs = F.array(*[F.struct(F.lit(f).alias("figure"), F.col(f).alias("have")) for f in figures])
    rows = have.select(entity, F.explode(pairs).alias("p")).select(entity, "p.figure", "p.have")
    low, high = F.lit(ends[0]).cast("int"), F.lit(ends[1]).cast("int")
    known = F.filter("have", lambda x: x.between(low, high))
    fence = F.concat(F.array(low - 1), known.cast("array<int>"), F.array(high + 1))
    rows = rows.select(entity, "figure", fence.alias("fence"))
    spans = F.transform(F.sequence(F.lit(1), F.size("fence") - 1), lambda i: F.struct(
        (F.element_at("fence", i) + 1).alias("from_q"), (F.element_at("fence", i + 1) - 1).alias("to_q")))
    blank = F.filter(spans, lambda s: s["from_q"] <= s["to_q"])
    return rows.select(entity, "figure", F.explode(blank).alias("s")).select(
        entity, "figure", "s.from_q", "s.to_q", (F.col("s.to_q") - F.col("s.from_q") + 1).alias("periods")
    )
