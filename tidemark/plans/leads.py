"""Queries over lead scoring: features, labels, splits, rank metrics and models.

The period is the day and the products are event types; every (user, day) row is scored.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import guards as G
from tidemark.operators import leads as L
from tidemark.operators import resample as Q
from tidemark.plans import inputs as I
from tidemark.plans.catalog import register
from tidemark.plans.inputs import CTES, EVENT_FLAGS, TARGETS
from tidemark.session import settle

ID = ["user_id", "day"]
FIRST = 19728  # the first days only serve as lags
# Adjacent windows over all labelled days: the last two are for stopping and for the test.
TRAIN, VALID, TEST = (19728, 19749), 19750, 19751
LAGS = {c: [1, *(range(2, 6) if c in TARGETS else ())] for c in EVENT_FLAGS}
LAG_COLS = [f"{c}_l{k}" for c, ks in LAGS.items() for k in ks]

_LAG_JOINS = " ".join(f"LEFT JOIN filled p{k} ON p{k}.user_id = f.user_id AND p{k}.day = f.day - {k}" for k in range(1, 6))
_LAG_SELECT = ", ".join(f"p{k}.{c} AS {c}_l{k}" for c, ks in LAGS.items() for k in ks)
_ADD = " OR ".join(f"(n.{c} = 1 AND f.{c} = 0)" for c in TARGETS)
_NOW = " + ".join(EVENT_FLAGS)
_PREV = " + ".join(f"coalesce({c}_l1, 0)" for c in EVENT_FLAGS)
_GAIN = " + ".join(f"CASE WHEN {c} = 1 AND coalesce({c}_l1, 0) = 0 THEN 1 ELSE 0 END" for c in EVENT_FLAGS)
_REOPEN = " OR ".join(f"(coalesce({c}_l{k}, 0) = 1 AND {c} = 0)" for c in TARGETS for k in range(1, 6))

CTES |= {
    "lagged": (f"SELECT f.*, {_LAG_SELECT} FROM filled f {_LAG_JOINS}", ("filled",)),
    "adds": (
        f"""SELECT f.user_id, f.day, CASE WHEN {_ADD} THEN 1 ELSE 0 END AS added FROM filled f
        JOIN filled n ON n.user_id = f.user_id AND n.day = f.day + 1""", ("filled",)),
    "feats": (
        f"""SELECT l.*, {_NOW} AS n_products, {_NOW} - ({_PREV}) AS n_products_change, {_GAIN} AS n_added_last,
        CASE WHEN {EVENT_FLAGS[0]}_l1 IS NULL THEN 1 ELSE 0 END AS new_customer, a.added, {_REOPEN} AS reopened
        FROM lagged l JOIN adds a ON a.user_id = l.user_id AND a.day = l.day WHERE l.day >= {FIRST}""", ("lagged", "adds")),
    # Scores: active customers first, then by products held; ties by (customer, day).
    "scored": (
        """SELECT f.*, c.segment, f.click * 100 + f.n_products AS score, f.user_id * 100000 + f.day AS row_id FROM feats f
        LEFT JOIN demo c ON c.user_id = f.user_id""", ("feats", "demo")),
    "ranked": (
        """SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS rank, count(*) OVER () AS total,
        sum(added) OVER () AS pos_total, avg(added) OVER () AS base FROM scored""", ("scored",)),
    "fresh": (
        """SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS rank, count(*) OVER () AS total,
        sum(added) OVER () AS pos_total, avg(added) OVER () AS base FROM scored WHERE NOT reopened""", ("scored",)),
    "gains": (
        """SELECT decile, count(*) AS customers, CAST(sum(added) AS BIGINT) AS adds, avg(added) AS hit_rate, avg(added) / max(base) AS lift,
        max(pos_total) AS pos_total, max(total) AS total FROM (SELECT *, ntile(10) OVER (ORDER BY score DESC, row_id) AS decile FROM ranked) GROUP BY 1""", ("ranked",)),
}


def features(spark, d):
    return L.build_features(I.customer_days(spark, d), "user_id", "day", EVENT_FLAGS, TARGETS, FIRST)


def full_features(spark, d):
    """Features with what is known of the customer and the month of the label."""
    return L.with_profile(features(spark, d), I.demographics(spark, d), "user_id", ["acctbal"]).withColumn(
        "label_month", F.month("ds") % 12 + 1)


def scored(spark, d):
    f = features(spark, d).withColumn("reopened", L.reopened(TARGETS))
    return f.join(I.demographics(spark, d), "user_id", "left").select(
        "*", (F.col("click") * 100 + F.col("n_products")).alias("score"),
        (F.col("user_id") * 100000 + F.col("day")).alias("row_id"),
    )


def ranked(spark, d, only_new: bool = False):
    s = scored(spark, d)
    return L.rank_scores(s.filter(~F.col("reopened")) if only_new else s, "score", "added", "row_id")


@register("flag_fill", f"SELECT user_id, day, {', '.join(EVENT_FLAGS)} FROM filled", ("filled",))
def flag_fill(spark, d):
    return L.flag_fill(I.customer_days(spark, d), EVENT_FLAGS).select(*ID, *EVENT_FLAGS)


@register(
    "demographic_features",
    """SELECT f.user_id, f.day, d.segment, d.acctbal, d.nation, CASE WHEN d.acctbal IS NULL THEN 1 ELSE 0 END AS acctbal_missing,
    month(f.ds) % 12 + 1 AS label_month FROM filled f LEFT JOIN demo d ON d.user_id = f.user_id""",
    ("filled", "demo"),
)
def demographic_features(spark, d):
    return I.customer_days(spark, d).join(I.demographics(spark, d), "user_id", "left").select(
        *ID, "segment", "acctbal", "nation", F.col("acctbal").isNull().cast("int").alias("acctbal_missing"),
        (F.month("ds") % 12 + 1).alias("label_month"),
    )


@register("calendar_lags", f"SELECT user_id, day, {', '.join(LAG_COLS)} FROM lagged", ("lagged",))
def calendar_lags(spark, d):
    filled = L.flag_fill(I.customer_days(spark, d), EVENT_FLAGS)
    return L.calendar_lags(filled, "user_id", "day", LAGS).select(*ID, *LAG_COLS)


@register("next_period_adds", "SELECT user_id, day, added FROM adds", ("adds",))
def next_period_adds(spark, d):
    filled = L.flag_fill(I.customer_days(spark, d), EVENT_FLAGS)
    return L.next_period_adds(filled, "user_id", "day", TARGETS).select(*ID, "added")


_COUNTS = ("n_products", "n_products_change", "n_added_last", "new_customer")


@register("horizontal_counts", f"SELECT user_id, day, {', '.join(_COUNTS)} FROM feats", ("feats",))
def horizontal_counts(spark, d):
    return features(spark, d).select(*ID, *_COUNTS)


PROFILE = ("segment", "acctbal", "nation", "acctbal_missing", "label_month")


@register(
    "build_features",
    f"""SELECT f.user_id, f.day, {', '.join(f'f.{c}' for c in (*EVENT_FLAGS, *LAG_COLS, *_COUNTS))}, d.segment, d.acctbal, d.nation,
    CASE WHEN d.acctbal IS NULL THEN 1 ELSE 0 END AS acctbal_missing, month(f.ds) % 12 + 1 AS label_month, f.added
    FROM feats f LEFT JOIN demo d ON d.user_id = f.user_id""",
    ("feats", "demo"),
)
def build_features(spark, d):
    return full_features(spark, d).select(*ID, *EVENT_FLAGS, *LAG_COLS, *_COUNTS, *PROFILE, "added")


@register(
    "attach_target",
    "SELECT l.user_id, l.day, l.purchase_l1, a.added FROM lagged l JOIN adds a ON a.user_id = l.user_id AND a.day = l.day",
    ("lagged", "adds"),
)
def attach_target(spark, d):
    """Labels that come as their own table are joined on (customer, period)."""
    filled = L.flag_fill(I.customer_days(spark, d), EVENT_FLAGS)
    lags = L.calendar_lags(filled, "user_id", "day", LAGS).select(*ID, "purchase_l1")
    return lags.join(L.next_period_adds(filled, "user_id", "day", TARGETS).select(*ID, "added"), ID)


@register("reopen_mask", "SELECT user_id, day, reopened FROM feats", ("feats",))
def reopen_mask(spark, d):
    return features(spark, d).select(*ID, L.reopened(TARGETS).alias("reopened"))


@register("rule_score", "SELECT user_id, day, score FROM scored", ("scored",))
def rule_score(spark, d):
    jittered = features(spark, d).withColumn("s", L.rule_score(F.col("click"), F.col("n_products"), F.col("user_id")))
    # Without its tie breaker the score is a whole number.
    return jittered.select(*ID, F.floor("s").alias("score"))


@register(
    "month_split",
    f"""SELECT user_id, day, CASE WHEN day BETWEEN {TRAIN[0]} AND {TRAIN[1]} THEN 'train' WHEN day = {VALID} THEN 'valid' ELSE 'test' END AS role
    FROM feats WHERE day BETWEEN {TRAIN[0]} AND {TRAIN[1]} OR day IN ({VALID}, {TEST})""",
    ("feats",),
)
def month_split(spark, d):
    split = L.period_split(features(spark, d), "day", TRAIN, VALID, TEST)
    G.assert_ordered_roles(split, "day", "role", ["train", "valid", "test"])
    return split.select(*ID, "role")


@register(
    "base_rate",
    """SELECT count(*) AS customers, CAST(sum(added) AS BIGINT) AS adds, round(avg(added), 8) AS base_rate, count(*) FILTER (WHERE NOT reopened) AS new_customers,
    CAST(sum(CASE WHEN reopened THEN 0 ELSE added END) AS BIGINT) AS new_adds, round(avg(CASE WHEN NOT reopened THEN added END), 8) AS new_base_rate,
    round(sum(CASE WHEN reopened THEN added ELSE 0 END) / sum(added), 8) AS share_excluded FROM scored""",
    ("scored",),
)
def base_rate(spark, d):
    b = L.base_rates(features(spark, d), "added", L.reopened(TARGETS))
    return b.withColumns({c: F.round(c, 8) for c in ("base_rate", "new_base_rate", "share_excluded")})


@register(
    "topk_by_score",
    "SELECT row_id, score, rank FROM ranked WHERE rank <= greatest(1, CAST(round_even(0.1 * total, 0) AS BIGINT))", ("ranked",),
)
def topk_by_score(spark, d):
    return L.top_k(ranked(spark, d), 0.1).select("row_id", "score", "rank")


_LIFTS = ", ".join(
    f"round(avg(CASE WHEN rank <= greatest(1, CAST(round_even({k} * total, 0) AS BIGINT)) THEN added END) / avg(added), 8) AS lift_{round(k * 100)}pct"
    for k in (0.1, 0.05, 0.01))


def _round_all(df, digits=8):
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields if f.dataType.typeName() == "double"})


@register("lift_at_k", f"SELECT count(*) AS customers, round(avg(added), 8) AS base_rate, {_LIFTS} FROM ranked", ("ranked",))
def lift_at_k(spark, d):
    return _round_all(L.lift_at(ranked(spark, d), "added", (0.1, 0.05, 0.01)))


@register(
    "lift_by_segment",
    """SELECT segment, count(*) AS customers, round(avg(added), 8) AS base_rate,
    round(avg(CASE WHEN r <= greatest(1, CAST(round_even(0.1 * n, 0) AS BIGINT)) THEN added END) / avg(added), 8) AS lift_10pct FROM (
    SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, row_id) AS r, count(*) OVER (PARTITION BY segment) AS n FROM scored)
    GROUP BY 1""",
    ("scored",),
)
def lift_by_segment(spark, d):
    r = L.rank_scores(scored(spark, d), "score", "added", "row_id", ["segment"])
    return _round_all(L.lift_at(r, "added", (0.1,), ["segment"]))


@register(
    "gains_table",
    """SELECT decile, customers, adds, round(hit_rate, 8) AS hit_rate, round(lift, 8) AS lift,
    round(sum(adds) OVER (ORDER BY decile) / pos_total, 8) AS cumulative_share FROM gains""",
    ("gains",),
)
def gains_table(spark, d):
    g = L.gains_table(ranked(spark, d), "added")
    return _round_all(g.select("decile", "customers", "adds", "hit_rate", "lift", "cumulative_share"))


@register("cumulative_gains", "SELECT decile, round(sum(adds) OVER (ORDER BY decile) / pos_total, 8) AS cumulative_share FROM gains", ("gains",))
def cumulative_gains(spark, d):
    return _round_all(L.gains_table(ranked(spark, d), "added").select("decile", "cumulative_share"))


@register(
    "capacity_frontier",
    """SELECT decile, contacted, adds, round(adds / pos_total, 8) AS share, round(adds / contacted, 8) AS hit_rate,
    round((adds / contacted) / (pos_total / total), 8) AS lift FROM (SELECT decile, CAST(sum(customers) OVER (ORDER BY decile) AS BIGINT) AS contacted,
    CAST(sum(adds) OVER (ORDER BY decile) AS BIGINT) AS adds, pos_total, total FROM gains)""",
    ("gains",),
)
def capacity_frontier(spark, d):
    return _round_all(L.capacity_frontier(L.gains_table(ranked(spark, d), "added")))


_AUC = """(SELECT sum(CASE WHEN p.score > n.score THEN w ELSE CASE WHEN p.score = n.score THEN w / 2.0 ELSE 0 END END) / sum(w) FROM
    (SELECT a.score AS s1, b.score AS s2, a.c * b.c AS w FROM (SELECT score, count(*) AS c FROM {t} WHERE added = 1 GROUP BY 1) a,
    (SELECT score, count(*) AS c FROM {t} WHERE added = 0 GROUP BY 1) b) x, LATERAL (SELECT s1 AS score) p, LATERAL (SELECT s2 AS score) n)"""
_AP = """(SELECT sum(pp / pt * cp / cn) FROM (SELECT score, sum(added) AS pp, max(pos_total) AS pt, sum(sum(added)) OVER (ORDER BY score DESC) AS cp,
    sum(count(*)) OVER (ORDER BY score DESC) AS cn FROM {t} GROUP BY 1))"""


@register("roc_auc", f"SELECT round({_AUC.format(t='ranked')}, 8) AS roc_auc", ("ranked",))
def roc_auc(spark, d):
    return _round_all(L.roc_auc(L.thresholds(scored(spark, d), "score", "added")))


@register("average_precision", f"SELECT round({_AP.format(t='ranked')}, 8) AS average_precision", ("ranked",))
def average_precision(spark, d):
    return _round_all(L.average_precision(L.thresholds(scored(spark, d), "score", "added")))


@register(
    "brier",
    f"""SELECT round(avg(pow(coalesce(r.p, (SELECT avg(added) FROM scored WHERE day BETWEEN {TRAIN[0]} AND {TRAIN[1]})) - t.added, 2)), 8) AS brier
    FROM (SELECT * FROM scored WHERE day = {TEST}) t
    LEFT JOIN (SELECT score, avg(added) AS p FROM scored WHERE day BETWEEN {TRAIN[0]} AND {TRAIN[1]} GROUP BY 1) r ON r.score = t.score""",
    ("scored",),
)
def brier(spark, d):
    """Probabilities of the rule: the rate of adds at each score in the training days, judged on the test day."""
    s = scored(spark, d)
    test = L.score_rates(s.filter(F.col("day").between(*TRAIN)), s.filter(F.col("day") == TEST), "score", "added")
    return _round_all(L.brier(test, "p", "added"))


def _metrics_sql(t: str) -> str:
    return f"""SELECT count(*) AS customers, round(avg(added), 8) AS base_rate, {_LIFTS}, round({_AUC.format(t=t)}, 8) AS roc_auc,
    round({_AP.format(t=t)}, 8) AS average_precision FROM {t}"""


@register("score_metrics", _metrics_sql("ranked"), ("ranked",))
def score_metrics(spark, d):
    return _round_all(L.score_metrics(ranked(spark, d), "score", "added"))


@register("new_adds_view", _metrics_sql("fresh"), ("fresh",))
def new_adds_view(spark, d):
    """The same metrics without customers that only re-open."""
    return _round_all(L.score_metrics(ranked(spark, d, only_new=True), "score", "added"))


@register("poisson_bootstrap_lift")
def poisson_bootstrap_lift(spark, d):
    return _round_all(Q.poisson_lift_interval(scored(spark, d), "score", "added", "row_id"), 6)


# Models -----------------------------------------------------------------------------------------------

MODEL_FEATURES = [*EVENT_FLAGS, *LAG_COLS, *_COUNTS, "acctbal", "acctbal_missing", "nation", "segment_code", "label_month"]


def _split(spark, d):
    """Features with roles and training weights, written once: fitting reads them many times."""
    split = L.period_split(L.with_codes(full_features(spark, d), {"segment": "segment_code"}), "day", TRAIN, VALID, TEST)
    sampled = L.negative_sample(split.filter(F.col("role") == "train"), "added", ID)
    rest = split.filter(F.col("role") != "train").withColumn("weight", F.lit(1.0))
    return settle(sampled.unionByName(rest))


@register(
    "negative_downsample",
    f"""SELECT user_id, day, added, CASE WHEN added = 1 THEN 1.0 ELSE 10.0 END::DOUBLE AS weight FROM feats
    WHERE day BETWEEN {TRAIN[0]} AND {TRAIN[1]}
      AND (added = 1 OR CAST('0x' || substr(md5(concat_ws(':', user_id, day, 42)), 1, 8) AS BIGINT) / 4294967296 < 0.1)""",
    ("feats",),
)
def negative_downsample(spark, d):
    train = features(spark, d).filter(F.col("day").between(*TRAIN))
    return L.negative_sample(train, "added", ID).select(*ID, "added", "weight")


@register("logistic_baseline")
def logistic_baseline(spark, d):
    data = _split(spark, d)
    s = L.logistic_scores(data.filter("role = 'train'"), data.filter("role = 'test'"), MODEL_FEATURES, "added")
    return s.select(*ID, "added", F.round("score", 6).alias("score"))


def _boosted(spark, d):
    data = _split(spark, d)
    fit = data.filter("role <> 'test'").withColumn("is_valid", F.col("role") == "valid")
    return data, L.boosted_model(fit, MODEL_FEATURES, "added", "is_valid")


@register("gbt_lead_model")
def gbt_lead_model(spark, d):
    data, model = _boosted(spark, d)
    s = L.boosted_scores(model, data.filter("role = 'test'"), MODEL_FEATURES)
    return s.select(*ID, "added", F.round("score", 6).alias("score"))


@register("importance_ranking")
def importance_ranking(spark, d):
    _, model = _boosted(spark, d)
    return L.importance_ranking(model, MODEL_FEATURES, spark).withColumn("gain", F.round("gain", 6))


@register("model_score_metrics")
def model_score_metrics(spark, d):
    """Boosted scores of the test period through the same metrics as the rule."""
    data, model = _boosted(spark, d)
    s = L.boosted_scores(model, data.filter("role = 'test'"), MODEL_FEATURES)
    r = L.rank_scores(s, "score", "added", "user_id")
    return _round_all(L.score_metrics(r, "score", "added"), 6)
