"""Lead scoring: calendar-exact lags, next-period adds, rank metrics, and the models behind the scores.

Tables hold one row per (customer, period); ``period`` is an integer that grows by one per period.
Windows are partitioned by customer and bounded by the number of periods. Everything that needs the
order of all customers goes through one distributed ranking.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.frames import side_by_side, with_period_columns
from tidemark.functions.numeric import any_of, half_even_count, ratio, total_of
from tidemark.functions.ranking import running_sums
from tidemark.operators.guards import require_unique


def flag_fill(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("tinyint") for c in flags})


def at_offset(c: str, customer: str, period: str, offset: int) -> Column:
    """Value of the same customer exactly ``offset`` periods away; NULL if there is no such row."""
    return F.max(c).over(W.partitionBy(customer).orderBy(period).rangeBetween(offset, offset))


def calendar_lags(df: DataFrame, customer: str, period: str, lags: dict[str, Iterable[int]]) -> DataFrame:
    """Exact-period lags ``<column>_l<k>`` in one window pass; replaces one self-join per lag."""
    return df.select(
        "*", *[at_offset(c, customer, period, -k).alias(f"{c}_l{k}") for c, ks in lags.items() for k in ks]
    )


def next_period_adds(df: DataFrame, customer: str, period: str, products: Sequence[str], out: str = "added") -> DataFrame:
    """1 when a product not held now is held next period. Only rows whose customer is present next period
    stay. Flags must be filled."""
    gained = any_of((F.coalesce(F.col(f"__n_{c}"), F.lit(0)) == 1) & (F.col(c) == 0) for c in products)
    present = F.count(F.lit(1)).over(W.partitionBy(customer).orderBy(period).rangeBetween(1, 1))
    ahead = df.select(
        "*", present.alias("__next"), *[at_offset(c, customer, period, 1).alias(f"__n_{c}") for c in products]
    )
    return (
        ahead.filter(F.col("__next") > 0)
        .withColumn(out, gained.cast("tinyint"))
        .drop("__next", *[f"__n_{c}" for c in products])
    )


def one_row_per_period(df: DataFrame, customer: str, period: str) -> DataFrame:
    """Fail the job when a customer has two rows in one period: lags would mix them up.

    Same window as the lags, so it adds no shuffle.
    """
    same = F.count(F.lit(1)).over(W.partitionBy(customer).orderBy(period).rangeBetween(0, 0))
    message = F.lit(f"duplicate key on {customer}, {period}")
    ok = F.when(F.col("__same") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return df.withColumn("__same", same).filter(ok).drop("__same")


def holdings(df: DataFrame, products: Sequence[str]) -> DataFrame:
    """Products held, change since the previous period, products gained then, first period seen."""
    now = [F.col(c).cast("int") for c in products]
    before = [F.coalesce(F.col(f"{c}_l1"), F.lit(0)).cast("int") for c in products]
    gained = [((a == 1) & (b == 0)).cast("int") for a, b in zip(now, before)]
    return df.select(
        "*",
        total_of(now).alias("n_products"),
        (total_of(now) - total_of(before)).alias("n_products_change"),
        total_of(gained).alias("n_added_last"),
        F.col(f"{products[0]}_l1").isNull().cast("int").alias("new_customer"),
    )


def build_features(
    df: DataFrame, customer: str, period: str, products: Sequence[str], targets: Sequence[str],
    first_period: int | None = None, deep_lags: Iterable[int] = range(2, 6), out: str = "added",
) -> DataFrame:
    """Feature rows with their next-period label: one shuffle on the customer for all lags and the label.

    Rows before ``first_period`` only serve as lags.
    """
    filled = one_row_per_period(flag_fill(df, products), customer, period)
    lags = {c: [1, *(deep_lags if c in targets else ())] for c in products}
    labelled = holdings(next_period_adds(calendar_lags(filled, customer, period, lags), customer, period, targets, out), products)
    return labelled if first_period is None else labelled.filter(F.col(period) >= first_period)


def with_profile(df: DataFrame, profile: DataFrame, customer: str, flag_missing: Sequence[str] = ()) -> DataFrame:
    """Columns of a table with one row per customer, and a 0/1 column ``<c>_missing`` for each of ``flag_missing``.

    Customers without a profile stay, with nulls; a customer with two profiles fails the job.
    """
    known = require_unique(profile.filter(F.col(customer).isNotNull()), [customer])
    return df.join(known, customer, "left").withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in flag_missing})


def with_codes(df: DataFrame, columns: Mapping[str, str], most: int = 10_000) -> DataFrame:
    """Numbers of categories in alphabetical order, null for null; more than ``most`` categories fail the job."""
    for c, out in columns.items():
        names = df.agg(F.array_sort(F.collect_set(c)).alias("n")).select(
            F.when(F.size("n") <= most, F.col("n")).otherwise(F.raise_error(F.lit(f"more than {most} categories in {c}"))))
        df = df.withColumn(out, F.array_position(names.scalar(), F.col(c)).cast("int"))
    return df


def score_rates(train: DataFrame, test: DataFrame, score: str, label: str, out: str = "p") -> DataFrame:
    """The rate of ``label`` among the training rows of each score, for the test rows; the overall rate at unseen scores.

    For scores of few values (at most 10,000, checked), whose rates are read as a one-row map.
    """
    rates = train.groupBy(score).agg(F.avg(F.col(label).cast("double")).alias(out))
    base = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    return with_period_columns(test, rates, score, [out]).withColumn(out, F.coalesce(F.col(out), base))


def reopened(targets: Sequence[str], lags: Iterable[int] = range(1, 6)) -> Column:
    """Held at some earlier lag and not now: a later add would be a re-opening."""
    lags = list(lags)
    return any_of(
        (F.coalesce(F.col(f"{c}_l{k}"), F.lit(0)) == 1) & (F.col(c) == 0) for c in targets for k in lags
    )


def rule_score(active: Column, n_products: Column, customer: Column, seed: int = 42) -> Column:
    """Active customers first, then by products held; a hash of the id breaks ties."""
    u = F.pmod(F.xxhash64(customer, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    return F.coalesce(active, F.lit(0)) * 100.0 + n_products + 1e-6 * u


def negative_sample(df: DataFrame, label: str, keys: Sequence[str], keep: float = 0.10, seed: int = 42) -> DataFrame:
    """All positives and a hashed share of the rest, with the weight that undoes the sampling.

    The sample only feeds model training; scoring and evaluation always see every row.
    """
    digest = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return df.filter((F.col(label) == 1) | (u < keep)).withColumn(
        "weight", F.when(F.col(label) == 1, 1.0).otherwise(1.0 / keep)
    )


def period_split(df: DataFrame, period: str, train: tuple[int, int], valid: int, test: int) -> DataFrame:
    """Label rows train / valid / test; rows outside all three are left out."""
    if not train[1] < valid < test:
        raise ValueError("periods must be ordered train < valid < test")
    p = F.col(period)
    role = F.when(p.between(*train), "train").when(p == valid, "valid").when(p == test, "test")
    return df.withColumn("role", role).filter(F.col("role").isNotNull())


def rank_scores(df: DataFrame, score: str, label: str, tie: str, group: Sequence[str] = ()) -> DataFrame:
    """One distributed sort: rank, running positives, and both totals for every scored row."""
    narrow = df.select(*group, F.col(tie), F.col(score), F.col(label).cast("long").alias(label)).withColumn(
        "__one", F.lit(1).cast("long")
    )
    return running_sums(narrow, group, [F.desc(score), F.asc(tie)], {"rank": "__one", "pos": label}).drop("__one")


def top_k(ranked: DataFrame, k: float) -> DataFrame:
    return ranked.filter(F.col("rank") <= half_even_count(k, F.col("rank_total")))


def lift_expr(k: float, label: str) -> Column:
    """Aggregate over ranked rows: hit rate of the top ``k`` over the overall hit rate."""
    inside = F.col("rank") <= half_even_count(k, F.col("rank_total"))
    return ratio(F.avg(F.when(inside, F.col(label))), F.avg(label))


def lift_at(ranked: DataFrame, label: str, ks: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    return ranked.groupBy(*group).agg(
        F.count("*").alias("customers"),
        F.avg(label).alias("base_rate"),
        *[lift_expr(k, label).alias(f"lift_{round(k * 100)}pct") for k in ks],
    )


def by_threshold(ranked: DataFrame, score: str, label: str) -> DataFrame:
    """Rows and positives at each distinct score with the counts down to and including it."""
    return ranked.groupBy(score).agg(
        F.count("*").alias("n"),
        F.sum(label).alias("p"),
        F.max("rank").alias("upto"),
        F.max("pos").alias("pos_upto"),
        F.max("pos_total").alias("pos_total"),
        F.max("rank_total").alias("total"),
    )


def thresholds(scored: DataFrame, score: str, label: str) -> DataFrame:
    """The table of ``by_threshold`` without a rank per row: rows of equal score are counted before anything is sorted."""
    counts = scored.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    sums = running_sums(counts, [], [F.desc(score)], {"upto": "n", "pos_upto": "p"})
    return sums.withColumnsRenamed({"pos_upto_total": "pos_total", "upto_total": "total"})


def roc_auc(thresholds: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs ranked rightly, ties counting half."""
    won = (F.col("n") - F.col("p")) * ((F.col("pos_upto") - F.col("p")) + F.col("p") / 2.0)
    pairs = F.max("pos_total").cast("double") * (F.max("total") - F.max("pos_total"))
    return thresholds.agg(F.try_divide(F.sum(won), pairs).alias("roc_auc"))


def average_precision(thresholds: DataFrame) -> DataFrame:
    """Precision at each distinct threshold weighted by the recall it adds."""
    step = ratio(F.col("p"), F.col("pos_total")) * ratio(F.col("pos_upto"), F.col("upto"))
    return thresholds.agg(F.sum(step).alias("average_precision"))


def brier(df: DataFrame, probability: str, label: str) -> DataFrame:
    e = F.col(probability) - F.col(label)
    return df.agg(F.avg(e * e).alias("brier"))


def score_metrics(ranked: DataFrame, score: str, label: str) -> DataFrame:
    """Lifts, ROC area and average precision in one row from one ranking."""
    t = by_threshold(ranked, score, label)
    return side_by_side(lift_at(ranked, label, (0.1, 0.05, 0.01)), roc_auc(t), average_precision(t))


def decile_of(rank: Column, total: Column, groups: int = 10) -> Column:
    """Near-equal groups in rank order; the first ``total % groups`` hold one row more."""
    base, extra = F.floor(total / groups), total % groups
    head = extra * (base + 1)
    return (
        F.when(rank <= head, F.floor((rank - 1) / (base + 1)) + 1)
        .otherwise(extra + F.floor(F.try_divide((rank - 1 - head).cast("double"), base.cast("double"))) + 1)
        .cast("int")
    )


def gains_table(ranked: DataFrame, label: str, groups: int = 10) -> DataFrame:
    """Size, adds, hit rate, lift and cumulative share of adds per decile."""
    d = ranked.withColumn("decile", decile_of(F.col("rank"), F.col("rank_total"), groups)).groupBy("decile").agg(
        F.count("*").alias("customers"),
        F.sum(label).alias("adds"),
        F.max("pos").alias("adds_upto"),
        F.max("rank").alias("customers_upto"),
        F.max("pos_total").alias("adds_total"),
        F.max("rank_total").alias("customers_total"),
    )
    hit, base = ratio(F.col("adds"), F.col("customers")), ratio(F.col("adds_total"), F.col("customers_total"))
    return d.select(
        "decile", "customers", "adds", hit.alias("hit_rate"), ratio(hit, base).alias("lift"),
        ratio(F.col("adds_upto"), F.col("adds_total")).alias("cumulative_share"),
        "customers_upto", "adds_upto", "customers_total", "adds_total",
    )


def capacity_frontier(gains: DataFrame) -> DataFrame:
    """What contacting the top 1..10 deciles reaches. Running counts come with the gains rows."""
    hit = ratio(F.col("adds_upto"), F.col("customers_upto"))
    return gains.select(
        "decile",
        F.col("customers_upto").alias("contacted"),
        F.col("adds_upto").alias("adds"),
        ratio(F.col("adds_upto"), F.col("adds_total")).alias("share"),
        hit.alias("hit_rate"),
        ratio(hit, ratio(F.col("adds_total"), F.col("customers_total"))).alias("lift"),
    )


def base_rates(df: DataFrame, label: str, is_reopened: Column) -> DataFrame:
    y = F.col(label).cast("long")
    fresh = ~is_reopened
    return df.agg(
        F.count("*").alias("customers"),
        F.sum(y).alias("adds"),
        F.avg(y).alias("base_rate"),
        F.count_if(fresh).alias("new_customers"),
        F.sum(F.when(fresh, y).otherwise(0)).alias("new_adds"),
        F.avg(F.when(fresh, y)).alias("new_base_rate"),
        ratio(F.sum(F.when(is_reopened, y).otherwise(0)), F.sum(y)).alias("share_excluded"),
    )


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=list(features), outputCol="raw_features").transform(filled)


def _probability(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return df.withColumn("score", vector_to_array("probability")[1])


def logistic_scores(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, weight: str = "weight",
                    max_iter: int = 500) -> DataFrame:
    """Weighted ridge logistic regression on standardised numeric features (missing counts as zero)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    data = _assembled(train, features)
    total = data.agg(F.sum(weight)).first()[0]
    steps = Pipeline(stages=[
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(labelCol=label, weightCol=weight, maxIter=max_iter, regParam=1.0 / total,
                           elasticNetParam=0.0, standardization=False),
    ])
    return _probability(steps.fit(data).transform(_assembled(test, features)))


def boosted_model(train_valid: DataFrame, features: Sequence[str], label: str, is_valid: str, weight: str = "weight",
                  max_iter: int = 400, depth: int = 4):
    """Boosted trees; rounds end when one gains too little on the validation period, at ``max_iter`` otherwise."""
    from pyspark.ml.classification import GBTClassifier

    gbt = GBTClassifier(labelCol=label, featuresCol="raw_features", weightCol=weight, maxIter=max_iter,
                        maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=42,
                        validationIndicatorCol=is_valid, validationTol=0.001)
    return gbt.fit(_assembled(train_valid, features))


def boosted_scores(model, test: DataFrame, features: Sequence[str]) -> DataFrame:
    return _probability(model.transform(_assembled(test, features)))


def importance_ranking(model, features: Sequence[str], spark) -> DataFrame:
    """Features by gain; the table has one row per feature."""
    rows = [(f, float(model.featureImportances[i])) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"), "feature")
