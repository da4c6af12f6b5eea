"""Walk-forward joins of proposals, features and outcomes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.canonical import not_finite
from paceline.schemas import DAY_KEY, FEATURES, PROPOSAL_KEY, VERSION_COLUMN


def realised(outcomes: DataFrame, as_of: date) -> DataFrame:
    """Outcomes known on `as_of`, that day included."""
    return outcomes.where(F.col("eval_date") <= F.lit(as_of))


def training_table(
    proposals: DataFrame, features: DataFrame, outcomes: DataFrame, as_of: date
) -> DataFrame:
    """One row per proposal whose outcome is known on `as_of`, with its features.

    The selective join comes first; the features of a day are one row per
    product, a small side that Spark broadcasts when its size allows.
    """
    known = realised(outcomes, as_of).drop(VERSION_COLUMN)
    return proposals.join(known, PROPOSAL_KEY).join(features.drop(VERSION_COLUMN), DAY_KEY)


def full_table(proposals: DataFrame, features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every proposal, with nulls where features or outcome are missing."""
    return proposals.join(outcomes.drop(VERSION_COLUMN), PROPOSAL_KEY, "left").join(
        features.drop(VERSION_COLUMN), DAY_KEY, "left"
    )


def pending_proposals(proposals: DataFrame, outcomes: DataFrame) -> DataFrame:
    return proposals.join(outcomes.select(*PROPOSAL_KEY), PROPOSAL_KEY, "left_anti")


def best_by_day(proposals: DataFrame) -> DataFrame:
    """Per (date, product) with proposals, the largest hash among its `best` rows, or null.

    At most days × products rows.
    """
    own = F.when(F.col("proposal_type") == "best", F.col("config_hash"))
    return proposals.groupBy(*DAY_KEY).agg(F.max(own).alias("config_hash"))


def latest_best(proposals: DataFrame) -> DataFrame:
    """The newest `best` proposal per product; ties on the day go to the largest hash.

    The key is found on narrow columns; one row per product is then read in full.
    """
    best = best_by_day(proposals).where(F.col("config_hash").isNotNull())
    newest = best.groupBy("product").agg(F.max(F.struct("date", "config_hash")).alias("newest"))
    return proposals.join(newest.select("product", "newest.*"), PROPOSAL_KEY, "left_semi")


def previous_best_by_day(
    proposals: DataFrame, carry: list[str] | None = None, day: date | None = None
) -> DataFrame:
    """Per (date, product) with proposals, the best proposal strictly before that date.

    The window runs over one row per calendar day and product, never over the
    proposals themselves; `carry` names columns to fetch from the earlier row.
    With `day` only that date's rows are returned, and the columns are fetched
    for the handful of keys that they name: one row per product is broadcast.
    """
    own = F.struct("date", "config_hash")
    earlier = Window.partitionBy("product").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    linked = (
        best_by_day(proposals)
        .withColumn("own", F.when(F.col("config_hash").isNotNull(), own))
        .withColumn("previous", F.last("own", ignorenulls=True).over(earlier))
        .select(
            *DAY_KEY,
            F.col("previous.date").alias("prev_date"),
            F.col("previous.config_hash").alias("prev_config_hash"),
        )
    )
    if day is not None:
        linked = linked.where(F.col("date") == F.lit(day))
    if not carry:
        return linked
    earlier_key = ["product", "prev_date", "prev_config_hash"]
    fetched = proposals.where(F.col("proposal_type") == "best").select(
        "product",
        F.col("date").alias("prev_date"),
        F.col("config_hash").alias("prev_config_hash"),
        *[F.col(c).alias(f"prev_{c}") for c in carry],
    )
    if day is not None:
        fetched = fetched.join(F.broadcast(linked.select(*earlier_key)), earlier_key, "left_semi")
    return linked.join(fetched, earlier_key, "left")


def previous_best(proposals: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every proposal with the best proposal of its product strictly before its date."""
    return proposals.join(previous_best_by_day(proposals, carry), DAY_KEY, "left")


def arm_days(
    proposals: DataFrame, features: DataFrame, outcomes: DataFrame, as_of: date | None = None
) -> DataFrame:
    """What the model needs of the training table, condensed.

    All proposals of a (date, product) share one feature row, so the regression
    only needs, per (product, family, date, eval_date), how many scores there
    are and their sum. Counting before the feature join shrinks the history to
    calendar size whatever the number of proposals, and map-side sums absorb a
    hot day. Scores that are null, NaN or infinite are left out; `fit_exclusions`
    counts them.
    """
    known = outcomes if as_of is None else realised(outcomes, as_of)
    scored = known.where(usable(F.col("meta_score")))
    counted = (
        proposals.select(*PROPOSAL_KEY, "family")
        .join(scored.select(*PROPOSAL_KEY, "eval_date", "meta_score"), PROPOSAL_KEY)
        .groupBy("product", "family", "date", "eval_date")
        .agg(F.count("*").alias("n"), F.sum("meta_score").alias("score_sum"))
    )
    return counted.join(usable_features(features), DAY_KEY)


def condense(training: DataFrame) -> DataFrame:
    """The same condensed rows from a training table that already exists.

    The feature values belong to the grouping key, so this is exact for any input.
    """
    scored = training.where(usable(F.col("meta_score")))
    return (
        usable_features(scored, "family", "eval_date", "meta_score")
        .groupBy("product", "family", "date", "eval_date", *FEATURES)
        .agg(F.count("*").alias("n"), F.sum("meta_score").alias("score_sum"))
    )


def usable(value: Column) -> Column:
    """Whether a number can enter the fit: neither null nor NaN nor infinite."""
    return value.isNotNull() & ~not_finite(value)


def usable_features(features: DataFrame, *more: str) -> DataFrame:
    """Key and features of the rows without a null key and with finite features."""
    complete = F.lit(True)
    for key in DAY_KEY:
        complete = complete & F.col(key).isNotNull()
    for name in FEATURES:
        complete = complete & usable(F.col(name))
    return features.where(complete).select(*DAY_KEY, *FEATURES, *more)


def fit_exclusions(features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(column, reason, rows): the values that keep rows out of the fit, zero counts included."""

    def counted(df: DataFrame, columns: list[str]) -> DataFrame:
        reasons = {
            "null": lambda c: F.col(c).isNull(),
            "NaN": lambda c: F.isnan(c),
            "infinite": lambda c: F.abs(c) == float("inf"),
        }
        cells = [
            (c, reason, F.count_if(F.coalesce(test(c), F.lit(False))))
            for c in columns
            for reason, test in reasons.items()
        ]
        found = df.agg(*[count.alias(f"n{i}") for i, (_, _, count) in enumerate(cells)])
        rows = [
            F.struct(F.lit(c).alias("column"), F.lit(reason).alias("reason"), F.col(f"n{i}").alias("rows"))
            for i, (c, reason, _) in enumerate(cells)
        ]
        return found.select(F.inline(F.array(*rows)))

    return counted(features, FEATURES).unionByName(counted(outcomes, ["meta_score"]))
