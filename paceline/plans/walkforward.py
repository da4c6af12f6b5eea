"""The daily choice replayed for every date in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions import linalg
from paceline.functions.score import NEAR_ZERO
from paceline.operators.arms import (
    ALPHA,
    DIAGONAL,
    DIM,
    OWN_MEANS,
    SIGMA_SQ,
    SUMS,
    centre,
    draw,
    predict,
    select_slots,
    sum_by,
)
from paceline.operators.keyed import spread
from paceline.operators.training import arm_days, usable_features
from paceline.schemas import FAMILIES, FEATURES

# Stands for all families that are not asked for.
OTHER = "*"
# A variance smaller than this share of the mean square is rounding noise: the
# running sums lose that many digits, so the daily fit's absolute test is too fine here.
RELATIVE_ZERO = 1e-12


def running_moments(rows: DataFrame, contexts: DataFrame, families: Sequence[str]) -> DataFrame:
    """Moment rows per (date, product, family) over everything evaluated by that date.

    History is summed per evaluation day first; the running windows see one row
    per arm and day (twice: history and decision dates), never proposals. All
    sums are centred on one fixed shift per product; it cancels exactly, so no
    later day leaks into an earlier one. Rows of other families are summed as one
    more arm: they take part in each date's scaler, as in the daily fit, and the
    arm is dropped afterwards.
    """
    listed = F.when(F.col("family").isin(list(families)), F.col("family")).otherwise(OTHER)
    daily = sum_by(
        centre(rows.withColumn("family", listed)).withColumn("date", F.col("eval_date")),
        ["product", "family", "date"],
        SUMS,
    )
    spine = contexts.select(
        "product",
        F.explode(F.lit([*families, OTHER])).alias("family"),
        "date",
        *FEATURES,
        F.lit(True).alias("decides"),
    )
    sofar = (
        "OVER (PARTITION BY product, family ORDER BY date "
        "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    gram = linalg.each_pair(DIM, f"coalesce(sum(gram[{{k}}]) {sofar}, 0D)")
    cross = linalg.each(DIM, f"coalesce(sum(cross[{{i}}]) {sofar}, 0D)")
    running = spine.unionByName(daily, allowMissingColumns=True).selectExpr(
        "date",
        "product",
        "family",
        "decides",
        *FEATURES,
        f"coalesce(sum(n) {sofar}, 0) AS n",
        f"{gram} AS gram",
        f"{cross} AS cross",
        f"max(means) {sofar} AS shift",
    )
    rescaled = _rescale(spread(running.where("decides"), "date", "product"))
    return rescaled.where(F.col("family") != OTHER)


def _rescale(running: DataFrame) -> DataFrame:
    """Move the centre from the shift to each date's own product mean, and add its deviation.

    With m the mean relative to the shift (m_0 = 0), sum d_i d_j about the mean is
    gram_ij - m_i gram_0j - m_j gram_0i + n m_i m_j, for the intercept row as well.
    Before the first outcome of a product there is no mean: m stays at 0 and the
    date's own features stand in as means.
    """
    own = "OVER (PARTITION BY date, product)"  # one row per family
    share = f"{own} / nullif(sum(n) {own}, 0)"
    mean = [f"coalesce(sum(gram[{i}]) {share}, 0D)" for i in range(1, DIM)]
    square = [f"coalesce(sum(gram[{k}]) {share}, 0D)" for k in DIAGONAL[1:]]
    with_means = running.selectExpr(
        "*",
        f"{linalg.array(['0D', *mean])} AS m",
        f"{linalg.array(['1D', *square])} AS q",
        f"max(shift) {own} AS base",
    )
    # Row 0 of the triangle holds the sums, entry j at position j.
    moved = "gram[{k}] - m[{i}] * gram[{j}] - m[{j}] * gram[{i}] + n * m[{i}] * m[{j}]"
    about_base = linalg.each(DIM, "base[{i}] + m[{i}]")
    spread = []
    for i in range(DIM):
        variance = f"(q[{i}] - m[{i}] * m[{i}])"
        tiny = f"{variance} <= {RELATIVE_ZERO!r}D * q[{i}] OR {variance} < {NEAR_ZERO**2!r}D"
        spread.append(f"if({tiny}, 1D, sqrt({variance}))")
    return with_means.selectExpr(
        "date",
        "product",
        "family",
        *FEATURES,
        "n",
        f"{linalg.each_pair(DIM, moved)} AS gram",
        f"{linalg.each(DIM, 'cross[{i}] - cross[0] * m[{i}]')} AS cross",
        f"if(base IS NULL, {OWN_MEANS}, {about_base}) AS means",
        f"{linalg.array(spread)} AS stds",
    )


def predictions(
    proposals: DataFrame,
    features: DataFrame,
    outcomes: DataFrame,
    families: Sequence[str] = FAMILIES,
    alpha: float = ALPHA,
    sigma_sq: float = SIGMA_SQ,
) -> DataFrame:
    """Predictive mean and deviation of every arm on every date with features."""
    rows = arm_days(proposals, features, outcomes)
    arms = running_moments(rows, usable_features(features), families)
    return predict(arms, ["date", "product", "family"], alpha, sigma_sq)


def backtest(
    proposals: DataFrame,
    features: DataFrame,
    outcomes: DataFrame,
    seed: object,
    families: Sequence[str] = FAMILIES,
    alpha: float = ALPHA,
    sigma_sq: float = SIGMA_SQ,
) -> DataFrame:
    """The slots each product would have been given on each date."""
    predicted = predictions(proposals, features, outcomes, families, alpha, sigma_sq)
    drawn = draw(predicted, seed, ["date", "product", "family"])
    return select_slots(drawn, ["date", "product"])
