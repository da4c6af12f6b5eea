"""Regression moments that can be stored and merged, so that a day adds to them instead of re-reading history.

A moment row describes any set of scored proposals of one arm:

  n           how many scores
  score_mean  their mean
  means       the seven feature means
  products    upper triangle of sum (x_i - mean_i) (x_j - mean_j)   (28 entries)
  cross       sum (x_i - mean_i) (score - score_mean)               (7 entries)

Two rows merge into the row of both sets exactly: means are weighted by n, and the sums
move to the new mean by n times the product of the distances. All sums stay centred, so
merging in any order keeps the digits that sums of raw squares would lose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from paceline.functions import linalg
from paceline.operators.arms import DIAGONAL, DIM, K, guarded_std, sum_by
from paceline.schemas import FEATURES

TRIANGLE = linalg.upper(K)
LAYOUT = (
    "date date, product string, family string, eval_date date, n long, score_mean double, "
    "means array<double>, products array<double>, cross array<double>"
)
COLUMNS = [part.split()[0] for part in LAYOUT.split(", ")]


def moment_rows(rows: DataFrame) -> DataFrame:
    """Moment rows of condensed history (`training.arm_days`): all proposals of one share their features."""
    return rows.selectExpr(
        "date",
        "product",
        "family",
        "eval_date",
        "cast(n AS long) AS n",
        "score_sum / n AS score_mean",
        f"{linalg.array([f'`{f}`' for f in FEATURES])} AS means",
        f"array_repeat(0D, {len(TRIANGLE)}) AS products",
        f"array_repeat(0D, {K}) AS cross",
    )


def merged(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One moment row per key from any number of them.

    The new means are an aggregate of their own, joined back to the rows, so a key's rows
    need not be in one task; both aggregates combine map-side.
    """
    totals = sum_by(
        rows,
        keys,
        {
            "n_all": "sum(n)",
            "score_all": "sum(n * score_mean) / sum(n)",
            "means_all": linalg.each(K, "sum(n * means[{i}]) / sum(n)"),
        },
    )
    moved = rows.join(totals, list(keys)).selectExpr("*", *[f"means[{i}] - means_all[{i}] AS d_{i}" for i in range(K)])
    products = linalg.array([f"sum(products[{k}] + n * d_{i} * d_{j})" for k, (i, j) in enumerate(TRIANGLE)])
    return sum_by(
        moved,
        keys,
        {
            "n": "first(n_all)",
            "score_mean": "first(score_all)",
            "means": "first(means_all)",
            "products": products,
            "cross": linalg.each(K, "sum(cross[{i}] + n * d_{i} * (score_mean - score_all))"),
        },
    )


def arm_moments(rows: DataFrame) -> DataFrame:
    """What `arms.moments` gives from history, from moment rows: centred on the product's means, with its deviations."""
    own = "OVER (PARTITION BY product)"  # one row per family
    means = [f"sum(n * means[{i}]) {own} / sum(n) {own}" for i in range(K)]
    placed = merged(rows, ["product", "family"]).selectExpr("*", f"{linalg.array(['0D', *means])} AS centre")
    apart = placed.selectExpr("*", f"{linalg.array(['1D', *[f'means[{i}] - centre[{i + 1}]' for i in range(K)]])} AS d")
    cells = []
    for i, j in linalg.upper(DIM):
        inner = f" + products[{TRIANGLE.index((i - 1, j - 1))}]" if i else ""
        cells.append(f"n * d[{i}] * d[{j}]{inner}")
    cross = ["n * score_mean", *[f"cross[{i}] + n * score_mean * d[{i + 1}]" for i in range(K)]]
    per_arm = apart.selectExpr("product", "family", "n", f"{linalg.array(cells)} AS gram", f"{linalg.array(cross)} AS cross", "centre AS means")
    deviations = [guarded_std(f"sqrt(sum(gram[{k}]) {own} / sum(n) {own})") for k in DIAGONAL[1:]]
    return per_arm.selectExpr("*", f"{linalg.array(['1D', *deviations])} AS stds")
