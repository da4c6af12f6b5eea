"""One Bayesian linear regression per (product, family) and the choice among families.

All functions work on every product (and every date, where there is one) at
once. History enters as condensed rows (`training.arm_days`), so everything
here is bounded by calendar days × products × families, not by proposals.

With d_0 = 1 and d_1 … d_7 the features less their mean, a moment row per
(product, family) holds

  n       number of scores
  gram    upper triangle of sum d_i d_j   (36 entries, n first)
  cross   sum d_i × score                 (8 entries)
  means   0 and the seven feature means of the product
  stds    1 and their seven deviations
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import linalg
from paceline.functions.draws import draw_key, keyed_normal
from paceline.functions.score import NEAR_ZERO
from paceline.schemas import FAMILIES, FEATURES

K = len(FEATURES)
DIM = K + 1  # the intercept comes first
# Prior strength, noise variance, and the ridge added to fitted arms.
ALPHA = 1.0
SIGMA_SQ = 0.16
JITTER = 1e-6

PAIRS = linalg.upper(DIM)
DIAGONAL = linalg.diagonal_positions(DIM)
FEATURE_CELLS = ["1D", *[f"`{f}`" for f in FEATURES]]
# Means that put a row's own features at zero.
OWN_MEANS = linalg.array(["0D", *FEATURE_CELLS[1:]])

GRAM = linalg.each_pair(DIM, "sum(n * d_{i} * d_{j})")
CROSS = linalg.each(DIM, "sum(score_sum * d_{i})")
# The sums of a moment row over condensed rows that carry means and d_i.
SUMS = {"n": "sum(n)", "gram": GRAM, "cross": CROSS, "means": "first(means)"}
NO_SUMS = {
    "n": "0",
    "gram": f"array_repeat(0D, {len(PAIRS)})",
    "cross": f"array_repeat(0D, {DIM})",
}


def sum_by(rows: DataFrame, keys: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Grouped aggregation of named expression texts."""
    return rows.groupBy(*keys).agg(*[F.expr(e).alias(name) for name, e in sums.items()])


def centre(rows: DataFrame) -> DataFrame:
    """Add the product's feature means, and d_i.

    Centring before squaring keeps the digits that sums of raw squares lose. The means
    are windows over the condensed rows, whose number per product is bounded by the
    calendar: so the rows are computed once, and being dealt by product already they
    are summed per arm without another shuffle.
    """
    own = "OVER (PARTITION BY product)"
    cells = [f"sum(n * `{f}`) {own} / sum(n) {own}" for f in FEATURES]
    return _less_means(rows.selectExpr("*", f"{linalg.array(['0D', *cells])} AS means"))


def _less_means(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("*", *[f"{x} - means[{i}] AS d_{i}" for i, x in enumerate(FEATURE_CELLS)])


def guarded_std(std: str) -> str:
    """A deviation that counts as zero becomes 1, so that constant features stay at zero."""
    return f"if({std} < {NEAR_ZERO!r}D, 1D, {std})"


def scaler(rows: DataFrame) -> DataFrame:
    """Means and population deviations per product; a constant feature gets deviation 1."""
    cells = [guarded_std(f"sqrt(sum(n * d_{i} * d_{i}) / sum(n))") for i in range(1, DIM)]
    sums = {"n_rows": "sum(n)", "means": "first(means)", "stds": linalg.array(["1D", *cells])}
    return sum_by(centre(rows), ["product"], sums)


def moments(rows: DataFrame) -> DataFrame:
    """Moment rows per (product, family) with the product's own scaler."""
    own = "OVER (PARTITION BY product)"  # one row per family
    cells = [guarded_std(f"sqrt(sum(gram[{k}]) {own} / sum(n) {own})") for k in DIAGONAL[1:]]
    per_arm = sum_by(centre(rows), ["product", "family"], SUMS)
    return per_arm.selectExpr("*", f"{linalg.array(['1D', *cells])} AS stds")


def moments_with_scaler(rows: DataFrame, scalers: DataFrame) -> DataFrame:
    """Moment rows under a given scaler: product, means, stds; one row per product."""
    given = scalers.selectExpr(
        "product", "means", f"transform(stds, s -> {guarded_std('s')}) AS stds"
    )
    return sum_by(
        _less_means(rows.join(given, "product")),
        ["product", "family"],
        {**SUMS, "stds": "first(stds)"},
    )


# The row's feature array, less means, over stds; the intercept stays 1.
STANDARDISED = linalg.array([f"({x} - means[{i}]) / stds[{i}]" for i, x in enumerate(FEATURE_CELLS)])


def standardised_rows(rows: DataFrame, scalers: DataFrame) -> DataFrame:
    """Condensed rows with their standardised features as array `z`."""
    return rows.join(scalers.select("product", "means", "stds"), "product").selectExpr(
        "*", f"{STANDARDISED} AS z"
    )


GRAM_CELL = "gram[{k}] / (stds[{i}] * stds[{j}])"
CROSS_CELL = "cross[{i}] / stds[{i}]"


def standardised_moments(moment_rows: DataFrame) -> DataFrame:
    """Gram matrix (upper triangle) and moment vector of the standardised features."""
    return moment_rows.withColumns(
        {
            "gram": F.expr(linalg.each_pair(DIM, GRAM_CELL)),
            "cross": F.expr(linalg.each(DIM, CROSS_CELL)),
        }
    )


def with_prior_arms(
    contexts: DataFrame, moment_rows: DataFrame, families: Sequence[str] = FAMILIES
) -> DataFrame:
    """Every family for every context row (date, product, features).

    Arms without rows have zero moments and still use the scaler of their
    product; a product without any history has none, so today's features stand
    in as means with deviation 1.
    """
    arms = contexts.withColumn("family", F.explode(F.lit(list(families))))
    known = moment_rows.where(F.col("family").isin(list(families)))
    own = "OVER (PARTITION BY date, product)"  # one row per family
    return arms.join(known, ["product", "family"], "left").selectExpr(
        *[f"`{c}`" for c in arms.columns],
        *[f"coalesce({c}, {nothing}) AS {c}" for c, nothing in NO_SUMS.items()],
        f"coalesce(max(means) {own}, {OWN_MEANS}) AS means",
        f"coalesce(max(stds) {own}, array_repeat(1D, {DIM})) AS stds",
    )


def _solved(
    arms: DataFrame, keep: Sequence[str], alpha: float, sigma_sq: float, sides: Sequence[str]
) -> DataFrame:
    """Columns keep, n and the solved posterior system; side 0 is the posterior mean."""
    scaled = _precision(arms, keep, alpha, sigma_sq)
    rows = linalg.system(DIM, "lambda", ["b", *sides])
    return scaled.selectExpr(*keep, "n", f"{linalg.solve(DIM, rows)} AS solved")


def _precision(arms: DataFrame, keep: Sequence[str], alpha: float, sigma_sq: float) -> DataFrame:
    """Columns keep, n, the posterior precision `lambda` (a triangle) and its right-hand side `b`.

    Arms that have seen no row keep the bare prior, without the jitter.
    """
    noise = f"{float(sigma_sq)!r}D"
    ridge = f"{float(alpha)!r}D + if(n > 0, {JITTER!r}D, 0D)"
    precision = [
        GRAM_CELL.format(i=i, j=j, k=k) + f" / {noise}" + (f" + {ridge}" if i == j else "")
        for k, (i, j) in enumerate(PAIRS)
    ]
    return arms.selectExpr(
        *keep,
        "n",
        f"{linalg.array(precision)} AS lambda",
        f"{linalg.each(DIM, CROSS_CELL + ' / ' + noise)} AS b",
    )


def posterior(
    arms: DataFrame,
    keys: Sequence[str] = ("product", "family"),
    alpha: float = ALPHA,
    sigma_sq: float = SIGMA_SQ,
) -> DataFrame:
    """Posterior mean of the weights per arm, intercept first, as array `mu`."""
    solved = _solved(arms, list(keys), alpha, sigma_sq, [])
    return solved.selectExpr(*keys, "n", f"{linalg.side(DIM, 'solved', 0)} AS mu")


def diagnostics(
    arms: DataFrame,
    keys: Sequence[str] = ("product", "family"),
    alpha: float = ALPHA,
    sigma_sq: float = SIGMA_SQ,
) -> DataFrame:
    """Per arm: observations, L2 norm of the posterior mean, trace of the covariance."""
    solved = _solved(arms, list(keys), alpha, sigma_sq, [linalg.IDENTITY])
    with_mu = solved.selectExpr("*", f"{linalg.side(DIM, 'solved', 0)} AS mu")
    return with_mu.selectExpr(
        *keys,
        "n AS n_obs",
        f"sqrt({linalg.dot(DIM, 'mu', 'mu')}) AS posterior_mean_norm",
        f"{linalg.trace(DIM, 'solved', 1)} AS posterior_trace",
    )


def predict(
    arms: DataFrame,
    keys: Sequence[str] = ("product", "family"),
    alpha: float = ALPHA,
    sigma_sq: float = SIGMA_SQ,
) -> DataFrame:
    """Predictive mean and deviation of each arm at the row's own feature values."""
    placed = arms.withColumn("x", F.expr(STANDARDISED))
    solved = _solved(placed, [*keys, "x"], alpha, sigma_sq, ["x"])
    return solved.selectExpr(
        *keys,
        "n AS n_obs",
        f"{_along_x(0)} AS posterior_mean",
        f"sqrt({_along_x(1)}) AS posterior_std",
    )


def _along_x(s: int) -> str:
    """x times solution s of the solved system."""
    return " + ".join(f"x[{i}] * solved[{i}][{DIM + s}]" for i in range(DIM))


def draw(predicted: DataFrame, seed: object, keys: Sequence[str]) -> DataFrame:
    """One posterior draw per arm and context.

    Where a context is drawn for once, only the value x'w matters, and with w normal
    x'w is normal with the predictive mean and deviation, so one scalar draw replaces
    a vector one. Contexts that must share one draw of w take `draw_weights`.
    """
    z = keyed_normal(draw_key(seed, *keys))
    return predicted.withColumn(
        "sampled_value", F.col("posterior_mean") + F.col("posterior_std") * z
    )


def draw_weights(
    arms: DataFrame,
    seed: object,
    keys: Sequence[str] = ("product", "family"),
    alpha: float = ALPHA,
    sigma_sq: float = SIGMA_SQ,
) -> DataFrame:
    """One draw of the whole weight vector per arm, as array `w`, with `mu`, `cov` and the scaler.

    With R'R the precision, R w = R'^-1 b + z for standard normal z gives w the
    posterior's mean and covariance. The eight z are keyed by seed, arm and place,
    so the same arm has the same w whatever contexts it meets.
    """
    solved = _precision(arms, [*keys, "means", "stds"], alpha, sigma_sq)
    normals = F.array(*[keyed_normal(draw_key(seed, *keys, F.lit(i))) for i in range(DIM)])
    keep = [*keys, "n", "means", "stds"]
    factored = solved.withColumn("z", normals).selectExpr(
        *keep,
        "z",
        f"{linalg.cholesky(DIM, linalg.system(DIM, 'lambda', ['b']))} AS factor",
        f"{linalg.solve(DIM, linalg.system(DIM, 'lambda', ['b', linalg.IDENTITY]))} AS solved",
    )
    inverse = linalg.each_pair(DIM, f"solved[{{i}}][{DIM + 1} + {{j}}]")
    return factored.selectExpr(
        *keep,
        f"{linalg.back_substitute(DIM, 'factor', f'factor[i][{DIM}] + z[i]')} AS w",
        f"{linalg.side(DIM, 'solved', 0)} AS mu",
        f"{inverse} AS cov",
    )


def apply_weights(contexts: DataFrame, weights: DataFrame) -> DataFrame:
    """Every context with every arm of its product: x'w, and the predictive mean and deviation.

    `weights` is small, one row per arm, and is solved once however many contexts there are.
    """
    placed = contexts.select("date", "product", *FEATURES).join(weights, "product").withColumn("x", F.expr(STANDARDISED))
    quadratic = " + ".join(
        f"{'' if i == j else '2 * '}x[{i}] * x[{j}] * cov[{k}]" for k, (i, j) in enumerate(PAIRS)
    )
    return placed.selectExpr(
        "date",
        "product",
        "family",
        "n AS n_obs",
        f"{linalg.dot(DIM, 'x', 'mu')} AS posterior_mean",
        f"sqrt({quadratic}) AS posterior_std",
        f"{linalg.dot(DIM, 'x', 'w')} AS sampled_value",
    )


def rank_arms(drawn: DataFrame, slot_keys: Sequence[str]) -> DataFrame:
    """Rank 1 … n by drawn value within each (date,) product; ties go by family name."""
    order = Window.partitionBy(*slot_keys).orderBy(F.desc("sampled_value"), "family")
    return drawn.withColumn("arm_rank", F.row_number().over(order))


def select_slots(drawn: DataFrame, slot_keys: Sequence[str]) -> DataFrame:
    """Best (rank 1), two alternatives (2, 3), and the most uncertain of the rest.

    With fewer families there are as many slots as there can be.
    """
    ranked = rank_arms(drawn, slot_keys)
    rest_first = Window.partitionBy(*slot_keys).orderBy(
        F.when(F.col("arm_rank") > 3, 0).otherwise(1), F.desc("posterior_std"), "arm_rank"
    )
    kind = (
        F.when(F.col("arm_rank") == 1, "best")
        .when(F.col("arm_rank") <= 3, "alt")
        .when(F.col("_uncertainty") == 1, "explore")
    )
    return (
        ranked.withColumn("_uncertainty", F.row_number().over(rest_first))
        .withColumn("proposal_type", kind)
        .where(F.col("proposal_type").isNotNull())
        .withColumn("slot", F.least(F.col("arm_rank"), F.lit(4)))
        .drop("_uncertainty")
        .withColumnRenamed("sampled_value", "thompson_sample_value")
    )


def slots_today(
    contexts: DataFrame,
    rows: DataFrame,
    seed: object,
    families: Sequence[str] = FAMILIES,
    alpha: float = ALPHA,
    sigma_sq: float = SIGMA_SQ,
) -> DataFrame:
    """From today's features per (date, product) and condensed history to today's slots."""
    return slots_fitted(contexts, moments(rows), seed, families, alpha, sigma_sq)


def slots_fitted(
    contexts: DataFrame,
    moment_rows: DataFrame,
    seed: object,
    families: Sequence[str] = FAMILIES,
    alpha: float = ALPHA,
    sigma_sq: float = SIGMA_SQ,
) -> DataFrame:
    """The same from moment rows per (product, family)."""
    arms = with_prior_arms(contexts.select("date", "product", *FEATURES), moment_rows, families)
    keys = ["date", "product", "family"]
    predicted = predict(arms, keys, alpha, sigma_sq)
    return select_slots(draw(predicted, seed, keys), ["date", "product"])
