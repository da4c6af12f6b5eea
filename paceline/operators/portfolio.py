"""Returns times weights: realised outcomes, in-sample figures, turnover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.score import ScoreRule, guarded_ratio, named_l1_distance, score_columns
from paceline.functions.vectors import dot
from paceline.schemas import DAY_KEY, PROPOSAL_KEY

# Rows per bucket when a running figure is split over tasks.
BUCKET = 4096


def column_sums(matrix_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: number of rows and the vector of column sums.

    Summing the days first turns "days × tickers × proposals" into one dot
    product per proposal. The sums combine map-side, so a key holding most rows
    sends one partial row per ticker and task.
    """
    per_ticker = (
        matrix_rows.select(*keys, F.posexplode("values").alias("idx", "value"))
        .groupBy(*keys, "idx")
        .agg(F.sum("value").alias("total"), F.count("*").alias("n_rows"))
    )
    # One entry per ticker: as many as a matrix row has cells.
    return per_ticker.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"),
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "total"))), lambda e: e["total"]).alias("sums"),
    )


def forward_pnl(proposals: DataFrame, sums: DataFrame, vols: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Window length, summed and mean return and risk per proposal.

    Proposals whose product has no returns or no risk figure drop out; see
    `skipped`. Weights and returns are matched by position.
    """
    pnl = dot(F.col("weights"), F.col("sums"))
    return (
        proposals.join(sums, list(keys))
        .join(vols.select("product", "vol"), "product")
        .select(
            *proposals.columns,
            F.col("n_rows").cast("int").alias("forward_window_days"),
            pnl.alias("forward_5d_pnl"),
            (pnl / F.col("n_rows")).alias("forward_5d_mean_return"),
            F.col("vol").alias("forward_realized_vol_21d"),
        )
    )


def skipped(proposals: DataFrame, sums: DataFrame, vols: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Proposals without forward returns or without a risk figure, with the reason."""
    has_returns = sums.select(*keys).distinct().withColumn("_returns", F.lit(True))
    has_vol = vols.select("product").distinct().withColumn("_vol", F.lit(True))
    reason = F.when(F.col("_returns").isNull(), "no forward returns").when(
        F.col("_vol").isNull(), "no trailing vol"
    )
    return (
        proposals.join(has_returns, list(keys), "left")
        .join(has_vol, "product", "left")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .drop("_returns", "_vol")
    )


def outcome_rows(realised: DataFrame, previous: DataFrame, rule: ScoreRule) -> DataFrame:
    """Score realised proposals against the previous best of their product.

    `previous` has one row per (date, product) with prev_weights and
    prev_column_names; weights are matched by ticker.
    """
    turnover = named_l1_distance(
        F.col("weights"), F.col("column_names"), F.col("prev_weights"), F.col("prev_column_names")
    )
    joined = realised.join(
        previous.select(*DAY_KEY, "prev_weights", "prev_column_names"), DAY_KEY, "left"
    )
    scores = score_columns(
        rule, F.col("forward_5d_mean_return"), F.col("forward_realized_vol_21d"), turnover
    )
    return joined.select(
        *PROPOSAL_KEY,
        "eval_date",
        "forward_window_days",
        "forward_5d_pnl",
        "forward_5d_mean_return",
        "forward_realized_vol_21d",
        *scores,
    )


def in_sample_stats(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, Sharpe ratio and worst drawdown of daily returns (keys, t, pnl).

    The running sum is taken inside buckets of consecutive t and the buckets
    are then chained, so one long series is spread over tasks. t is unique per
    key; the peak starts at the first value. The deviation is Spark's own, so a
    constant series has none and its ratio is 0.
    """
    bucketed = daily.withColumn("bucket", F.floor(F.col("t") / F.lit(BUCKET)))
    inside = Window.partitionBy(*keys, "bucket").orderBy("t")
    local = bucketed.withColumn("run", F.sum("pnl").over(inside)).withColumn(
        "drop", F.col("run") - F.max("run").over(inside)
    )
    buckets = local.groupBy(*keys, "bucket").agg(
        F.sum("pnl").alias("gain"),
        F.max("run").alias("high"),
        F.min("run").alias("low"),
        F.min("drop").alias("drop"),
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    chained = (
        buckets.withColumn("start", F.coalesce(F.sum("gain").over(earlier), F.lit(0.0)))
        .withColumn("peak", F.max(F.col("start") + F.col("high")).over(earlier))
        .withColumn("worst", F.least("drop", F.col("start") + F.col("low") - F.col("peak")))
    )
    worst = chained.groupBy(*keys).agg(F.min("worst").alias("in_sample_max_dd"))
    figures = daily.groupBy(*keys).agg(
        F.count("*").alias("n_days"),
        F.avg("pnl").alias("in_sample_mean_pnl"),
        F.stddev_pop("pnl").alias("spread"),
    )
    ratio = guarded_ratio(F.col("in_sample_mean_pnl"), F.col("spread"))
    return figures.join(worst, list(keys)).select(
        *keys, "n_days", "in_sample_mean_pnl", ratio.alias("in_sample_sharpe"), "in_sample_max_dd"
    )


def normalise(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Scale a long weight table to sum 1 per key.

    An aggregate and a join rather than a window, so that a key with very many
    rows is not gathered in one task.
    """
    totals = rows.groupBy(key).agg(F.sum(value).alias("_total"))
    return rows.join(totals, key).withColumn(out, F.col(value) / F.col("_total")).drop("_total")


def turnover(weights: DataFrame, links: DataFrame, earlier: DataFrame) -> DataFrame:
    """L1 distance of long weights (key, ticker, w) to those of a linked earlier key.

    `links` has one row per key with prev_key, null when there is none; `earlier`
    the long weights of the earlier keys, one basket per product and day. Written
    as  sum |w - p| - |p|  over the current tickers  +  sum |p|  over all earlier
    ones, which needs no full outer join and no more rows than `weights`.
    """
    held = earlier.select(F.col("key").alias("prev_key"), "ticker", F.col("w").alias("p"))
    mass = held.groupBy("prev_key").agg(F.sum(F.abs("p")).alias("mass"))
    p = F.coalesce(F.col("p"), F.lit(0.0))
    partial = (
        weights.join(links, "key")
        .join(held, ["prev_key", "ticker"], "left")
        .groupBy("key", "prev_key")
        .agg(F.sum(F.abs(F.col("w") - p) - F.abs(p)).alias("moved"))
    )
    return partial.join(mass, "prev_key", "left").select(
        "key", "prev_key", (F.col("moved") + F.coalesce(F.col("mass"), F.lit(0.0))).alias("turnover")
    )
