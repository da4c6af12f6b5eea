"""The score of a realised proposal and its parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below this size a volatility or deviation counts as zero.
NEAR_ZERO = 1e-12


@dataclass(frozen=True)
class ScoreRule:
    """`research` scores the return per unit of risk; `continuous` also charges turnover."""

    mode: str = "research"
    lambda_turnover: float = 0.0

    def __post_init__(self) -> None:
        if self.mode not in ("research", "continuous"):
            raise ValueError(f"unknown score mode {self.mode!r}")
        if self.mode == "continuous" and not self.lambda_turnover > 0:
            raise ValueError("a continuous score needs lambda_turnover > 0")
        if self.mode == "research" and self.lambda_turnover != 0:
            raise ValueError("a research score takes no lambda_turnover; leave it at 0")


def rule_violation(mode: Column, lam: Column) -> Column:
    """True where a row's (mode, lambda) pair breaks the rule above; null counts as broken."""
    fits = ((mode == "continuous") & (lam > 0)) | ((mode == "research") & (lam == 0))
    return ~F.coalesce(fits, F.lit(False))


def guarded_ratio(mean: Column, vol: Column) -> Column:
    return F.when(F.abs(vol) < NEAR_ZERO, F.lit(0.0)).otherwise(mean / vol)


def l1_distance(current: Column, previous: Column) -> Column:
    """L1 distance of two weight arrays on the same positions.

    Without a previous array the distance is taken from zero. Arrays of
    different length have no positional distance and give null.
    """
    from_zero = F.aggregate(current, F.lit(0.0), lambda total, w: total + F.abs(w))
    apart = F.aggregate(
        F.zip_with(current, previous, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda total, d: total + d
    )
    return F.when(previous.isNull(), from_zero).when(F.size(current) == F.size(previous), apart)


def named_l1_distance(
    current: Column, current_names: Column, previous: Column, previous_names: Column
) -> Column:
    """L1 distance of two weight arrays matched by ticker; an absent ticker weighs 0.

    The weights of a ticker that a side names several times are summed first. Equal
    lists of names are compared by position. Both sides are sorted by name together,
    the earlier one with its signs turned, and each name's sum is closed when the next
    name begins: no map, so no lookups and no rule against repeated names.
    """

    def entries(names: Column, weights: Column, sign: float) -> Column:
        return F.zip_with(names, weights, lambda n, w: F.struct(n.alias("name"), (w * F.lit(sign)).alias("w")))

    both = F.array_sort(F.concat(entries(current_names, current, 1.0), entries(previous_names, previous, -1.0)))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("run"))

    def add(acc: Column, e: Column) -> Column:
        same = acc["name"].eqNullSafe(e["name"])
        return F.struct(
            F.when(same, acc["total"]).otherwise(acc["total"] + F.abs(acc["run"])).alias("total"),
            e["name"].alias("name"),
            F.when(same, acc["run"] + e["w"]).otherwise(e["w"]).alias("run"),
        )

    apart = F.aggregate(both, start, add, lambda acc: acc["total"] + F.abs(acc["run"]))
    return (
        F.when(previous.isNull(), l1_distance(current, previous))
        .when(current_names == previous_names, l1_distance(current, previous))
        .otherwise(apart)
    )


def score_columns(rule: ScoreRule, mean: Column, vol: Column, turnover: Column) -> list[Column]:
    """The five score columns of an outcome row."""
    sharpe = guarded_ratio(mean, vol)
    if rule.mode == "research":
        charged, score = F.lit(None).cast("double"), sharpe
    else:
        charged, score = turnover, sharpe - F.lit(rule.lambda_turnover) * turnover
    return [
        sharpe.alias("forward_sharpe"),
        charged.alias("turnover_vs_prev_best"),
        score.alias("meta_score"),
        F.lit(rule.mode).alias("meta_score_mode"),
        F.lit(rule.lambda_turnover).cast("double").alias("lambda_used"),
    ]
