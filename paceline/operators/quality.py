"""Rule reports: every rule is a predicate that marks violating rows.

All rules of a table are counted in one pass over it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline import schemas


def outside(column: str, allowed: Sequence[str]) -> Column:
    """True for values outside a domain; null is outside every domain."""
    return F.col(column).isNull() | ~F.col(column).isin(list(allowed))


def lengths_differ(left: str, right: str) -> Column:
    return F.size(left) != F.size(right)


def replacement_mismatch() -> Column:
    """`modified` goes with a replacement hash, every other decision without one."""
    modified = F.coalesce(F.col("decision") == "modified", F.lit(False))
    return modified != F.col("modified_config_hash").isNotNull()


def null_rules(table: str) -> dict[str, Column]:
    return {f"{c}: null": F.col(c).isNull() for c in schemas.required_columns(table)}


def proposal_rules() -> dict[str, Column]:
    return {
        "family: outside domain": outside("family", schemas.FAMILIES),
        "proposal_type: outside domain": outside("proposal_type", schemas.PROPOSAL_TYPES),
        "solver_status: outside domain": outside("solver_status", schemas.SOLVER_STATUSES),
        "weights: length differs from column_names": lengths_differ("weights", "column_names"),
    }


def decision_rules() -> dict[str, Column]:
    return {
        "decision: outside domain": outside("decision", schemas.DECISIONS),
        "modified_config_hash: set if and only if modified": replacement_mismatch(),
    }


def rule_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations) for every rule, zero counts included, in one aggregation."""
    counts = [F.count_if(F.coalesce(p, F.lit(False))).alias(f"r{i}") for i, p in enumerate(rules.values())]
    pairs = [
        F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"))
        for i, name in enumerate(rules)
    ]
    return df.agg(*counts).select(F.inline(F.array(*pairs)))


def bad_values(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """(column, value, rows) for every value outside its column's domain, in one pass."""
    tagged = [
        F.when(
            outside(name, allowed),
            F.struct(F.lit(name).alias("column"), F.col(name).cast("string").alias("value")),
        )
        for name, allowed in domains.items()
    ]
    return (
        df.select(F.inline(F.array_compact(F.array(*tagged))))
        .groupBy("column", "value")
        .agg(F.count("*").alias("rows"))
    )


def broken_rules(df: DataFrame, rules: Mapping[str, Column]) -> list[str]:
    """Every broken rule and how often it is broken."""
    broken = rule_report(df, rules).where("violations > 0").collect()
    return [f"{r['rule']} ({r['violations']} rows)" for r in broken]


def refuse(table: str, problems: Sequence[str]) -> None:
    """Raise once, naming all problems; nothing to name, nothing raised."""
    if problems:
        raise ValueError(f"{table}: {len(problems)} rule(s) broken: {'; '.join(problems)}")


def require_clean(df: DataFrame, rules: Mapping[str, Column], table: str) -> None:
    refuse(table, broken_rules(df, rules))


def unmatched_decisions(decisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Decisions that name no stored proposal, with the reason."""
    hashes = proposals.select(*schemas.PROPOSAL_KEY)
    days = proposals.select(*schemas.DAY_KEY).distinct().withColumn("_day_known", F.lit(True))
    return (
        decisions.join(hashes, schemas.PROPOSAL_KEY, "left_anti")
        .join(days, schemas.DAY_KEY, "left")
        .withColumn(
            "problem",
            F.when(F.col("_day_known"), F.lit("unknown config_hash")).otherwise(
                F.lit("no proposals that day")
            ),
        )
        .drop("_day_known")
    )
