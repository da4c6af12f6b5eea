"""The daily cycle: propose, record outcomes, record decisions."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline import schemas
from paceline.functions.canonical import not_finite
from paceline.functions.score import ScoreRule
from paceline.functions.vectors import pick_by_name
from paceline.operators.arms import ALPHA, SIGMA_SQ, moments, slots_fitted
from paceline.operators.attempts import MAX_ATTEMPTS, failed_attempts, first_success, plan_attempt
from paceline.operators.moments import arm_moments
from paceline.operators.portfolio import column_sums, forward_pnl, outcome_rows, skipped
from paceline.operators.quality import unmatched_decisions
from paceline.operators.training import arm_days, previous_best_by_day
from paceline.sources.grid import config_grid
from paceline.sources.matrices import SHARED, matrix_reference
from paceline.sources.moments import MomentStore
from paceline.sources.tables import TableStore

SLOT_KEY = ["date", "product", "proposal_type", "slot"]

# A solver takes the attempts (date, product, family, attempt, config_json, …) and
# returns them with weights, column_names, n_names, in_sample_sharpe,
# in_sample_mean_pnl, in_sample_max_dd, solver_status and solve_time_seconds.
Solver = Callable[[DataFrame], DataFrame]


def fan_out(market: DataFrame, products: Sequence[str]) -> DataFrame:
    """One feature row per product from one market row per date."""
    return market.withColumn("product", F.explode(F.array(*[F.lit(p) for p in products])))


def choose(
    slots: DataFrame,
    grid: DataFrame,
    solve: Solver,
    seed: object,
    keep: Callable[[DataFrame], DataFrame],
    ties: Sequence[str] = (),
    attempts: int = MAX_ATTEMPTS,
    failed: list[DataFrame] | None = None,
) -> DataFrame:
    """A configuration per slot: draw and solve, and again for the slots left without a solution.

    `keep` writes a round's results and reads them back, so that each attempt is
    solved once; a slot that is solved is not tried again. The attempts without a
    solution of each round are added to `failed`.
    """
    found, left = [], slots
    for attempt in range(attempts):
        results = keep(solve(plan_attempt(left, grid, seed, ["date", "product", "family"], attempt)))
        solved = first_success(results, SLOT_KEY, ties)
        found.append(solved)
        if failed is not None:
            failed.append(failed_attempts(results))
        left = left.join(solved.select(*SLOT_KEY), SLOT_KEY, "left_anti")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def proposal_rows(chosen: DataFrame) -> DataFrame:
    """Chosen slots in the proposals layout."""
    reference = matrix_reference(F.col("date"), F.col("product"), F.col("config_hash"))
    return (
        chosen.withColumn("config_schema_version", F.lit(1))
        .withColumn("pnl_matrix_path", reference)
        .select(*schemas.data_columns("proposals"))
    )


def summary(slots: DataFrame) -> DataFrame:
    """Per (date, product): how many proposals, and families and types in slot order.

    At most one row per slot enters a list.
    """

    def listed(name: str) -> Column:
        entries = F.sort_array(F.collect_list(F.struct("slot", name)))
        return F.array_join(F.transform(entries, lambda e: e[name]), ",")

    return slots.groupBy(*schemas.DAY_KEY).agg(
        F.count("*").alias("n_proposals"),
        listed("family").alias("families"),
        listed("proposal_type").alias("types"),
    )


def totals(slots: DataFrame) -> DataFrame:
    """Per date: products and proposals."""
    return (
        slots.groupBy(*schemas.DAY_KEY)
        .agg(F.count("*").alias("n"))
        .groupBy("date")
        .agg(F.count("*").alias("n_products"), F.sum("n").alias("n_proposals_total"))
    )


def propose_today(
    store: TableStore,
    today: date,
    features: Mapping[str, float],
    matrices: DataFrame,
    solve: Solver,
    products: Sequence[str] = tuple(schemas.PRODUCTS),
    alpha: float = ALPHA,
    sigma_sq: float = SIGMA_SQ,
    seed: object = 0,
) -> DataFrame:
    """Run the cycle for one day, store features, matrices and proposals, return the summary.

    Attempts that found no solution are kept, see `TableStore.read_failed_attempts`. A
    store that keeps moments (`MomentStore.rebuild`) is fitted from them; else from the
    whole history.
    `matrices` has one row per matrix row: product, t, values.
    """
    missing = set(schemas.FEATURES) - set(features)
    if missing:
        raise ValueError(f"missing features: {sorted(missing)}")
    odd = sorted(f for f in schemas.FEATURES if not math.isfinite(float(features[f])))
    if odd:
        raise ValueError(f"features are not finite: {odd}")
    unknown = set(products) - set(schemas.PRODUCTS)
    if unknown:
        raise ValueError(f"unknown products: {sorted(unknown)}")
    spark = store.spark
    width = F.size("values")
    shapes = matrices.groupBy("product").agg(F.min(width).alias("least"), F.max(width).alias("most"))
    widths = {r["product"]: (r["least"], r["most"]) for r in shapes.collect()}  # one row per product
    absent = sorted(set(products) - set(widths))
    if absent:
        raise ValueError(f"no matrix for products: {absent}")
    ragged = sorted(p for p, (least, most) in widths.items() if least != most or not least or least < 1)
    if ragged:
        raise ValueError(f"matrix rows differ in width or are empty for products: {ragged}")
    market = spark.createDataFrame(
        [(today, *[float(features[f]) for f in schemas.FEATURES])],
        "date date, " + ", ".join(f"{f} double" for f in schemas.FEATURES),
    )
    contexts = fan_out(market, products).select(*schemas.DAY_KEY, *schemas.FEATURES)
    store.write_features(contexts)
    stored = MomentStore(store)
    if stored.kept():
        stored.refresh([today])  # today's features may replace others
        fitted = arm_moments(stored.read(today, list(products)))
    else:
        rows = arm_days(
            store.read_proposals(products=list(products)),
            store.read_features(products=list(products)),
            store.read_outcomes(products=list(products)),
            today,
        )
        fitted = moments(rows)
    slots = slots_fitted(contexts, fitted, seed, alpha=alpha, sigma_sq=sigma_sq)
    failed: list[DataFrame] = []
    with store.job():
        slots = store.staged(slots, "slots")
        keep = lambda tried: store.staged(tried, "attempts")
        kept = choose(slots, config_grid(spark), solve, seed, keep, failed=failed)
        store.write_report("failed_attempts", today, reduce(DataFrame.unionByName, failed))
        if not kept.isEmpty():
            shared = matrices.select(
                F.lit(today).alias("date"), "product", F.lit(SHARED).alias("config_hash"), "t", "values"
            )
            store.write_proposals(proposal_rows(kept), shared)
        report = summary(kept)
        return spark.createDataFrame(report.collect(), report.schema)  # one row per product


def record_outcomes(
    store: TableStore,
    propose_date: date,
    eval_date: date,
    returns: DataFrame,
    vols: DataFrame,
    column_names: Sequence[str] | None = None,
    rule: ScoreRule | None = None,
) -> DataFrame:
    """Score the proposals of a day from realised returns and store the outcomes.

    `returns`: product, t, values; `vols`: product, vol. With `column_names` the
    returns are matched to a proposal's weights by ticker, else by position. Proposals
    whose product has no returns or risk figure, or whose figures are NaN or infinite,
    get no outcome; `TableStore.read_skipped_outcomes` tells which, and why.
    """
    rule = rule or ScoreRule()
    if column_names is not None and len(set(column_names)) < len(column_names):
        repeated = sorted({c for c in column_names if list(column_names).count(c) > 1})
        raise ValueError(f"returns have several columns for tickers: {repeated}")
    proposals = store.read_proposals(propose_date, propose_date)
    if proposals.isEmpty():
        raise ValueError(f"no proposals found for {propose_date}")
    sums = column_sums(returns, ["product"])
    todays = proposals.select(*schemas.PROPOSAL_KEY, "weights", "column_names")
    if column_names is not None:
        names = F.array(*[F.lit(c) for c in column_names])
        by_name = todays.join(sums, "product").withColumn(
            "sums", pick_by_name(F.col("column_names"), names, F.col("sums"))
        )
        realised = _realise(by_name, vols)
    else:
        realised = forward_pnl(todays, sums, vols, ["product"])
    realised = realised.withColumn("eval_date", F.lit(eval_date))
    history = store.read_proposals(end_date=propose_date)
    previous = previous_best_by_day(history, ["weights", "column_names"], propose_date)
    missing = skipped(todays.select(*schemas.PROPOSAL_KEY), sums, vols, ["product"])
    with store.job():
        made = store.staged(outcome_rows(realised, previous, rule), "outcomes")
        odd = F.lit(False)
        for field in schemas.schema("outcomes").fields:
            if field.dataType.typeName() == "double":
                odd = odd | not_finite(F.col(field.name))
        odd = F.coalesce(odd, F.lit(False))
        reasons = made.where(odd).select(*schemas.PROPOSAL_KEY, F.lit("a figure is not finite").alias("reason"))
        store.write_report("outcomes_skipped", propose_date, missing.select(*schemas.PROPOSAL_KEY, "reason").unionByName(reasons))
        outcomes = made.where(~odd)
        if outcomes.isEmpty():
            raise ValueError(f"no outcomes could be computed for {propose_date}")
        store.write_outcomes(outcomes)
        if MomentStore(store).kept():
            MomentStore(store).refresh([propose_date])
    return store.read_outcomes(propose_date, propose_date)


def _realise(with_sums: DataFrame, vols: DataFrame) -> DataFrame:
    proposals = with_sums.drop("sums", "n_rows")
    keyed = with_sums.select(*schemas.PROPOSAL_KEY, "sums", "n_rows")
    return forward_pnl(proposals, keyed, vols, schemas.PROPOSAL_KEY)


def record_decisions(store: TableStore, decisions: DataFrame) -> None:
    """Append a batch of decisions; any that names no stored proposal fails the batch."""
    bounds = decisions.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
    stray = unmatched_decisions(decisions, store.read_proposals(bounds["first"], bounds["last"]))
    with store.job():
        stray = store.staged(stray.select(*schemas.PROPOSAL_KEY, "problem"), "stray")
        counts = stray.groupBy("problem").count().orderBy("problem").collect()  # two rows
        if counts:
            found = ", ".join(f"{r['count']} with {r['problem']}" for r in counts)
            raise ValueError(f"decisions without a proposal: {found} ({store.listed(stray, 'decisions')})")
        store.append_decisions(decisions)


def record_decision(
    store: TableStore,
    propose_date: date,
    config_hash: str,
    product: str,
    decision: str,
    notes: str | None = None,
    modified_config_hash: str | None = None,
    decided_at: datetime | None = None,
) -> None:
    """Append one decision, stamped with the current time unless one is given."""
    row = (
        propose_date,
        product,
        config_hash,
        decision,
        decided_at or datetime.now(timezone.utc),
        notes,
        modified_config_hash,
    )
    layout = ", ".join(
        f"{f.name} {f.dataType.simpleString()}"
        for f in schemas.schema("decisions").fields
        if f.name != schemas.VERSION_COLUMN
    )
    record_decisions(store, store.spark.createDataFrame([row], layout))
