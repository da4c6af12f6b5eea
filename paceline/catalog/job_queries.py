"""The daily jobs run against stores, with histories taken from the given tables."""

from __future__ import annotations

from datetime import date
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline import schemas
from paceline.catalog import check_sql as C
from paceline.catalog import views
from paceline.catalog.model_queries import DIM, DRAW_U, SEED, digit_solver, grid_sql
from paceline.catalog.registry import query, rounded, sql_rounded
from paceline.catalog.score_queries import FORWARD
from paceline.functions.score import ScoreRule
from paceline.operators import arms
from paceline.operators.attempts import matrix_solver
from paceline.operators.moments import arm_moments, merged
from paceline.plans.daily import choose, propose_today, record_outcomes
from paceline.schemas import DAY_KEY, FAMILIES, FEATURES, PRODUCTS, PROPOSAL_KEY
from paceline.session import scratch_path
from paceline.sources.grid import config_grid
from paceline.sources.moments import MomentStore
from paceline.sources.tables import TableStore

FIRST, TODAY = date(2000, 1, 1), date(2000, 1, 1)
RECORDED = date(2000, 1, 4)


def in_layout(rows: DataFrame, table: str, **given: Column) -> DataFrame:
    """Rows in a table's layout: given columns, else the row's own, else a zero or an empty text."""
    blank = {"string": F.lit(""), "int": F.lit(0), "double": F.lit(0.0), "date": F.lit(FIRST)}
    columns = []
    for field in schemas.schema(table).fields:
        name, kind = field.name, field.dataType.simpleString()
        if name == schemas.VERSION_COLUMN:
            continue
        own = F.col(name) if name in rows.columns else blank.get(kind, F.lit(None))
        columns.append(given.get(name, own).cast(field.dataType).alias(name))
    return rows.select(*columns)


#: Vectors of one matrix and label: dates follow one another in blocks of so many.
MATRIX_ROWS = 128


def dated_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """A matrix for each label and block of vectors: the block gives the date."""
    day = F.date_add(F.lit(FIRST), F.floor(F.col("t") / MATRIX_ROWS).cast("int"))
    return views.matrix_rows(spark, sf).withColumn("date", day)


def inverse_variance(attempt: dict, matrix: np.ndarray) -> dict:
    """Weights by inverse variance; the configuration's key tells which attempts fail, and how."""
    digit = attempt["config_hash"][0]
    if digit >= "c":
        raise ValueError(f"no solution for {digit}")
    if digit >= "8":
        return {"solver_status": "infeasible"}
    variance = matrix.var(axis=0)
    if (variance < 1e-12).any():
        raise ValueError("a ticker does not move")
    weights = 1 / variance / (1 / variance).sum()
    pnl = matrix @ weights
    run = np.cumsum(pnl)
    return {
        "weights": weights.tolist(),
        "column_names": [f"S{j:02d}" for j in range(matrix.shape[1])],
        "n_names": matrix.shape[1],
        "in_sample_sharpe": float(pnl.mean() / pnl.std()),
        "in_sample_mean_pnl": float(pnl.mean()),
        "in_sample_max_dd": float((run - np.maximum.accumulate(run)).min()),
        "solver_status": "optimal",
        "solve_time_seconds": 0.0,
    }


def matrix_slots(matrices: DataFrame) -> DataFrame:
    """A slot for each family on every (date, product) that has a matrix."""
    days = matrices.select(*DAY_KEY).distinct().withColumn("proposal_type", F.lit("candidate"))
    return days.select("*", F.posexplode(F.lit(FAMILIES)).alias("slot", "family"))


def solved_with_matrices(spark: SparkSession, sf: str, purpose: str) -> tuple[DataFrame, list[DataFrame]]:
    matrices, failed = dated_matrices(spark, sf), []
    store = TableStore(spark, scratch_path(spark, purpose))
    slots = store.staged(matrix_slots(matrices), "slots")
    solve = matrix_solver(inverse_variance, matrices)
    found = choose(slots, config_grid(spark), solve, SEED, lambda tried: store.staged(tried, "attempts"), failed=failed)
    return found, failed


MATRIX_ATTEMPTS = [
    f"""cells AS (SELECT cast(DATE '{FIRST}' + cast(vec_id // {MATRIX_ROWS} AS integer) AS date) AS date, cast(label AS varchar) AS product,
      vec_id AS t, cast(unnest(range(len(embedding))) AS bigint) AS idx, cast(unnest(embedding) AS double) AS value FROM embeddings)""",
    "spread AS (SELECT date, product, idx, var_pop(value) AS v FROM cells GROUP BY 1, 2, 3)",
    "still AS (SELECT date, product, min(v) < 1e-12 AS still FROM spread GROUP BY 1, 2)",
    "weights AS (SELECT date, product, idx, 1 / v / sum(1 / v) OVER (PARTITION BY date, product) AS w FROM spread WHERE v > 0)",
    "daily AS (SELECT date, product, t, sum(value * w) AS pnl FROM cells JOIN weights USING (date, product, idx) GROUP BY 1, 2, 3)",
    "runs AS (SELECT *, sum(pnl) OVER (PARTITION BY date, product ORDER BY t) AS run FROM daily)",
    "drops AS (SELECT *, run - max(run) OVER (PARTITION BY date, product ORDER BY t) AS d FROM runs)",
    "figures AS (SELECT date, product, avg(pnl) AS mean_pnl, avg(pnl) / stddev_pop(pnl) AS sharpe, min(d) AS max_dd FROM drops GROUP BY 1, 2)",
    "firsts AS (SELECT date, product, w AS first_weight FROM weights WHERE idx = 0)",
    f"slots AS (SELECT still.*, f.slot, f.family FROM still, (VALUES {', '.join(f'({k}, {f!r})' for k, f in enumerate(FAMILIES))}) f(slot, family))",
    grid_sql(),
    f"tries AS (SELECT *, {DRAW_U} AS u FROM slots, (VALUES (0), (1), (2), (3)) a(attempt))",
    """tried AS (SELECT tries.*, grid.config_hash,
      CASE WHEN config_hash[1] >= 'c' THEN 'solver_error' WHEN config_hash[1] >= '8' THEN 'infeasible'
           WHEN still THEN 'solver_error' ELSE 'optimal' END AS solver_status,
      CASE WHEN config_hash[1] >= 'c' THEN 'ValueError: no solution for ' || config_hash[1]
           WHEN config_hash[1] < '8' AND still THEN 'ValueError: a ticker does not move' END AS failure
      FROM tries JOIN grid ON grid.family = tries.family AND grid.idx = cast(floor(u * grid.grid_size) AS integer))""",
    """numbered AS (SELECT *, sum(cast(solver_status = 'optimal' AS integer)) OVER (PARTITION BY date, product, slot ORDER BY attempt) AS solved
      FROM tried)""",
]


@query(
    C.with_(*MATRIX_ATTEMPTS)
    + f"""SELECT date, product, family, cast(attempt AS integer) AS attempt, config_hash,
      {sql_rounded('first_weight', 'first_weight', 8)}, {sql_rounded('mean_pnl', 'in_sample_mean_pnl', 8)},
      {sql_rounded('sharpe', 'in_sample_sharpe')}, {sql_rounded('max_dd', 'in_sample_max_dd', 8)}
    FROM numbered JOIN figures USING (date, product) JOIN firsts USING (date, product)
    WHERE solver_status = 'optimal' AND solved = 1"""
)
def matrix_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Slots solved by a function that gets each (date, product)'s matrix."""
    found, _ = solved_with_matrices(spark, sf, "matrix_attempts")
    found = found.withColumn("first_weight", F.col("weights")[0])
    figures = [rounded("first_weight", 8), rounded("in_sample_mean_pnl", 8), rounded("in_sample_sharpe"), rounded("in_sample_max_dd", 8)]
    return found.select(*DAY_KEY, "family", "attempt", "config_hash", *figures)


@query(
    C.with_(*MATRIX_ATTEMPTS)
    + """SELECT date, product, family, cast(attempt AS integer) AS attempt, config_hash, solver_status, failure
    FROM numbered WHERE solved = 0"""
)
def failed_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """What was tried in vain on the way, with the verdict or the exception's text."""
    _, failed = solved_with_matrices(spark, sf, "failed_attempts")
    rows = reduce(DataFrame.unionByName, failed)
    return rows.select(*DAY_KEY, "family", "attempt", "config_hash", "solver_status", "failure")


NAMED_WEIGHTS = [
    *FORWARD[:5],
    """wp AS (SELECT * REPLACE (cast(DATE '2000-01-01' + cast((date - DATE '2000-01-01') % 4 AS integer) AS date) AS date) FROM wprop)""",
    "named AS (SELECT p.vec_id, w.idx + day(p.date) % 2 AS ticker, w.w FROM wp p JOIN wlong w USING (vec_id))",
    "fwd AS (SELECT vec_id, count(*) AS n_days, sum(pnl) AS pnl, avg(pnl) AS mean FROM daily GROUP BY 1)",
    "bests AS (SELECT product, date, max(config_hash) AS config_hash FROM wp WHERE proposal_type = 'best' GROUP BY 1, 2)",
    """link AS (SELECT p.vec_id, q.vec_id AS prev_id FROM wp p LEFT JOIN wp q ON q.config_hash = (SELECT b.config_hash FROM bests b
      WHERE b.product = p.product AND b.date < p.date ORDER BY b.date DESC LIMIT 1) WHERE p.date = DATE '2000-01-04')""",
    """pairs AS (SELECT link.vec_id, ticker, w FROM link JOIN named USING (vec_id)
      UNION ALL SELECT link.vec_id, ticker, -w FROM link JOIN named ON named.vec_id = link.prev_id)""",
    """turn AS (SELECT vec_id, sum(abs(d)) AS turnover FROM (
      SELECT vec_id, ticker, sum(w) AS d FROM pairs GROUP BY 1, 2) GROUP BY 1)""",
]


@query(
    C.with_(*NAMED_WEIGHTS)
    + f"""SELECT p.date, p.product, p.config_hash, DATE '2000-01-11' AS eval_date, cast(n_days AS integer) AS forward_window_days,
      {sql_rounded('pnl', 'forward_5d_pnl', 8)}, {sql_rounded('turnover', 'turnover_vs_prev_best', 8)},
      {sql_rounded('mean / vol - 0.3 * turnover', 'meta_score', 8)}
    FROM wp p JOIN fwd USING (vec_id) JOIN risk USING (product) JOIN turn USING (vec_id)"""
)
def outcomes_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals of four days stored, the last day's outcomes recorded and read back.

    Tickers are shifted by one on every other day, so turnover goes by name.
    """
    store = TableStore(spark, scratch_path(spark, "outcomes_recorded"))
    proposals = views.weighted_proposals(spark, sf)
    day = F.date_add(F.lit(FIRST), (F.datediff("date", F.lit(FIRST)) % 4).cast("int"))
    shift = (F.day("date") % 2).cast("int")
    names = F.transform(F.sequence(F.lit(0), F.size("weights") - 1), lambda j: F.format_string("S%02d", j + shift))
    stored = in_layout(
        proposals.withColumn("date", day).withColumn("column_names", names),
        "proposals",
        family=F.lit(FAMILIES[0]),
        n_names=F.size("weights"),
        solver_status=F.lit("optimal"),
    )
    store.write_proposals(stored)
    rule = ScoreRule("continuous", 0.3)
    found = record_outcomes(store, RECORDED, date(2000, 1, 11), views.matrix_rows(spark, sf), views.risk(spark, sf), rule=rule)
    doubles = [rounded(c, 8) for c in ("forward_5d_pnl", "turnover_vs_prev_best", "meta_score")]
    return found.select(*PROPOSAL_KEY, "eval_date", "forward_window_days", *doubles)


NAMED_PROP = [
    C.PROP.replace("prop AS (", "prop0 AS (", 1),
    f"prop AS (SELECT * REPLACE ({C.product_name()} AS product, {C.family_name()} AS family) FROM prop0)",
]
PROPOSED_TODAY = [
    *NAMED_PROP,
    C.LINES,
    C.FEAT,
    C.OUTC,
    C.training(str(TODAY)),
    C.scaler(),
    C.standardised(),
    C.gram(),
    f"market AS (SELECT {', '.join(f'avg({f}) AS {f}' for f in FEATURES)} FROM feat)",
    f"ctx AS (SELECT DATE '{TODAY}' AS date, p.product, market.* FROM market, (VALUES {', '.join(f'({p!r})' for p in PRODUCTS)}) p(product))",
    C.arms_spine("(SELECT * FROM ctx LEFT JOIN scal USING (product))", FAMILIES),
    C.precision("date, product, family", "spine", C.x_cells(DIM + 1)),
    C.eliminate("date, product, family, " + C.x_names(), DIM + 2),
    C.predicted("date, product, family"),
    C.drawn(SEED),
    C.SLOTS,
    grid_sql(),
    f"tries AS (SELECT *, {DRAW_U} AS u FROM slots, (VALUES (0), (1), (2), (3)) a(attempt))",
    """tried AS (SELECT tries.*, grid.config_json, grid.config_hash,
      CASE WHEN grid.config_hash[1] < '5' THEN 'optimal' WHEN grid.config_hash[1] < '8' THEN 'optimal_inaccurate'
           ELSE 'infeasible' END AS solver_status
      FROM tries JOIN grid ON grid.family = tries.family AND grid.idx = cast(floor(u * grid.grid_size) AS integer))""",
]


def solved(attempts: DataFrame) -> DataFrame:
    """Equal weights on the matrix's names, with the verdict of the configuration's key."""
    names = [f"S{j:02d}" for j in range(4)]
    return digit_solver(attempts).withColumns(
        {
            "weights": F.lit([0.25] * 4),
            "column_names": F.lit(names),
            "n_names": F.lit(4),
            **{c: F.lit(0.0) for c in ("in_sample_sharpe", "in_sample_mean_pnl", "in_sample_max_dd", "solve_time_seconds")},
        }
    )


def write_history(store: TableStore, sf: str) -> DataFrame:
    """Store the given tables as features, proposals and outcomes; the features."""
    spark = store.spark
    features = views.named_products(views.features(spark, sf))
    store.write_features(features)
    store.write_proposals(
        in_layout(
            views.named(views.proposals(spark, sf)),
            "proposals",
            solver_status=F.lit("optimal"),
            weights=F.array(F.lit(1.0)),
            column_names=F.array(F.lit("S00")),
            n_names=F.lit(1),
        )
    )
    outcomes = views.named_products(views.outcomes(spark, sf))
    store.write_outcomes(in_layout(outcomes, "outcomes", meta_score_mode=F.lit("research")))
    return features


@query(
    C.with_(*PROPOSED_TODAY)
    + f"""SELECT date, product, family, proposal_type, config_hash, solver_status, {sql_rounded('posterior_mean', 'posterior_mean')},
      {sql_rounded('posterior_std', 'posterior_std')}
    FROM (SELECT *, row_number() OVER (PARTITION BY date, product, slot ORDER BY attempt) AS r
          FROM tried WHERE solver_status <> 'infeasible') WHERE r = 1"""
)
def proposals_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The day's cycle on a store that holds the whole history; its proposals read back.

    Two of the three order statuses stand for products that are proposed for.
    """
    store = TableStore(spark, scratch_path(spark, "proposals_stored"))
    features = write_history(store, sf)
    market = features.agg(*[F.avg(f).alias(f) for f in FEATURES]).first().asDict()
    matrices = spark.createDataFrame([(p, t, [0.01] * 4) for p in PRODUCTS for t in range(5)], "product string, t int, values array<double>")
    propose_today(store, TODAY, market, matrices, solved, seed=SEED)
    made = store.read_proposals(TODAY, TODAY).where("weights[0] = 0.25")
    return made.select(*DAY_KEY, "family", "proposal_type", "config_hash", "solver_status", rounded("posterior_mean"), rounded("posterior_std"))


MERGED_FIT = [
    *NAMED_PROP,
    C.LINES,
    C.FEAT,
    C.OUTC,
    C.training(str(TODAY)),
    C.scaler(),
    C.standardised(),
    C.gram(),
    C.arms_spine("(SELECT DISTINCT product FROM train)", FAMILIES),
    C.precision("product, family", "spine"),
    C.eliminate("product, family", DIM + 1),
]
MU_NAMES = [f"mu_{i}" for i in range(DIM)]


@query(
    C.with_(*MERGED_FIT)
    + f"""SELECT product, family, n, {', '.join(sql_rounded(f'm_{i}_{DIM}', name) for i, name in enumerate(MU_NAMES))} FROM m{DIM}"""
)
def moments_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The posterior from stored moments: merged by month, by year, then by arm.

    The moments of all dates are stored, then those of three days computed anew in their place.
    """
    store = TableStore(spark, scratch_path(spark, "moments_stored"))
    features = write_history(store, sf)
    kept = MomentStore(store)
    kept.rebuild()
    days = features.select("date").distinct().orderBy(F.xxhash64("date")).limit(3)
    kept.refresh([r["date"] for r in days.collect()])
    rows = kept.read(TODAY)
    arm = ["product", "family"]
    monthly = merged(rows.withColumn("month", F.trunc("eval_date", "month")), [*arm, "month"])
    yearly = merged(monthly.withColumn("year", F.year("month")), [*arm, "year"])
    contexts = features.groupBy("product").agg(F.max("date").alias("date"), *[F.max(f).alias(f) for f in FEATURES])
    solved = arms.posterior(arms.with_prior_arms(contexts, arm_moments(yearly), FAMILIES))
    return solved.selectExpr(*arm, "n", *[f"round(mu[{i}], 6) + 0D AS {name}" for i, name in enumerate(MU_NAMES)])
