"""Queries of the grouped regression and the choice among families."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.catalog import check_sql as C
from paceline.catalog import views
from paceline.catalog.registry import query, rounded, sql_rounded
from paceline.functions import linalg
from paceline.operators import arms, training
from paceline.operators.keyed import last_per_key
from paceline.plans import walkforward
from paceline.plans.daily import choose, summary, totals
from paceline.schemas import FEATURES
from paceline.session import scratch_path
from paceline.sources.grid import config_grid
from paceline.sources.tables import TableStore

AS_OF = "2000-01-01"
CUT = date(2000, 1, 1)
SEED = 42
DIM, K = arms.DIM, arms.K
ARM = ["product", "family"]
SLOT = ["date", "product", "family"]
SIDES = [f"mean_{i}" for i in range(K)] + [f"std_{i}" for i in range(K)]


def history(spark: SparkSession, sf: str, as_of: date | None = CUT) -> DataFrame:
    return training.arm_days(
        views.proposals(spark, sf), views.features(spark, sf), views.outcomes(spark, sf), as_of
    )


def today(spark: SparkSession, sf: str) -> DataFrame:
    """The latest feature row per product on or before the cut-off."""
    past = views.features(spark, sf).where(F.col("date") <= F.lit(CUT))
    return last_per_key(past, ["product"], ["date"])


def placed_arms(spark: SparkSession, sf: str) -> DataFrame:
    return arms.with_prior_arms(
        today(spark, sf), arms.moments(history(spark, sf)), views.PRIORITIES
    )


def _entries(array: str, names: list[str]) -> list[str]:
    """Array entries as rounded columns."""
    return [f"round({array}[{i}], 6) + 0D AS {name}" for i, name in enumerate(names)]


VIEWS = [C.PROP, C.LINES, C.FEAT, C.OUTC]
TRAIN = [*VIEWS, C.training(AS_OF)]
FIT = [*TRAIN, C.scaler(), C.standardised(), C.gram()]
ROUNDED_ARM = "date, product, family, n_obs, " + ", ".join(
    sql_rounded(c, c) for c in ("posterior_mean", "posterior_std")
)


@query(
    C.with_(*TRAIN)
    + f"""SELECT product, family, count(*) AS n_obs, {sql_rounded('sum(meta_score)', 'score_sum')}
    FROM train GROUP BY 1, 2"""
)
def arm_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = history(spark, sf).groupBy(*ARM)
    counted = rows.agg(F.sum("n").alias("n_obs"), F.sum("score_sum").alias("score_sum"))
    return counted.select(*ARM, "n_obs", rounded("score_sum"))


@query(
    C.with_(*TRAIN, C.scaler())
    + f"SELECT product, n_rows, {', '.join(sql_rounded(c, c, 7) for c in SIDES)} FROM scal"
)
def scaler_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = arms.scaler(history(spark, sf)).selectExpr(
        "product",
        "n_rows",
        *[f"means[{i + 1}] AS mean_{i}" for i in range(K)],
        *[f"stds[{i + 1}] AS std_{i}" for i in range(K)],
    )
    return stats.select("product", "n_rows", *[rounded(c, 7) for c in SIDES])


Z = [f"z_{i}" for i in range(DIM)]


@query(
    C.with_(*TRAIN, C.scaler(), C.standardised())
    + f"""SELECT product, family, date, count(*) AS n, {', '.join(sql_rounded(f'min({c})', c) for c in Z)}
    FROM z GROUP BY 1, 2, 3"""
)
def standardized_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = history(spark, sf)
    scaled = arms.standardised_rows(rows, arms.scaler(rows))
    return scaled.selectExpr(*ARM, "date", "n", *_entries("z", Z))


GRAM = [f"g_{i}_{j}" for i, j in linalg.upper(DIM)]
CROSS = [f"h_{i}" for i in range(DIM)]


@query(C.with_(*FIT) + f"SELECT product, family, n, {', '.join(sql_rounded(c, c) for c in GRAM + CROSS)} FROM gram")
def gram_stats(spark: SparkSession, sf: str) -> DataFrame:
    cells = arms.standardised_moments(arms.moments(history(spark, sf)))
    return cells.selectExpr(*ARM, "n", *_entries("gram", GRAM), *_entries("cross", CROSS))


def _mu(solved: DataFrame) -> DataFrame:
    return solved.selectExpr(*ARM, "n", *_entries("mu", [f"mu_{i}" for i in range(DIM)]))


MU = ", ".join(sql_rounded(f"m_{i}_{DIM}", f"mu_{i}") for i in range(DIM))
SOLVE = [
    C.arms_spine("(SELECT DISTINCT product FROM train)"),
    C.precision("product, family", "spine"),
    C.eliminate("product, family", DIM + 1),
]


@query(C.with_(*FIT, *SOLVE) + f"SELECT product, family, n, {MU} FROM m{DIM}")
def posterior_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _mu(arms.posterior(placed_arms(spark, sf)))


@query(
    C.with_(*TRAIN)
    + f"""SELECT product, family, count(*) AS n_obs, {sql_rounded('sum(meta_score)', 'score_sum')},
      {sql_rounded('sum(meta_score * ' + FEATURES[1] + ')', 'cross_sum')}
    FROM train GROUP BY 1, 2"""
)
def condensed_training(spark: SparkSession, sf: str) -> DataFrame:
    """The condensed rows taken from the joined training table instead of the three tables."""
    joined = training.training_table(
        views.proposals(spark, sf),
        views.features(spark, sf),
        views.outcomes(spark, sf).drop("o_orderkey"),
        CUT,
    )
    sums = training.condense(joined).groupBy(*ARM).agg(
        F.sum("n").alias("n_obs"),
        F.sum("score_sum").alias("score_sum"),
        F.sum(F.col("score_sum") * F.col(FEATURES[1])).alias("cross_sum"),
    )
    return sums.select(*ARM, "n_obs", rounded("score_sum"), rounded("cross_sum"))


@query(
    C.with_(
        *TRAIN,
        f"pooled AS (SELECT {', '.join(f'avg({f}) AS mean_{i}, stddev_pop({f}) AS std_{i}' for i, f in enumerate(FEATURES))} FROM feat)",
        "scal AS (SELECT p.product, pooled.* FROM (SELECT DISTINCT product FROM train) p, pooled)",
        C.standardised(),
        C.gram(),
        *SOLVE,
    )
    + f"SELECT product, family, n, {MU} FROM m{DIM}"
)
def posterior_given_scaler(spark: SparkSession, sf: str) -> DataFrame:
    """One scaler for all products, taken from every feature row."""
    features = views.features(spark, sf)
    pooled = features.agg(
        F.array(F.lit(0.0), *[F.avg(f) for f in FEATURES]).alias("means"),
        F.array(F.lit(1.0), *[F.stddev_pop(f) for f in FEATURES]).alias("stds"),
    )
    scalers = pooled.withColumn("product", F.explode(F.lit(views.STATUSES)))
    fitted = arms.moments_with_scaler(history(spark, sf), scalers)
    return _mu(arms.posterior(arms.with_prior_arms(today(spark, sf), fitted, views.PRIORITIES)))


PREDICT = [
    *FIT,
    C.contexts(AS_OF),
    C.arms_spine("(SELECT * FROM ctx LEFT JOIN scal USING (product))"),
    C.precision("date, product, family", "spine", C.x_cells(DIM + 1)),
    C.eliminate("date, product, family, " + C.x_names(), DIM + 2),
    C.predicted("date, product, family"),
]


@query(C.with_(*PREDICT) + f"SELECT {ROUNDED_ARM} FROM pred")
def posterior_predict(spark: SparkSession, sf: str) -> DataFrame:
    predicted = arms.predict(placed_arms(spark, sf), SLOT)
    return predicted.select(*SLOT, "n_obs", rounded("posterior_mean"), rounded("posterior_std"))


UNIT = ", " + ", ".join(
    f"{1.0 if i == k else 0.0} AS m_{i}_{DIM + 1 + k}" for i in range(DIM) for k in range(DIM)
)
NORM = "sqrt(" + " + ".join(f"m_{i}_{DIM} * m_{i}_{DIM}" for i in range(DIM)) + ")"
TRACE = " + ".join(f"m_{i}_{DIM + 1 + i}" for i in range(DIM))


@query(
    C.with_(
        *FIT,
        C.arms_spine("(SELECT DISTINCT product FROM train)"),
        C.precision("product, family", "spine", UNIT),
        C.eliminate("product, family", 2 * DIM + 1),
    )
    + f"""SELECT product, family, n AS n_obs, {sql_rounded(NORM, 'posterior_mean_norm')},
      {sql_rounded(TRACE, 'posterior_trace')} FROM m{DIM}"""
)
def arm_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    found = arms.diagnostics(placed_arms(spark, sf))
    return found.select(*ARM, "n_obs", rounded("posterior_mean_norm"), rounded("posterior_trace"))


@query(
    C.with_(*PREDICT, C.drawn(SEED))
    + f"""SELECT date, product, family, {sql_rounded('sampled_value', 'sampled_value')},
      cast(row_number() OVER (PARTITION BY date, product ORDER BY sampled_value DESC, family) AS integer) AS arm_rank
    FROM drawn"""
)
def thompson_draws(spark: SparkSession, sf: str) -> DataFrame:
    drawn = arms.draw(arms.predict(placed_arms(spark, sf), SLOT), SEED, SLOT)
    ranked = arms.rank_arms(drawn, ["date", "product"])
    return ranked.select(*SLOT, rounded("sampled_value"), "arm_rank")


WEIGHTS = [f"w_{i}" for i in range(DIM)]
DRAW_WEIGHTS = [
    *FIT,
    C.arms_spine("(SELECT DISTINCT product FROM train)"),
    C.precision("product, family", "spine", UNIT),
    C.cholesky("product, family"),
    C.drawn_weights("product, family", SEED, "product", "family"),
]


@query(C.with_(*DRAW_WEIGHTS) + f"SELECT product, family, n, {', '.join(sql_rounded(c, c) for c in WEIGHTS)} FROM weights")
def weight_draws(spark: SparkSession, sf: str) -> DataFrame:
    """One draw of every arm's whole weight vector."""
    drawn = arms.draw_weights(placed_arms(spark, sf), SEED)
    return drawn.selectExpr(*ARM, "n", *_entries("w", WEIGHTS))


X = ["1.0::double", *[f"(({f} - mean_{i}) / std_{i})" for i, f in enumerate(FEATURES)]]
SHARED_DRAWS = [
    *DRAW_WEIGHTS,
    C.eliminate("product, family", 2 * DIM + 1),
    f"""drawn AS (SELECT date, product, family, weights.n AS n_obs, {' + '.join(f'{X[i]} * m_{i}_{DIM}' for i in range(DIM))} AS posterior_mean,
      sqrt({' + '.join(f'{X[i]} * {X[j]} * m_{i}_{DIM + 1 + j}' for i in range(DIM) for j in range(DIM))}) AS posterior_std,
      {' + '.join(f'{X[i]} * w_{i}' for i in range(DIM))} AS sampled_value
      FROM feat JOIN scal USING (product) JOIN weights USING (product) JOIN m{DIM} USING (product, family))""",
    C.SLOTS,
]


@query(
    C.with_(*SHARED_DRAWS)
    + f"""SELECT date, product, family, proposal_type, cast(slot AS integer) AS slot,
      {sql_rounded('posterior_std', 'posterior_std', 5)}, {sql_rounded('thompson_sample_value', 'thompson_sample_value', 5)} FROM slots"""
)
def shared_draw_slots(spark: SparkSession, sf: str) -> DataFrame:
    """The slots of every date and product under one draw of each arm's weights."""
    drawn = arms.draw_weights(placed_arms(spark, sf), SEED)
    slots = arms.select_slots(arms.apply_weights(views.features(spark, sf), drawn), ["date", "product"])
    return slots.select(*SLOT, "proposal_type", "slot", rounded("posterior_std", 5), rounded("thompson_sample_value", 5))


SLOT_OUT = (
    "date, product, family, proposal_type, cast(slot AS integer) AS slot, n_obs, "
    + ", ".join(sql_rounded(c, c) for c in ("posterior_mean", "posterior_std", "thompson_sample_value"))
)


def _slot_columns(slots: DataFrame) -> DataFrame:
    return slots.select(
        *SLOT,
        "proposal_type",
        "slot",
        "n_obs",
        *[rounded(c) for c in ("posterior_mean", "posterior_std", "thompson_sample_value")],
    )


@query(C.with_(*PREDICT, C.drawn(SEED), C.SLOTS) + f"SELECT {SLOT_OUT} FROM slots")
def select_slots(spark: SparkSession, sf: str) -> DataFrame:
    return _slot_columns(
        arms.slots_today(today(spark, sf), history(spark, sf), SEED, views.PRIORITIES)
    )


COLD = [
    C.PROP,
    C.arms_spine("(SELECT DISTINCT date, product FROM prop)"),
    "pred AS (SELECT date, product, family, 0 AS n_obs, 0.0::double AS posterior_mean, 1.0::double AS posterior_std FROM spine)",
    C.drawn(SEED),
    C.SLOTS,
]


HISTORY = "date date, product string, family string, eval_date date, n long, score_sum double, " + ", ".join(
    f"{f} double" for f in FEATURES
)


def _cold_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Slots for every (date, product) before any outcome is known."""
    nothing_known = spark.createDataFrame([], HISTORY)
    return arms.slots_today(views.features(spark, sf), nothing_known, SEED, views.PRIORITIES)


@query(C.with_(*COLD) + f"SELECT {SLOT_OUT.replace('n_obs', 'cast(n_obs AS bigint) AS n_obs')} FROM slots")
def cold_start_slots(spark: SparkSession, sf: str) -> DataFrame:
    return _slot_columns(_cold_slots(spark, sf))


@query(
    C.with_(*COLD)
    + """SELECT date, product, count(*) AS n_proposals, string_agg(family, ',' ORDER BY slot) AS families,
      string_agg(proposal_type, ',' ORDER BY slot) AS types FROM slots GROUP BY 1, 2"""
)
def proposal_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary(_cold_slots(spark, sf))


@query(
    C.with_(C.PROP)
    + """SELECT date, count(DISTINCT product) AS n_products, count(*) AS n_proposals_total FROM prop GROUP BY 1"""
)
def proposal_totals(spark: SparkSession, sf: str) -> DataFrame:
    return totals(views.proposals(spark, sf))


REPLAY = [
    *VIEWS,
    "train AS (SELECT p.family, o.eval_date, o.meta_score, f.* FROM prop p JOIN feat f USING (date, product) "
    "JOIN outc o USING (date, product, config_hash))",
    "pairs AS (SELECT s.date AS as_of, t.* FROM feat s JOIN train t ON t.product = s.product AND t.eval_date <= s.date)",
    C.scaler("pairs", "as_of, product"),
    f"z AS (SELECT pairs.*, {C.z_columns()} FROM pairs JOIN scal USING (as_of, product))",
    C.gram("as_of, product, family"),
    C.arms_spine(
        "(SELECT feat.*, scal.* EXCLUDE (as_of, product) FROM feat LEFT JOIN scal "
        "ON scal.as_of = feat.date AND scal.product = feat.product)"
    ),
    C.precision(
        "spine.date AS date, spine.product AS product, spine.family AS family",
        "spine",
        C.x_cells(DIM + 1),
        "ON gram.as_of = spine.date AND gram.product = spine.product AND gram.family = spine.family",
    ),
    C.eliminate("date, product, family, " + C.x_names(), DIM + 2),
    C.predicted("date, product, family"),
    C.drawn(SEED),
    C.SLOTS,
]


@query(C.with_(*REPLAY) + f"SELECT {SLOT_OUT} FROM slots")
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    return _slot_columns(
        walkforward.backtest(
            views.proposals(spark, sf),
            views.features(spark, sf),
            views.outcomes(spark, sf),
            SEED,
            views.PRIORITIES,
        )
    )


def digit_solver(attempts: DataFrame) -> DataFrame:
    """The drawn configuration's key decides: solved, solved inexactly, or not."""
    digit = F.substring("config_hash", 1, 1)
    return attempts.withColumn(
        "solver_status",
        F.when(digit < "5", "optimal").when(digit < "8", "optimal_inaccurate").otherwise("infeasible"),
    )


def grid_sql() -> str:
    """The 99-row grid written out by nested value lists, as `grid`."""
    ranges = "(VALUES (0, 10, 20), (1, 15, 30), (2, 20, 40)) r(pr, lo, hi)"
    wide = "(VALUES (0, '0.05'), (1, '0.08'), (2, '0.1'), (3, '0.15')) m(pm, mx)"
    narrow = "(VALUES (0, '0.05'), (1, '0.08'), (2, '0.1')) m(pm, mx)"
    head = """'{"_v":1,"config":{"cardinality":{"max_names":' || hi || ',"method":"mip","min_names":' || lo || '},'"""
    tail = """',"weight_bounds":{"max":' || mx || ',"min":0.0}}}'"""
    comps = """(VALUES (0, '[{"period":"3m","stat":"mean","weight":0.5},{"period":"1m","stat":"min","weight":0.5}]'),
      (1, '[{"period":"full","stat":"sum","weight":1.0},{"period":"1y","stat":"std","weight":-0.3}]'),
      (2, '[{"period":"1m","stat":"mean","weight":1.0},{"period":"3m","stat":"mean","weight":2.0},{"period":"1y","stat":"mean","weight":3.0}]')) c(pc, comp)"""
    stds = "(VALUES (0, '0.01'), (1, '0.02'), (2, '0.03'), (3, '0.05')) s(ps, sd)"
    plain = [
        f"""SELECT '{f}' AS family, pm * 3 + pr AS idx, 12 AS grid_size,
        {head} || '"objective":"{f}"' || {tail} AS config_json FROM {wide}, {ranges}"""
        for f in ("max_mean", "max_min", "min_drawdown")
    ]
    sharpe = f"""SELECT 'max_sharpe', (ps * 3 + pm) * 3 + pr, 36,
      {head} || '"objective":"max_sharpe","target_std":' || sd || {tail} FROM {stds}, {narrow}, {ranges}"""
    composite = f"""SELECT 'composite', (pc * 3 + pm) * 3 + pr, 27,
      {head} || '"components":' || comp || ',"objective":"composite"' || {tail} FROM {comps}, {narrow}, {ranges}"""
    body = "\nUNION ALL ".join([*plain, sharpe, composite])
    return f"grid AS (SELECT *, substr(sha256(config_json), 1, 16) AS config_hash FROM ({body}))"


DRAW_U = C.uniform(C.key_text(SEED, "date", "product", "family", "attempt"))
CYCLE = [
    grid_sql(),
    f"named_slots AS (SELECT * REPLACE ({C.family_name()} AS family) FROM slots)",
    f"tries AS (SELECT *, {DRAW_U} AS u FROM named_slots, (VALUES (0), (1), (2), (3)) a(attempt))",
    """tried AS (SELECT tries.*, grid.idx, grid.config_json, grid.config_hash,
      CASE WHEN grid.config_hash[1] < '5' THEN 'optimal' WHEN grid.config_hash[1] < '8' THEN 'optimal_inaccurate'
           ELSE 'infeasible' END AS solver_status
      FROM tries JOIN grid ON grid.family = tries.family AND grid.idx = cast(floor(u * grid.grid_size) AS integer))""",
]


@query(
    C.with_(*PREDICT, C.drawn(SEED), C.SLOTS, *CYCLE)
    + f"""SELECT date, product, family, proposal_type, cast(slot AS integer) AS slot, cast(attempt AS integer) AS attempt,
      solver_status, config_hash, config_json, {sql_rounded('thompson_sample_value', 'thompson_sample_value')}
    FROM (SELECT *, row_number() OVER (PARTITION BY date, product, slot ORDER BY attempt) AS r
          FROM tried WHERE solver_status <> 'infeasible') WHERE r = 1"""
)
def propose_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """From history to solved proposals, for all products in one plan."""
    slots = views.named_families(
        arms.slots_today(today(spark, sf), history(spark, sf), SEED, views.PRIORITIES)
    )
    store = TableStore(spark, scratch_path(spark, "propose_cycle"))
    chosen = choose(
        store.staged(slots, "slots"), config_grid(spark), digit_solver, SEED, lambda tried: store.staged(tried, "attempts")
    )
    return chosen.select(
        *SLOT,
        "proposal_type",
        "slot",
        "attempt",
        "solver_status",
        "config_hash",
        "config_json",
        rounded("thompson_sample_value"),
    )
