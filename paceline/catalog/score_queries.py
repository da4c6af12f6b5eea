"""Queries of configurations, scores, returns and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.catalog import check_sql as C
from paceline.catalog import views
from paceline.catalog.model_queries import SEED, grid_sql
from paceline.catalog.registry import query, rounded, sql_rounded
from paceline.functions.canonical import canonical_json, config_key
from paceline.functions.score import ScoreRule, score_columns
from paceline.functions.vectors import dot
from paceline.operators import arms, attempts, linear, portfolio, training
from paceline.plans.daily import fan_out
from paceline.schemas import FAMILIES, FEATURES, PRODUCTS, PROPOSAL_KEY
from paceline.sources.grid import config_grid

NAMED = f"named AS (SELECT * REPLACE ({C.family_name()} AS family, {C.product_name()} AS product) FROM prop)"
PICK_U = C.uniform(C.key_text(SEED, "date", "product", "config_hash"))


@query(
    """SELECT event_id, '{"_v":1,"config":' || replace(props, ' ', '') || '}' AS canonical,
      substr(sha256('{"_v":1,"config":' || replace(props, ' ', '') || '}'), 1, 16) AS config_hash FROM events"""
)
def config_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Free-form JSON objects."""
    parsed = views.table(spark, sf, "events").select("event_id", canonical_json("props").alias("c"))
    return parsed.select("event_id", "c.canonical", config_key(F.col("c.canonical")).alias("config_hash"))


@query(
    """SELECT CASE WHEN value > 20 THEN 'invalid JSON' ELSE 'number is not finite' END AS problem, count(*) AS n
    FROM events WHERE value > 15 GROUP BY 1"""
)
def config_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Planted faults: NaN members above one value, cut-off text above another."""
    value = F.col("value")
    planted = (
        F.when(value > 20, F.expr("rtrim('}', props)"))
        .when(value > 15, F.replace("props", F.lit("}"), F.lit(', "x": NaN}')))
        .otherwise(F.col("props"))
    )
    parsed = views.table(spark, sf, "events").select(canonical_json(planted).alias("c"))
    return parsed.where("c.problem IS NOT NULL").groupBy("c.problem").agg(F.count("*").alias("n"))


def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    slots = views.named_families(views.proposals(spark, sf)).withColumnRenamed("config_hash", "slot_key")
    return attempts.sample_configs(slots, config_grid(spark), SEED, ["date", "product", "slot_key"])


SAMPLED = [
    C.PROP,
    grid_sql(),
    f"picks AS (SELECT date, product, config_hash AS slot_key, {C.family_name()} AS family, {PICK_U} AS u FROM prop)",
    """sampled AS (SELECT picks.*, grid.idx, grid.config_json, grid.config_hash, grid.grid_size FROM picks JOIN grid
      ON grid.family = picks.family AND grid.idx = cast(floor(u * grid.grid_size) AS integer))""",
]


@query(
    C.with_(*SAMPLED)
    + "SELECT date, product, slot_key, family, cast(idx AS integer) AS idx, config_hash FROM sampled"
)
def sample_config(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf).select("date", "product", "slot_key", "family", "idx", "config_hash")


@query(
    C.with_(*SAMPLED)
    + """SELECT g.family, cast(g.idx AS integer) AS idx, cast(g.grid_size AS integer) AS grid_size, g.config_json,
      g.config_hash, count(s.idx) AS n_drawn
    FROM grid g LEFT JOIN sampled s ON s.family = g.family AND s.idx = g.idx GROUP BY ALL"""
)
def grid_usage(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid with the number of proposals that drew each configuration."""
    drawn = _sampled(spark, sf).groupBy("family", "idx").agg(F.count("*").alias("n"))
    return (
        config_grid(spark)
        .join(drawn, ["family", "idx"], "left")
        .select(
            "family",
            "idx",
            "grid_size",
            "config_json",
            "config_hash",
            F.coalesce("n", F.lit(0)).alias("n_drawn"),
        )
    )


@query(
    """SELECT l_orderkey, cast(attempt AS integer) AS attempt, solver_status, l_partkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey
          ORDER BY attempt, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS r
      FROM (SELECT *, l_linenumber - 1 AS attempt, CASE l_returnflag WHEN 'A' THEN 'optimal'
                   WHEN 'R' THEN 'optimal_inaccurate' ELSE 'infeasible' END AS solver_status FROM lineitem)
      WHERE solver_status <> 'infeasible') WHERE r = 1"""
)
def first_success(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as attempts, the return flag as the solver's verdict."""
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", "optimal").when(flag == "R", "optimal_inaccurate").otherwise("infeasible")
    ties = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    tried = views.table(spark, sf, "lineitem").select(
        "l_orderkey",
        (F.col("l_linenumber") - 1).alias("attempt"),
        status.alias("solver_status"),
        *ties,
    )
    found = attempts.first_success(tried, ["l_orderkey"], ties)
    return found.select("l_orderkey", "attempt", "solver_status", "l_partkey")


@query(
    C.with_(C.PROP)
    + """SELECT date, product, config_hash, family, CASE row_number() OVER (
        PARTITION BY date, product, family ORDER BY o_totalprice, config_hash)
      WHEN 1 THEN 'best' WHEN 2 THEN 'alt' ELSE 'candidate' END AS label FROM prop"""
)
def slot_labels(spark: SparkSession, sf: str) -> DataFrame:
    labelled = attempts.label_first_two(
        views.proposals(spark, sf),
        ["date", "product", "family"],
        ["o_totalprice", "config_hash"],
        "o_orderkey",
    )
    return labelled.select(*PROPOSAL_KEY, "family", "label")


MAXIMA = ", ".join(f"max({f}) AS {f}" for f in FEATURES)


@query(
    C.with_(C.PROP, C.LINES, C.FEAT, f"market AS (SELECT date, {MAXIMA} FROM feat GROUP BY date)")
    + f"""SELECT market.date, p.product, {', '.join('market.' + f for f in FEATURES)}
    FROM market, (VALUES ('corridor_var'), ('dngamma'), ('gamma'), ('var'), ('vol')) p(product)"""
)
def feature_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """The largest figures of each date serve as its market row."""
    market = views.features(spark, sf).groupBy("date").agg(*[F.max(f).alias(f) for f in FEATURES])
    return fan_out(market, PRODUCTS).select("date", "product", *FEATURES)


FORWARD = [
    C.CELLS,
    C.WPROP,
    "ret AS (SELECT product, t, idx, value FROM cells)",
    "risk AS (SELECT product, sqrt(avg(value * value)) AS vol FROM cells WHERE idx = 0 AND product <> '9' GROUP BY 1)",
    """daily AS (SELECT p.vec_id, r.t, sum(r.value * w.w) AS pnl FROM wprop p
      JOIN wlong w USING (vec_id) JOIN ret r ON r.product = p.product AND r.idx = w.idx GROUP BY 1, 2)""",
    """fwd AS (SELECT vec_id, count(*) AS n_days, sum(pnl) AS pnl, avg(pnl) AS mean FROM daily GROUP BY 1)""",
    "bestday AS (SELECT product, date, max(config_hash) AS config_hash FROM wprop WHERE proposal_type = 'best' GROUP BY 1, 2)",
    """prev AS (SELECT p.vec_id, (SELECT b.config_hash FROM bestday b WHERE b.product = p.product AND b.date < p.date
      ORDER BY b.date DESC LIMIT 1) AS prev_hash FROM wprop p)""",
    """link AS (SELECT prev.vec_id, q.vec_id AS prev_id FROM prev LEFT JOIN wprop q ON q.config_hash = prev.prev_hash)""",
    """turn AS (SELECT link.vec_id, sum(abs(w.w - coalesce(q.w, 0))) AS turnover FROM link
      JOIN wlong w USING (vec_id) LEFT JOIN wlong q ON q.vec_id = link.prev_id AND q.idx = w.idx GROUP BY 1)""",
]


def _realised(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    proposals = views.weighted_proposals(spark, sf)
    sums = portfolio.column_sums(views.matrix_rows(spark, sf), ["product"])
    return proposals, sums, views.risk(spark, sf)


@query(
    C.with_(*FORWARD)
    + f"""SELECT p.date, p.product, p.config_hash, cast(p.date + 7 AS date) AS eval_date,
      cast(n_days AS integer) AS forward_window_days, {sql_rounded('pnl', 'forward_5d_pnl', 8)},
      {sql_rounded('mean', 'forward_5d_mean_return', 8)}, {sql_rounded('vol', 'forward_realized_vol_21d', 8)},
      {sql_rounded('mean / vol', 'forward_sharpe', 8)}, {sql_rounded('turnover', 'turnover_vs_prev_best', 8)},
      {sql_rounded('mean / vol - 0.3 * turnover', 'meta_score', 8)}, 'continuous' AS meta_score_mode,
      cast(0.3 AS double) AS lambda_used
    FROM wprop p JOIN fwd USING (vec_id) JOIN risk USING (product) JOIN turn USING (vec_id)"""
)
def forward_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Realised returns times weights, scored with a turnover charge."""
    proposals, sums, risk = _realised(spark, sf)
    realised = portfolio.forward_pnl(proposals, sums, risk, ["product"])
    realised = realised.withColumn("eval_date", F.date_add("date", 7))
    previous = training.previous_best_by_day(proposals, ["weights", "column_names"])
    scored = portfolio.outcome_rows(realised, previous, ScoreRule("continuous", 0.3))
    doubles = [
        "forward_5d_pnl",
        "forward_5d_mean_return",
        "forward_realized_vol_21d",
        "forward_sharpe",
        "turnover_vs_prev_best",
        "meta_score",
    ]
    return scored.select(
        *PROPOSAL_KEY,
        "eval_date",
        "forward_window_days",
        *[rounded(c, 8) for c in doubles],
        "meta_score_mode",
        "lambda_used",
    )


@query(
    C.with_(C.CELLS, C.WPROP)
    + "SELECT vec_id, 'no trailing vol' AS reason FROM wprop WHERE product = '9'"
)
def skipped_proposals(spark: SparkSession, sf: str) -> DataFrame:
    proposals, sums, risk = _realised(spark, sf)
    return portfolio.skipped(proposals, sums, risk, ["product"]).select("vec_id", "reason")


@query(
    C.with_(
        C.CELLS,
        "sums AS (SELECT product, idx, sum(abs(value)) AS s FROM cells GROUP BY 1, 2)",
        "w AS (SELECT product, idx, s / sum(s) OVER (PARTITION BY product) AS w FROM sums)",
        "daily AS (SELECT product, t, sum(value * w) AS pnl FROM cells JOIN w USING (product, idx) GROUP BY 1, 2)",
        "cum AS (SELECT *, sum(pnl) OVER (PARTITION BY product ORDER BY t) AS run FROM daily)",
        "dd AS (SELECT *, run - max(run) OVER (PARTITION BY product ORDER BY t) AS d FROM cum)",
    )
    + f"""SELECT product, count(*) AS n_days, {sql_rounded('avg(pnl)', 'in_sample_mean_pnl', 8)},
      {sql_rounded('avg(pnl) / stddev_pop(pnl)', 'in_sample_sharpe', 7)}, {sql_rounded('min(d)', 'in_sample_max_dd', 8)}
    FROM dd GROUP BY 1"""
)
def in_sample_stats(spark: SparkSession, sf: str) -> DataFrame:
    """One portfolio per product, weighted by the mean size of each ticker's values."""
    rows = views.matrix_rows(spark, sf)
    sizes = rows.withColumn("values", F.transform("values", lambda v: F.abs(v)))
    weights = portfolio.column_sums(sizes, ["product"]).select(
        "product", views.to_simplex(F.col("sums")).alias("weights")
    )
    daily = rows.join(weights, "product").select(
        "product", "t", dot(F.col("values"), F.col("weights")).alias("pnl")
    )
    stats = portfolio.in_sample_stats(daily, ["product"])
    return stats.select(
        "product",
        "n_days",
        rounded("in_sample_mean_pnl", 8),
        rounded("in_sample_sharpe", 7),
        rounded("in_sample_max_dd", 8),
    )


LONG = """amounts AS (SELECT l_orderkey AS key, l_suppkey AS ticker,
    cast(sum(cast(floor(l_extendedprice * 100 + 0.5) AS bigint)) AS bigint) AS amount FROM lineitem GROUP BY 1, 2),
wts AS (SELECT key, ticker, amount, cast(amount AS double) / cast(sum(amount) OVER (PARTITION BY key) AS double) AS w FROM amounts)"""


@query(
    C.with_(LONG)
    + f"SELECT key, printf('S%02d', cast(ticker AS bigint)) AS ticker, {sql_rounded('w', 'w', 9)} FROM wts"
)
def normalized_weights(spark: SparkSession, sf: str) -> DataFrame:
    weights = views.long_weights(spark, sf)
    return weights.select(
        "key", F.format_string("S%02d", "ticker").alias("ticker"), rounded("w", 9)
    )


LINKS = [
    C.PROP,
    LONG,
    "bests AS (SELECT product, date, max(config_hash) AS config_hash FROM prop WHERE proposal_type = 'best' GROUP BY 1, 2)",
    """links AS (SELECT p.o_orderkey AS key, q.o_orderkey AS prev_key
      FROM (SELECT *, date - 1 AS before FROM prop) p ASOF LEFT JOIN bests b ON b.product = p.product AND p.before >= b.date
      LEFT JOIN prop q ON q.config_hash = b.config_hash)""",
    """pairs AS (SELECT links.key, links.prev_key, w.ticker, w.w FROM links JOIN wts w ON w.key = links.key
      UNION ALL SELECT links.key, links.prev_key, q.ticker, -q.w FROM links JOIN wts q ON q.key = links.prev_key
      WHERE links.key IN (SELECT key FROM wts))""",
    """turn AS (SELECT key, prev_key, sum(abs(d)) AS turnover FROM (
      SELECT key, prev_key, ticker, sum(w) AS d FROM pairs GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
]


def _turnover(spark: SparkSession, sf: str) -> DataFrame:
    proposals = views.proposals(spark, sf)
    by_day = training.previous_best_by_day(proposals, ["o_orderkey"]).withColumnRenamed(
        "prev_o_orderkey", "prev_key"
    )
    links = proposals.join(by_day, ["date", "product"]).select(
        F.col("o_orderkey").alias("key"), "prev_key"
    )
    earlier = views.long_weights(spark, sf, by_day.select(F.col("prev_key").alias("key")).distinct())
    return portfolio.turnover(views.long_weights(spark, sf), links, earlier)


@query(C.with_(*LINKS) + f"SELECT key, cast(prev_key AS varchar) AS prev_key, {sql_rounded('turnover', 'turnover', 8)} FROM turn")
def turnover_l1(spark: SparkSession, sf: str) -> DataFrame:
    moved = _turnover(spark, sf)
    return moved.select("key", F.col("prev_key").cast("string").alias("prev_key"), rounded("turnover", 8))


SCORES = ["forward_sharpe", "turnover_vs_prev_best", "meta_score"]


def _scored(outcomes: DataFrame, rule: ScoreRule, turnover) -> DataFrame:
    scored = outcomes.select(
        *PROPOSAL_KEY, *score_columns(rule, F.col("mean_return"), F.col("vol"), turnover)
    )
    return scored.select(
        *PROPOSAL_KEY, *[rounded(c, 8) for c in SCORES], "meta_score_mode", "lambda_used"
    )


@query(
    C.with_(C.PROP, C.LINES, C.OUTC)
    + f"""SELECT date, product, config_hash, {sql_rounded('meta_score', 'forward_sharpe', 8)},
      cast(NULL AS double) AS turnover_vs_prev_best, {sql_rounded('meta_score', 'meta_score', 8)},
      'research' AS meta_score_mode, cast(0.0 AS double) AS lambda_used FROM outc"""
)
def meta_score_research(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(views.outcomes(spark, sf).drop("meta_score"), ScoreRule(), F.lit(None).cast("double"))


@query(
    C.with_(*LINKS, C.LINES, C.OUTC)
    + f"""SELECT date, product, config_hash, {sql_rounded('meta_score', 'forward_sharpe', 8)},
      {sql_rounded('turnover', 'turnover_vs_prev_best', 8)},
      {sql_rounded('outc.meta_score - 0.3 * turnover', 'meta_score', 8)},
      'continuous' AS meta_score_mode, cast(0.3 AS double) AS lambda_used
    FROM outc JOIN turn ON turn.key = outc.o_orderkey"""
)
def meta_score_continuous(spark: SparkSession, sf: str) -> DataFrame:
    moved = _turnover(spark, sf).select(F.col("key").alias("o_orderkey"), "turnover")
    outcomes = views.outcomes(spark, sf).drop("meta_score").join(moved, "o_orderkey")
    return _scored(outcomes, ScoreRule("continuous", 0.3), F.col("turnover"))


# Written out again, so that a wrong coefficient in the library shows.
CHECK_COEFFICIENTS = """coef(family, c0, c1, c2, c3, c4, c5, c6) AS (VALUES
  ('max_sharpe', -0.8::double, -0.2::double, 1.5::double, 0.3::double, 0.1::double, 0.1::double, -0.7::double),
  ('max_mean', 0.1, 0.0, 0.2, 1.8, 0.1, 0.0, -0.1),
  ('max_min', -0.3, -0.1, 0.9, 1.0, 0.2, 0.1, -0.4),
  ('min_drawdown', 1.2, 0.9, -1.0, 0.1, 0.2, 0.1, -0.3),
  ('composite', 0.1, 0.0, 0.2, 0.3, 1.5, 1.3, 0.0)),
prod(product, scale, shift) AS (VALUES ('corridor_var', 1.0::double, 0.0::double), ('vol', 0.8, 0.1),
  ('gamma', 1.1, -0.05), ('dngamma', 0.9, 0.15), ('var', 0.95, 0.05))"""
EXPECTED = (
    "(("
    + " + ".join(f"c{i} * {name}" for i, name in enumerate(FEATURES))
    + ") * coalesce(scale, 1.0::double) + coalesce(shift, 0.0::double))"
)
NAMED_ROWS = f"""rows_ AS (SELECT p.config_hash, {C.family_name('p.family')} AS family, f.* REPLACE ({C.product_name('p.product')} AS product)
  FROM prop p JOIN feat f ON f.date = p.date AND f.product = p.product)"""


@query(
    C.with_(C.PROP, C.LINES, C.FEAT, NAMED_ROWS, CHECK_COEFFICIENTS)
    + f"""SELECT date, rows_.product, config_hash, {sql_rounded(EXPECTED, 'expected_score', 9)}
    FROM rows_ JOIN coef USING (family) LEFT JOIN prod ON prod.product = rows_.product"""
)
def linear_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Status P stays an unknown product, which takes scale 1 and offset 0."""
    joined = views.proposals(spark, sf).join(views.features(spark, sf), ["date", "product"])
    scored = views.named(joined).withColumn("expected_score", linear.expected_score())
    return scored.select(*PROPOSAL_KEY, rounded("expected_score", 9))


HELD = FEATURES.index("skew_steepness")


def ols_estimate(i: int) -> str:
    """A feature held constant for one product has no estimate there."""
    value = f"m_{i + 1}_{C.DIM} / std_{i}"
    return sql_rounded(f"CASE WHEN product = 'gamma' THEN NULL ELSE {value} END" if i == HELD else value, "estimate", 5)


def held_row(i: int, j: int) -> str:
    """The held feature's own equation becomes x = 0, which is how it drops out."""
    cell = f"g_{min(i, j)}_{max(i, j)}" if j < C.DIM else f"h_{i}"
    return f"{cell} + CASE WHEN product = 'gamma' THEN 1 ELSE 0 END AS m_{i}_{j}" if i == j == HELD + 1 else f"{cell} AS m_{i}_{j}"


@query(
    C.with_(
        C.PROP, C.LINES, C.FEAT, C.OUTC, NAMED_ROWS,
        """train AS (SELECT rows_.* REPLACE (CASE WHEN rows_.product = 'gamma' THEN 0.1::double ELSE rows_.skew_steepness END AS skew_steepness),
          outc.meta_score FROM rows_ JOIN outc USING (config_hash))""",
        C.scaler(),
        C.standardised(),
        C.gram(),
        "m0 AS (SELECT product, family, n, "
        + ", ".join(
            held_row(i, j) for i in range(C.DIM) for j in range(C.DIM + 1)
        )
        + " FROM gram)",
        C.eliminate("product, family", C.DIM + 1),
    )
    + "\nUNION ALL ".join(
        f"SELECT product, family, cast(n AS bigint) AS n, '{f}' AS feature, {ols_estimate(i)} FROM m{C.DIM} JOIN scal USING (product)"
        for i, f in enumerate(FEATURES)
    )
)
def ols_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares on the realised scores, per product and family, in feature units.

    One feature of one product is held constant: it has no estimate, the others keep theirs.
    """
    features = views.named_products(views.features(spark, sf))
    held = F.when(F.col("product") == "gamma", 0.1).otherwise(F.col("skew_steepness"))
    fitted = linear.recover_coefficients(
        arms.moments(
            training.arm_days(
                views.named(views.proposals(spark, sf)),
                features.withColumn("skew_steepness", held),
                views.named_products(views.outcomes(spark, sf)),
            )
        )
    )
    return fitted.select("product", "family", "n", "feature", rounded("estimate", 5))
