"""Queries over the stored tables: reads, upsert, log, checks, joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline import schemas
from paceline.catalog import check_sql as C
from paceline.catalog import views
from paceline.catalog.registry import query, rounded, sql_rounded
from paceline.functions.canonical import not_finite
from paceline.functions.score import rule_violation
from paceline.operators import quality, training
from paceline.operators.keyed import last_per_key, merge_rows
from paceline.plans.daily import record_decisions
from paceline.schemas import FEATURES, PROPOSAL_KEY
from paceline.sources.matrices import SHARED, MatrixStore, matrix_reference, orphans, width_violations
from paceline.session import scratch_path
from paceline.sources.tables import TableStore, row_filter, with_month

CUT = date(2000, 1, 1)
FEATURE_LIST = ", ".join(FEATURES)
MATRIX_DAY = date(2024, 1, 1)


@query(
    C.with_(C.PROP, C.LINES, C.FEAT)
    + f"""SELECT date, product, {FEATURE_LIST} FROM feat
    WHERE date >= DATE '1996-02-10' AND date <= DATE '1999-11-20' AND product IN ('F', 'P')"""
)
def read_features(spark: SparkSession, sf: str) -> DataFrame:
    return views.features(spark, sf).where(
        row_filter(date(1996, 2, 10), date(1999, 11, 20), product=["F", "P"])
    )


@query(
    C.with_(C.PROP)
    + """SELECT date, product, config_hash, family, proposal_type,
      'pnl_matrices/' || cast(date AS varchar) || '/' || product || '/' || config_hash || '.parquet' AS pnl_matrix_path
    FROM prop WHERE date >= DATE '1996-02-10' AND product IN ('F', 'O')
      AND family IN ('1-URGENT', '5-LOW') AND proposal_type IN ('best', 'alt', 'explore')"""
)
def read_proposals(spark: SparkSession, sf: str) -> DataFrame:
    chosen = views.proposals(spark, sf).where(
        row_filter(
            date(1996, 2, 10),
            product=["F", "O"],
            family=["1-URGENT", "5-LOW"],
            proposal_type=["best", "alt", "explore"],
        )
    )
    path = matrix_reference(F.col("date"), F.col("product"), F.col("config_hash"))
    return chosen.select(*PROPOSAL_KEY, "family", "proposal_type", path.alias("pnl_matrix_path"))


@query(
    C.with_(C.PROP, C.LINES, C.OUTC)
    + f"""SELECT date, product, config_hash, eval_date, {sql_rounded('mean_return', 'mean_return', 9)},
      {sql_rounded('vol', 'vol', 9)}, {sql_rounded('meta_score', 'meta_score', 9)}
    FROM outc WHERE date <= DATE '2000-06-30'"""
)
def read_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    kept = views.outcomes(spark, sf).where(row_filter(end=date(2000, 6, 30)))
    return kept.select(
        *PROPOSAL_KEY, "eval_date", *[rounded(c, 9) for c in ("mean_return", "vol", "meta_score")]
    )


DECISION_COLUMNS = "date, product, config_hash, decision, decided_at, notes, modified_config_hash"


def _with_local_time(decisions: DataFrame) -> DataFrame:
    """UTC wall-clock time, which is what the check engine's zone-less type holds."""
    return decisions.select(
        *PROPOSAL_KEY,
        "decision",
        F.col("decided_at_utc").cast("timestamp_ntz").alias("decided_at"),
        "notes",
        "modified_config_hash",
    )


@query(
    C.with_(C.DEC)
    + f"SELECT {DECISION_COLUMNS} FROM dec WHERE date >= DATE '2024-01-05' AND product IN ('click', 'view', 'error')"
)
def decisions_raw(spark: SparkSession, sf: str) -> DataFrame:
    keep = row_filter(date(2024, 1, 5), product=["click", "view", "error"])
    return _with_local_time(views.decisions(spark, sf).where(keep))


@query(
    C.with_(C.DEC)
    + f"""SELECT {DECISION_COLUMNS} FROM (
      SELECT *, row_number() OVER (PARTITION BY date, product, config_hash
                                   ORDER BY decided_at DESC, event_id DESC) AS r FROM dec
      WHERE date <= DATE '2024-01-25') WHERE r = 1"""
)
def decisions_latest(spark: SparkSession, sf: str) -> DataFrame:
    in_range = views.decisions(spark, sf).where(row_filter(end=date(2024, 1, 25)))
    return _with_local_time(last_per_key(in_range, PROPOSAL_KEY, ["decided_at_utc", "event_id"]))


UPSERT_KEY = ["l_orderkey", "l_linenumber"]
UPSERT_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


@query(
    """SELECT l_orderkey, l_linenumber, cast(l_shipdate AS date) AS ship_date, l_partkey, l_suppkey, l_extendedprice
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS r
          FROM lineitem) WHERE r = 1"""
)
def upsert_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """Lines shipped before the cut are the stored table, later ones a batch with repeated keys."""
    lines = views.table(spark, sf, "lineitem").select(*UPSERT_KEY, *UPSERT_ORDER)
    later = F.col("l_shipdate") >= F.lit(CUT)
    stored = last_per_key(lines.where(~later), UPSERT_KEY, UPSERT_ORDER)
    batch = last_per_key(lines.where(later), UPSERT_KEY, UPSERT_ORDER)
    return merge_rows(stored, batch, UPSERT_KEY, lines.where(later)).select(
        *UPSERT_KEY,
        F.to_date("l_shipdate").alias("ship_date"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


@query(
    C.with_(C.PROP, C.LINES, C.FEAT)
    + f"""SELECT date, product, vix_level + CASE WHEN date >= DATE '1999-05-17' THEN 100 ELSE 0 END AS vix_level,
      {', '.join(FEATURES[1:])} FROM feat WHERE date >= DATE '1996-03-10'"""
)
def stored_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Features written as a table, later days replaced by a second write, read back pruned."""
    store = TableStore(spark, scratch_path(spark, "stored_upsert"))
    first = views.features(spark, sf)
    store.write_features(first)
    later = first.where(F.col("date") >= F.lit(date(1999, 5, 17)))
    store.write_features(later.withColumn("vix_level", F.col("vix_level") + 100))
    return store.read_features(date(1996, 3, 10)).drop(schemas.VERSION_COLUMN)


@query(
    C.with_(C.DEC)
    + f"""SELECT {DECISION_COLUMNS} FROM (
      SELECT *, row_number() OVER (PARTITION BY date, product, config_hash ORDER BY decided_at DESC) AS r FROM dec
      WHERE product <> 'view') WHERE r = 1"""
)
def stored_log(spark: SparkSession, sf: str) -> DataFrame:
    """The decision log appended in two batches, then collapsed to the latest rows."""
    store = TableStore(spark, scratch_path(spark, "stored_log"))
    log = views.decisions(spark, sf).drop("event_id", "user_id")
    early = F.col("date") < F.lit(date(2024, 1, 12))
    store.append_decisions(log.where(early))
    store.append_decisions(log.where(~early))
    kinds = ["signup", "error", "click", "purchase"]
    return _with_local_time(store.read_decisions_latest(products=kinds))


@query(
    """SELECT cast(year(l_shipdate) AS integer) AS year, cast(month(l_shipdate) AS integer) AS month,
      count(*) AS n_rows, min(cast(l_shipdate AS date)) AS first_day, max(cast(l_shipdate AS date)) AS last_day
    FROM lineitem GROUP BY 1, 2"""
)
def partition_counts(spark: SparkSession, sf: str) -> DataFrame:
    dated = views.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return (
        with_month(dated)
        .groupBy("year", "month")
        .agg(
            F.count("*").alias("n_rows"),
            F.min("date").alias("first_day"),
            F.max("date").alias("last_day"),
        )
    )


@query(
    C.with_(C.PROP, C.LINES, C.FEAT)
    + f"SELECT date, product, {FEATURE_LIST}, cast(1 AS integer) AS {schemas.VERSION_COLUMN} FROM feat"
)
def conform_cast(spark: SparkSession, sf: str) -> DataFrame:
    """Features with a text column, an integer column and an unset version are brought to layout."""
    loose = views.features(spark, sf).select(
        F.lit(None).cast("int").alias(schemas.VERSION_COLUMN),
        *reversed(FEATURES[1:]),
        F.col(FEATURES[0]).cast("int").alias(FEATURES[0]),
        F.col("product"),
        F.col("date").cast("string").alias("date"),
    )
    return schemas.conform(loose, "daily_features")


@query(
    C.with_(C.PROP, C.DEC)
    + """SELECT 'family' AS "column", family AS value, count(*) AS rows FROM prop
      WHERE family NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 2
    UNION ALL SELECT 'product', product, count(*) FROM prop WHERE product NOT IN ('F', 'O') GROUP BY 2
    UNION ALL SELECT 'proposal_type', proposal_type, count(*) FROM prop
      WHERE proposal_type NOT IN ('best', 'alt', 'explore') GROUP BY 2
    UNION ALL SELECT 'decision', decision, count(*) FROM dec
      WHERE decision NOT IN ('accepted', 'modified') GROUP BY 2"""
)
def domain_violations(spark: SparkSession, sf: str) -> DataFrame:
    of_proposals = quality.bad_values(
        views.proposals(spark, sf),
        {
            "family": views.PRIORITIES[:3],
            "product": views.STATUSES[:2],
            "proposal_type": schemas.PROPOSAL_TYPES[:3],
        },
    )
    of_decisions = quality.bad_values(
        views.decisions(spark, sf), {"decision": ["accepted", "modified"]}
    )
    return of_proposals.unionByName(of_decisions)


@query(
    C.with_(C.PROP, C.LINES, C.OUTC)
    + """SELECT 'family: outside domain' AS rule, (SELECT count(*) FROM prop WHERE family NOT IN ('1-URGENT', '2-HIGH')) AS violations
    UNION ALL SELECT 'meta_score: null', (SELECT count(*) FROM prop LEFT JOIN outc USING (o_orderkey) WHERE meta_score IS NULL)
    UNION ALL SELECT 'meta_score: not finite', (SELECT count(*) FROM outc WHERE NOT isfinite(meta_score))
    UNION ALL SELECT 'config_hash: null', 0"""
)
def rule_report(spark: SparkSession, sf: str) -> DataFrame:
    scored = views.proposals(spark, sf).join(
        views.outcomes(spark, sf).select(*PROPOSAL_KEY, "meta_score"), PROPOSAL_KEY, "left"
    )
    rules = {
        "family: outside domain": quality.outside("family", views.PRIORITIES[:2]),
        "meta_score: null": F.col("meta_score").isNull(),
        "meta_score: not finite": not_finite(F.col("meta_score")),
        "config_hash: null": F.col("config_hash").isNull(),
    }
    return quality.rule_report(scored, rules)


@query(
    C.with_(C.PROP, C.LINES, C.FEAT)
    + """SELECT rule, count(*) - count(f.product) AS violations
    FROM prop p LEFT JOIN (SELECT * FROM feat WHERE product <> 'P') f USING (date, product),
      (VALUES """
    + ", ".join(f"('{f}: null')" for f in FEATURES)
    + """) r(rule) GROUP BY 1 UNION ALL VALUES ('date: null', 0), ('product: null', 0)"""
)
def null_report(spark: SparkSession, sf: str) -> DataFrame:
    """Columns declared as never null; product P, as a planted gap, has no features."""
    known = views.features(spark, sf).where(F.col("product") != "P")
    joined = views.proposals(spark, sf).join(known, schemas.DAY_KEY, "left")
    return quality.rule_report(joined, quality.null_rules("daily_features"))


@query(
    """SELECT vec_id, cast(len(embedding) AS integer) AS n_weights, cast(60 + label AS integer) AS n_names
    FROM embeddings WHERE len(embedding) <> 60 + label"""
)
def array_length_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Weight arrays against name lists of 60 + label entries."""
    rows = views.table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("embedding").alias("weights"),
        F.sequence(F.lit(1), F.lit(60) + F.col("label")).alias("column_names"),
    )
    return rows.where(quality.lengths_differ("weights", "column_names")).select(
        "vec_id", F.size("weights").alias("n_weights"), F.size("column_names").alias("n_names")
    )


@query(
    """SELECT cast(label AS varchar) AS product, count(*) AS n_rows,
      cast(min(len(embedding)) AS integer) AS min_width, cast(max(len(embedding)) AS integer) AS max_width
    FROM embeddings WHERE label <> 4 GROUP BY 1"""
)
def matrix_shape(spark: SparkSession, sf: str) -> DataFrame:
    """One shared matrix per product; the proposals name 60 + label tickers, so only label 4 fits."""
    rows = views.matrix_rows(spark, sf)
    matrices = rows.select(
        F.lit(MATRIX_DAY).alias("date"), "product", F.lit(SHARED).alias("config_hash"), "t", "values"
    )
    proposals = rows.select(
        F.lit(MATRIX_DAY).alias("date"),
        "product",
        views.short_digest(F.col("t")).alias("config_hash"),
        F.sequence(F.lit(1), F.lit(60) + F.col("product").cast("int")).alias("column_names"),
    )
    return width_violations(matrices, proposals).select("product", "n_rows", "min_width", "max_width")


@query(
    """SELECT 'decision: outside domain' AS rule, 0 AS violations
    UNION ALL SELECT 'modified_config_hash: set if and only if modified',
      (SELECT count(*) FROM events WHERE (event_id % 3 = 2) <> (value > 12))
    UNION ALL SELECT 'notes: null', (SELECT count(*) FROM events WHERE coalesce(value, 0) <= 10)"""
)
def conditional_null_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Replacement hashes planted by value instead of by decision."""
    replaced = views.decisions(spark, sf).join(
        views.table(spark, sf, "events").select("event_id", "value"), "event_id"
    )
    planted = replaced.withColumn(
        "modified_config_hash", F.when(F.col("value") > 12, views.short_digest(F.col("event_id")))
    )
    rules = {**quality.decision_rules(), "notes: null": F.col("notes").isNull()}
    return quality.rule_report(planted, rules)


@query(
    C.with_(C.PROP)
    + """SELECT product, mode, count(*) AS violations FROM (
      SELECT product, CASE WHEN proposal_type = 'best' THEN 'continuous' ELSE 'research' END AS mode,
        CASE WHEN o_totalprice > 200000 THEN 0.3 ELSE 0.0 END AS lam FROM prop)
    WHERE NOT ((mode = 'continuous' AND lam > 0) OR (mode = 'research' AND lam = 0)) GROUP BY 1, 2"""
)
def score_config_violations(spark: SparkSession, sf: str) -> DataFrame:
    mode = F.when(F.col("proposal_type") == "best", "continuous").otherwise("research")
    lam = F.when(F.col("o_totalprice") > 200000, 0.3).otherwise(0.0)
    rows = views.proposals(spark, sf).select("product", mode.alias("mode"), lam.alias("lam"))
    return (
        rows.where(rule_violation(F.col("mode"), F.col("lam")))
        .groupBy("product", "mode")
        .agg(F.count("*").alias("violations"))
    )


def _proposed(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals planted from the events: high values before the 20th."""
    return (
        views.decisions(spark, sf)
        .where(F.col("notes").isNotNull() & (F.col("date") <= F.lit(date(2024, 1, 20))))
        .select(*PROPOSAL_KEY)
    )


def _in_layout(keys: DataFrame) -> DataFrame:
    """Proposal rows of the keys, other columns filled with fixed values."""
    return keys.select(
        *PROPOSAL_KEY,
        F.lit("{}").alias("config_json"),
        F.lit(1).alias("config_schema_version"),
        F.lit(schemas.FAMILIES[0]).alias("family"),
        F.lit(schemas.PROPOSAL_TYPES[0]).alias("proposal_type"),
        *[F.lit(None).cast("double").alias(c) for c in ("thompson_sample_value", "posterior_mean", "posterior_std")],
        F.array(F.lit(1.0)).alias("weights"),
        F.array(F.lit("S00")).alias("column_names"),
        F.lit(1).alias("n_names"),
        *[F.lit(0.0).alias(c) for c in ("in_sample_sharpe", "in_sample_mean_pnl", "in_sample_max_dd")],
        F.lit("optimal").alias("solver_status"),
        F.lit(0.0).alias("solve_time_seconds"),
        F.lit(None).cast("string").alias("pnl_matrix_path"),
    )


PROPOSED = """proposed AS (
  SELECT DISTINCT date, product, config_hash FROM dec WHERE notes IS NOT NULL AND date <= DATE '2024-01-20')"""


@query(
    C.with_(C.DEC, PROPOSED)
    + """SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM proposed p WHERE p.date = dec.date AND p.product = dec.product)
      THEN 'unknown config_hash' ELSE 'no proposals that day' END AS problem
    FROM dec WHERE NOT EXISTS (SELECT 1 FROM proposed p
      WHERE p.date = dec.date AND p.product = dec.product AND p.config_hash = dec.config_hash)"""
)
def decision_reference_check(spark: SparkSession, sf: str) -> DataFrame:
    stray = quality.unmatched_decisions(views.decisions(spark, sf), _proposed(spark, sf))
    return stray.select("event_id", "problem")


@query(
    C.with_(C.DEC, PROPOSED)
    + """SELECT date, product, decision, count(*) AS n, count(DISTINCT config_hash) AS n_keys
    FROM dec JOIN proposed USING (date, product, config_hash)
    WHERE (decision = 'modified') = (modified_config_hash IS NOT NULL) GROUP BY 1, 2, 3"""
)
def decisions_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions on planted proposals, recorded in a store and read back from its log."""
    store = TableStore(spark, scratch_path(spark, "decisions_recorded"))
    known = _proposed(spark, sf).distinct()
    store.write_proposals(_in_layout(known))
    valid = views.decisions(spark, sf).join(known, PROPOSAL_KEY, "left_semi").drop("event_id", "user_id")
    record_decisions(store, valid)
    return store.read_decisions_raw().groupBy("date", "product", "decision").agg(
        F.count("*").alias("n"), F.count_distinct("config_hash").alias("n_keys")
    )


STORED_MATRIX = """cells0 AS (SELECT cast(DATE '2024-01-01' + cast(vec_id % 2 AS integer) AS date) AS date, cast(label AS varchar) AS product,
  substr(sha256(cast(vec_id % 5 AS varchar)), 1, 16) AS config_hash, vec_id, vec_id % 5 AS kind, cast(embedding[1] AS double) AS first
  FROM embeddings)"""


def _stored_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Up to five matrices per product on each of two days."""
    return views.matrix_rows(spark, sf).select(
        F.date_add(F.lit(MATRIX_DAY), (F.col("t") % 2).cast("int")).alias("date"),
        "product",
        views.short_digest(F.col("t") % 5).alias("config_hash"),
        F.col("t").cast("int").alias("t"),
        "values",
    )


def _matrix_sums(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*PROPOSAL_KEY).agg(F.count("*").alias("n_rows"), F.sum(F.col("values")[0]).alias("first"))
    return sums.select(*PROPOSAL_KEY, "n_rows", rounded("first", 8))


@query(
    C.with_(STORED_MATRIX)
    + f"""SELECT date, product, config_hash, count(*) AS n_rows,
      {sql_rounded('sum(CASE WHEN kind = 0 THEN -first ELSE first END)', 'first', 8)}
    FROM cells0 WHERE kind <> 0 OR vec_id % 3 = 0 GROUP BY 1, 2, 3"""
)
def matrices_stored(spark: SparkSession, sf: str) -> DataFrame:
    """All matrices written, one in five replaced by a shorter, negated version, all read back."""
    store = MatrixStore(TableStore(spark, scratch_path(spark, "matrices_stored")))
    rows = _stored_matrices(spark, sf)
    store.write(rows)
    again = rows.where((F.col("t") % 5 == 0) & (F.col("t") % 3 == 0))
    gone = rows.where((F.col("t") % 5 == 0)).select(*PROPOSAL_KEY).distinct()
    store.write(again.withColumn("values", F.transform("values", lambda v: -v)))
    unreplaced = gone.join(again.select(*PROPOSAL_KEY), PROPOSAL_KEY, "left_anti")
    return _matrix_sums(store.rows().join(unreplaced, PROPOSAL_KEY, "left_anti"))


@query(
    C.with_(STORED_MATRIX)
    + f"""SELECT date, product, config_hash, count(*) AS n_rows, {sql_rounded('sum(first)', 'first', 8)}
    FROM cells0 WHERE kind IN (1, 2, 3) AND product <> '4' GROUP BY 1, 2, 3"""
)
def orphans_swept(spark: SparkSession, sf: str) -> DataFrame:
    """Matrices of which some have a proposal; product 4 has none, so its folders go."""
    store = TableStore(spark, scratch_path(spark, "orphans_swept"))
    rows = _stored_matrices(spark, sf)
    MatrixStore(store).write(rows)
    kept = rows.where((F.col("t") % 5).isin(1, 2, 3) & (F.col("product") != "4"))
    store.write_proposals(_in_layout(kept.select(*PROPOSAL_KEY).distinct()))
    MatrixStore(store).sweep(rows)
    return _matrix_sums(MatrixStore(store).rows())


PLANTED = {1: "NULL", 2: "'NaN'::double", 3: "'Infinity'::double", 4: "'-Infinity'::double"}
ODD_FEATURE = "CASE day(date) " + " ".join(f"WHEN {k} THEN {v}" for k, v in PLANTED.items()) + f" ELSE {FEATURES[1]} END"
ODD_SCORE = "CASE config_hash[1] " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PLANTED.items()) + " ELSE meta_score END"


def _exclusion_rows(column: str, source: str) -> list[str]:
    tests = {"null": f"{column} IS NULL", "NaN": f"isnan({column})", "infinite": f"isinf({column})"}
    return [
        f"SELECT '{column}' AS \"column\", '{reason}' AS reason, count(*) FILTER ({test}) AS rows FROM {source}"
        for reason, test in tests.items()
    ]


@query(
    C.with_(
        C.PROP, C.LINES, C.FEAT, C.OUTC,
        f"feat1 AS (SELECT * REPLACE ({ODD_FEATURE} AS {FEATURES[1]}) FROM feat)",
        f"outc1 AS (SELECT * REPLACE ({ODD_SCORE} AS meta_score) FROM outc)",
    )
    + "\nUNION ALL ".join([x for f in FEATURES for x in _exclusion_rows(f, "feat1")] + _exclusion_rows("meta_score", "outc1"))
)
def fit_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """Values planted by day and by key that keep rows out of the fit, counted by reason."""

    def planted(key: Column, kinds: list, value: str) -> Column:
        odd = [None, float("nan"), float("inf"), float("-inf")]
        case = F.col(value)
        for kind, bad in zip(kinds, odd):
            case = F.when(key == kind, F.lit(bad).cast("double")).otherwise(case)
        return case

    features = views.features(spark, sf)
    features = features.withColumn(FEATURES[1], planted(F.day("date"), list(PLANTED), FEATURES[1]))
    first = F.substring("config_hash", 1, 1)
    outcomes = views.outcomes(spark, sf)
    outcomes = outcomes.withColumn("meta_score", planted(first, [str(k) for k in PLANTED], "meta_score"))
    return training.fit_exclusions(features, outcomes)


@query(C.with_(C.CELLS) + "SELECT product, t, idx, value FROM cells")
def matrix_read(spark: SparkSession, sf: str) -> DataFrame:
    cells = views.matrix_rows(spark, sf).select(
        "product", "t", F.posexplode("values").alias("idx", "value")
    )
    return cells.withColumn("idx", F.col("idx").cast("bigint"))


@query(
    """SELECT cast(label AS varchar) AS product, vec_id AS t FROM embeddings
    WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""
)
def orphan_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """A matrix row lives when its document was labelled as good."""
    key = views.short_digest(F.col("t"))
    rows = views.matrix_rows(spark, sf).select(
        F.lit(MATRIX_DAY).alias("date"), "product", key.alias("config_hash"), "t"
    )
    good = views.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("t"))
    return orphans(rows, rows.join(good, "t", "left_semi")).select("product", "t")


TRAINING_OUT = (
    "date, product, config_hash, family, proposal_type, eval_date, "
    + FEATURE_LIST
    + ", "
    + sql_rounded("meta_score", "meta_score", 9)
)


def _training_columns(joined: DataFrame) -> DataFrame:
    return joined.select(
        *PROPOSAL_KEY,
        "family",
        "proposal_type",
        "eval_date",
        *FEATURES,
        rounded("meta_score", 9),
    )


@query(C.with_(C.PROP, C.LINES, C.FEAT, C.OUTC, C.training("2000-01-01")) + f"SELECT {TRAINING_OUT} FROM train")
def training_table(spark: SparkSession, sf: str) -> DataFrame:
    joined = training.training_table(
        views.proposals(spark, sf),
        views.features(spark, sf),
        views.outcomes(spark, sf).drop("o_orderkey"),
        CUT,
    )
    return _training_columns(joined)


@query(
    C.with_(C.PROP, C.LINES, C.FEAT, C.OUTC, "known AS (SELECT * FROM feat WHERE product <> 'P')")
    + f"""SELECT {TRAINING_OUT} FROM prop p
    LEFT JOIN known f USING (date, product)
    LEFT JOIN (SELECT date, product, config_hash, eval_date, meta_score FROM outc) o USING (date, product, config_hash)"""
)
def full_table(spark: SparkSession, sf: str) -> DataFrame:
    """Product P, as a planted gap, has no features."""
    known = views.features(spark, sf).where(F.col("product") != "P")
    joined = training.full_table(
        views.proposals(spark, sf), known, views.outcomes(spark, sf).drop("o_orderkey")
    )
    return _training_columns(joined)


@query(
    C.with_(C.PROP)
    + """SELECT date, product, config_hash, family FROM prop
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""
)
def pending_proposals(spark: SparkSession, sf: str) -> DataFrame:
    pending = training.pending_proposals(views.proposals(spark, sf), views.outcomes(spark, sf))
    return pending.select(*PROPOSAL_KEY, "family")


@query(
    C.with_(C.PROP)
    + """SELECT date, product, config_hash, family, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY product ORDER BY date DESC, config_hash DESC) AS r
      FROM prop WHERE proposal_type = 'best') WHERE r = 1"""
)
def latest_best(spark: SparkSession, sf: str) -> DataFrame:
    latest = training.latest_best(views.proposals(spark, sf))
    return latest.select(*PROPOSAL_KEY, "family", "o_totalprice")


@query(
    C.with_(
        C.PROP,
        "best AS (SELECT product, date, max(config_hash) AS config_hash FROM prop WHERE proposal_type = 'best' GROUP BY 1, 2)",
        "days AS (SELECT DISTINCT product, date, date - 1 AS before FROM prop)",
    )
    + """SELECT prop.date, prop.product, prop.config_hash, b.date AS prev_date, b.config_hash AS prev_config_hash
    FROM prop JOIN days USING (date, product) ASOF LEFT JOIN best b ON b.product = prop.product AND days.before >= b.date"""
)
def prev_best_asof(spark: SparkSession, sf: str) -> DataFrame:
    linked = training.previous_best(views.proposals(spark, sf))
    return linked.select(*PROPOSAL_KEY, "prev_date", "prev_config_hash")
