"""The given tables seen as proposals, features, outcomes, decisions and matrices.

Stand-ins by row-local expressions wherever possible, so that a query's cost is
its operator's cost:

  proposals   one per order; product = order status, family = order priority,
              key = digest of the order key, type from the key's first digit
  features    per (order date, product), from orders and their lines
  outcomes    per order with lines: return = discount less tax, risk = spread
              of the discount, known seven days after the order
  decisions   one per event, several per (date, product, user)
  matrices    embeddings: product = label, t = vec_id, 64 tickers
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.score import guarded_ratio
from paceline.functions.vectors import ticker_labels, to_simplex
from paceline.operators.portfolio import normalise
from paceline.schemas import FAMILIES, FEATURES

# The order priorities stand in for the option families.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


_handles: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. The handle is kept per session, which saves repeated listing; no data is."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _handles:
        _handles[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _handles[key]


def hundredths(name: str) -> Column:
    """Two-decimal amounts as integers: their sums are exact in any order.

    `floor(x + 0.5)` stays in generated code; `round` goes through BigDecimal.
    """
    return F.floor(F.col(name) * 100 + 0.5)


def short_digest(column: Column) -> Column:
    return F.substring(F.sha2(column.cast("string"), 256), 1, 16)


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.substring("config_hash", 1, 1)
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.to_date("o_orderdate").alias("date"),
            F.col("o_orderstatus").alias("product"),
            short_digest(F.col("o_orderkey")).alias("config_hash"),
            F.col("o_orderpriority").alias("family"),
            "o_orderkey",
            "o_totalprice",
        )
        .withColumn(
            "proposal_type",
            F.when(digit <= "3", "best")
            .when(digit <= "9", "alt")
            .when(digit <= "b", "explore")
            .otherwise("candidate"),
        )
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: sums over its lines in whole hundredths."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.col("l_quantity").cast("bigint").alias("q"),
            hundredths("l_discount").alias("d"),
            hundredths("l_tax").alias("x"),
            hundredths("l_extendedprice").alias("p"),
            (F.col("l_returnflag") == "R").cast("bigint").alias("r"),
        )
        .groupBy("o_orderkey")
        .agg(
            F.count("*").alias("n_lines"),
            F.sum("q").alias("qty"),
            F.sum("d").alias("disc"),
            F.sum(F.col("d") * F.col("d")).alias("disc_sq"),
            F.sum("x").alias("tax"),
            F.sum("p").alias("price"),
            F.sum("r").alias("returned"),
        )
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven figures per (date, product); days without lines get zeros."""
    sums = ("n_lines", "qty", "disc", "tax", "price", "returned")
    orders = proposals(spark, sf_dir).select(
        "date", "product", "o_orderkey", hundredths("o_totalprice").alias("total")
    )
    days = (
        orders.join(order_lines(spark, sf_dir).select("o_orderkey", *sums), "o_orderkey", "left")
        .groupBy("date", "product")
        .agg(F.count("*").alias("n_orders"), F.sum("total").alias("total"), *[F.sum(c).alias(c) for c in sums])
    )

    def per_line(name: str, scale: float) -> Column:
        return F.coalesce(F.col(name) / F.col("n_lines") / F.lit(scale), F.lit(0.0))

    values = [
        F.col("n_orders").cast("double"),
        F.col("total") / F.col("n_orders") / F.lit(1e7),
        per_line("qty", 1.0),
        per_line("disc", 100.0),
        per_line("tax", 100.0),
        per_line("price", 1e7),
        per_line("returned", 1.0),
    ]
    return days.select("date", "product", *[v.alias(f) for v, f in zip(values, FEATURES)])


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_lines")
    spread = n * F.col("disc_sq") - F.col("disc") * F.col("disc")
    return (
        proposals(spark, sf_dir)
        .select("date", "product", "config_hash", "o_orderkey")
        .join(order_lines(spark, sf_dir).select("o_orderkey", "n_lines", "disc", "disc_sq", "tax"), "o_orderkey")
        .select(
            "date",
            "product",
            "config_hash",
            "o_orderkey",
            F.date_add("date", 7).alias("eval_date"),
            ((F.col("disc") - F.col("tax")) / n / F.lit(100.0)).alias("mean_return"),
            (F.sqrt(spread) / n / F.lit(100.0)).alias("vol"),
        )
        .withColumn("meta_score", guarded_ratio(F.col("mean_return"), F.col("vol")))
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 3
    decision = F.when(kind == 0, "accepted").when(kind == 1, "rejected").otherwise("modified")
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("product"),
        short_digest(F.col("user_id")).alias("config_hash"),
        decision.alias("decision"),
        F.col("ts").cast("timestamp").alias("decided_at_utc"),
        F.when(F.col("value") > 10, F.col("props")).alias("notes"),
        F.when(kind == 2, short_digest(F.col("event_id"))).alias("modified_config_hash"),
        "event_id",
        "user_id",
    )


def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("product"),
        F.col("vec_id").alias("t"),
        F.col("embedding").cast("array<double>").alias("values"),
    )


def weighted_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proposal per embedding: its absolute values, scaled to sum 1, are the weights.

    The date is one of 256 days, taken from the first byte of the key's digest.
    """
    weights = to_simplex(F.transform("values", lambda v: F.abs(v)))
    byte = F.conv(F.substring("config_hash", 1, 2), 16, 10).cast("int")
    third = F.substring("config_hash", 3, 1)
    return (
        matrix_rows(spark, sf_dir)
        .withColumn("config_hash", short_digest(F.col("t")))
        .select(
            F.date_add(F.lit("2000-01-01").cast("date"), byte).alias("date"),
            "product",
            "config_hash",
            F.when(third <= "7", "best").otherwise("alt").alias("proposal_type"),
            F.col("t").alias("vec_id"),
            weights.alias("weights"),
            ticker_labels(F.size("values")).alias("column_names"),
        )
    )


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk figure per product; product 9 has none."""
    first = F.col("values")[0]
    return (
        matrix_rows(spark, sf_dir)
        .where(F.col("product") != "9")
        .groupBy("product")
        .agg(F.sqrt(F.avg(first * first)).alias("vol"))
    )


def long_weights(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, ticker, w) per order and supplier, summing to 1 per order; all orders or some."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"),
        F.col("l_suppkey").alias("ticker"),
        hundredths("l_extendedprice").alias("amount"),
    )
    if keys is not None:
        lines = lines.join(keys, "key", "left_semi")
    amounts = lines.groupBy("key", "ticker").agg(F.sum("amount").alias("amount"))
    return normalise(amounts, "key", "amount", "w")


def named_families(df: DataFrame) -> DataFrame:
    """Library names for the stand-in families."""
    names = F.create_map(*[F.lit(v) for pair in zip(PRIORITIES, FAMILIES) for v in pair])
    return df.withColumn("family", names[F.col("family")])


def named_products(df: DataFrame) -> DataFrame:
    """Library names for two of the three stand-in products."""
    name = F.when(F.col("product") == "F", "gamma").when(F.col("product") == "O", "vol")
    return df.withColumn("product", F.coalesce(name, F.col("product")))


def named(df: DataFrame) -> DataFrame:
    return named_products(named_families(df))
