"""Proposals joined to their outcomes while both arrive.

A left outer join of two streams. Each proposal waits for an outcome that is evaluated
within `horizon` days of it; a match comes out at once, and a proposal whose time is up
comes out without one. Watermarks bound the state of both sides: a proposal is forgotten
when the watermark has passed its horizon, an outcome when no proposal can wait for it any
more. The watermark is the least of both streams' latest dates, `delay` days back; what
arrives behind it is late and joins nothing, see `unmatched_outcomes` and `dropped`.

Results go to a table of Spark's file sink, whose log tells committed files from those of
a batch that failed half way, so a replay adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paceline.schemas import PROPOSAL_KEY
from paceline.sources.tables import TableStore

RESOLVED = "proposals_resolved"
LAYOUT = "date date, product string, config_hash string, eval_date date"
HORIZON_DAYS = 30
DELAY_DAYS = 10


def resolutions(
    proposals: DataFrame, outcomes: DataFrame, horizon_days: int = HORIZON_DAYS, delay_days: int = DELAY_DAYS
) -> DataFrame:
    """A stream of (key, eval_date): matched proposals, and with a null date those whose horizon has passed."""
    delay = f"{int(delay_days)} days"
    waiting = proposals.select(*PROPOSAL_KEY, F.to_timestamp("date").alias("proposed_at")).withWatermark("proposed_at", delay)
    arriving = outcomes.select(
        *[F.col(k).alias(f"own_{k}") for k in PROPOSAL_KEY],
        "eval_date",
        F.to_timestamp("eval_date").alias("evaluated_at"),
    ).withWatermark("evaluated_at", delay)
    match = F.expr(f"evaluated_at >= proposed_at AND evaluated_at <= proposed_at + INTERVAL {int(horizon_days)} DAYS")
    for key in PROPOSAL_KEY:
        match = match & (F.col(key) == F.col(f"own_{key}"))
    return waiting.join(arriving, match, "left_outer").select(*PROPOSAL_KEY, "eval_date")


def track_pending(
    proposals: DataFrame,
    outcomes: DataFrame,
    store: TableStore,
    checkpoint: str,
    horizon_days: int = HORIZON_DAYS,
    delay_days: int = DELAY_DAYS,
    once: bool = False,
) -> StreamingQuery:
    """Start writing resolutions below the store; with `once` take what is there and stop.

    `checkpoint` must be a folder all executors share.
    """
    writer = (
        resolutions(proposals, outcomes, horizon_days, delay_days)
        .writeStream.format("parquet")
        .option("path", store.path(RESOLVED))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_resolved(store: TableStore) -> DataFrame:
    """What the stream has settled so far."""
    return store.spark.read.schema(LAYOUT).parquet(store.path(RESOLVED))


def pending(proposals: DataFrame, resolved: DataFrame) -> DataFrame:
    """Proposals without an outcome, with `state`: open (may still get one) or expired."""
    matched = resolved.where(F.col("eval_date").isNotNull()).select(*PROPOSAL_KEY)
    expired = resolved.where(F.col("eval_date").isNull()).select(*PROPOSAL_KEY).distinct()
    left = proposals.join(matched, PROPOSAL_KEY, "left_anti")
    state = F.when(F.col("is_expired"), "expired").otherwise("open")
    return left.join(expired.withColumn("is_expired", F.lit(True)), PROPOSAL_KEY, "left").withColumn("state", state).drop("is_expired")


def unmatched_outcomes(outcomes: DataFrame, proposals: DataFrame, resolved: DataFrame) -> DataFrame:
    """Outcomes that joined no proposal, with the reason."""
    matched = resolved.where(F.col("eval_date").isNotNull()).select(*PROPOSAL_KEY, "eval_date")
    known = proposals.select(*PROPOSAL_KEY).distinct().withColumn("is_known", F.lit(True))
    reason = F.when(F.col("is_known"), "late or beyond the horizon").otherwise("no such proposal")
    left = outcomes.join(matched, [*PROPOSAL_KEY, "eval_date"], "left_anti")
    return left.join(known, PROPOSAL_KEY, "left").withColumn("reason", reason).drop("is_known")


def dropped(query: StreamingQuery) -> int:
    """Rows that the query's recent batches left out as late."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def waiting_rows(query: StreamingQuery) -> int:
    """Rows that the join holds in its state after the last batch."""
    last = query.lastProgress
    return sum(s["numRowsTotal"] for s in last["stateOperators"]) if last else 0
