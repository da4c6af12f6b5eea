"""The decision log fed by a stream.

The batch rules apply per micro-batch. Rows that break a rule go to a table of
their own instead of stopping the stream. Every row is stored with the name of
its micro-batch; one that is replayed after a failure finds its name and adds
nothing twice. No row is left out for being equal to another: a log holds what
was sent, as an append of the same rows as a batch would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paceline import schemas
from paceline.operators.quality import decision_rules
from paceline.sources.tables import BATCH, TableStore

REJECTED = "decisions_rejected"


def append_new(store: TableStore, batch: DataFrame, name: str) -> None:
    """Append the rows of a batch that keep the rules, unless the log has the batch already."""
    with store.job():
        # the steps below would each run the batch again
        _append(store, store.staged(batch, "decisions"), name)


def _append(store: TableStore, rows: DataFrame, name: str) -> None:
    bounds = rows.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n")).first()
    if not bounds["n"]:
        return
    broken = F.lit(False)
    for predicate in decision_rules().values():
        broken = broken | F.coalesce(predicate, F.lit(False))
    rejected = rows.where(broken)
    if not rejected.isEmpty() and not store.holds_batch(REJECTED, name):
        rejected.withColumn(BATCH, F.lit(name)).write.mode("append").parquet(store.path(REJECTED))
    kept = rows.where(~broken)
    if not kept.isEmpty() and not store.holds_batch("decisions", name, bounds["first"], bounds["last"]):
        store.append_decisions(kept, name)


def append_stream(
    decisions: DataFrame, store: TableStore, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Start appending a streaming frame in the decisions layout.

    `checkpoint` must be a folder all executors share; it and Spark's number of
    the micro-batch name a batch. With `once` the query takes what is there and
    stops.
    """
    schemas.require_zoned(decisions, "decided_at_utc")
    writer = (
        decisions.writeStream.option("checkpointLocation", checkpoint)
        .outputMode("append")
        .foreachBatch(lambda batch, number: append_new(store, batch, f"{checkpoint}#{number}"))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
