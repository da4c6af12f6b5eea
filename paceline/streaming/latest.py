"""The latest decision of every proposal, kept while decisions arrive.

The state holds one row per proposal: the greatest of all decisions seen, by time and then
by the other columns, as in `TableStore.read_decisions_latest`. A greatest value does not
depend on the order of arrival, so batches may come in any order and a batch may be
replayed. Each micro-batch gives the proposals whose latest decision may have changed;
they replace their rows in a table of their own. Spark combines a batch's rows per task
before it meets the state, so a proposal with most of a batch's rows sends one of each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paceline import schemas
from paceline.operators.keyed import last_per_key
from paceline.sources.tables import TableStore

CURRENT = "decisions_current"
ORDER = ["decided_at_utc", "decision", "modified_config_hash", "notes"]


def latest(decisions: DataFrame) -> DataFrame:
    """The latest decision per proposal, of a stream or a batch; rows with a null key are left out."""
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in schemas.PROPOSAL_KEY])
    greatest = F.max(F.struct(*ORDER)).alias("last")
    return decisions.where(keyed).groupBy(*schemas.PROPOSAL_KEY).agg(greatest).select(*schemas.PROPOSAL_KEY, "last.*")


def merge_latest(store: TableStore, changed: DataFrame) -> None:
    """Let rows of (key, decision) take the place of earlier ones in the current table; later ones stay."""
    with store.job():
        rows = store.staged(changed.select(*schemas.PROPOSAL_KEY, *ORDER), "latest")
        months = store._touched_months(rows)
        if not months:
            return
        held = _stored(store)
        if held is not None:
            numbers = [year * 12 + month for year, month in months]
            held = held.where((F.col("year") * 12 + F.col("month")).isin(numbers)).select(*rows.columns)
            rows = store.staged(last_per_key(held.unionByName(rows), schemas.PROPOSAL_KEY, ORDER), "merged")
        store._write(rows, CURRENT, "overwrite", schemas.PROPOSAL_KEY)


def _stored(store: TableStore) -> DataFrame | None:
    return store._stored(CURRENT)


def read_current(store: TableStore) -> DataFrame:
    """The latest decision of every proposal that the stream has seen."""
    held = _stored(store)
    columns = [*schemas.PROPOSAL_KEY, *ORDER]
    return store.spark.createDataFrame([], schemas.schema("decisions")).select(*columns) if held is None else held.select(*columns)


def track_latest(decisions: DataFrame, store: TableStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start keeping the current table; with `once` take what is there and stop.

    `checkpoint` must be a folder all executors share.
    """
    schemas.require_zoned(decisions, "decided_at_utc")
    writer = (
        latest(decisions)
        .writeStream.option("checkpointLocation", checkpoint)
        .outputMode("update")
        .foreachBatch(lambda batch, _: merge_latest(store, batch))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
