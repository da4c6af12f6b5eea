"""Streams over files that arrive in two parts, against what a batch job makes of all of them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.catalog import check_sql as C
from paceline.catalog import views
from paceline.catalog.registry import query
from paceline.schemas import PROPOSAL_KEY
from paceline.session import scratch_path
from paceline.sources.tables import TableStore
from paceline.streaming.latest import ORDER, read_current, track_latest
from paceline.streaming.pending import DELAY_DAYS, HORIZON_DAYS, pending, read_resolved, track_pending

CUT = date(1995, 6, 17)


def arrive(part: DataFrame, folder: str) -> DataFrame:
    """Put a part into a folder; the stream of all that the folder gets."""
    part.write.mode("append").parquet(folder)
    return part.sparkSession.readStream.schema(part.schema).parquet(folder)


KEYS = ", ".join(PROPOSAL_KEY)
ARRIVALS = [
    C.PROP,
    C.LINES,
    C.OUTC,
    f"""arrivals AS (SELECT {KEYS}, eval_date, eval_date < DATE '{CUT}' AND config_hash[1] <> 'e' AS early
      FROM outc WHERE config_hash[1] <> 'f')""",
    f"""marks AS (SELECT
      least((SELECT max(date) FROM prop WHERE date < DATE '{CUT}'), (SELECT max(eval_date) FROM arrivals WHERE early)) - {DELAY_DAYS} AS halfway,
      least((SELECT max(date) FROM prop), (SELECT max(eval_date) FROM arrivals)) - {DELAY_DAYS} AS final)""",
    f"accepted AS (SELECT {KEYS} FROM arrivals, marks WHERE early OR eval_date > halfway)",
]


@query(
    C.with_(*ARRIVALS)
    + f"""SELECT p.date, p.product, p.config_hash, CASE WHEN date < final - {HORIZON_DAYS} THEN 'expired' ELSE 'open' END AS state
    FROM marks, (SELECT * FROM prop ANTI JOIN accepted USING ({KEYS})) p"""
)
def pending_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals left without an outcome when proposals and outcomes have streamed in, in two parts.

    Keys that begin with f get no outcome; early outcomes of keys that begin with e come
    with the second part, too late but for the last days before the watermark.
    """
    store = TableStore(spark, scratch_path(spark, "pending_stream"))
    proposals = views.proposals(spark, sf).select(*PROPOSAL_KEY)
    digit = F.substring("config_hash", 1, 1)
    outcomes = views.outcomes(spark, sf).select(*PROPOSAL_KEY, "eval_date").where(digit != "f")
    early = (F.col("eval_date") < F.lit(CUT)) & (digit != "e")
    before = F.col("date") < F.lit(CUT)
    for new, results in ((before, early), (~before, ~early)):
        waiting = arrive(proposals.where(new), store.path("in/proposals"))
        arriving = arrive(outcomes.where(results), store.path("in/outcomes"))
        track_pending(waiting, arriving, store, store.path("checkpoint"), once=True).awaitTermination()
    return pending(proposals, read_resolved(store)).select(*PROPOSAL_KEY, "state")


@query(
    C.with_(C.DEC)
    + """SELECT date, product, config_hash, decision, decided_at AS decided_at_utc, modified_config_hash, notes FROM (
      SELECT *, row_number() OVER (PARTITION BY date, product, config_hash ORDER BY decided_at DESC, decision DESC,
        modified_config_hash DESC NULLS LAST, notes DESC NULLS LAST) AS r FROM dec) WHERE r = 1"""
)
def latest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The latest decision per proposal after two parts of the log, later rows in the first."""
    store = TableStore(spark, scratch_path(spark, "latest_stream"))
    log = views.decisions(spark, sf).select(*PROPOSAL_KEY, *ORDER)
    late = F.col("date") >= F.lit(date(2024, 1, 12))
    for part in (log.where(late), log.where(~late)):
        stream = arrive(part, store.path("in"))
        track_latest(stream, store, store.path("checkpoint"), once=True).awaitTermination()
    local = F.col("decided_at_utc").cast("timestamp_ntz")
    return read_current(store).withColumn("decided_at_utc", local)
