"""Month-partitioned Parquet tables: pruned reads, keyed upserts, appends.

Layout: <root>/<table>/year=YYYY/month=M/*.parquet. The partition columns are
derived from `date` on write and dropped again on read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paceline import schemas
from paceline.operators.keyed import last_per_key, merge_rows
from paceline.operators.quality import refuse

MONTH = ["year", "month"]
# Stored beside a log's declared columns: which batch of a stream a row came with.
BATCH = "_batch"
# Columns of a batch that tell which row of a key came last, numbered.
ARRIVAL = "_arrival_"


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.year("date"), "month": F.month("date")})


def in_months(start: date | None, end: date | None) -> Column:
    """A predicate on the partition columns alone, so that whole months are never listed."""
    month_number = F.col("year") * 12 + F.col("month")
    keep = F.lit(True)
    if start is not None:
        keep = keep & (month_number >= start.year * 12 + start.month)
    if end is not None:
        keep = keep & (month_number <= end.year * 12 + end.month)
    return keep


def row_filter(
    start: date | None = None, end: date | None = None, **members: Sequence[str] | None
) -> Column:
    """Inclusive date range and membership lists; an empty list keeps nothing."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col("date") >= F.lit(start))
    if end is not None:
        keep = keep & (F.col("date") <= F.lit(end))
    for column, allowed in members.items():
        if allowed is not None:
            keep = keep & F.col(column).isin(list(allowed))
    return keep


class TableStore:
    """The tables below one root path.

    One writer per table at a time: Parquet folders have no transactions. A job
    that loses executors only re-runs tasks; old files stay until the new ones
    are committed.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._copies: list[str] | None = None

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def staged(self, df: DataFrame, purpose: str) -> DataFrame:
        """The frame written once below the root and read back.

        What follows may read it several times without running its plan again,
        and unlike a cache it outlives lost executors. Inside a `job` it goes when
        the job ends.
        """
        path = self.path(f"_staging/{purpose}-{uuid.uuid4().hex}")
        if self._copies is not None:
            self._copies.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextmanager
    def job(self) -> Iterator[None]:
        """What is staged inside is deleted at the end, after an error too; inner jobs leave it to the outer one."""
        if self._copies is not None:
            yield
            return
        self._copies = []
        try:
            yield
        finally:
            copies, self._copies = self._copies, None
            for path in copies:
                self.remove(path)

    def _folder(self, address: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(address)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def remove(self, address: str) -> None:
        """Delete a folder, if it is there."""
        files, path = self._folder(address)
        files.delete(path, True)

    def sweep_staging(self, hours: float = 24) -> int:
        """Delete copies that jobs whose driver was lost left behind, older than so many hours; their number."""
        files, path = self._folder(self.path("_staging"))
        if not files.exists(path):
            return 0
        oldest = time.time() * 1000 - hours * 3_600_000
        left = [x.getPath() for x in files.listStatus(path) if x.getModificationTime() <= oldest]
        for folder in left:
            files.delete(folder, True)
        return len(left)

    def listed(self, rows: DataFrame, purpose: str) -> str | None:
        """Where the rows are written as a table of violations, with their number; None for no rows.

        Such a table stays after the job, for whoever reads the error.
        """
        path = self.path(f"_violations/{purpose}-{uuid.uuid4().hex}")
        rows.write.parquet(path)
        n = self.spark.read.schema(rows.schema).parquet(path).count()
        if not n:
            self.remove(path)
        return f"{n} rows, listed in {path}" if n else None

    def write_report(self, table: str, day: date, rows: DataFrame) -> None:
        """Replace what a table of reports holds for a day; no rows clear the day."""
        rows.drop("date").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.path(table)}/date={day}")

    def read_report(self, table: str, layout: str, start_date: date | None = None, end_date: date | None = None) -> DataFrame:
        """A table of reports; `layout` names its columns, `date` among them."""
        try:
            stored = self.spark.read.schema(layout).parquet(self.path(table))
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = self.spark.createDataFrame([], layout)
        return stored.where(row_filter(start_date, end_date))

    def read_failed_attempts(self, start_date=None, end_date=None) -> DataFrame:
        """Attempts of the daily cycle that found no solution, with the reason."""
        layout = "product string, family string, proposal_type string, slot int, attempt int, config_hash string, "
        return self.read_report("failed_attempts", layout + "solver_status string, failure string, date date", start_date, end_date)

    def read_skipped_outcomes(self, start_date=None, end_date=None) -> DataFrame:
        """Proposals that got no outcome when their day was recorded, with the reason."""
        return self.read_report("outcomes_skipped", "product string, config_hash string, reason string, date date", start_date, end_date)

    # -- reads ---------------------------------------------------------------

    def _stored(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path(table))
        except AnalysisException as problem:
            if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def read(
        self,
        table: str,
        start_date: date | None = None,
        end_date: date | None = None,
        **members: Sequence[str] | None,
    ) -> DataFrame:
        """Rows of a table; a table never written is empty, with its declared columns."""
        stored = self._stored(table)
        if stored is None:
            return self.spark.createDataFrame([], schemas.schema(table))
        pruned = stored.where(in_months(start_date, end_date))
        return schemas.check_readable(pruned, table).where(
            row_filter(start_date, end_date, **members)
        )

    def read_months(self, table: str, months: Sequence[tuple[int, int]]) -> DataFrame:
        """The rows of some calendar months; no other folder is opened."""
        stored = self._stored(table)
        if stored is None:
            return self.spark.createDataFrame([], schemas.schema(table))
        numbers = [year * 12 + month for year, month in months]
        touched = stored.where((F.col("year") * 12 + F.col("month")).isin(numbers))
        return schemas.check_readable(touched, table)

    def read_features(self, start_date=None, end_date=None, products=None) -> DataFrame:
        return self.read("daily_features", start_date, end_date, product=products)

    def read_proposals(
        self, start_date=None, end_date=None, products=None, families=None, proposal_types=None
    ) -> DataFrame:
        return self.read(
            "proposals",
            start_date,
            end_date,
            product=products,
            family=families,
            proposal_type=proposal_types,
        )

    def read_outcomes(self, start_date=None, end_date=None, products=None) -> DataFrame:
        return self.read("outcomes", start_date, end_date, product=products)

    def read_decisions_raw(self, start_date=None, end_date=None, products=None) -> DataFrame:
        return self.read("decisions", start_date, end_date, product=products)

    def read_decisions_latest(self, start_date=None, end_date=None, products=None) -> DataFrame:
        """The last decision per proposal among those in range."""
        raw = self.read_decisions_raw(start_date, end_date, products)
        others = ["decision", "modified_config_hash", "notes"]  # decide between equal times
        return last_per_key(raw, schemas.PROPOSAL_KEY, ["decided_at_utc", *others])

    # -- writes --------------------------------------------------------------

    def _write(self, df: DataFrame, table: str, mode: str, order: Sequence[str]) -> None:
        # Rebalancing splits a month that holds most rows and joins small ones,
        # so neither one task nor a swarm of files results; sorting by key
        # afterwards gives row groups narrow key ranges.
        (
            with_month(df)
            .hint("rebalance", *[F.col(c) for c in MONTH])
            .sortWithinPartitions(*MONTH, *order)
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*MONTH)
            .parquet(self.path(table))
        )

    def _touched_months(self, df: DataFrame) -> list[tuple[int, int]]:
        months = with_month(df.select("date")).select(*MONTH).distinct()
        return [(r["year"], r["month"]) for r in months.collect()]  # one row per calendar month

    def upsert(
        self, table: str, batch: DataFrame, arrival: Sequence[str] | None = None
    ) -> None:
        """Insert or replace rows by the table's key, rewriting only the touched months.

        `arrival` names batch columns that tell which of several rows with one
        key came last; they need not belong to the table. Without it no key may be
        repeated: a frame has no order of its own that would tell.
        """
        with self.job():
            rows, problems, _ = self._taken(table, batch, arrival, {})
            refuse(table, problems)
            self._replace(table, rows)

    def _taken(
        self, table: str, batch: DataFrame, arrival: Sequence[str] | None, rules: Mapping[str, Column]
    ) -> tuple[DataFrame, list[str], int]:
        """The batch in the table's layout, staged; every broken rule with its count; the number of rows.

        The rules, and that no key is null, are counted by the job that stages the batch, so
        the batch's own plan runs once however many rules there are.
        """
        declared = schemas.data_columns(table)
        sequence = [F.col(c).alias(f"{ARRIVAL}{i}") for i, c in enumerate(arrival or [])]
        extra = set(arrival or []) - set(declared)
        typed = schemas.conform(batch.drop(*extra), table)
        rows = batch.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in typed.schema.fields if f.name in declared],
            *sequence,
        )
        return self._counted(rows, {f"{k}: null": F.col(k).isNull() for k in schemas.KEYS[table]} | dict(rules), table)

    def _counted(self, rows: DataFrame, rules: Mapping[str, Column], purpose: str) -> tuple[DataFrame, list[str], int]:
        seen = Observation()
        counts = [F.count_if(F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())]
        staged = self.staged(rows.observe(seen, F.count("*").alias("n"), *counts), purpose)
        found = seen.get
        broken = [(name, found.get(f"r{i}", 0)) for i, name in enumerate(rules)]
        return staged, [f"{name} ({n} rows)" for name, n in broken if n], found.get("n", 0)

    def _replace(self, table: str, rows: DataFrame) -> None:
        """Upsert staged rows, whose arrival columns are numbered."""
        keys = schemas.KEYS[table]
        names = [c for c in rows.columns if c.startswith(ARRIVAL)]
        if names:
            fresh = last_per_key(rows, keys, names).drop(*names)
        else:
            repeated = rows.groupBy(*keys).count().where("count > 1")
            if not repeated.isEmpty():
                raise ValueError(f"{table}: {repeated.count()} repeated keys; name the columns of their arrival")
            fresh = rows
        fresh = schemas.conform(fresh, table)
        if self._stored(table) is not None:
            months = self._touched_months(rows)
            if not months:
                return
            fresh = merge_rows(self.read_months(table, months), fresh, keys, rows)
        self._write(fresh, table, "overwrite", keys)

    def write_features(self, df: DataFrame, arrival=None) -> None:
        self.upsert("daily_features", df, arrival)

    def write_outcomes(self, df: DataFrame, arrival=None) -> None:
        """Check that no required figure is missing, then upsert."""
        from paceline.operators.quality import null_rules

        with self.job():
            rows, problems, n = self._taken("outcomes", df, arrival, null_rules("outcomes"))
            if not n:
                raise ValueError("there are no outcomes to write")
            refuse("outcomes", problems)
            self._replace("outcomes", rows)

    def write_proposals(self, df: DataFrame, matrices: DataFrame | None = None, arrival=None) -> None:
        """Check, store the matrices, upsert the proposals, drop matrices without a proposal."""
        from paceline.operators.quality import proposal_rules
        from paceline.sources.matrices import MatrixStore, width_violations

        with self.job():
            rows, problems, _ = self._taken("proposals", df, arrival, proposal_rules())
            if matrices is not None:
                wide = self.listed(width_violations(matrices, rows), "matrices")
                problems += [f"matrix width differs from column_names ({wide})"] if wide else []
            refuse("proposals", problems)
            if matrices is not None:
                MatrixStore(self).write(matrices)
            self._replace("proposals", rows)
            if matrices is not None:
                MatrixStore(self).sweep(matrices.select("date", "product").distinct())

    def append_decisions(self, df: DataFrame, batch: str | None = None) -> None:
        """Append to the decision log, in time order within each file; nothing is replaced.

        `batch` names the batch of a stream, so that a replay can be told.
        """
        from paceline.operators.quality import decision_rules

        with self.job():
            rows, problems, _ = self._counted(schemas.conform(df, "decisions"), decision_rules(), "decisions")
            refuse("decisions", problems)
            self._write(rows.withColumn(BATCH, F.lit(batch).cast("string")), "decisions", "append", ["decided_at_utc"])

    def holds_batch(self, table: str, batch: str, first: date | None = None, last: date | None = None) -> bool:
        """Whether a table has rows of the batch, looked for in the months of its dates only."""
        stored = self._stored(table)
        if stored is None:
            return False
        pruned = stored.where(in_months(first, last)) if "year" in stored.columns else stored
        return not pruned.where(F.col(BATCH) == batch).isEmpty()
