"""Return matrices as rows: one row per (key, t), `values` along the tickers.

A matrix used by all proposals of a (date, product) is stored once under the
key SHARED instead of once per proposal.
"""

from __future__ import annotations

from datetime import date
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from paceline import schemas

if TYPE_CHECKING:
    from paceline.sources.tables import TableStore

SHARED = "*"
TABLE = "pnl_matrices"


def matrix_reference(day, product, key):
    """The reference text a proposal row keeps of its matrix."""
    return F.concat_ws("/", F.lit(TABLE), day.cast("string"), product, F.concat(key, F.lit(".parquet")))


def matrix_shapes(matrices: DataFrame) -> DataFrame:
    """Rows and narrowest / widest row per matrix; ragged matrices have two widths."""
    return matrices.groupBy(*schemas.PROPOSAL_KEY).agg(
        F.count("*").alias("n_rows"),
        F.min(F.size("values")).alias("min_width"),
        F.max(F.size("values")).alias("max_width"),
    )


def width_violations(matrices: DataFrame, proposals: DataFrame) -> DataFrame:
    """Matrices that are ragged or not as wide as their proposal's column_names."""
    shapes = matrix_shapes(matrices)
    named = proposals.select(*schemas.PROPOSAL_KEY, F.size("column_names").alias("n_names"))
    own = shapes.join(named, schemas.PROPOSAL_KEY, "left")
    day_widths = named.groupBy("date", "product").agg(
        F.min("n_names").alias("least_names"), F.max("n_names").alias("most_names")
    )
    wanted_low = F.when(F.col("config_hash") == SHARED, F.col("least_names")).otherwise(F.col("n_names"))
    wanted_high = F.when(F.col("config_hash") == SHARED, F.col("most_names")).otherwise(F.col("n_names"))
    return (
        own.join(day_widths, schemas.DAY_KEY, "left")
        .where(
            (F.col("min_width") != F.col("max_width"))
            | (F.col("min_width") != wanted_low)
            | (F.col("max_width") != wanted_high)
        )
        .select(*schemas.PROPOSAL_KEY, "n_rows", "min_width", "max_width", "n_names")
    )


def orphans(matrices: DataFrame, proposals: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Matrix rows no proposal refers to, within the touched (date, product) pairs."""
    scope = matrices if touched is None else matrices.join(touched, schemas.DAY_KEY, "left_semi")
    live = proposals.select(*schemas.PROPOSAL_KEY)
    own = scope.where(F.col("config_hash") != SHARED).join(live, schemas.PROPOSAL_KEY, "left_anti")
    shared = scope.where(F.col("config_hash") == SHARED).join(live, schemas.DAY_KEY, "left_anti")
    return own.unionByName(shared)


class MatrixStore:
    """Matrices in one folder per date and product: <root>/pnl_matrices/date=…/product=…/."""

    def __init__(self, store: TableStore) -> None:
        self.store = store
        self.spark = store.spark

    def _stored(self) -> DataFrame | None:
        path = self.store.path(TABLE)
        try:
            return self.spark.read.schema(schemas.schema(TABLE)).parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _days(self, pairs: list[Row]) -> DataFrame:
        """The stored rows of some (date, product) pairs; no other folder is opened."""
        near = self.rows().where(
            F.col("date").isin([r["date"] for r in pairs]) & F.col("product").isin([r["product"] for r in pairs])
        )
        wanted = self.spark.createDataFrame([tuple(r) for r in pairs], "date date, product string")
        return near.join(wanted, schemas.DAY_KEY, "left_semi")

    def _write(self, rows: DataFrame) -> None:
        (
            rows.hint("rebalance", *[F.col(c) for c in schemas.DAY_KEY])
            .sortWithinPartitions(*schemas.KEYS[TABLE])
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*schemas.DAY_KEY)
            .parquet(self.store.path(TABLE))
        )

    def write(self, matrices: DataFrame) -> None:
        """Replace whole matrices: a shorter new version leaves no old rows behind."""
        fresh = schemas.conform(matrices, TABLE)
        pairs = fresh.select(*schemas.DAY_KEY).distinct().collect()  # days times products
        if not pairs:
            return
        replaced = fresh.select(*schemas.PROPOSAL_KEY)
        kept = self._days(pairs).join(replaced, schemas.PROPOSAL_KEY, "left_anti")
        self._write(kept.unionByName(fresh))

    def rows(self) -> DataFrame:
        """All stored matrix rows."""
        stored = self._stored()
        return self.spark.createDataFrame([], schemas.schema(TABLE)) if stored is None else stored

    def read(self, day: date, product: str, config_hash: str) -> DataFrame:
        """The rows of one proposal's matrix in order of t; empty if there is none."""
        pair = Row(date=day, product=product)
        return (
            self._days([pair])
            .where(F.col("config_hash").isin(config_hash, SHARED))
            .select("t", "values")
            .orderBy("t")
        )

    def sweep(self, touched: DataFrame) -> None:
        """Rewrite the touched (date, product) folders that hold orphans without them.

        A folder that keeps no matrix is deleted.
        """
        pairs = touched.select(*schemas.DAY_KEY).distinct().collect()  # days times products
        if not pairs:
            return
        stored = self._days(pairs)
        months = sorted({(r["date"].year, r["date"].month) for r in pairs})
        proposals = self.store.read_months("proposals", months).select(*schemas.PROPOSAL_KEY)
        dead = self.store.staged(orphans(stored, proposals).select(*schemas.PROPOSAL_KEY).distinct(), "orphans")
        changed = dead.select(*schemas.DAY_KEY).distinct().collect()
        if not changed:
            return
        left = self.store.staged(self._days(changed).join(dead, schemas.PROPOSAL_KEY, "left_anti"), "matrices")
        kept = {tuple(r) for r in left.select(*schemas.DAY_KEY).distinct().collect()}
        if kept:
            self._write(left)
        for pair in changed:
            if tuple(pair) not in kept:
                self._delete(pair)

    def _delete(self, pair: Row) -> None:
        """Delete the folder of one (date, product), by the folder name Spark gave it."""
        own = self._stored().where((F.col("date") == pair["date"]) & (F.col("product") == pair["product"]))
        files = own.select("_metadata.file_path").distinct().collect()
        for folder in {r[0].rsplit("/", 1)[0] for r in files}:
            self.store.remove(self.spark._jvm.java.net.URI(folder))
