"""Stored regression moments, kept up to date by proposal date.

A row belongs to one (date, product, family, eval_date). Recording a day's outcomes
recomputes the rows of that proposal date alone, from that date's proposals, features and
outcomes, and replaces them; a repeated recording so replaces what it gave before. A fit
reads these rows, whose number is bounded by the calendar and the arms, and no history.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators.moments import COLUMNS, LAYOUT, moment_rows
from paceline.operators.training import arm_days
from paceline.sources.tables import TableStore, in_months, row_filter

TABLE = "arm_moments"
KEYS = ["date", "product", "family", "eval_date"]


class MomentStore:
    """The moment rows below a store's root; there are none before `rebuild`."""

    def __init__(self, store: TableStore) -> None:
        self.store = store

    def _stored(self) -> DataFrame | None:
        layout = f"{LAYOUT}, year int, month int"
        try:
            return self.store.spark.read.schema(layout).parquet(self.store.path(TABLE))
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def kept(self) -> bool:
        """Whether this store keeps moments."""
        return self._stored() is not None

    def read(self, as_of: date | None = None, products: Sequence[str] | None = None) -> DataFrame:
        """Moment rows of what was evaluated by `as_of`."""
        stored = self._stored()
        rows = self.store.spark.createDataFrame([], LAYOUT) if stored is None else stored.select(*COLUMNS)
        if as_of is not None:
            rows = rows.where(F.col("eval_date") <= F.lit(as_of))
        return rows.where(row_filter(product=products))

    def _computed(self, start: date | None, end: date | None) -> DataFrame:
        store = self.store
        return moment_rows(
            arm_days(store.read_proposals(start, end), store.read_features(start, end), store.read_outcomes(start, end))
        )

    def rebuild(self) -> None:
        """Compute all moment rows from the whole history; from then on the daily jobs keep them."""
        with self.store.job():
            rows = self.store.staged(self._computed(None, None), "moments")
            self.store.remove(self.store.path(TABLE))
            self.store._write(rows, TABLE, "overwrite", KEYS)

    def refresh(self, days: Sequence[date]) -> None:
        """Replace the rows of some proposal dates; only their months' rows are read and written."""
        days = sorted(set(days))
        if not days:
            return
        with self.store.job():
            fresh = reduce(DataFrame.unionByName, [self._computed(day, day) for day in days])
            months = sorted({(d.year, d.month) for d in days})
            others = self.store.spark.createDataFrame([], LAYOUT)
            if (stored := self._stored()) is not None:
                touched = reduce(lambda a, b: a | b, [in_months(date(y, m, 1), date(y, m, 1)) for y, m in months])
                others = stored.where(touched & ~F.col("date").isin(days)).select(*COLUMNS)
            rows = self.store.staged(others.unionByName(fresh), "moments")
            self.store._write(rows, TABLE, "overwrite", KEYS)

