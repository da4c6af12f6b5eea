"""One row per key: keep-last, merge by key, first success."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order.

    The `= 1` filter on the row number lets Spark cut every map task's output to
    one row per key before the shuffle, so a key with a third of all rows does
    not land in one task. Null keys form a group of their own.
    """
    ranked = df.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.where("_rank = 1").drop("_rank")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [F.col(c).desc() for c in order])


def merge_rows(
    kept: DataFrame, fresh: DataFrame, keys: Sequence[str], batch: DataFrame | None = None
) -> DataFrame:
    """Old rows whose key is not replaced, followed by the new rows.

    `batch` is what `fresh` was reduced from; its keys are the same, and taking
    them from there saves a second run of that reduction.
    """
    replaced = (fresh if batch is None else batch).select(*keys)
    return kept.join(replaced, list(keys), "left_anti").unionByName(fresh)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the keys into the session's shuffle partitions.

    For few rows with much work each: by their size alone they would be put into
    one task. Windows over the same keys need no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
