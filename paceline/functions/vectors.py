"""Array columns as vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(left: Column, right: Column) -> Column:
    """Dot product; null when the lengths differ, since `zip_with` would pad."""
    product = total(F.zip_with(left, right, lambda a, b: a * b))
    return F.when(F.size(left) == F.size(right), product)


def to_simplex(values: Column) -> Column:
    """Scale a non-negative array to sum 1."""
    scale = total(values)
    return F.transform(values, lambda v: v / scale)


def ticker_labels(count: Column) -> Column:
    """S00, S01, … for `count` positions; an empty array for none."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.format_string("S%02d", j))).otherwise(
        F.array().cast("array<string>")
    )


def pick_by_name(names: Column, source_names: Column, source: Column) -> Column:
    """`source` re-ordered to `names`; unknown names give null entries."""
    lookup = F.map_from_arrays(source_names, source)
    return F.when(names == source_names, source).otherwise(
        F.transform(names, lambda n: F.element_at(lookup, n))
    )
