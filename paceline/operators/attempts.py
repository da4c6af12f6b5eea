"""Configurations drawn for slots, and the first attempt that solves."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paceline.functions.draws import draw_key, keyed_index
from paceline.operators.keyed import first_per_key
from paceline.schemas import DAY_KEY, SOLVED

# One attempt and three retries per slot.
MAX_ATTEMPTS = 4
FAILED = "solver_error"
FAILURE = ["date", "product", "family", "proposal_type", "slot", "attempt", "config_hash", "solver_status", "failure"]


def sample_configs(
    slots: DataFrame, grid: DataFrame, seed: object, keys: Sequence[str]
) -> DataFrame:
    """One uniformly drawn configuration of the row's family.

    How the grid is joined is left to its measured size. `keys` make the draw
    unique; an attempt number among them lets retries repeat a configuration.
    """
    sized = grid.groupBy("family").agg(F.count("*").alias("size"))
    drawn = slots.join(sized, "family").withColumn(
        "idx", keyed_index(draw_key(seed, *keys), F.col("size"))
    )
    chosen = grid.select("family", "idx", "config_json", "config_hash")
    return drawn.join(chosen, ["family", "idx"]).drop("size")


def plan_attempt(
    slots: DataFrame, grid: DataFrame, seed: object, keys: Sequence[str], attempt: int
) -> DataFrame:
    """One attempt of every slot, with the configuration drawn for it."""
    tries = slots.withColumn("attempt", F.lit(attempt))
    return sample_configs(tries, grid, seed, [*keys, "attempt"])


RESULT = (
    "weights array<double>, column_names array<string>, n_names int, in_sample_sharpe double, "
    "in_sample_mean_pnl double, in_sample_max_dd double, solver_status string, solve_time_seconds double, "
    "failure string"
)
RESULT_NAMES = [part.split()[0] for part in RESULT.split(", ")]


def one_result(function: Callable[..., dict], attempt: dict, *more: object) -> dict:
    """The function's result columns; an exception is a failed attempt and its text the failure."""
    try:
        found = function(attempt, *more)
    except Exception as problem:  # kept with the attempt, see failed_attempts()
        found = {"solver_status": FAILED, "failure": f"{type(problem).__name__}: {problem}"}
    return {**attempt, **{name: found.get(name) for name in RESULT_NAMES}}


def result_shape(attempts: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in attempts.schema.fields) + f", {RESULT}"


def solver_from(function: Callable[[dict], dict]) -> Callable[[DataFrame], DataFrame]:
    """A solver of attempts from a Python function that solves one.

    The function takes an attempt as a dict and returns the columns of RESULT. An
    exception in it is a failed attempt (`solver_error`), not the end of the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one_result(function, attempt) for attempt in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=[*batch.columns, *RESULT_NAMES])

    def solve(attempts: DataFrame) -> DataFrame:
        return attempts.mapInPandas(run, result_shape(attempts))

    return solve


def matrix_solver(
    function: Callable[[dict, np.ndarray], dict], matrices: DataFrame
) -> Callable[[DataFrame], DataFrame]:
    """A solver of attempts from a Python function of one attempt and its matrix.

    `matrices` holds matrix rows: t, values and `date` and `product` or one of them,
    which tell whose they are. The attempts of a (date, product) meet its matrix in one
    cogroup, so a matrix is moved once for all of them and none is closed over or
    sent by the driver. The function gets the rows in the order of t; attempts without
    a matrix, and matrices whose rows differ in width, are failed attempts. A matrix, days
    times tickers, has to fit in a task.
    """
    keys = [k for k in DAY_KEY if k in matrices.columns]
    if not keys:
        raise ValueError("matrices need a date or a product")

    def solve(attempts: DataFrame) -> DataFrame:
        shape = result_shape(attempts)
        kinds = to_arrow_schema(StructType.fromDDL(shape))

        def run(tries: pa.Table, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("t")
            widths = set(rows.column("values").combine_chunks().value_lengths().to_pylist())
            if len(widths) == 1 and None not in widths:
                cells = rows.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                matrix = cells.reshape(rows.num_rows, -1).astype(float)
                found = [one_result(function, attempt, matrix.copy()) for attempt in tries.to_pylist()]
            else:
                reason = "matrix rows differ in width" if widths else "no matrix"
                refuse = {"solver_status": FAILED, "failure": reason}
                found = [one_result(lambda _: refuse, attempt) for attempt in tries.to_pylist()]
            return pa.Table.from_pylist(found, kinds)

        held = matrices.select(*keys, "t", "values")
        return attempts.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, shape)

    return solve


def failed_attempts(results: DataFrame) -> DataFrame:
    """Attempts without a solution, with the solver's verdict and the failure's text."""
    text = F.col("failure") if "failure" in results.columns else F.lit(None).cast("string")
    unsolved = ~F.coalesce(F.col("solver_status").isin(SOLVED), F.lit(False))
    return results.where(unsolved).select(*FAILURE[:-1], text.alias("failure"))


def first_success(
    results: DataFrame, slot_keys: Sequence[str], ties: Sequence[Column | str] = ()
) -> DataFrame:
    """The earliest solved attempt per slot; slots without one drop out."""
    solved = results.where(F.col("solver_status").isin(SOLVED))
    order = [F.col("attempt"), *[F.col(c) if isinstance(c, str) else c for c in ties]]
    return first_per_key(solved, slot_keys, order)


def label_first_two(
    items: DataFrame, group: Sequence[str], order: Sequence[str], item: str
) -> DataFrame:
    """First item of a group `best`, second `alt`, all others `candidate`.

    Only two rows per group and map task are shuffled to be ranked; the labels
    go back to the items by their own unique key.
    """
    ranked = items.select(item, *group, *order).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    )
    first = ranked.where("_rank <= 2").select(item, "_rank")
    label = F.when(F.col("_rank") == 1, "best").when(F.col("_rank") == 2, "alt").otherwise("candidate")
    return items.join(first, item, "left").withColumn("label", label).drop("_rank")
