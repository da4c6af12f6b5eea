"""The discrete configuration grid, built from its axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.functions.canonical import canonical_double, canonical_struct, config_key

# The axes of the grid. The last axis varies fastest.
WIDE_MAXIMA = [0.05, 0.08, 0.10, 0.15]
NARROW_MAXIMA = [0.05, 0.08, 0.10]
NAME_RANGES = [(10, 20), (15, 30), (20, 40)]
TARGET_STDS = [0.01, 0.02, 0.03, 0.05]
COMPONENT_SETS = [
    [("3m", "mean", 0.5), ("1m", "min", 0.5)],
    [("full", "sum", 1.0), ("1y", "std", -0.3)],
    [("1m", "mean", 1.0), ("3m", "mean", 2.0), ("1y", "mean", 3.0)],
]
MIN_WEIGHT = 0.0
CARDINALITY_METHOD = "mip"

# family -> (component sets, target stds, weight maxima); None: the axis is absent.
AXES = {
    "composite": (COMPONENT_SETS, None, NARROW_MAXIMA),
    "max_mean": (None, None, WIDE_MAXIMA),
    "max_min": (None, None, WIDE_MAXIMA),
    "max_sharpe": (None, TARGET_STDS, NARROW_MAXIMA),
    "min_drawdown": (None, None, WIDE_MAXIMA),
}

_AXES_SCHEMA = (
    "family string, components array<array<struct<period:string,stat:string,weight:double>>>, "
    "target_stds array<double>, maxima array<double>, ranges array<struct<lo:int,hi:int>>"
)


def grid_size(family: str) -> int:
    components, stds, maxima = AXES[family]
    return len(components or [None]) * len(stds or [None]) * len(maxima) * len(NAME_RANGES)


def total_grid_size() -> int:
    return sum(grid_size(family) for family in AXES)


def config_struct(
    objective, components, target_std, max_weight, min_names, max_names
):
    """A configuration with its fields in alphabetical order, as hashing needs them."""
    return F.struct(
        F.struct(
            max_names.alias("max_names"),
            F.lit(CARDINALITY_METHOD).alias("method"),
            min_names.alias("min_names"),
        ).alias("cardinality"),
        components.alias("components"),
        objective.alias("objective"),
        canonical_double(target_std).alias("target_std"),
        F.struct(
            canonical_double(max_weight).alias("max"), F.lit(MIN_WEIGHT).alias("min")
        ).alias("weight_bounds"),
    )


def config_grid(spark: SparkSession, families: list[str] | None = None) -> DataFrame:
    """One row per configuration: family, idx, grid_size, config, config_json, config_hash.

    A few dozen rows by construction, whatever the data: safe to broadcast.
    """
    chosen = sorted(AXES) if families is None else families
    rows = [(f, *AXES[f], NAME_RANGES) for f in chosen]
    axes = spark.createDataFrame(rows, T._parse_datatype_string(_AXES_SCHEMA))
    exploded = (
        axes.select("*", F.posexplode_outer("components").alias("pos_c", "part"))
        .select("*", F.posexplode_outer("target_stds").alias("pos_s", "target_std"))
        .select("*", F.posexplode("maxima").alias("pos_m", "max_weight"))
        .select("*", F.posexplode("ranges").alias("pos_r", "names"))
    )
    steps_s = F.greatest(F.coalesce(F.size("target_stds"), F.lit(1)), F.lit(1))
    position = F.coalesce("pos_c", F.lit(0))
    position = position * steps_s + F.coalesce("pos_s", F.lit(0))
    position = position * F.size("maxima") + F.col("pos_m")
    position = position * F.size("ranges") + F.col("pos_r")
    sized = F.create_map(*[F.lit(v) for f in chosen for v in (f, grid_size(f))])
    config = config_struct(
        F.col("family"),
        F.col("part"),
        F.col("target_std"),
        F.col("max_weight"),
        F.col("names.lo"),
        F.col("names.hi"),
    )
    return (
        exploded.select(
            "family",
            position.cast("int").alias("idx"),
            sized[F.col("family")].alias("grid_size"),
            config.alias("config"),
        )
        .withColumn("config_json", canonical_struct(F.col("config")))
        .withColumn("config_hash", config_key(F.col("config_json")))
    )
