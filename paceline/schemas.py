"""Table layouts, value domains, and the write/read conformance checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The data model's identifiers.
PRODUCTS = ["corridor_var", "dngamma", "gamma", "var", "vol"]
FAMILIES = ["composite", "max_mean", "max_min", "max_sharpe", "min_drawdown"]
PROPOSAL_TYPES = ["best", "alt", "explore", "candidate"]
DECISIONS = ["accepted", "rejected", "modified"]
SCORE_MODES = ["research", "continuous"]
SOLVER_STATUSES = ["optimal", "optimal_inaccurate", "infeasible", "unbounded", "solver_error"]
SOLVED = ["optimal", "optimal_inaccurate"]
FEATURES = [
    "vix_level",
    "vix_20d_change",
    "avg_pairwise_corr",
    "dispersion_pnl_20d",
    "skew_steepness",
    "term_structure_slope",
    "earnings_density_21d",
]
VERSION_COLUMN = "_table_schema_version"
VERSIONS = {"daily_features": 1, "proposals": 1, "outcomes": 1, "decisions": 1, "pnl_matrices": 1}

DAY_KEY = ["date", "product"]
PROPOSAL_KEY = ["date", "product", "config_hash"]
KEYS = {
    "daily_features": DAY_KEY,
    "proposals": PROPOSAL_KEY,
    "outcomes": PROPOSAL_KEY,
    "decisions": PROPOSAL_KEY,
    "pnl_matrices": [*PROPOSAL_KEY, "t"],
}

# Column types per table; a trailing "?" marks a column that may be null.
_LAYOUT = {
    "daily_features": "date date, product string, "
    + ", ".join(f"{name} double" for name in FEATURES)
    + f", {VERSION_COLUMN} int",
    "proposals": (
        "date date, product string, config_hash string, config_json string, "
        "config_schema_version int, family string, proposal_type string, "
        "thompson_sample_value double?, posterior_mean double?, posterior_std double?, "
        "weights array<double>, column_names array<string>, n_names int, "
        "in_sample_sharpe double, in_sample_mean_pnl double, in_sample_max_dd double, "
        "solver_status string, solve_time_seconds double, pnl_matrix_path string?, "
        f"{VERSION_COLUMN} int"
    ),
    "outcomes": (
        "date date, product string, config_hash string, eval_date date, "
        "forward_window_days int, forward_5d_pnl double, forward_5d_mean_return double, "
        "forward_realized_vol_21d double, forward_sharpe double, turnover_vs_prev_best double?, "
        f"meta_score double, meta_score_mode string, lambda_used double, {VERSION_COLUMN} int"
    ),
    "decisions": (
        "date date, product string, config_hash string, decision string, "
        "decided_at_utc timestamp, notes string?, modified_config_hash string?, "
        f"{VERSION_COLUMN} int"
    ),
    # One row per matrix row; `values` runs along the tickers.
    "pnl_matrices": (
        "date date, product string, config_hash string, t int, values array<double>, "
        f"{VERSION_COLUMN} int"
    ),
}


class SchemaError(ValueError):
    """A frame does not fit the declared layout of its table."""


def schema(table: str) -> T.StructType:
    """The declared layout, with `nullable` telling which columns may be null."""
    fields = []
    for column in _LAYOUT[table].split(", "):
        name, kind = column.split(" ", 1)
        optional = kind.endswith("?")
        parsed = T._parse_datatype_string(kind.rstrip("?"))
        fields.append(T.StructField(name, parsed, optional))
    return T.StructType(fields)


def data_columns(table: str) -> list[str]:
    return [f.name for f in schema(table).fields if f.name != VERSION_COLUMN]


def required_columns(table: str) -> list[str]:
    return [f.name for f in schema(table).fields if not f.nullable and f.name != VERSION_COLUMN]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Bring `df` to the declared layout, or raise.

    Column names are compared on the schema alone, so nothing runs unless the
    caller left a version column in, which must then hold only nulls. Casts
    follow the session's ANSI rules: text that is no number fails the write.
    """
    if VERSION_COLUMN in df.columns:
        if not df.where(F.col(VERSION_COLUMN).isNotNull()).isEmpty():
            raise SchemaError(f"{VERSION_COLUMN} is set by the library, not by callers")
        df = df.drop(VERSION_COLUMN)
    wanted, got = set(data_columns(table)), set(df.columns)
    if wanted - got:
        raise SchemaError(f"{table}: missing columns {sorted(wanted - got)}")
    if got - wanted:
        raise SchemaError(f"{table}: extra columns {sorted(got - wanted)}")
    if table == "decisions":
        require_zoned(df, "decided_at_utc")
    return df.select(
        *[
            F.lit(VERSIONS[table]).cast("int").alias(f.name)
            if f.name == VERSION_COLUMN
            else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in schema(table).fields
        ]
    )


def require_zoned(df: DataFrame, column: str) -> None:
    """Reject a timestamp column without a time zone; decided on the schema."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        raise SchemaError(f"{column} must be a zone-aware timestamp, got timestamp_ntz")


def check_readable(df: DataFrame, table: str) -> DataFrame:
    """Select the declared columns of a stored table; extra ones are ignored."""
    missing = set(schema(table).names) - set(df.columns)
    if missing:
        raise SchemaError(f"stored {table} lacks columns {sorted(missing)}")
    return df.select(*schema(table).names)
