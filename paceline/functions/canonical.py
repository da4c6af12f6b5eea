"""Canonical text and key of a configuration.

There is one canonical form, written by one Arrow-batched helper: it takes
free-form JSON text, which needs recursion over unknown members, and structs by
way of `to_json`, so that a configuration has the same key in either shape.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Version of the hashed payload, digits kept of a float, key length.
PAYLOAD_VERSION = 1
FLOAT_DIGITS = 10
KEY_LENGTH = 16


def config_key(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical, 256), 1, KEY_LENGTH)


def canonical_double(value: Column) -> Column:
    return F.round(value, FLOAT_DIGITS)


def not_finite(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == float("inf"))


def _tidy(value: object) -> object:
    if isinstance(value, dict):
        return {name: _tidy(member) for name, member in value.items() if member is not None}
    if isinstance(value, list):
        return [_tidy(member) for member in value]
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("number is not finite")
        return round(value, FLOAT_DIGITS)
    if value is None or isinstance(value, (bool, int, str)):
        return value
    raise TypeError(f"a {type(value).__name__} is no config value")


def canonical_text(config: dict) -> str:
    """Canonical text of one configuration held by the driver."""
    payload = {"_v": PAYLOAD_VERSION, "config": _tidy(config)}
    return json.dumps(payload, sort_keys=True, separators=(",", ":"))


def _canonical_or_problem(text: str | None) -> tuple[str | None, str | None]:
    if text is None:
        return None, "no text"
    try:
        config = json.loads(text)
        if not isinstance(config, dict):
            return None, "not an object"
        return canonical_text(config), None
    except ValueError as problem:
        return None, "invalid JSON" if isinstance(problem, json.JSONDecodeError) else str(problem)


_RESULT = T.StructType(
    [T.StructField("canonical", T.StringType()), T.StructField("problem", T.StringType())]
)


@F.pandas_udf(_RESULT)
def canonical_json(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Canonical form of free-form JSON objects, or the reason there is none."""
    for batch in texts:
        yield pd.DataFrame(
            [_canonical_or_problem(text) for text in batch], columns=["canonical", "problem"]
        )


def canonical_struct(config: Column) -> Column:
    """Canonical text of a struct; an error for a number that is not finite.

    `to_json` leaves null members out and writes such numbers as the texts
    tested here, which are therefore refused as texts, too.
    """
    text = F.to_json(config)
    finite = F.when(text.rlike('[:,\\[]"(NaN|-?Infinity)"'), F.raise_error(F.lit("number is not finite"))).otherwise(text)
    return canonical_json(finite.cast("string"))["canonical"]
