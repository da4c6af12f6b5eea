"""Random draws that depend on a text key only.

The same key gives the same draw whatever the partitioning, the number of
executors or the number of task retries, which a seeded `randn` does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits of the digest make a 52-bit integer, exact in a double.
_DIGITS = 13
_RANGE = float(2**52)


def _bits(key: Column) -> Column:
    return F.conv(F.substring(F.sha2(key, 256), 1, _DIGITS), 16, 10).cast("bigint")


def draw_key(seed: object, *parts: Column | str) -> Column:
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])


def keyed_uniform(key: Column) -> Column:
    """A draw from [0, 1)."""
    return _bits(key) / F.lit(_RANGE)


def keyed_normal(key: Column) -> Column:
    """A standard normal draw (Box and Muller's cosine form)."""
    u = (_bits(F.concat(key, F.lit("|u1"))) + F.lit(1)) / F.lit(_RANGE)
    v = _bits(F.concat(key, F.lit("|u2"))) / F.lit(_RANGE)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0) * F.pi() * v)


def keyed_index(key: Column, size: Column) -> Column:
    """A uniform position 0 … size-1."""
    return F.floor(keyed_uniform(key) * size).cast("int")
