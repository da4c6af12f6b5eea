"""Every registered query against its check SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences
from tests.conftest import SF_DIR

QUERIES = entry.QUERIES
CHECKS = entry.CHECKS


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_check_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR).toPandas()
    assert name in CHECKS
    wanted = duck.execute(CHECKS[name]).df()
    assert differences(found, wanted) == []
    assert len(found) > 0


def test_entry_runs(spark):
    slots = entry.entry(spark)
    rows = slots.collect()
    per_product = {}
    for row in rows:
        per_product.setdefault(row["product"], []).append(row)
    for chosen in per_product.values():
        assert sorted(r["proposal_type"] for r in chosen) == ["alt", "alt", "best", "explore"]
        assert len({r["family"] for r in chosen}) == 4
