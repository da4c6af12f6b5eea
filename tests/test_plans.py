"""Plan shapes that keep the jobs scalable."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_DIR


# Queries that aggregate a whole table into one row, combined map-side.
GLOBAL_ROW = ("rule_report", "null_report", "conditional_null_violations", "posterior_given_scaler", "fit_exclusions")


@pytest.fixture(autouse=True)
def whole_metadata(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")


def plan(spark, name):
    return entry.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["decisions_latest", "upsert_keep_last", "first_success", "slot_labels"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    below_exchange = text[text.index("Exchange", text.index("WindowGroupLimit")) :]
    assert "Partial" in below_exchange.split("WindowGroupLimit", 1)[1].splitlines()[0]


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_no_product_joins_or_single_partitions(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in GLOBAL_ROW:
        assert "SinglePartition" not in text


def test_history_is_condensed_before_any_window(spark):
    text = plan(spark, "walk_forward")
    windows = text.split("+- Window [")[1:]
    assert len(windows) >= 4
    assert "partial_count(1)" in windows[-1]
    assert "FileScan" not in "".join(windows[:-2])


@pytest.mark.parametrize(
    "name, columns",
    [
        ("partition_counts", "l_shipdate"),
        ("pending_proposals", "l_orderkey"),
        ("turnover_l1", "l_orderkey,l_suppkey,l_extendedprice"),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    scans = [line for line in plan(spark, name).splitlines() if "FileScan" in line and "l_" in line]
    assert scans
    for line in scans:
        read = line.split("ReadSchema: struct<")[1].split(">")[0]
        assert sorted(c.split(":")[0] for c in read.split(",")) == sorted(columns.split(","))


def test_date_filters_reach_the_scan(spark):
    text = plan(spark, "read_proposals")
    assert "PushedFilters" in text and "In(o_orderpriority" in text
