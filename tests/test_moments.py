"""Stored moments against full refits."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import arms, training
from paceline.operators.moments import arm_moments, merged, moment_rows
from paceline.plans import daily
from paceline.schemas import FAMILIES, FEATURES, PRODUCTS
from paceline.sources.moments import MomentStore
from tests import makers as m
from tests.test_arms import random_history

ARM = ["product", "family"]


@pytest.fixture(scope="module")
def rows(spark):
    features, proposals, outcomes = random_history(days=30)
    frames = [spark.createDataFrame(f) for f in (proposals, features, outcomes)]
    return training.arm_days(*frames).cache()


def same(left, right, tolerance=1e-9):
    left = {(r["product"], r["family"]): r for r in left.collect()}
    right = {(r["product"], r["family"]): r for r in right.collect()}
    assert left.keys() == right.keys() and left
    for key, a in left.items():
        b = right[key]
        assert a["n"] == b["n"]
        for name in ("gram", "cross", "means", "stds"):
            assert np.allclose(a[name], b[name], rtol=tolerance, atol=tolerance), (key, name)


def test_moments_of_rows_are_those_of_history(rows):
    same(arm_moments(moment_rows(rows)), arms.moments(rows))


def test_merging_in_any_order_and_shape(rows):
    single = moment_rows(rows).withColumn("part", F.pmod(F.xxhash64("date", "family"), F.lit(7)))
    thirds = merged(single, [*ARM, "part"]).withColumn("half", F.col("part") % 2)
    same(arm_moments(merged(thirds, [*ARM, "half"])), arms.moments(rows))
    twice = merged(merged(single, [*ARM, "part", "date"]), ARM)
    same(arm_moments(twice), arms.moments(rows))


def test_a_pair_merges_as_its_union(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(50, 1e-3, (20, len(FEATURES))), rng.normal(size=20)
    columns = "date date, product string, family string, eval_date date, n long, score_sum double, " + ", ".join(f"{f} double" for f in FEATURES)
    made = [(m.DAY + timedelta(days=k), "vol", "max_mean", m.DAY, 1, float(y[k]), *map(float, x[k])) for k in range(20)]
    single = moment_rows(spark.createDataFrame(made, columns))
    halves = merged(single.withColumn("half", (F.dayofmonth("date") > 9).cast("int")), [*ARM, "half"])
    row = merged(halves, ARM).first()
    centred = x - x.mean(axis=0)
    products = (centred.T @ centred)[np.triu_indices(len(FEATURES))]
    assert row["n"] == 20 and np.allclose(row["means"], x.mean(axis=0), rtol=1e-14)
    assert np.allclose(row["products"], products, rtol=1e-8)
    assert np.allclose(row["cross"], centred.T @ y, rtol=1e-8, atol=1e-12)
    assert row["score_mean"] == pytest.approx(y.mean())


def history(store, spark, days):
    """Proposals and features of some days in a store."""
    rng = np.random.default_rng(8)
    first = date(2031, 1, 29)
    proposals, features, outcomes = [], [], []
    for k in range(days):
        day = first + timedelta(days=k)
        for product in PRODUCTS[:2]:
            features.append(m.feature(day, product, **{f: float(v) for f, v in zip(FEATURES, rng.normal(size=7))}))
            for family in FAMILIES:
                for n in range(2):
                    key = f"{family}-{n}"
                    proposals.append(m.proposal(day, product, key, family=family))
                    outcomes.append(m.outcome(day, product, key, eval_date=day + timedelta(days=7), meta_score=float(rng.normal())))
    store.write_features(m.frame(spark, "daily_features", features))
    store.write_proposals(m.frame(spark, "proposals", proposals))
    return first, outcomes


def test_days_added_one_by_one_equal_a_full_refit(spark, store):
    first, outcomes = history(store, spark, 8)
    kept = MomentStore(store)
    assert not kept.kept() and kept.read().count() == 0
    kept.rebuild()
    for k in range(8):
        day = first + timedelta(days=k)
        store.write_outcomes(m.frame(spark, "outcomes", [r for r in outcomes if r["date"] == day]))
        kept.refresh([day])
    as_of = first + timedelta(days=12)
    full = training.arm_days(store.read_proposals(), store.read_features(), store.read_outcomes(), as_of)
    assert full.count() == 6 * 2 * len(FAMILIES)
    same(arm_moments(kept.read(as_of)), arms.moments(full))
    # a day recorded again takes the place of what it gave before
    again = [{**r, "meta_score": 2.0} for r in outcomes if r["date"] == first]
    store.write_outcomes(m.frame(spark, "outcomes", again))
    kept.refresh([first, first])
    full = training.arm_days(store.read_proposals(), store.read_features(), store.read_outcomes(), as_of)
    same(arm_moments(kept.read(as_of)), arms.moments(full))
    assert kept.read(products=["nothing"]).count() == 0
    before = sorted(map(repr, kept.read().collect()))
    kept.rebuild()
    assert sorted(map(repr, kept.read().collect())) == before


def test_a_day_reads_its_own_month_and_a_fit_reads_no_history(spark, store):
    first, outcomes = history(store, spark, 8)
    store.write_outcomes(m.frame(spark, "outcomes", outcomes))
    kept = MomentStore(store)
    kept.rebuild()
    plan = kept._computed(first, first)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 3
    for scan in scans:
        assert "month" in scan.split("PartitionFilters: [")[1].split("]")[0]
        assert f"GreaterThanOrEqual(date,{first})" in scan and f"LessThanOrEqual(date,{first})" in scan
    files = arm_moments(kept.read(first + timedelta(days=9))).inputFiles()
    assert files and all("/arm_moments/" in f for f in files)


def test_the_daily_jobs_keep_and_use_them(spark, store):
    from tests.test_daily import MARKET, TODAY, matrices, solver

    kept = MomentStore(store)
    kept.rebuild()
    daily.propose_today(store, TODAY, MARKET, matrices(spark), solver(), seed=42)
    vols = spark.createDataFrame([(p, 0.02) for p in PRODUCTS], "product string, vol double")
    daily.record_outcomes(store, TODAY, date(2026, 4, 23), matrices(spark, days=5), vols)
    assert kept.read().agg(F.sum("n")).first()[0] == 20
    later = date(2026, 4, 24)
    daily.propose_today(store, later, MARKET, matrices(spark), solver(), seed=1)
    columns = ["product", "family", "posterior_mean", "posterior_std", "thompson_sample_value"]
    found = {tuple(r[:2]): r for r in store.read_proposals(later).select(*columns).collect()}
    rows = training.arm_days(store.read_proposals(), store.read_features(), store.read_outcomes(), later)
    contexts = store.read_features(later, later)
    wanted = {(r["product"], r["family"]): r for r in arms.slots_today(contexts, rows, 1).collect()}
    assert found.keys() == wanted.keys()
    for key, row in found.items():
        assert row["posterior_mean"] == pytest.approx(wanted[key]["posterior_mean"], abs=1e-9)
        assert row["posterior_std"] == pytest.approx(wanted[key]["posterior_std"], abs=1e-9)
