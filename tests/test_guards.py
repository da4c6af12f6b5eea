"""Inputs that once gave wrong figures, were dropped in silence, or ended a whole job."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from paceline import schemas
from paceline.functions.canonical import canonical_json, canonical_struct, config_key
from paceline.operators import arms, attempts, linear, portfolio, training
from paceline.plans import daily, walkforward
from paceline.sources.grid import config_grid
from paceline.sources.matrices import MatrixStore
from tests import makers as m
from tests.test_arms import START, random_history, to_spark


def test_a_constant_series_has_no_ratio(spark):
    rows = [(k, t, v) for k, v, n in (("a", 0.01, 7), ("b", 0.3, 252), ("c", 0.0, 3)) for t in range(n)]
    stats = portfolio.in_sample_stats(spark.createDataFrame(rows, "k string, t int, pnl double"), ["k"])
    assert {r["k"]: r["in_sample_sharpe"] for r in stats.collect()} == {"a": 0.0, "b": 0.0, "c": 0.0}


def test_a_constant_feature_leaves_the_others_their_estimates(spark):
    f, p, o = to_spark(spark, random_history(days=30, constant=4))
    found = linear.recover_coefficients(arms.moments(training.arm_days(p, f, o))).collect()
    for r in found:
        assert (r["estimate"] is None) == (r["feature"] == schemas.FEATURES[4])


def test_replay_and_daily_fit_agree_beside_unlisted_families(spark):
    f, p, o = to_spark(spark, random_history(days=25))
    listed, day = schemas.FAMILIES[:3], START + timedelta(days=20)
    today = f.where(F.col("date") == F.lit(day))
    fitted = arms.with_prior_arms(today, arms.moments(training.arm_days(p, f, o, day)), listed)
    wanted = arms.predict(fitted, ["date", "product", "family"]).collect()
    replay = walkforward.predictions(p, f, o, listed).where(F.col("date") == F.lit(day)).collect()
    key = lambda r: (r["product"], r["family"])
    assert len(replay) == 2 * 3
    for a, b in zip(sorted(wanted, key=key), sorted(replay, key=key), strict=True):
        assert key(a) == key(b) and a["n_obs"] == b["n_obs"]
        assert a["posterior_mean"] == pytest.approx(b["posterior_mean"], rel=1e-9)


def test_infinite_scores_stay_out_of_the_fit(spark):
    f, p, o = to_spark(spark, random_history(days=10))
    odd = o.withColumn("meta_score", F.when(F.col("config_hash") == "max_mean-0", float("inf")).otherwise(F.col("meta_score")))
    rows = training.arm_days(p, f, odd)
    assert rows.where("family = 'max_mean'").agg(F.sum("n")).first()[0] == 10 * 2
    assert rows.where(F.abs("score_sum") == float("inf")).isEmpty()
    counts = {(r["column"], r["reason"]): r["rows"] for r in training.fit_exclusions(f, odd).collect()}
    assert counts["meta_score", "infinite"] == 20 and sum(counts.values()) == 20


def test_outcomes_of_another_width_are_refused(spark, store):
    store.write_proposals(m.frame(spark, "proposals", [m.proposal()]))
    vols = spark.createDataFrame([("vol", 0.1)], "product string, vol double")
    narrow = spark.createDataFrame([("vol", 0, [0.03, 0.01])], "product string, t int, values array<double>")
    with pytest.raises(ValueError, match="forward_5d_pnl: null"):
        daily.record_outcomes(store, m.DAY, date(2031, 1, 10), narrow, vols)
    with pytest.raises(ValueError, match="forward_5d_pnl: null"):
        daily.record_outcomes(store, m.DAY, date(2031, 1, 10), narrow, vols, ["X", "Q"])
    assert store.read_outcomes().isEmpty()


def test_a_failing_attempt_is_a_failed_attempt_and_solved_slots_are_left_alone(spark, store):
    def solve_one(attempt):
        if attempt["family"] == "max_mean" and attempt["attempt"] < 2:
            raise RuntimeError("no solution")
        return {"solver_status": "optimal", "weights": [1.0], "column_names": ["X"], "n_names": 1}

    rows = [(m.DAY, "vol", "best", 1, "max_mean"), (m.DAY, "vol", "alt", 2, "max_min")]
    slots = spark.createDataFrame(rows, "date date, product string, proposal_type string, slot int, family string")
    rounds = []

    def keep(tried):
        kept = store.staged(tried, "attempts")
        rounds.append(sorted((r["family"], r["solver_status"]) for r in kept.collect()))
        return kept

    chosen = daily.choose(slots, config_grid(spark), attempts.solver_from(solve_one), 1, keep).collect()
    assert sorted((r["family"], r["attempt"]) for r in chosen) == [("max_mean", 2), ("max_min", 0)]
    failed = ("max_mean", "solver_error")
    assert rounds == [[failed, ("max_min", "optimal")], [failed], [("max_mean", "optimal")]]


def test_a_bad_batch_names_everything_at_once(spark, store):
    rows = m.frame(spark, "proposals", [m.proposal(key=f"k{i}", family="x") for i in range(30)])
    wide = spark.createDataFrame([(m.DAY, "vol", f"k{i}", 0, [1.0] * 5) for i in range(25)], "date date, product string, config_hash string, t int, values array<double>")
    with pytest.raises(ValueError, match=r"2 rule.*family: outside domain \(30 rows\).*width.*25 rows, listed in"):
        store.write_proposals(rows, wide)
    assert store.read_proposals().isEmpty() and MatrixStore(store).rows().isEmpty()
    strays = m.frame(spark, "decisions", [m.decision(key=f"k{i}") for i in range(30)])
    with pytest.raises(ValueError, match="30 with no proposals that day"):
        daily.record_decisions(store, strays)


def test_repeated_keys_need_an_arrival(spark, store):
    with pytest.raises(ValueError, match="repeated keys"):
        store.write_features(m.frame(spark, "daily_features", [m.feature(), m.feature(vix_level=3.0)]))


def test_a_day_that_keeps_no_matrix_loses_its_folder(spark, store):
    rows = [(m.DAY, p, "gone", t, [1.0]) for p in ("vol", "var") for t in range(3)]
    matrices = spark.createDataFrame(rows, "date date, product string, config_hash string, t int, values array<double>")
    MatrixStore(store).write(matrices)
    store.write_proposals(m.frame(spark, "proposals", [m.proposal(product="var", key="gone")]))
    MatrixStore(store).sweep(matrices)
    assert {r["product"] for r in MatrixStore(store).rows().collect()} == {"var"}


def test_one_key_for_a_configuration_in_either_shape(spark):
    texts = ['{"a":0.0001,"b":"é","c":1e7}', '{"a":-0.0,"b":"x","c":1e-9}', '{"a":1e22,"b":null,"c":0.1}', '{"a":12345.678,"b":"","c":-2.5}']
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    both = rows.select(
        config_key(canonical_json("text")["canonical"]).alias("by_text"),
        config_key(canonical_struct(F.from_json("text", "a double, b string, c double"))).alias("by_struct"),
    ).collect()
    assert all(r["by_text"] == r["by_struct"] for r in both) and len({r["by_text"] for r in both}) == len(texts)
    for bad in ("nan", "inf", "-inf"):
        config = F.struct(F.lit(float(bad)).alias("a"))
        with pytest.raises(Exception, match="not finite"):
            spark.range(1).select(canonical_struct(config)).collect()
