"""Portfolio figures, attempts and reports against brute force, with hot keys."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import attempts, portfolio, quality, training
from paceline.operators.keyed import last_per_key, merge_rows
from paceline.plans.daily import fan_out, summary, totals
from paceline.sources.grid import config_grid
from tests import makers as m


def test_drawdown_over_chained_buckets(spark, monkeypatch):
    """A hot product's series spans many buckets; the others fit in one or two."""
    monkeypatch.setattr(portfolio, "BUCKET", 7)
    rng = np.random.default_rng(1)
    series = {"hot": rng.normal(0.01, 1, 200), "falling": -np.ones(15), "rising": np.ones(9), "one": [-2.0]}
    rows = [(k, 3 * t + 5, float(v)) for k, values in series.items() for t, v in enumerate(values)]
    daily = spark.createDataFrame(rows, "product string, t bigint, pnl double").repartition(5)
    found = {r["product"]: r for r in portfolio.in_sample_stats(daily, ["product"]).collect()}
    for name, values in series.items():
        run = np.cumsum(values)
        row = found[name]
        assert row["n_days"] == len(values)
        assert row["in_sample_mean_pnl"] == pytest.approx(np.mean(values))
        assert row["in_sample_max_dd"] == pytest.approx(np.min(run - np.maximum.accumulate(run)))
        std = np.std(values)
        assert row["in_sample_sharpe"] == pytest.approx(np.mean(values) / std if std > 1e-12 else 0.0)


def test_turnover_with_a_hot_key(spark):
    rng = np.random.default_rng(2)
    held = {k: {} for k in range(12)}
    for k in held:
        for ticker in rng.choice(300, size=200 if k == 4 else 8, replace=False):
            held[k][int(ticker)] = float(rng.random())
    total = {k: sum(v.values()) for k, v in held.items()}
    rows = [(k, t, w) for k, v in held.items() for t, w in v.items()]
    raw = spark.createDataFrame(rows, "key bigint, ticker int, amount double")
    weights = portfolio.normalise(raw, "key", "amount", "w")
    before = {0: None, 1: 4, 2: 4, 3: 4, 4: 5, 5: 6, 6: 7, 7: 7, 8: 99, 9: 4, 10: 4, 11: 4}
    links = spark.createDataFrame(list(before.items()), "key bigint, prev_key bigint")
    earlier = weights.join(links.select(F.col("prev_key").alias("key")).distinct(), "key", "left_semi")
    found = {r["key"]: r["turnover"] for r in portfolio.turnover(weights, links, earlier).collect()}
    share = lambda k, t: held.get(k, {}).get(t, 0.0) / total[k] if k in total else 0.0
    for k, p in before.items():
        tickers = set(held[k]) | set(held.get(p, {}))
        assert found[k] == pytest.approx(sum(abs(share(k, t) - share(p, t)) for t in tickers))


def test_column_sums(spark):
    rows = [("a", t, [float(t), 1.0, -float(t)]) for t in range(50)] + [("b", 0, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "product string, t int, values array<double>").repartition(4)
    found = {r["product"]: (r["n_rows"], r["sums"]) for r in portfolio.column_sums(df, ["product"]).collect()}
    assert found == {"a": (50, [1225.0, 50.0, -1225.0]), "b": (1, [1.0, 2.0, 3.0])}


def test_skipped_proposals_carry_the_reason(spark):
    rows = [m.proposal(product=p) for p in ("vol", "var", "gamma")]
    proposals = m.frame(spark, "proposals", rows).select("date", "product", "config_hash")
    sums = spark.createDataFrame([("vol",), ("var",)], "product string")
    vols = spark.createDataFrame([("vol", 0.1), ("gamma", 0.1)], "product string, vol double")
    found = portfolio.skipped(proposals, sums, vols, ["product"]).collect()
    assert {r["product"]: r["reason"] for r in found} == {
        "var": "no trailing vol", "gamma": "no forward returns",
    }


def test_previous_best_is_strictly_earlier(spark):
    day = lambda i: m.DAY + timedelta(days=i)
    rows = [
        m.proposal(day(0), key="a", weights=[1.0]),
        m.proposal(day(0), key="b", weights=[2.0]),
        m.proposal(day(2), key="c", proposal_type="alt"),
        m.proposal(day(3), key="d", weights=[3.0]),
        m.proposal(day(4), key="e"),
        m.proposal(day(4), product="var", key="f"),
    ]
    linked = training.previous_best(m.frame(spark, "proposals", rows), ["weights"])
    found = {r["config_hash"]: (r["prev_config_hash"], r["prev_weights"]) for r in linked.collect()}
    assert found == {
        "a": (None, None), "b": (None, None), "c": ("b", [2.0]),
        "d": ("b", [2.0]), "e": ("d", [3.0]), "f": (None, None),
    }
    latest = training.latest_best(m.frame(spark, "proposals", rows)).collect()
    assert {r["product"]: r["config_hash"] for r in latest} == {"vol": "e", "var": "f"}


def test_full_and_pending(spark):
    proposals = m.frame(spark, "proposals", [m.proposal(key="a"), m.proposal(key="b")])
    outcomes = m.frame(spark, "outcomes", [m.outcome(key="a")])
    features = m.frame(spark, "daily_features", [m.feature()])
    full = {r["config_hash"]: r for r in training.full_table(proposals, features, outcomes).collect()}
    assert full["a"]["meta_score"] == 0.25 and full["b"]["meta_score"] is None
    assert full["b"]["vix_level"] == 17.5
    assert [r["config_hash"] for r in training.pending_proposals(proposals, outcomes).collect()] == ["b"]
    on_day = training.training_table(proposals, features, outcomes, date(2031, 1, 10))
    assert [r["config_hash"] for r in on_day.collect()] == ["a"]
    assert len(on_day.columns) == 19 + 7 + 10
    assert training.training_table(proposals, features, outcomes, date(2031, 1, 9)).isEmpty()


def test_keep_last_and_merge_with_a_hot_key(spark):
    rows = [(1 if i % 3 == 0 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, seq int").repartition(8)
    found = {r["k"]: r["seq"] for r in last_per_key(df, ["k"], ["seq"]).collect()}
    wanted = {}
    for k, seq in rows:
        wanted[k] = max(seq, wanted.get(k, -1))
    assert found == wanted
    old = spark.createDataFrame([(1, -1), (-5, -1), (None, -1)], "k int, seq int")
    merged = {(r["k"], r["seq"]) for r in merge_rows(old, last_per_key(df, ["k"], ["seq"]), ["k"]).collect()}
    assert merged == set(wanted.items()) | {(-5, -1), (None, -1)}


def test_sampling_covers_the_grid(spark):
    slots = spark.range(3000).select(F.col("id").cast("string").alias("slot_key"), F.lit("max_sharpe").alias("family"))
    drawn = attempts.sample_configs(slots, config_grid(spark), 1, ["slot_key"])
    counts = {r["idx"]: r["count"] for r in drawn.groupBy("idx").count().collect()}
    assert sorted(counts) == list(range(36)) and min(counts.values()) > 40


def test_first_success_per_slot(spark):
    rows = [
        ("a", 0, "infeasible"), ("a", 1, "optimal_inaccurate"), ("a", 2, "optimal"),
        ("b", 3, "optimal"), ("c", 4, "optimal"), ("d", 0, "solver_error"), ("e", 0, None),
    ]
    df = spark.createDataFrame(rows, "slot string, attempt int, solver_status string")
    found = {r["slot"]: r["attempt"] for r in attempts.first_success(df, ["slot"]).collect()}
    assert found == {"a": 1, "b": 3, "c": 4}


def test_reports(spark):
    df = spark.createDataFrame([("x", None), ("y", "p"), ("x", "q")], "a string, b string")
    bad = {(r["column"], r["value"], r["rows"]) for r in quality.bad_values(df, {"a": ["y"], "b": ["p"]}).collect()}
    assert bad == {("a", "x", 2), ("b", None, 1), ("b", "q", 1)}
    with pytest.raises(ValueError, match="1 rule.*a: outside"):
        quality.require_clean(df, {"a: outside": quality.outside("a", ["y"]), "fine": F.lit(None)}, "t")


def test_unmatched_decisions(spark):
    proposals = m.frame(spark, "proposals", [m.proposal(key="a"), m.proposal(key="b")])
    rows = [m.decision(key="a"), m.decision(key="z"), m.decision(product="var", key="a")]
    found = quality.unmatched_decisions(m.frame(spark, "decisions", rows), proposals).collect()
    assert {(r["product"], r["config_hash"], r["problem"]) for r in found} == {
        ("vol", "z", "unknown config_hash"), ("var", "a", "no proposals that day"),
    }


def test_fan_out_and_summary(spark):
    market = spark.createDataFrame([(m.DAY, 1.0)], "date date, vix_level double")
    assert sorted(r["product"] for r in fan_out(market, ["b", "a"]).collect()) == ["a", "b"]
    slots = spark.createDataFrame(
        [(m.DAY, "vol", 2, "y", "alt"), (m.DAY, "vol", 1, "x", "best"), (m.DAY, "var", 1, "z", "best")],
        "date date, product string, slot int, family string, proposal_type string",
    )
    found = {r["product"]: (r["n_proposals"], r["families"], r["types"]) for r in summary(slots).collect()}
    assert found == {"vol": (2, "x,y", "best,alt"), "var": (1, "z", "best")}
    assert tuple(totals(slots).first()) == (m.DAY, 2, 3)
