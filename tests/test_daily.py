from __future__ import annotations

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from paceline.functions.score import ScoreRule
from paceline.operators.attempts import matrix_solver
from paceline.plans import daily
from paceline.schemas import FAMILIES, FEATURES, PRODUCTS
from paceline.sources.grid import config_grid
from paceline.sources.matrices import MatrixStore
from paceline.sources.tables import TableStore
from tests import makers as m

TODAY = date(2026, 4, 16)
MARKET = dict(zip(FEATURES, [18.5, -0.02, 0.42, 0.013, 0.08, 0.015, 0.07]))
NAMES = ["A", "B", "C", "D"]


def matrices(spark, products=PRODUCTS, days=6, width=4):
    rows = [(p, t, [0.01 * (t + 1)] * width) for p in products for t in range(days)]
    return spark.createDataFrame(rows, "product string, t int, values array<double>")


def solver(status="optimal", fails_below=0):
    """Equal weights; attempts below a number end without a solution."""

    def solve(attempts):
        verdict = F.when(F.col("attempt") < fails_below, "infeasible").otherwise(F.lit(status))
        return attempts.select(
            "*",
            F.lit([0.25] * 4).alias("weights"),
            F.lit(NAMES).alias("column_names"),
            F.lit(4).alias("n_names"),
            F.lit(1.5).alias("in_sample_sharpe"),
            F.lit(0.01).alias("in_sample_mean_pnl"),
            F.lit(-0.03).alias("in_sample_max_dd"),
            verdict.alias("solver_status"),
            F.lit(0.05).alias("solve_time_seconds"),
        )

    return solve


@pytest.fixture(scope="module")
def proposed(spark, tmp_path_factory):
    store = TableStore(spark, str(tmp_path_factory.mktemp("daily")))
    report = daily.propose_today(store, TODAY, MARKET, matrices(spark), solver(), seed=42).collect()
    return store, report


def test_four_proposals_per_product(proposed):
    store, report = proposed
    assert sorted(r["product"] for r in report) == PRODUCTS
    for r in report:
        assert r["n_proposals"] == 4 and r["types"] == "best,alt,alt,explore"
        assert len(set(r["families"].split(","))) == 4
    rows = store.read_proposals().collect()
    assert len(rows) == 20
    for r in rows:
        assert r["family"] in FAMILIES and r["solver_status"] == "optimal"
        assert r["pnl_matrix_path"] == f"pnl_matrices/{TODAY}/{r['product']}/{r['config_hash']}.parquet"
        assert f'"objective":"{r["family"]}"' in r["config_json"]
        assert r["posterior_std"] == pytest.approx(1.0)


def test_features_and_matrices_are_stored(proposed):
    store, _ = proposed
    assert store.read_features().count() == 5
    row = store.read_proposals(products=["vol"]).first()
    found = MatrixStore(store).read(TODAY, "vol", row["config_hash"])
    assert [r["t"] for r in found.collect()] == list(range(6))


def test_a_seed_fixes_the_proposals(spark, proposed, store):
    first, _ = proposed
    daily.propose_today(store, TODAY, MARKET, matrices(spark), solver(), seed=42)
    pick = lambda s: s.read_proposals().select("product", "config_hash", "family").orderBy(
        "product", "config_hash").collect()
    assert pick(store) == pick(first)
    daily.propose_today(store, TODAY, MARKET, matrices(spark), solver(), seed=43)
    assert store.read_proposals().count() > 20


def test_retries_until_solved(spark, store):
    report = daily.propose_today(store, TODAY, MARKET, matrices(spark), solver(fails_below=3)).collect()
    assert all(r["n_proposals"] == 4 for r in report)


def test_inexact_solutions_count(spark, store):
    daily.propose_today(store, TODAY, MARKET, matrices(spark), solver("optimal_inaccurate"), ["vol"])
    assert {r["solver_status"] for r in store.read_proposals().collect()} == {"optimal_inaccurate"}


def test_unsolved_slots_drop_out(spark, store):
    report = daily.propose_today(store, TODAY, MARKET, matrices(spark), solver(fails_below=4))
    assert report.isEmpty() and store.read_proposals().isEmpty()
    assert store.read_features().count() == 5


def test_bad_inputs(spark, store):
    with pytest.raises(ValueError, match="missing features"):
        daily.propose_today(store, TODAY, {"vix_level": 1.0}, matrices(spark), solver())
    with pytest.raises(ValueError, match="unknown products"):
        daily.propose_today(store, TODAY, MARKET, matrices(spark), solver(), ["swap"])
    with pytest.raises(ValueError, match="width"):
        daily.propose_today(store, TODAY, MARKET, matrices(spark, width=3), solver(), ["vol"])


def test_history_is_used(spark, proposed):
    """After outcomes are recorded, the next cycle fits on them."""
    store, _ = proposed
    vols = spark.createDataFrame([(p, 0.02) for p in PRODUCTS], "product string, vol double")
    flat = spark.createDataFrame(
        [(p, t, [0.01] * 4) for p in PRODUCTS for t in range(5)],
        "product string, t int, values array<double>",
    )
    eval_date = date(2026, 4, 23)
    written = daily.record_outcomes(store, TODAY, eval_date, flat, vols).collect()
    assert len(written) == 20
    for r in written:
        assert r["forward_5d_pnl"] == pytest.approx(0.05)
        assert r["forward_5d_mean_return"] == pytest.approx(0.01)
        assert r["meta_score"] == pytest.approx(0.5)
        assert (r["eval_date"], r["forward_window_days"]) == (eval_date, 5)
        assert r["turnover_vs_prev_best"] is None
    later = date(2026, 4, 24)
    daily.propose_today(store, later, MARKET, matrices(spark), solver(), seed=1)
    means = [r["posterior_mean"] for r in store.read_proposals(later).collect()]
    assert len(means) == 20 and any(v > 0.3 for v in means)


def test_recording_needs_proposals_and_returns(spark, store):
    vols = spark.createDataFrame([("vol", 0.02)], "product string, vol double")
    returns = matrices(spark, ["vol"], width=3)
    with pytest.raises(ValueError, match="no proposals"):
        daily.record_outcomes(store, m.DAY, date(2031, 1, 9), returns, vols)
    rows = [m.proposal(), m.proposal(product="var"), m.proposal(product="gamma")]
    store.write_proposals(m.frame(spark, "proposals", rows))
    with pytest.raises(ValueError, match="no outcomes"):
        daily.record_outcomes(store, m.DAY, date(2031, 1, 9), returns.where("false"), vols)
    both = matrices(spark, ["vol", "var"], width=3)
    assert daily.record_outcomes(store, m.DAY, date(2031, 1, 9), both, vols).count() == 1


def test_turnover_is_charged_against_the_earlier_best(spark, store):
    before, day = date(2031, 1, 1), m.DAY
    rows = [
        m.proposal(before, key="old", weights=[0.2, 0.3, 0.5]),
        m.proposal(day, key="new", weights=[0.5, 0.3, 0.2]),
        m.proposal(day, key="alt", weights=[0.2, 0.3, 0.5], proposal_type="alt"),
        m.proposal(date(2031, 1, 3), key="late", weights=[1.0, 0.0, 0.0]),
    ]
    store.write_proposals(m.frame(spark, "proposals", rows))
    vols = spark.createDataFrame([("vol", 0.1)], "product string, vol double")
    returns = spark.createDataFrame([("vol", 0, [0.01, 0.02, 0.03])], "product string, t int, values array<double>")
    rule = ScoreRule("continuous", 0.3)
    found = daily.record_outcomes(store, day, date(2031, 1, 9), returns, vols, rule=rule).collect()
    moved = {r["config_hash"]: r["turnover_vs_prev_best"] for r in found}
    assert moved == {"new": pytest.approx(0.6), "alt": pytest.approx(0.0)}
    new = next(r for r in found if r["config_hash"] == "new")
    assert new["meta_score"] == pytest.approx(0.017 / 0.1 - 0.3 * 0.6)


def test_returns_by_ticker(spark, store):
    store.write_proposals(m.frame(spark, "proposals", [m.proposal()]))
    vols = spark.createDataFrame([("vol", 0.1)], "product string, vol double")
    returns = spark.createDataFrame([("vol", 0, [0.03, 0.01, 0.02])], "product string, t int, values array<double>")
    row = daily.record_outcomes(store, m.DAY, date(2031, 1, 9), returns, vols, ["Z", "X", "Y"]).first()
    assert row["forward_5d_pnl"] == pytest.approx(0.25 * 0.01 + 0.6 * 0.02 + 0.15 * 0.03)


def test_decisions_are_checked_and_logged(spark, store):
    with pytest.raises(ValueError, match="no proposals that day"):
        daily.record_decision(store, m.DAY, "abc", "vol", "accepted")
    store.write_proposals(m.frame(spark, "proposals", [m.proposal(key="abc")]))
    with pytest.raises(ValueError, match="unknown config_hash"):
        daily.record_decision(store, m.DAY, "xyz", "vol", "accepted")
    with pytest.raises(ValueError, match="rule"):
        daily.record_decision(store, m.DAY, "abc", "vol", "modified")
    at = datetime(2021, 1, 2, 9, tzinfo=timezone.utc)
    daily.record_decision(store, m.DAY, "abc", "vol", "rejected", "too wide", decided_at=at)
    daily.record_decision(store, m.DAY, "abc", "vol", "modified", None, "5eed0f0a51ce0002")
    assert store.read_decisions_raw().count() == 2
    latest = store.read_decisions_latest().collect()
    assert [(r["decision"], r["modified_config_hash"]) for r in latest] == [("modified", "5eed0f0a51ce0002")]


def staged_folders(store):
    import os

    root = os.path.join(store.root, "_staging")
    return os.listdir(root) if os.path.isdir(root) else []


def test_a_repeated_ticker_does_not_end_the_recording(spark, store):
    before = m.proposal(date(2031, 1, 1), key="old", weights=[0.2, 0.3, 0.5], column_names=["X", "X", "Z"])
    store.write_proposals(m.frame(spark, "proposals", [before, m.proposal()]))
    vols = spark.createDataFrame([("vol", 0.1)], "product string, vol double")
    returns = spark.createDataFrame([("vol", 0, [0.01, 0.02, 0.03])], "product string, t int, values array<double>")
    row = daily.record_outcomes(store, m.DAY, date(2031, 1, 9), returns, vols, rule=ScoreRule("continuous", 0.3)).first()
    assert row["turnover_vs_prev_best"] == pytest.approx(abs(0.25 - 0.5) + 0.6 + abs(0.15 - 0.5))
    with pytest.raises(ValueError, match=r"several columns for tickers: \['X'\]"):
        daily.record_outcomes(store, m.DAY, date(2031, 1, 9), returns, vols, ["X", "X", "Y"])


def test_skipped_proposals_are_reported(spark, store):
    rows = [m.proposal(product=p) for p in ("vol", "var", "gamma", "dngamma")]
    store.write_proposals(m.frame(spark, "proposals", rows))
    vols = spark.createDataFrame([("vol", 0.1), ("gamma", 0.1), ("dngamma", 0.2)], "product string, vol double")
    cells = [("vol", 0, [0.01, 0.02, 0.03]), ("var", 0, [0.0, 0.0, 0.1]), ("dngamma", 0, [float("nan"), 0.0, 0.1])]
    returns = spark.createDataFrame(cells, "product string, t int, values array<double>")
    found = daily.record_outcomes(store, m.DAY, date(2031, 1, 9), returns, vols).collect()
    assert [r["product"] for r in found] == ["vol"]
    reasons = {r["product"]: r["reason"] for r in store.read_skipped_outcomes(m.DAY, m.DAY).collect()}
    assert reasons == {"var": "no trailing vol", "gamma": "no forward returns", "dngamma": "a figure is not finite"}
    assert staged_folders(store) == []
    whole = spark.createDataFrame([(p, 0, [0.01, 0.02, 0.03]) for p in ("vol", "gamma", "dngamma", "var")], returns.schema)
    all_vols = spark.createDataFrame([(p, 0.1) for p in PRODUCTS], "product string, vol double")
    assert daily.record_outcomes(store, m.DAY, date(2031, 1, 9), whole, all_vols).count() == 4
    assert store.read_skipped_outcomes().count() == 0


def test_solvers_that_get_the_matrix(spark, store):
    """Each attempt meets its own product's rows, in order; failures keep their text."""

    def solve(attempt, matrix):
        if attempt["product"] == "var":
            raise RuntimeError("does not converge")
        if attempt["product"] == "gamma" and attempt["attempt"] < 2:
            return {"solver_status": "infeasible"}
        assert matrix[:, 0].tolist() == sorted(matrix[:, 0].tolist()) and matrix.shape == (6, 4)
        return {
            "weights": [float(matrix[0, 0]), *[0.0] * 3], "column_names": NAMES, "n_names": 4, "in_sample_sharpe": 1.0,
            "in_sample_mean_pnl": float(matrix.mean()), "in_sample_max_dd": 0.0, "solver_status": "optimal", "solve_time_seconds": 0.1,
        }

    rows = [(p, t, [k + t / 10] * 4) for k, p in enumerate(PRODUCTS) for t in range(6) if p != "vol"]
    rows += [("vol", t, [1.0] * (4 + (t == 3))) for t in range(6)]
    held = spark.createDataFrame(rows, "product string, t int, values array<double>").repartition(7)
    solver = matrix_solver(solve, held)
    slots = spark.createDataFrame(
        [(TODAY, p, "best", 1, FAMILIES[0]) for p in [*PRODUCTS, "none"]],
        "date date, product string, proposal_type string, slot int, family string",
    )
    failed = []
    found = daily.choose(slots, config_grid(spark), solver, 3, lambda df: store.staged(df, "a"), failed=failed).collect()
    assert {r["product"]: (r["attempt"], r["weights"][0]) for r in found} == {
        "corridor_var": (0, 0.0), "dngamma": (0, 1.0), "gamma": (2, 2.0),
    }
    log = [(r["product"], r["attempt"], r["solver_status"], r["failure"]) for f in failed for r in f.collect()]
    wanted = [("gamma", k, "infeasible", None) for k in range(2)]
    wanted += [("var", k, "solver_error", "RuntimeError: does not converge") for k in range(4)]
    wanted += [("vol", k, "solver_error", "matrix rows differ in width") for k in range(4)]
    wanted += [("none", k, "solver_error", "no matrix") for k in range(4)]
    assert sorted(log, key=repr) == sorted(wanted, key=repr)


def test_the_cycle_takes_such_a_solver_and_keeps_its_failures(spark, store):
    held = matrices(spark)

    def solve(attempt, matrix):
        if attempt["attempt"] == 0 and attempt["product"] == "vol":
            raise ValueError("first try")
        return {
            "weights": matrix.mean(axis=0).tolist(), "column_names": NAMES, "n_names": 4, "in_sample_sharpe": 1.0, "in_sample_mean_pnl": 0.0,
            "in_sample_max_dd": 0.0, "solver_status": "optimal", "solve_time_seconds": 0.1,
        }

    report = daily.propose_today(store, TODAY, MARKET, held, matrix_solver(solve, held), seed=1).collect()
    assert sum(r["n_proposals"] for r in report) == 20
    assert store.read_proposals().first()["weights"] == pytest.approx([0.035] * 4)
    log = store.read_failed_attempts(TODAY, TODAY).collect()
    assert [(r["product"], r["attempt"], r["failure"]) for r in log] == [("vol", 0, "ValueError: first try")] * 4
    assert staged_folders(store) == [] and store.sweep_staging(0) == 0
    assert TableStore(spark, store.root + "/elsewhere").read_failed_attempts().count() == 0


def test_copies_of_a_broken_job_go(spark, store):
    with pytest.raises(RuntimeError), store.job():
        store.staged(spark.range(3), "inner")
        assert len(staged_folders(store)) == 1
        with store.job():
            store.staged(spark.range(3), "inner")
        assert len(staged_folders(store)) == 2
        raise RuntimeError
    assert staged_folders(store) == []
    store.staged(spark.range(3), "left")
    assert store.sweep_staging(1) == 0 and store.sweep_staging(0) == 1 and staged_folders(store) == []


def test_a_null_key_is_a_named_violation(spark, store):
    store.write_outcomes(m.frame(spark, "outcomes", [m.outcome()]))
    for table, row in (("outcomes", m.outcome(day=None)), ("proposals", m.proposal(product=None)), ("daily_features", m.feature(day=None))):
        with pytest.raises(ValueError, match=r"(date|product): null \(1 rows\)"):
            store.upsert(table, m.frame(spark, table, [row]))
