from __future__ import annotations

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from paceline.schemas import VERSION_COLUMN, schema
from paceline.sources.matrices import SHARED, MatrixStore
from tests import makers as m


def test_missing_table_is_empty(store):
    assert store.read_features().isEmpty()
    assert store.read_proposals().columns == schema("proposals").names


def test_upsert_over_months_and_dates(spark, store):
    days = [date(2031, 1, 2), date(2031, 1, 3), date(2031, 2, 1), date(2030, 12, 31)]
    store.write_features(m.frame(spark, "daily_features", [m.feature(d) for d in days]))
    again = [m.feature(date(2031, 1, 3), vix_level=30.0), m.feature(date(2031, 1, 4))]
    store.write_features(m.frame(spark, "daily_features", again))
    store.write_features(m.frame(spark, "daily_features", again))
    levels = {r["date"]: r["vix_level"] for r in store.read_features().collect()}
    assert levels == {
        days[0]: 17.5, days[1]: 30.0, days[2]: 17.5, days[3]: 17.5, date(2031, 1, 4): 17.5,
    }
    assert store.read_features().count() == 5
    assert "year" not in store.read_features().columns


def test_upsert_keeps_last_of_a_batch(spark, store):
    rows = [(m.DAY, "vol", float(i), i) for i in (3, 1, 2)]
    batch = spark.createDataFrame(rows, "date date, product string, vix_level double, seq int")
    for name in m.schemas.FEATURES[1:]:
        batch = batch.withColumn(name, F.lit(0.0))
    store.write_features(batch, arrival=["seq"])
    assert [r["vix_level"] for r in store.read_features().collect()] == [3.0]


def test_reads_filter_and_prune(spark, store):
    days = [date(2030, 11, 5), date(2031, 1, 2), date(2031, 1, 20), date(2031, 3, 1)]
    rows = [m.feature(d, p) for d in days for p in ("vol", "var")]
    store.write_features(m.frame(spark, "daily_features", rows))
    part = store.read_features(date(2031, 1, 2), date(2031, 1, 20), ["vol"])
    assert sorted(r["date"] for r in part.collect()) == days[1:3]
    assert store.read_features(products=[]).isEmpty()
    plan = part._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "year" in partition_filters and "month" in partition_filters
    pushed = plan.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(date" in pushed and "product" in pushed


def test_empty_outcomes_are_refused(spark, store):
    with pytest.raises(ValueError, match="no outcomes"):
        store.write_outcomes(m.frame(spark, "outcomes", []))


@pytest.mark.parametrize(
    "change, rule",
    [
        ({"family": "bogus"}, "family"),
        ({"family": None}, "family"),
        ({"proposal_type": "bogus"}, "proposal_type"),
        ({"solver_status": "bogus"}, "solver_status"),
        ({"weights": [0.5, 0.5]}, "length differs"),
    ],
)
def test_bad_proposals_are_refused(spark, store, change, rule):
    with pytest.raises(ValueError, match=rule):
        store.write_proposals(m.frame(spark, "proposals", [m.proposal(**change)]))
    assert store.read_proposals().isEmpty()


def test_all_broken_rules_are_named_at_once(spark, store):
    bad = [m.proposal(family="x"), m.proposal(key="b", proposal_type="y")]
    with pytest.raises(ValueError, match="2 rule"):
        store.write_proposals(m.frame(spark, "proposals", bad))


def test_filters_on_family_and_type(spark, store):
    rows = [
        m.proposal(key="a"),
        m.proposal(key="b", family="max_min", proposal_type="alt"),
        m.proposal(
            key="c", family="max_min", proposal_type="candidate",
            thompson_sample_value=None, posterior_mean=None, posterior_std=None,
        ),
    ]
    store.write_proposals(m.frame(spark, "proposals", rows))
    keys = lambda df: sorted(r["config_hash"] for r in df.collect())
    assert keys(store.read_proposals(families=["max_min"])) == ["b", "c"]
    assert keys(store.read_proposals(proposal_types=["best", "candidate"])) == ["a", "c"]


def matrix(spark, rows):
    flat = [(d, p, k, t, v) for d, p, k, values in rows for t, v in enumerate(values)]
    return spark.createDataFrame(
        flat, "date date, product string, config_hash string, t int, values array<double>"
    )


def test_matrix_round_trip_and_replacement(spark, store):
    long = [[float(t), 1.0, 2.0] for t in range(10)]
    store.write_proposals(
        m.frame(spark, "proposals", [m.proposal(key="a")]), matrix(spark, [(m.DAY, "vol", "a", long)])
    )
    found = MatrixStore(store).read(m.DAY, "vol", "a").collect()
    assert [r["values"] for r in found] == long
    assert MatrixStore(store).read(m.DAY, "vol", "other").isEmpty()
    MatrixStore(store).write(matrix(spark, [(m.DAY, "vol", "a", long[:4])]))
    assert MatrixStore(store).read(m.DAY, "vol", "a").count() == 4


def test_shared_matrix_serves_every_proposal(spark, store):
    store.write_proposals(
        m.frame(spark, "proposals", [m.proposal(key="a"), m.proposal(key="b")]),
        matrix(spark, [(m.DAY, "vol", SHARED, [[1.0, 2.0, 3.0]])]),
    )
    for key in "ab":
        assert MatrixStore(store).read(m.DAY, "vol", key).count() == 1


def test_matrix_of_wrong_width_is_refused(spark, store):
    rows = m.frame(spark, "proposals", [m.proposal(key="a")])
    with pytest.raises(ValueError, match="width"):
        store.write_proposals(rows, matrix(spark, [(m.DAY, "vol", "a", [[1.0] * 5])]))
    with pytest.raises(ValueError, match="width"):
        store.write_proposals(rows, matrix(spark, [(m.DAY, "vol", "a", [[1.0] * 3, [1.0] * 2])]))


def test_orphans_of_touched_days_are_swept(spark, store):
    other = date(2031, 1, 9)
    MatrixStore(store).write(
        matrix(spark, [(m.DAY, "vol", "gone", [[1.0] * 3]), (other, "vol", "kept", [[1.0] * 3])])
    )
    store.write_proposals(
        m.frame(spark, "proposals", [m.proposal(key="a")]),
        matrix(spark, [(m.DAY, "vol", "a", [[2.0] * 3])]),
    )
    assert MatrixStore(store).read(m.DAY, "vol", "gone").isEmpty()
    assert MatrixStore(store).read(m.DAY, "vol", "a").count() == 1
    assert MatrixStore(store).read(other, "vol", "kept").count() == 1


def test_log_appends_each_row_once(spark, store):
    days = [date(2031, 1, d) for d in (2, 3, 4)]
    store.append_decisions(m.frame(spark, "decisions", [m.decision(d) for d in days]))
    assert store.read_decisions_raw().count() == 3
    store.append_decisions(m.frame(spark, "decisions", [m.decision()]))
    assert store.read_decisions_raw().count() == 4


def test_latest_decision_wins(spark, store):
    at = lambda h: datetime(2031, 1, 2, h, tzinfo=timezone.utc)
    rows = [
        m.decision(decided_at_utc=at(10)),
        m.decision(decision="rejected", decided_at_utc=at(12), notes="second look"),
        m.decision(decided_at_utc=at(11)),
        m.decision(key="other"),
    ]
    store.append_decisions(m.frame(spark, "decisions", rows))
    latest = {r["config_hash"]: r["decision"] for r in store.read_decisions_latest().collect()}
    assert latest == {"5eed0f0a51ce0001": "rejected", "other": "accepted"}


@pytest.mark.parametrize(
    "change",
    [
        {"decision": "maybe"},
        {"decision": None},
        {"decision": "modified"},
        {"modified_config_hash": "5eed0f0a51ce0002"},
    ],
)
def test_bad_decisions_are_refused(spark, store, change):
    with pytest.raises(ValueError, match="rule"):
        store.append_decisions(m.frame(spark, "decisions", [m.decision(**change)]))


def test_stored_versions(spark, store):
    store.write_outcomes(m.frame(spark, "outcomes", [m.outcome()]))
    assert store.read_outcomes().first()[VERSION_COLUMN] == 1


def test_a_batch_s_own_plan_runs_once_whatever_is_checked(spark, store, tmp_path):
    """Each run of a partition leaves a file; two rules are broken in the last batch."""
    marks = tmp_path / "marks"
    marks.mkdir()

    def counted(rows):
        def mark(batches):
            import uuid

            (marks / uuid.uuid4().hex).touch()
            yield from batches

        marked = rows.coalesce(1).mapInArrow(mark, rows.schema)
        before = len(list(marks.iterdir()))
        return marked, lambda: len(list(marks.iterdir())) - before

    layout = m.layout("pnl_matrices")
    matrix = spark.createDataFrame([(m.DAY, "vol", "5eed0f0a51ce0001", t, [0.1, 0.2, 0.3]) for t in range(3)], layout)
    for _ in range(2):  # the second time months are merged
        for table, write, row in (
            ("proposals", lambda f: store.write_proposals(f, matrix), m.proposal()),
            ("outcomes", store.write_outcomes, m.outcome()),
            ("daily_features", store.write_features, m.feature()),
            ("decisions", store.append_decisions, m.decision()),
        ):
            marked, runs = counted(m.frame(spark, table, [row]))
            write(marked)
            assert runs() == 1, table
    marked, runs = counted(m.frame(spark, "proposals", [m.proposal(family="x", solver_status=None), m.proposal(key=None)]))
    with pytest.raises(ValueError, match=r"3 rule\(s\) broken: config_hash: null \(1 rows\); family: .* \(1 rows\); solver_status: .* \(1 rows\)"):
        store.write_proposals(marked)
    assert runs() == 1
