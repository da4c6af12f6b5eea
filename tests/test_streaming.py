from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from paceline import schemas
from paceline.sources.tables import TableStore
from paceline.streaming.decisions import REJECTED, append_new, append_stream
from paceline.streaming.latest import latest, merge_latest, read_current, track_latest
from paceline.streaming.pending import dropped, pending, read_resolved, track_pending, unmatched_outcomes, waiting_rows
from tests import makers as m


def test_stream_appends_valid_rows_once(spark, store, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    rows = [
        m.decision(),
        m.decision(decision="rejected", decided_at_utc=datetime(2031, 1, 3, tzinfo=timezone.utc)),
        m.decision(decision="maybe"),
    ]
    frame = m.frame(spark, "decisions", rows)
    frame.write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)

    def run():
        query = append_stream(stream, store, checkpoint, once=True)
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    assert store.read_decisions_raw().count() == 2
    assert spark.read.parquet(store.path(REJECTED)).count() == 1
    m.frame(spark, "decisions", [m.decision(key="second")]).write.mode("append").parquet(source)
    run()
    assert store.read_decisions_raw().count() == 3
    # A replayed batch adds nothing, neither to the log nor to the rejected rows.
    append_new(store, frame, f"{checkpoint}#0")
    assert store.read_decisions_raw().count() == 3
    assert spark.read.parquet(store.path(REJECTED)).count() == 1
    assert store.read_decisions_raw().columns == schemas.schema("decisions").names


def test_equal_decisions_are_kept_as_a_batch_append_keeps_them(spark, store, tmp_path):
    rows = [m.decision(notes="first"), m.decision(notes="second"), m.decision(notes="second")]
    frame = m.frame(spark, "decisions", rows)
    append_new(store, frame, "stream#0")
    other = TableStore(spark, str(tmp_path / "other"))
    other.append_decisions(frame)
    found = [sorted(map(tuple, s.read_decisions_raw().collect())) for s in (store, other)]
    assert found[0] == found[1] and len(found[0]) == 3


def streamed(spark, frame, folder):
    frame.write.mode("append").parquet(folder)
    return spark.readStream.schema(frame.schema).parquet(folder)


def days(rows):
    return [(date(2031, 1, 1) + timedelta(days=d), p, k, *(date(2031, 1, 1) + timedelta(days=e) for e in more)) for d, p, k, *more in rows]


PROPOSED = "date date, product string, config_hash string"
EVALUATED = PROPOSED + ", eval_date date"


def test_pending_equals_the_batch_anti_join_after_each_part(spark, store, tmp_path):
    parts = [
        ([(d, "vol", f"k{d}") for d in range(60)], [(d, "vol", f"k{d}", d + 5) for d in range(0, 50, 2)]),
        ([(d, "vol", f"k{d}") for d in range(60, 100)], [(d, "vol", f"k{d}", d + 5) for d in range(50, 90, 2)] + [(1, "vol", "k1", 6)]),
        ([(100, "vol", "k100")], [(99, "vol", "k99", 104), (300, "none", "x", 105), (55, "vol", "k55", 95)]),
    ]
    known, settled, query = [], {}, None
    for proposed, evaluated in parts:
        p = spark.createDataFrame(days(proposed), PROPOSED)
        o = spark.createDataFrame(days(evaluated), EVALUATED)
        known += proposed
        waiting, arriving = streamed(spark, p, str(tmp_path / "p")), streamed(spark, o, str(tmp_path / "o"))
        query = track_pending(waiting, arriving, store, str(tmp_path / "c"), horizon_days=30, delay_days=10, once=True)
        assert query.awaitTermination(120) and query.exception() is None
        late = {"k1", "k55"}  # behind the watermark, beyond the horizon
        settled |= {k: e for _, _, k, e in evaluated if k not in late | {"x"}}
        everything = spark.createDataFrame(days(known), PROPOSED)
        left = pending(everything, read_resolved(store)).collect()
        assert sorted(r["config_hash"] for r in left) == sorted({k for _, _, k in known} - set(settled))
    found = {r["config_hash"]: r["state"] for r in left}
    latest_day = min(100, 105) - 10  # the final watermark
    assert all(state == ("expired" if int(k[1:]) < latest_day - 30 else "open") for k, state in found.items())
    assert found["k1"] == "expired" and "k99" not in found
    # the state holds what may still be joined, not all that came
    assert waiting_rows(query) < 100
    outcomes = spark.read.schema(EVALUATED).parquet(str(tmp_path / "o"))
    strays = unmatched_outcomes(outcomes, everything, read_resolved(store)).collect()
    assert {r["config_hash"]: r["reason"] for r in strays} == {
        "k1": "late or beyond the horizon", "k55": "late or beyond the horizon", "x": "no such proposal",
    }
    # nothing new: a further run adds nothing
    before = sorted(map(tuple, read_resolved(store).collect()), key=repr)
    track_pending(waiting, arriving, store, str(tmp_path / "c"), 30, 10, once=True).awaitTermination(120)
    assert sorted(map(tuple, read_resolved(store).collect()), key=repr) == before


def test_late_rows_are_counted(spark, store, tmp_path):
    first = spark.createDataFrame(days([(d, "vol", f"k{d}") for d in range(40)]), PROPOSED)
    outcomes = spark.createDataFrame(days([(d, "vol", f"k{d}", d + 1) for d in range(5, 40)]), EVALUATED)
    late = spark.createDataFrame(days([(0, "vol", "k0", 1), (1, "vol", "k1", 2)]), EVALUATED)
    counts = []
    for o in (outcomes, late):
        waiting, arriving = streamed(spark, first.where("false") if counts else first, str(tmp_path / "p")), streamed(spark, o, str(tmp_path / "o"))
        query = track_pending(waiting, arriving, store, str(tmp_path / "c"), once=True)
        query.awaitTermination(120)
        counts.append(dropped(query))
    assert counts == [0, 2]


def test_latest_decisions_after_any_order_and_replay(spark, store, tmp_path):
    at = lambda h: datetime(2031, 1, 2, h, tzinfo=timezone.utc)
    rows = [m.decision(key=f"k{h % 3}", decision=["accepted", "rejected"][h % 2], decided_at_utc=at(h), notes=f"n{h}") for h in range(12)]
    rows += [m.decision(date(2031, 2, 5), key="feb"), m.decision(key="k1", decided_at_utc=at(10), notes=None)]
    rows += [m.decision(key="k2", decided_at_utc=at(11), notes="tie"), m.decision(None, key="k2")]
    frame = m.frame(spark, "decisions", rows)
    wanted = sorted((tuple(r) for r in latest(frame).collect()), key=repr)
    store.append_decisions(frame.where("date is not null"))
    read = store.read_decisions_latest().select(*latest(frame).columns)
    assert wanted == sorted((tuple(r) for r in read.collect()), key=repr) and len(wanted) == 4
    for name, order in (("a", [0, 1, 2]), ("b", [2, 0, 1])):
        own = TableStore(spark, str(tmp_path / name))
        assert read_current(own).count() == 0
        parts = [frame.where(f"hour(decided_at_utc) % 3 = {k}") for k in range(3)]
        for k in order:
            stream = streamed(spark, parts[k], f"{tmp_path}/{name}-in")
            query = track_latest(stream, own, f"{tmp_path}/{name}-c", once=True)
            assert query.awaitTermination(120) and query.exception() is None
        found = lambda s=own: sorted((tuple(r) for r in read_current(s).select(*latest(frame).columns).collect()), key=repr)
        assert found() == wanted
        for part in parts:  # a replayed batch, also an old one, changes nothing
            merge_latest(own, latest(part))
            assert found() == wanted
