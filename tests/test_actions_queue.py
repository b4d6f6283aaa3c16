import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import actions, queue, reports
from riskloom.operators.latest import latest_per_key

T0 = dt.datetime(2020, 1, 1)


def _t(days):
    return T0 + dt.timedelta(days=days)


def test_asof_latest_matches_brute_force(spark):
    preds = [(1, _t(d), f"p{d}", d % 3) for d in (0, 10, 40, 41, 90)] + [(2, _t(5), "q5", 0)]
    reqs = [(100, 1, _t(-1)), (101, 1, _t(10)), (102, 1, _t(45)), (103, 1, _t(200)), (104, 2, _t(100)), (105, 3, _t(1))]
    right = spark.createDataFrame(preds, "rid long, ts timestamp, pid string, tie long")
    left = spark.createDataFrame(reqs, "id long, rid long, at timestamp")
    got = {r.id: r.asof_value for r in actions.asof_latest(left, right, "rid", "at", "ts", "pid", ["tie"]).collect()}

    def brute(rid, at):
        c = [p for p in preds if p[0] == rid and p[1] <= at]
        return max(c, key=lambda p: (p[1], p[3]))[2] if c else None

    assert got == {i: brute(r, a) for i, r, a in reqs}


def test_apply_updates_non_null_overwrite(spark):
    acts = spark.createDataFrame([(1, 10, "open", "n1"), (2, 10, "open", None)], "id long, reservation_id long, action_status string, action_note string")
    upd = spark.createDataFrame(
        [(1, 1, "completed", None, _t(1)), (2, 1, None, "later note", _t(2)), (3, 99, "completed", None, _t(1))],
        "update_id long, id long, action_status string, action_note string, updated_at timestamp",
    )
    state, rejected = actions.apply_updates(acts, upd)
    s = {r.id: r for r in state.collect()}
    assert s[1].action_status == "completed" and s[1].action_note == "later note" and s[1].update_count == 2
    assert s[2].action_status == "open" and s[2].update_count == 0
    assert [r.id for r in rejected.collect()] == [99]


def test_validation_reasons(spark):
    df = spark.createDataFrame(
        [("call_guest", "open", None, "ops"), ("x", "open", None, "ops"), ("call", "bogus", None, "ops"),
         ("call", "open", "n" * 501, "ops"), ("call", "open", None, "o")],
        "action_type string, action_status string, action_note string, acted_by string",
    )
    reasons = [r[0] for r in df.select(actions.rejection_reason()).collect()]
    assert reasons == [None, "invalid_action_type", "invalid_status", "note_too_long", "invalid_acted_by"]


def test_latest_per_key_duplicate_timestamps(spark):
    df = spark.createDataFrame([(1, _t(1), 1), (1, _t(1), 2), (1, _t(0), 9), (2, _t(3), 1)], "k long, ts timestamp, tie long")
    got = {r.k: r.tie for r in latest_per_key(df, ["k"], ["ts", "tie"]).collect()}
    assert got == {1: 2, 2: 1}


def test_queue_page_bounds_and_filters(spark):
    with pytest.raises(ValueError):
        queue.check_page_size(0)
    with pytest.raises(ValueError):
        queue.check_page_size(201)
    rows = spark.createDataFrame(
        [(1, "A", 0.9, dt.date(2017, 1, 1)), (2, "B", 0.9, dt.date(2017, 1, 2)), (3, "A", None, None), (4, "A", 0.9, dt.date(2017, 1, 2))],
        "reservation_id long, property_id string, score double, arrival_date date",
    )
    page = [r.reservation_id for r in queue.queue_page(rows, 10).collect()]
    assert page == [4, 2, 1, 3]
    assert [r.reservation_id for r in queue.queue_page(rows, 10, id_ascending=True).collect()] == [2, 4, 1, 3]
    filt = queue.apply_filters(rows, property_id="A", date_from="2017-01-02")
    assert [r.reservation_id for r in filt.collect()] == [4]


def test_effectiveness_without_action_log(spark):
    rows = spark.createDataFrame([(1, "high"), (2, "high"), (3, "low")], "reservation_id long, risk_class string")
    r = reports.action_effectiveness(rows, None).first()
    assert r.total_actions == 0 and r.high_risk_with_action_count == 0 and r.high_risk_without_action_count == 2
    acts = spark.createDataFrame([(10, 1, "open"), (11, 1, "completed"), (12, 3, "follow_up")], "id long, reservation_id long, action_status string")
    r = reports.action_effectiveness(rows, acts).first()
    assert (r.total_actions, r.open_actions, r.completed_actions, r.follow_up_actions) == (3, 1, 1, 1)
    assert (r.high_risk_with_action_count, r.high_risk_without_action_count) == (1, 1)


def test_empty_report_is_one_zero_row(spark):
    rows = spark.createDataFrame([], "reservation_id long, score double, risk_class string, no_show_flag long, is_canceled long, reservation_status string, arrival_date date")
    acts = spark.createDataFrame([], "id long, reservation_id long, action_status string")
    r = reports.operations_summary(rows, acts).collect()
    assert len(r) == 1 and r[0].total_reservations == 0 and r[0].no_show_rate == 0.0
    assert r[0].action_pending_count == 0
    assert reports.trends(rows).count() == 0
    with pytest.raises(ValueError):
        reports.dimension_breakdown(rows, "country_code")


def test_entity_actions_unknown_entity(spark):
    acts = spark.createDataFrame([(1, 10, _t(1))], "id long, reservation_id long, acted_at timestamp")
    ents = spark.createDataFrame([(10,)], "reservation_id long")
    assert [r.id for r in queue.entity_actions(acts, 10, ents).collect()] == [1]
    with pytest.raises(LookupError):
        queue.entity_actions(acts, 11, ents)


def test_mandatory_key_resolution(spark):
    from riskloom.sources import layers

    parent = spark.createDataFrame([("H1.csv", 1)], "source_file string, source_row_number long")
    child = spark.createDataFrame([("H1.csv", 1), ("H1.csv", 2)], "source_file string, source_row_number long")
    with pytest.raises(KeyError):
        layers.require_resolved(child, parent, "clean_to_raw")
    assert layers.require_resolved(child.limit(1), parent, "ok").count() == 1


def test_bootstrap_benchmark(spark):
    rows = reports.bootstrap_benchmark(spark).collect()
    assert {r.status for r in rows} == {"planned"} and all(r.pr_auc is None and not r.is_recommended for r in rows)
