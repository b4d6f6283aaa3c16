import pytest
from pyspark.sql import functions as F

from riskloom import config
from riskloom.config import stage
from riskloom.operators import cleanse, contracts, features
from tests.fixtures import raw_fixture, snapshot_fixture

BOOKING = stage()
DAY1 = stage("post_booking_day_1")


def test_booking_time_dataset(spark):
    raw = raw_fixture(spark)
    clean = cleanse.normalize_reservations(raw, BOOKING)
    feats = features.build_features(clean, BOOKING)
    modeling = features.modeling_rows(feats, BOOKING)
    assert raw.count() == 4 and clean.count() == 4
    assert modeling.count() == 3
    assert clean.filter("excluded_from_training").count() == 1
    assert {r[0] for r in modeling.select("no_show_flag").collect()} == {0, 1}
    forbidden = set(config.EXCLUDED_INTERNAL_COLUMNS) - {"no_show_flag"}
    assert not forbidden & set(modeling.columns)
    row = clean.filter("reservation_key = 'H1.csv:1'").first()
    assert row.meal_plan == "BB" and row.agent_code is None and row.property_id == "RESORT_H1"
    canceled = clean.filter("reservation_key = 'H2.csv:4'").first()
    assert canceled.exclusion_reason == "canceled_status" and canceled.no_show_flag is None


def test_temporal_split_years(spark):
    modeling = features.modeling_rows(
        features.build_features(cleanse.normalize_reservations(raw_fixture(spark), BOOKING), BOOKING), BOOKING
    )
    train, test = features.temporal_split(modeling, BOOKING)
    assert {int(r[0]) for r in train.select("arrival_year").collect()} == {2015, 2016}
    assert {int(r[0]) for r in test.select("arrival_year").collect()} == {2017}
    for side, name in ((train, "train"), (test, "test")):  # each side is read from its own files
        assert side.columns == modeling.columns
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(split_name" in plan and f"= {name})" in plan and "Join" not in plan
    with pytest.raises(ValueError, match="no rows to test"):
        features.temporal_split(modeling, BOOKING, test_years=(1990,))


def test_snapshot_stage_requires_contract(spark):
    with pytest.raises(ValueError, match="required columns are missing"):
        cleanse.normalize_snapshot(raw_fixture(spark), DAY1)


def test_snapshot_stage_dataset(spark):
    clean = cleanse.normalize_snapshot(snapshot_fixture(spark), DAY1)
    feats = features.build_features(clean, DAY1)
    modeling = features.modeling_rows(feats, DAY1)
    assert "final_outcome" not in modeling.columns
    for c in config.SNAPSHOT_EXTRA_ENGINEERED:
        assert c in modeling.columns
    flags = {r.reservation_key: r for r in feats.collect()}
    assert flags["H1.csv:2"].has_any_booking_change_as_of_cutoff is None  # null in -> null out
    assert flags["H1.csv:3"].has_any_booking_change_as_of_cutoff == 1
    assert flags["H1.csv:1"].room_assigned_flag_as_of_cutoff is None
    train, test = features.temporal_split(modeling, DAY1)
    assert {int(r[0]) for r in train.select("snapshot_year").collect()} == {2015, 2016}
    assert {int(r[0]) for r in test.select("snapshot_year").collect()} == {2017}
    inactive = clean.filter("reservation_key = 'H1.csv:4'").first()
    assert inactive.excluded_from_training and inactive.exclusion_reason == "canceled_before_or_after_snapshot"


def test_leakage_guard(spark):
    modeling = features.modeling_rows(
        features.build_features(cleanse.normalize_reservations(raw_fixture(spark), BOOKING), BOOKING), BOOKING
    )
    rules = contracts.leakage_rules(BOOKING)
    with pytest.raises(ValueError, match="known only after the outcome: is_canceled.*features are missing: adr"):
        contracts.check(modeling.withColumn("is_canceled", F.lit(0)).drop("adr"), rules, "rows", ["reservation_id"])


def test_stage_facts():
    assert list(config.STAGE_DAYS)[0] == "booking_time" and len(config.STAGE_DAYS) == 5
    with pytest.raises(ValueError):
        DAY1.check_input(None)
    with pytest.raises(ValueError):
        config.stage("day_9")
    assert DAY1.output_root("/out") == "/out/post_booking_day_1" and BOOKING.output_root("/out") == "/out"
    for s in (BOOKING, DAY1):
        assert set(s.columns("number")) | set(s.columns("text")) == set(s.columns("feature"))
        assert list(s.record()) == [config.RECORD_VERSION, *config.RECORD_LISTS]
