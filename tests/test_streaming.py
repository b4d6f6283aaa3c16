import datetime as dt

from riskloom.streaming.actions import REQUEST_SCHEMA, start_action_ingest


def test_action_ingest_micro_batches(spark, tmp_path):
    req_dir, acc, rej = str(tmp_path / "req"), str(tmp_path / "acc"), str(tmp_path / "rej")
    t = dt.datetime(2020, 1, 5)
    rows = [
        (1, 10, "call_guest", None, None, "ops_user", "{}", t),
        (2, 99, "call_guest", "open", None, "ops_user", "{}", t),  # unknown entity
        (3, 10, "x", "open", None, "ops_user", "{}", t),  # invalid type
    ]
    spark.createDataFrame(rows, REQUEST_SCHEMA).write.parquet(req_dir)
    entities = spark.createDataFrame([(10,)], "reservation_id long")
    preds = spark.createDataFrame(
        [(10, dt.datetime(2020, 1, 1), "p1"), (10, dt.datetime(2020, 1, 9), "p2")],
        "reservation_id long, scored_at timestamp_ntz, prediction_id string",
    )
    q = start_action_ingest(spark, req_dir, entities, preds, acc, rej, checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    accepted = spark.read.parquet(acc).collect()
    assert [(r.id, r.prediction_id, r.action_status) for r in accepted] == [(1, "p1", "open")]
    reasons = sorted(r.rejection_reason for r in spark.read.parquet(rej).collect())
    assert reasons == ["invalid_action_type", "unknown_entity"]
