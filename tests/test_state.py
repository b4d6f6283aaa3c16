"""Stored state by value: merged newest rows, folded action state, typed payloads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import actions, queue
from riskloom.operators.latest import latest_per_key
from riskloom.sources import files, layers, state

T0 = dt.datetime(2020, 1, 1)
HISTORY = "reservation_id long, scored_at timestamp, tie long, prediction_id string, score double"
ORDER = ["scored_at", "tie"]
LOG = "id long, reservation_id long, action_status string, action_note string"
UPDATES = "update_id long, id long, action_status string, action_note string, updated_at timestamp"


def history(rng, n):
    """Rows of 40 entities; entity 7 has a third of them, some keys and times are null."""
    rows = []
    for i in range(n):
        key = 7 if rng.random() < 0.33 else rng.choice([*range(40), None])
        at = rng.choice([None, *[T0 + dt.timedelta(d) for d in range(5)]])
        rows.append((key, at, i, f"p{i}", rng.random()))
    return rows


def newest(rows):
    out = {}
    for r in rows:
        place = (r[1] is not None, r[1] or T0, r[2])
        if r[0] is not None and (r[0] not in out or place > out[r[0]][0]):
            out[r[0]] = (place, r)
    return {k: v[1] for k, v in out.items()}


def test_merged_latest_equals_whole_history(spark):
    rows = history(random.Random(3), 600)
    random.Random(4).shuffle(rows)
    keys = ["reservation_id"]
    frame = lambda part: spark.createDataFrame(part, HISTORY)
    table = state.store_latest(frame(rows[:200]), keys, ORDER, 8)
    for part in (rows[200:400], rows[200:400], [], rows[400:]):  # one run comes twice, one is empty
        table = state.merge_latest(spark, table, frame(part), keys, ORDER, 8)
    got = {r.reservation_id: tuple(r) for r in spark.table(table).select(*[f.split()[0] for f in HISTORY.split(", ")]).collect()}
    assert got == newest(rows)


def test_bucketed_sides_are_not_shuffled(spark):
    rows = history(random.Random(5), 300)
    keys = ["reservation_id"]
    entities = spark.createDataFrame([(i, f"c{i % 3}") for i in range(50)], "reservation_id long, channel string")
    kept, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(kept, "-1")
    try:
        base = spark.table(state.write_bucketed(entities, "entities", keys, 8))
        latest = spark.table(state.store_latest(spark.createDataFrame(rows, HISTORY), keys, ORDER, 8))
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        joined = queue.with_latest(base, latest)
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert joined.count() == 50
        merged = plan(state.merged_latest(latest, spark.createDataFrame(rows, HISTORY), keys, ORDER))
        side = merged.split("FullOuter", 1)[1]
        stored_side, run_side = side.split("Sort [reservation_id", 2)[1:]
        assert "Exchange" not in stored_side and "Bucketed: true" in stored_side
        assert "Exchange hashpartitioning" in run_side and "WindowGroupLimit" in run_side
        written = spark.table(state.merge_latest(spark, _name(spark, latest), spark.createDataFrame(rows, HISTORY), keys, ORDER, 8))
        assert len(written.inputFiles()) <= 8  # one file for each bucket, written without dealing again
    finally:
        spark.conf.set(kept, before)


def _name(spark, table):
    """A catalog name of ``table``'s rows."""
    return state.write_bucketed(table, "again", ["reservation_id"], 8)


def batches(rng):
    """Actions and updates in batches; updates come late, twice, with null ids and to unknown ids."""
    out, made, n = [], [], 0
    for b in range(5):
        new = [(len(made) + i, rng.randrange(9), rng.choice(["open", None]), rng.choice([None, "n"])) for i in range(rng.randrange(12))]
        made += new
        ups = []
        for _ in range(rng.randrange(40)):
            n += 1
            target = rng.choice([None, 999 + n, *[a[0] for a in made][-20:], 0])
            at = rng.choice([None, T0 + dt.timedelta(rng.randrange(6))])
            ups.append((n, target, rng.choice([None, "completed", "follow_up"]), rng.choice([None, "x", f"note{n}"]), at))
        out.append((new, ups))
    return out


def rows_of(df):
    cols = ["id", "reservation_id", "action_status", "action_note", "update_count", "last_updated_at"]
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_folded_state_equals_full_replay(spark, tmp_path, seed):
    path = str(tmp_path / "state")
    log, updates = [], []
    for n, (new, ups) in enumerate(batches(random.Random(seed))):
        log, known = log + new, {a[0] for a in log + new}
        updates += [u for u in ups if u[1] in known]
        batch = (spark.createDataFrame(new, LOG), spark.createDataFrame(ups, UPDATES))
        out = state.fold_batch(spark, path, n, *batch, buckets=5)
        if n == 2:  # cut short after its write: the same batch once more
            out = state.fold_batch(spark, path, n, *batch, buckets=5)
        assert sorted(r.update_id for r in out.collect()) == sorted(u[0] for u in ups if u[1] not in known)
    replay, _ = actions.apply_updates(spark.createDataFrame(log, LOG), spark.createDataFrame(updates, UPDATES))
    assert rows_of(state.read_state(spark, path)) == rows_of(replay)
    held = {}
    for bucket, part in state._parts(spark, path):
        held.setdefault(bucket, []).append(part)
    assert all(len(b) <= 2 for b in held.values())
    with pytest.raises(ValueError):
        state.fold_batch(spark, path, 1, *batch, buckets=5)


def test_fold_reads_its_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "state")
    log = spark.createDataFrame([(i, i, "open", None) for i in range(60)], LOG)
    none = spark.createDataFrame([], UPDATES)
    state.fold_batch(spark, path, 0, log, none, buckets=6)
    one = spark.createDataFrame([(1, 17, "completed", None, T0)], UPDATES)
    state.fold_batch(spark, path, 1, log.limit(0), one, buckets=6)
    parts = state._parts(spark, path)
    assert [b for _, b in parts].count(1) == 1
    bucket = next(k for k, b in parts if b == 1)
    held = state.read_state(spark, path, before=1, only=[bucket])
    assert all(f"/bucket={bucket}/batch=0/" in f for f in held.inputFiles())
    assert held.select("bucket", "batch").distinct().collect() == [(bucket, 0)]
    current = {r.id: r.action_status for r in state.read_state(spark, path).collect()}
    assert len(current) == 60 and current[17] == "completed" and list(current.values()).count("completed") == 1


def test_fold_of_empty_batches(spark, tmp_path):
    path = str(tmp_path / "state")
    log, none = spark.createDataFrame([], LOG), spark.createDataFrame([], UPDATES)
    assert state.read_state(spark, path) is None
    assert state.fold_batch(spark, path, 0, log, none).count() == 0
    lone = spark.createDataFrame([(1, 5, "open", None, T0)], UPDATES)
    assert [r.id for r in state.fold_batch(spark, path, 1, log, lone).collect()] == [5]
    assert state.read_state(spark, path) is None
    with pytest.raises(ValueError):
        state.fold_batch(spark, path, 2, log, none, keep=1)


def test_typed_payload_round_trip(spark):
    fields = T.StructType.fromDDL(
        "a long, b double, c string, d date, e timestamp, f boolean, `g'h` string, i array<int>, j decimal(20,3), k double"
    )
    at = dt.datetime(2020, 5, 1, 3, 4, 5, 678900)
    rows = [
        (1, 2**60, 0.1, "x\"y\\z é", dt.date(1999, 2, 28), at, True, "q", [1, None], None, 1.2345678901234567e-300),
        (2, None, None, None, None, None, None, None, None, None, None),
        (3, -1, -1e22, "", dt.date(2024, 2, 29), at, False, "null", [], None, 5e-324),
    ]
    schema = T.StructType([T.StructField("key", T.LongType()), *fields])
    frame = spark.createDataFrame(rows, schema)
    stored_rows = frame.select("key", layers._json([f"`{f.name}`" for f in fields]).alias("payload"))
    back = layers.typed_payload(stored_rows, "payload", fields)
    assert back.schema.simpleString() == schema.simpleString()
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_typed_payload_of_bad_text(spark):
    fields = T.StructType.fromDDL("a long, b string")
    rows = [(1, None), (2, "{"), (3, "{}"), (4, '{"a": "x", "b": 5}'), (5, '{"a": 7, "b": null}'), (6, "[1]")]
    got = layers.typed_payload(spark.createDataFrame(rows, "key long, payload string"), "payload", fields)
    assert sorted(map(tuple, got.collect())) == [
        (1, None, None), (2, None, None), (3, None, None), (4, None, "5"), (5, 7, None), (6, None, None),
    ]


def test_latest_bucket_files_and_folder(spark, tmp_path):
    rows = history(random.Random(8), 100)
    table = state.store_latest(spark.createDataFrame(rows, HISTORY), ["reservation_id"], ORDER, 4)
    assert len(spark.table(table).inputFiles()) == 4
    assert spark.table(table).count() == latest_per_key(spark.createDataFrame(rows, HISTORY).where("reservation_id is not null"), ["reservation_id"], ORDER).count()
    folder = str(tmp_path / "x")
    spark.range(3).withColumn("b", F.col("id")).write.parquet(folder)
    files.delete_folder(spark, folder)
    assert not files.path_exists(spark, folder)
