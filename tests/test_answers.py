"""Source choice, composed answers and page ids by value."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom import config
from riskloom.operators import answers, queue
from riskloom.operators.ranking import global_rank, keys_below
from riskloom.sources import files, layers, resolver

CLEAN = (
    "source_file string, source_row_number bigint, reservation_key string, property_id string, arrival_date date, distribution_channel string,"
    " market_segment string, customer_type string, reservation_status string, is_canceled bigint, no_show_flag bigint"
)
SCORES = (
    "prediction_id string, reservation_key string, source_file string, source_row_number bigint, model_name string,"
    " model_version string, score double, risk_class string, threshold_used double, scored_at timestamp"
)


def entities(spark):
    rows = [
        ("H1.csv", 1, "H1.csv:1", "RESORT_H1", dt.date(2017, 1, 5), "TA/TO", "Online", "Transient", "Check-Out", 0, 0),
        ("H1.csv", 2, "H1.csv:2", "RESORT_H1", dt.date(2017, 2, 5), "Direct", "Direct", "Group", "No-Show", 0, 1),
        ("H2.csv", 1, "H2.csv:1", "CITY_H2", None, None, None, None, "Canceled", 1, None),
    ]
    return spark.createDataFrame(rows, CLEAN)


def scores(spark):
    at = dt.datetime(2017, 3, 1)
    rows = [
        ("p1", "H1.csv:1", "H1.csv", 1, "gbt", "gbt_1", 0.2, "low", 0.35, at),
        ("p2", "H1.csv:1", "H1.csv", 1, "gbt", "gbt_2", 0.81, "high", 0.35, at + dt.timedelta(1)),
        ("p3", "H1.csv:2", "H1.csv", 2, "gbt", "gbt_1", 0.4, "medium", 0.35, at),
    ]
    return spark.createDataFrame(rows, SCORES)


def write_store(spark, store, with_scores):
    for run in ("r1", "r2"):  # the same rows imported twice count once
        rows = entities(spark).withColumn("run_id", F.lit(run))
        rows.write.mode("append").partitionBy("run_id").parquet(f"{store}/reservations_clean")
    if with_scores:
        scores(spark).withColumn("run_id", F.lit("r2")).write.partitionBy("run_id").parquet(f"{store}/predictions")


def write_run(spark, root, finished=True):
    paths = files.run_paths(root, "run1")
    entities(spark).write.parquet(f"{paths['datasets']}/reservations_clean")
    scores(spark).where("prediction_id != 'p1'").write.parquet(f"{paths['predictions']}/predictions")
    if finished:
        document = {"recommended_model": "gbt", "models": {"gbt": {"model_version": "gbt_2"}}}
        files.write_document(spark, document, f"{paths['reports']}/{files.SUMMARY}")


def test_resolver_tests_what_is_stored(spark, tmp_path):
    store, root, none = str(tmp_path / "store"), str(tmp_path / "runs"), str(tmp_path / "none")
    assert resolver.resolve(spark).label == config.BOOTSTRAP_SOURCE
    assert resolver.resolve(spark, none, none).label == config.BOOTSTRAP_SOURCE
    write_run(spark, root, finished=False)
    assert resolver.resolve(spark, none, root).label == config.BOOTSTRAP_SOURCE
    write_store(spark, store, with_scores=False)
    bare = resolver.resolve(spark, store, root)
    assert bare.label == config.BOOTSTRAP_SOURCE and not bare.writable and bare.rows.count() == 3
    write_run(spark, str(tmp_path / "runs2"))
    artifact = resolver.resolve(spark, store, str(tmp_path / "runs2"))
    assert (artifact.label, artifact.status, artifact.writable) == ("artifact_fallback", "artifact_fallback", False)
    assert (artifact.model_name, artifact.model_version) == ("gbt", "gbt_2")
    scores(spark).where("false").withColumn("run_id", F.lit("r0")).write.parquet(f"{store}/predictions")
    assert resolver.resolve(spark, store, None).label == config.BOOTSTRAP_SOURCE  # a layer without rows
    full = str(tmp_path / "full")
    write_store(spark, full, with_scores=True)
    source = resolver.resolve(spark, full, str(tmp_path / "runs2"))  # the store comes first
    assert (source.label, source.status, source.writable) == ("database_prediction_store", "ready", True)
    got = {r.reservation_key: (r.reservation_id, r.score, r.prediction_id) for r in source.rows.collect()}
    assert got == {"H1.csv:1": (1, 0.81, "p2"), "H1.csv:2": (2, 0.4, "p3"), "H2.csv:1": (3, None, None)}


def test_answers_of_all_sources(spark, tmp_path):
    store, root = str(tmp_path / "store"), str(tmp_path / "runs")
    write_store(spark, store, with_scores=True)
    write_run(spark, root)
    full, artifact, bare = resolver.resolve(spark, store), resolver.resolve(spark, None, root), resolver.resolve(spark)

    top = answers.dashboard_summary(full).first()
    assert (top.kpis.total_reservations, top.kpis.high_risk_reservations, top.kpis.medium_risk_reservations) == (3, 1, 1)
    assert [(i.place, i.reservation_id, i.score) for i in top["items"]] == [(1, 1, 0.81), (2, 2, 0.4)]
    top = answers.dashboard_summary(artifact).first()
    assert (top.kpis.total_reservations, top.kpis.active_model_name, top.kpis.active_model_version) == (2, "gbt", "gbt_2")
    assert [i.reservation_id for i in top["items"]] == [1, 2] and top.data_source == "artifact_fallback"
    top = answers.dashboard_summary(bare).first()
    assert (top.kpis.total_reservations, top["items"], top.scoring_status) == (0, [], "awaiting_predictions")

    one = answers.queue_answer(full, 1, property_id="RESORT_H1").first()
    assert one.total == 2 and [i.reservation_id for i in one["items"]] == [1] and one.filters.property_ids == []
    one = answers.queue_answer(artifact, risk_class="medium").first()
    assert one.total == 1 and [i.reservation_id for i in one["items"]] == [2]
    assert one.filters.distribution_channels == ["Direct", "TA/TO"] and one.filters.risk_classes == ["high", "medium", "low"]
    assert one.filters.min_arrival_date == dt.date(2017, 1, 5) and one.filters.model_version == "gbt_2"
    assert answers.queue_answer(bare).first().total == 0
    with pytest.raises(ValueError):
        answers.queue_answer(full, queue.MAX_PAGE_SIZE + 1)

    assert answers.operations_report(full).first().total_reservations == 3
    assert answers.operations_report(bare).first().note == config.SUMMARY_NOTES[config.BOOTSTRAP_SOURCE]
    assert [r.period for r in answers.trends_report(artifact).collect()] == ["2017-01", "2017-02"]
    for report in (answers.trends_report(bare), answers.breakdown_report(bare, "property_id")):
        assert report.count() == 0 and {"data_source", "action_support_enabled"} <= set(report.columns)
    for source, count in ((full, 1), (artifact, 1), (bare, 0)):
        row = answers.action_report(source).first()
        assert (row.total_actions, row.high_risk_without_action_count, row.status_breakdown) == (0, count, [])
        assert row.data_source == source.label and row.action_support_enabled == source.writable


def test_benchmark_document_nests_tables(spark):
    names = ["roc_auc", "pr_auc", "precision", "recall", "f1", "brier_score"]
    metrics = spark.createDataFrame(
        [("a", 0.7, 0.2, 0.1, 0.3, 0.4, None), ("b", 0.6, 0.5, 0.1, 0.3, 0.4, 0.2)], f"model_name string, {', '.join(n + ' double' for n in names)}"
    ).withColumn("threshold", F.lit(0.35))
    from riskloom.operators import evaluate

    sweep = spark.createDataFrame([("a", 0.5, 1), ("a", 0.1, 2), ("b", 0.1, 3)], "model_name string, threshold double, actioned_count bigint")
    top = spark.createDataFrame([("a", "top_5pct", 1), ("a", "top_100", 2), ("a", "top_25", 3)], "model_name string, segment string, selected_count bigint")
    versions = spark.createDataFrame([("a", "v1"), ("b", "v2")], "model_name string, model_version string")
    one = answers.benchmark_document(metrics, evaluate.model_comparison(metrics), sweep, top, versions, "split").first()
    assert one.recommended_model == "b" and "(0.500)" in one.recommendation_reason
    assert [r.model_name for r in one.comparison] == ["b", "a"]
    assert [(m.model_name, m.notes) for m in one.models] == [("a", "Version v1 evaluated from latest artifact."), ("b", "Version v2 evaluated from latest artifact.")]
    assert [(x.name, x.status) for x in one.models[0].metrics][-1] == ("brier_score", "pending")
    assert [x.name for x in one.models[0].metrics] == list(config.PRIMARY_METRICS)
    assert {k: [r.threshold for r in v] for k, v in one.threshold_tables.items()} == {"a": [0.1, 0.5], "b": [0.1]}
    assert [r.segment for r in one.top_k_tables["a"]] == ["top_25", "top_100", "top_5pct"]


@pytest.mark.parametrize("seed", range(1))
def test_page_ids_equal_full_numbering(spark, seed):
    """Ids of a page by interval counts equal those of the numbered view, null files too."""
    rnd = random.Random(seed)
    files_ = [None, "H1.csv", "H2.csv", "H3.csv"]
    keys = {(rnd.choice(files_), rnd.randrange(400)) for _ in range(300)}
    rows = [(f, n, rnd.choice([None, 0.1, 0.5, 0.9]), None, rnd.choice(["high", "low"])) for f, n in keys]
    view = spark.createDataFrame(rows, "source_file string, source_row_number bigint, score double, arrival_date date, risk_class string")
    want = {
        (r.source_file, r.source_row_number): r.id
        for r in global_rank(view, [("source_row_number", True)], ["source_file"], "id", continuous=True).collect()
    }
    for limit, where in ((200, None), (50, F.col("risk_class") == "high"), (5, F.lit(False))):
        page = queue.numbered_page(view, limit, where).collect()
        assert {(r.source_file, r.source_row_number): r.reservation_id for r in page}.items() <= want.items()
        chosen = [r for r in rows if where is None or (limit == 50 and r[4] == "high")]
        assert len(page) == min(limit, len(chosen))
    with pytest.raises(ValueError):
        queue.numbered_page(view, 201)


def test_keys_below_is_a_binary_search(spark):
    for n in (0, 1, 2, 3, 7, 8, 9, 200):
        keys = list(range(0, 2 * n, 2))
        df = spark.range(-1, 2 * n + 2).withColumn("keys", F.array(*[F.lit(k).cast("long") for k in keys]))
        got = df.select("id", keys_below(F.col("id"), F.col("keys"), 200).alias("n")).collect()
        assert all(r.n == sum(k < r.id for k in keys) for r in got)


def test_page_reads_the_view_once(spark):
    """Neither the page nor its keys pass through the driver; the view is scanned by one plan."""
    view = spark.range(1000).selectExpr(
        "'H1.csv' as source_file", "id as source_row_number", "id % 7 / 7.0 as score", "cast(null as date) as arrival_date"
    )
    plan = queue.numbered_page(view, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Range (" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_append_counts_and_quarantine(spark, tmp_path):
    """A run's rows by layer; a rerun without errors removes the run's quarantine."""
    raw = spark.createDataFrame([("H1.csv", 1, "x", "2016-01-01"), ("H1.csv", 3, "y", None)], "source_file string, source_row_number bigint, ReservationStatus string, ReservationStatusDate string")
    clean = raw.select("source_file", "source_row_number")
    feats = clean.withColumn("feature_set_version", F.lit("v1")).withColumn("f", F.lit(1))
    errors = spark.createDataFrame([("H1.csv", 2, "a,b", "too_few_fields", "m")], layers.NO_ERRORS)
    preds = {"m": scores(spark).limit(0).withColumn("scoring_run_id", F.lit("r"))}
    store = str(tmp_path / "store")
    got = layers.append_run(spark, store, raw, clean, feats, preds, "v1", "r1", errors=errors)
    assert got == {"import_batches": 1, "reservations_raw": 2, "reservations_clean": 2, "reservation_features": 2, "predictions": 0, "import_errors": 1}
    assert layers.read_layer(spark, store, "import_batches").first().error_count == 1
    assert layers.append_run(spark, store, raw, clean, feats, preds, "v1", "r2", errors=errors)["import_errors"] == 1
    assert layers.append_run(spark, store, raw, clean, feats, preds, "v1", "r1")["import_errors"] == 0
    left = layers.read_layer(spark, store, "import_errors").collect()
    assert [(r.run_id, r.source_row_number) for r in left] == [("r2", 2)]
    batch = {r.run_id: r.error_count for r in layers.read_layer(spark, store, "import_batches").collect()}
    assert batch == {"r1": 0, "r2": 1}


def write_tables(spark, base):
    """A few orders of one nation with eight lines each, shipped in eight months."""
    day = dt.datetime(1997, 1, 1)
    tables = {
        "nation": ([(0, "FRANCE", 3)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, 0, "BUILDING")], "c_custkey bigint, c_nationkey int, c_mktsegment string"),
        "orders": (
            [(k, 1, "FO"[k % 2], 10.0 * k, day, "1-URGENT") for k in range(40)],
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
        ),
        "lineitem": (
            [(k, 1, 1, n, 5.0 * n, "RN"[n % 2], "OF"[n % 2], day + dt.timedelta(31 * n)) for k in range(40) for n in range(8)],
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string,"
            " l_linestatus string, l_shipdate timestamp_ntz",
        ),
        "events": (
            [(k, day, 1, "click", 1.0, "{}") for k in range(80)],
            "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/{name}.parquet")
    return str(base)


def test_rows_of_a_small_file_are_dealt_to_all_tasks(spark, tmp_path):
    from riskloom.sources import adapter

    raw = adapter.raw_reservations(spark, write_tables(spark, tmp_path / "in"))
    tasks = {r[0] for r in raw.select(F.spark_partition_id()).distinct().collect()}
    assert raw.count() == 40 and len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_stored_predictions_lie_in_few_files(spark, tmp_path):
    from riskloom.plans.answers import stored_case

    data = write_tables(spark, tmp_path / "in")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        source = stored_case(spark, data, predictions=True, run=False)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored_rows = source.predictions
    assert stored_rows.count() == 320 and stored_rows.select("run_id").distinct().count() == 8
    assert len(stored_rows.inputFiles()) == 8  # one for each run, not one for each run and task


def test_store_queue_joins_once(spark, tmp_path):
    write_store(spark, str(tmp_path), True)
    source = resolver.resolve(spark, str(tmp_path), None)
    out = answers.queue_answer(source, risk_class="high")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "scored_at" in plan and "Join LeftOuter" not in plan  # total and page read the joined rows
    one = out.first()
    assert one.total == 1 and [i.model_version for i in one["items"]] == ["gbt_2"]
