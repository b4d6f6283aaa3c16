"""Registered queries over stored layers and runs: quarantine, source choice, composed answers.

Each one writes what it resolves (layers, a finished run, CSV files) to the
shared folder first, because the choice of source tests what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import config
from riskloom.operators import answers, evaluate, queue, reports
from riskloom.plans import catalog
from riskloom.plans.catalog import BY, LABEL, SCORE, TIE_BREAK, register
from riskloom.plans.frames import ARTIFACT_MODEL, Frames
from riskloom.session import shared_path
from riskloom.sources import adapter, files, layers, resolver, state

RUN = "20250101T000000Z"
QUEUE_FILTER = {"property_id": "CITY_H2", "risk_class": "high"}


# --- malformed records --------------------------------------------------------------------


def _scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = shared_path(spark, "csv-lines")
    adapter.raw_csv_lines(spark, sf_dir).write.partitionBy("source_file").option("compression", "none").text(f"{base}/text")
    return files.scan_raw_csv(
        spark, [f"{base}/text"], columns=list(adapter.RAW_COLUMNS), source_col="source_file", header=False, multi_line=False
    )


@register("csv_quarantine")
def csv_quarantine(spark, sf_dir):
    """Rows and malformed records of each source by kind: their number, a sum over hashes of
    their texts, and the number of records of the source that the row numbers reach."""
    rows, errors = _scanned(spark, sf_dir)
    text = rows.select("source_file", "source_row_number", F.lit("row").alias("kind"), F.concat_ws("|", *adapter.RAW_COLUMNS).alias("t"))
    bad = errors.select("source_file", "source_row_number", F.concat_ws(": ", "error_code", "error_message").alias("kind"), F.col("raw_record").alias("t"))
    both = text.unionByName(bad).groupBy("source_file", "kind").agg(
        F.count(F.lit(1)).cast("bigint").alias("record_count"),
        F.sum(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("bigint")).cast("bigint").alias("text_hash_sum"),
        F.max("source_row_number").alias("last"),
    )
    every = Window.partitionBy("source_file")  # one row for each kind
    return both.withColumn("last_number", F.max("last").over(every).cast("bigint")).drop("last")


@register("import_batch_quarantine")
def import_batch_quarantine(spark, sf_dir):
    rows, errors = _scanned(spark, sf_dir)
    return layers.import_batch(rows, "csv_lines", config.FEATURE_SET_VERSION, errors)


# --- source choice ------------------------------------------------------------------------


def _kept(df: DataFrame, path: str) -> None:
    df.write.partitionBy("run_id").parquet(path)


def stored_case(spark: SparkSession, sf_dir: str, predictions: bool, run: bool) -> resolver.Source:
    """Layers with or without predictions, with or without a finished run, resolved."""
    fr = Frames(spark, sf_dir)
    base = shared_path(spark, "case")
    store, root = f"{base}/store", f"{base}/runs"
    clean = fr.clean()
    _kept(clean.withColumn("run_id", F.lit(RUN)), f"{store}/reservations_clean")
    fr.actions().write.parquet(f"{store}/actions")
    if predictions:
        # Dealt and sorted by run before the payload is built: a task holds few runs, so there are few
        # files, and what it sorts are narrow rows of a bounded number.
        history = fr.keyed_predictions().hint("rebalance", "scoring_run_id").sortWithinPartitions("scoring_run_id")
        rows = layers.prediction_layer({"all": history}).withColumnRenamed("scoring_run_id", "run_id")
        _kept(rows, f"{store}/predictions")
    if run:
        paths = files.run_paths(root, RUN)
        clean.drop("reservation_id").write.parquet(f"{paths['datasets']}/reservations_clean")
        fr.model_latest().drop("reservation_id").write.parquet(f"{paths['predictions']}/predictions")
        document = {"recommended_model": ARTIFACT_MODEL, "models": {ARTIFACT_MODEL: {"model_version": "logreg_v9"}}}
        files.write_document(spark, document, f"{paths['reports']}/{files.SUMMARY}")
    return resolver.resolve(spark, store, root)


CASES = {"store": (True, True), "artifact": (False, True), "bootstrap": (False, False)}


def _register_cases(name: str, build, cases=("store", "artifact")) -> None:
    for case in cases:
        what = CASES[case]
        register(f"{name}_{case}")(lambda spark, sf_dir, what=what: build(stored_case(spark, sf_dir, *what)))


def _dashboard_rows(source: resolver.Source) -> DataFrame:
    """The dashboard answer, one row for each listed entity."""
    one = answers.dashboard_summary(source)
    head = ["kpis.*", "scoring_status", "data_source", "action_support_enabled"]
    return one.select(*head, F.explode_outer("items").alias("i")).select("*", "i.*").drop("i")


def _queue_rows(source: resolver.Source) -> DataFrame:
    """The queue answer, one row for each listed entity."""
    one = answers.queue_answer(source, **QUEUE_FILTER)
    listed = [F.array_join(f"filters.{c}", "|").alias(c) for c in ("property_ids", "distribution_channels", "risk_classes")]
    head = ["total", *listed, "filters.min_arrival_date", "filters.max_arrival_date", "data_source", "action_support_enabled"]
    head += [F.col(f"filters.{c}").alias(f"filter_{c}") for c in ("model_name", "model_version")]
    return one.select(*head, F.explode_outer("items").alias("i")).select("*", "i.*").drop("i")


def _action_rows(source: resolver.Source) -> DataFrame:
    """The action answer with its breakdowns as text."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["label"], x["count"].cast("string"))), "|").alias(c)
    out = answers.action_report(source)
    names = [c for c in out.columns if not c.endswith("_breakdown")]
    return out.select(*names, text("status_breakdown"), text("type_breakdown"))


_register_cases("operations_report", answers.operations_report, CASES)
_register_cases("trends_report", answers.trends_report)
_register_cases("channel_report", lambda s: answers.breakdown_report(s, "distribution_channel"))
_register_cases("action_report", _action_rows)
_register_cases("dashboard_answer", _dashboard_rows, CASES)
_register_cases("queue_answer", _queue_rows)


# --- benchmark document -------------------------------------------------------------------


@register("benchmark_document")
def benchmark_document(spark, sf_dir):
    """The nested benchmark document, read back as rows."""
    fr = Frames(spark, sf_dir)
    scored = catalog._scored(fr)
    metrics = catalog._metrics(fr)
    versions = fr.predictions().groupBy("model_name").agg(
        F.max_by("model_version", F.struct("scored_at", "model_version")).alias("model_version")
    )
    document = answers.benchmark_document(
        metrics, evaluate.model_comparison(metrics), evaluate.threshold_sweep(scored, LABEL, SCORE, by=BY),
        evaluate.top_k_capture(scored, LABEL, SCORE, TIE_BREAK, by=BY), versions,
        reports.split_text(catalog.TRAIN_YEARS, catalog.TEST_YEARS),
    )
    return answers.document_rows(document)


# --- stored state -------------------------------------------------------------------------

ENTITY = ["reservation_id"]


def _merged(fr: Frames) -> DataFrame:
    """Newest predictions of a history that comes in two deliveries: odd lines, then even ones."""
    rows = fr.predictions()
    table = state.store_latest(rows.where("tie_line % 2 = 1"), ENTITY, adapter.PREDICTION_ORDER)
    table = state.merge_latest(fr.spark, table, rows.where("tie_line % 2 = 0"), ENTITY, adapter.PREDICTION_ORDER)
    return fr.spark.table(table)


@register("latest_prediction_merged")
def latest_prediction_merged(spark, sf_dir):
    return _merged(Frames(spark, sf_dir)).select(*ENTITY, *queue.PREDICTION_FIELDS)


@register("queue_store_bucketed")
def queue_store_bucketed(spark, sf_dir):
    """The store's queue page over entities and newest predictions in equal buckets."""
    fr = Frames(spark, sf_dir)
    entities = spark.table(state.write_bucketed(fr.clean(), "entities", ENTITY))
    rows = queue.with_latest(entities, _merged(fr))
    return queue.queue_page(rows, 50, id_ascending=False).select(*catalog.QUEUE_COLUMNS)


def _fold_all(spark: SparkSession, sf_dir: str) -> tuple[str, list[DataFrame]]:
    """The action log and its updates in three batches: the log, later updates, earlier ones."""
    path = shared_path(spark, "action-state")
    log, updates = Frames(spark, sf_dir).actions(), adapter.action_updates(spark, sf_dir)
    late = F.hour("updated_at") >= 12
    batches = [(log, updates.limit(0)), (log.limit(0), updates.where(late)), (log.limit(0), updates.where(~F.coalesce(late, F.lit(False))))]
    return path, [state.fold_batch(spark, path, n, a, u) for n, (a, u) in enumerate(batches)]


@register("action_state_folded")
def action_state_folded(spark, sf_dir):
    path, _ = _fold_all(spark, sf_dir)
    return state.read_state(spark, path).select("id", "reservation_id", "action_status", "action_note", "update_count", "last_updated_at")


@register("action_state_rejections")
def action_state_rejections(spark, sf_dir):
    _, rejected = _fold_all(spark, sf_dir)
    out = rejected[0].unionByName(rejected[1]).unionByName(rejected[2])
    return out.select("update_id", "id", "rejection_reason")


@register("feature_payload_typed")
def feature_payload_typed(spark, sf_dir):
    """The features read back from the JSON payload of their layer, each by its own type."""
    rows = catalog._features(Frames(spark, sf_dir))
    layer = layers.feature_layer(rows)
    fields = T.StructType([f for f in rows.schema if f.name not in (*layer.columns, "reservation_key", "reservation_id")])
    return layers.typed_payload(layer, "feature_payload", fields)
