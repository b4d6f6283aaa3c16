"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query composes library operators over the adapter frames; every one
reads whole tables.  Output columns are aliased to match the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import config
from riskloom.operators import actions, cleanse, evaluate, features, queue, reports
from riskloom.sources import adapter, files, layers
from riskloom.operators.reports import is_canceled_store
from riskloom.plans.frames import ARTIFACT_MODEL, Frames

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

DETAIL_ID = 4242  # entity looked up by the point-lookup queries
QUEUE_FILTERS = {"property_id": "RESORT_H1", "date_from": "1996-01-01", "date_to": "1999-12-31"}


def register(name: str):
    def wrap(fn):
        REGISTRY[name] = fn
        return fn

    return wrap


def _f(spark: SparkSession, sf_dir: str) -> Frames:
    return Frames(spark, sf_dir)


# --- cleanse / label / canonical ------------------------------------------------


@register("cleanse_text")
def cleanse_text(spark, sf_dir):
    return _f(spark, sf_dir).clean().select(
        "reservation_id", "meal_plan", "country_code", "market_segment", "distribution_channel",
        "reserved_room_type", "assigned_room_type", "deposit_type", "agent_code", "company_code",
        "customer_type", "reservation_status",
    )


@register("cleanse_numeric")
def cleanse_numeric(spark, sf_dir):
    return _f(spark, sf_dir).clean().select(
        "reservation_id", "lead_time_days", "weekend_nights", "week_nights", "adults", "children", "babies",
        "is_repeated_guest", "previous_cancellations", "previous_non_cancelled_bookings", "booking_changes",
        "days_in_waiting_list", "adr", "required_car_parking_spaces", "total_special_requests",
    )


@register("cleanse_dates")
def cleanse_dates(spark, sf_dir):
    return _f(spark, sf_dir).clean().select(
        "reservation_id", "arrival_year", "arrival_month_name", "arrival_month_number", "arrival_week_number",
        "arrival_day_of_month", "arrival_date", "reservation_status_date",
    )


@register("label_and_exclusion")
def label_and_exclusion(spark, sf_dir):
    return _f(spark, sf_dir).clean().select(
        "reservation_id", "model_stage", "reservation_status", "is_canceled", "no_show_flag",
        "excluded_from_training", "exclusion_reason", is_canceled_store().alias("canceled_flag"),
    )


@register("canonical_projection")
def canonical_projection(spark, sf_dir):
    return _f(spark, sf_dir).clean().select(
        "reservation_id", "reservation_key", "source_file", "source_row_number", "property_id",
        "arrival_month_name", "arrival_month_number", "arrival_date",
    )


# --- latest / view / queue ----------------------------------------------------------


@register("latest_prediction")
def latest_prediction(spark, sf_dir):
    return _f(spark, sf_dir).latest().select(
        "reservation_id", "prediction_id", "model_name", "model_version", "score", "risk_class",
        "threshold_used", "scored_at",
    )


@register("reservation_view")
def reservation_view(spark, sf_dir):
    return _f(spark, sf_dir).view(numbered=True).select(
        "reservation_id", "reservation_key", "source_file", "source_row_number", "property_id", "arrival_date",
        "distribution_channel", "customer_type", "no_show_flag", "score", "risk_class", "model_name",
        "model_version", "scored_at", "arrival_date_prediction",
    )


QUEUE_COLUMNS = (
    "reservation_id", "property_id", "source_file", "arrival_date", "distribution_channel", "customer_type",
    "no_show_flag", "score", "risk_class", "model_name", "model_version", "scored_at",
)


@register("queue_store")
def queue_store(spark, sf_dir):
    rows = _f(spark, sf_dir).store_rows()
    return queue.queue_page(rows, 50, id_ascending=False).select(*QUEUE_COLUMNS)


@register("queue_artifact")
def queue_artifact(spark, sf_dir):
    view = _f(spark, sf_dir).view().select(*QUEUE_COLUMNS[1:], "source_row_number")
    wanted = queue.filter_condition(property_id="CITY_H2", risk_class="high")
    return queue.numbered_page(view, 50, wanted).select(*QUEUE_COLUMNS)


@register("queue_count")
def queue_count(spark, sf_dir):
    rows = queue.apply_filters(_f(spark, sf_dir).store_rows(), risk_class="medium", **QUEUE_FILTERS)
    return rows.agg(F.count(F.lit(1)).cast("bigint").alias("total"))


@register("filter_options")
def filter_options(spark, sf_dir):
    return queue.filter_options(_f(spark, sf_dir).view())


@register("filter_option_rows")
def filter_option_rows(spark, sf_dir):
    return queue.filter_option_rows(_f(spark, sf_dir).view())


@register("reservation_detail")
def reservation_detail(spark, sf_dir):
    fr = _f(spark, sf_dir)
    return queue.entity_detail(fr.store_rows(), fr.actions(), DETAIL_ID)


@register("risky_store")
def risky_store(spark, sf_dir):
    fr = _f(spark, sf_dir)
    rows = queue.with_latest(fr.clean(), fr.latest(), how="inner")
    return queue.risky_page(rows, 8, None, id_ascending=False, with_arrival=False).select(
        "reservation_id", "property_id", "arrival_date", "distribution_channel", "risk_class", "score", "model_version"
    )


@register("risky_artifact")
def risky_artifact(spark, sf_dir):
    columns = ("property_id", "arrival_date", "distribution_channel", "risk_class", "score", "model_version")
    view = _f(spark, sf_dir).view().select(*columns, "source_file", "source_row_number")
    return queue.numbered_page(view, 12, F.col("risk_class").isin("high", "medium")).select("reservation_id", *columns)


# --- reports ---------------------------------------------------------------------------


@register("dashboard_kpis")
def dashboard_kpis(spark, sf_dir):
    fr = _f(spark, sf_dir)
    return reports.kpis(fr.clean(), fr.latest(), fr.predictions(), fr.actions())


@register("dashboard_kpis_artifact")
def dashboard_kpis_artifact(spark, sf_dir):
    return reports.kpis_artifact(_f(spark, sf_dir).view(), ARTIFACT_MODEL, None)


@register("operations_summary")
def operations_summary(spark, sf_dir):
    fr = _f(spark, sf_dir)
    return reports.operations_summary(fr.store_rows(), fr.actions(), store_rules=True)


@register("operations_summary_artifact")
def operations_summary_artifact(spark, sf_dir):
    return reports.operations_summary(_f(spark, sf_dir).view(), None, store_rules=False)


@register("no_show_trends")
def no_show_trends(spark, sf_dir):
    return reports.trends(_f(spark, sf_dir).store_rows(), store_rules=True)


@register("no_show_trends_artifact")
def no_show_trends_artifact(spark, sf_dir):
    return reports.trends(_f(spark, sf_dir).view(), store_rules=False)


@register("channel_breakdown")
def channel_breakdown(spark, sf_dir):
    return reports.dimension_breakdown(_f(spark, sf_dir).store_rows(), "distribution_channel")


@register("segment_breakdown")
def segment_breakdown(spark, sf_dir):
    return reports.dimension_breakdown(_f(spark, sf_dir).store_rows(), "market_segment")


@register("property_breakdown")
def property_breakdown(spark, sf_dir):
    return reports.dimension_breakdown(_f(spark, sf_dir).store_rows(), "property_id")


@register("channel_breakdown_artifact")
def channel_breakdown_artifact(spark, sf_dir):
    return reports.dimension_breakdown(_f(spark, sf_dir).view(), "distribution_channel", store_rules=False)


# --- actions ----------------------------------------------------------------------------


@register("action_effectiveness")
def action_effectiveness(spark, sf_dir):
    fr = _f(spark, sf_dir)
    return reports.action_effectiveness(fr.store_rows(), fr.actions())


@register("action_effectiveness_artifact")
def action_effectiveness_artifact(spark, sf_dir):
    # An entity is one row of the view: its key stands for the id that numbering would give.
    view = _f(spark, sf_dir).view().withColumn("reservation_id", F.struct("source_file", "source_row_number"))
    return reports.action_effectiveness(view, None)


@register("action_status_breakdown")
def action_status_breakdown(spark, sf_dir):
    return reports.action_breakdown(_f(spark, sf_dir).actions(), "action_status")


@register("action_type_breakdown")
def action_type_breakdown(spark, sf_dir):
    return reports.action_breakdown(_f(spark, sf_dir).actions(), "action_type")


@register("action_counts_per_entity")
def action_counts_per_entity(spark, sf_dir):
    return reports.action_counts_per_entity(_f(spark, sf_dir).actions())


@register("action_history")
def action_history(spark, sf_dir):
    return queue.entity_actions(_f(spark, sf_dir).actions(), DETAIL_ID // 2).select(
        "id", "reservation_id", "action_type", "action_status", "action_note", "acted_by", "acted_at"
    )


# --- features / modeling / split --------------------------------------------------------

TRAIN_YEARS = (1995, 1996, 1997, 1998, 1999)  # adapter data spans 1995-2001
TEST_YEARS = (2000, 2001)
BOOKING = config.stage()
DAY1 = config.stage("post_booking_day_1")


def _features(fr: Frames) -> DataFrame:
    return fr._get("features", lambda: features.build_features(fr.clean(), BOOKING))


def _modeling(fr: Frames) -> DataFrame:
    return fr._get("modeling", lambda: features.modeling_rows(_features(fr), BOOKING))


@register("feature_dataset")
def feature_dataset(spark, sf_dir):
    return _features(_f(spark, sf_dir))


@register("lead_time_bucket_counts")
def lead_time_bucket_counts(spark, sf_dir):
    return (
        _features(_f(spark, sf_dir))
        .groupBy("lead_time_bucket")
        .agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))
    )


@register("modeling_rows")
def modeling_rows_q(spark, sf_dir):
    return _modeling(_f(spark, sf_dir))


@register("temporal_split_rows")
def temporal_split_rows(spark, sf_dir):
    """Every labelled row with its side of the split."""
    rows = features.split_rows(_modeling(_f(spark, sf_dir)), BOOKING, TRAIN_YEARS, TEST_YEARS)
    return rows.select("reservation_id", "reservation_key", "arrival_year", "no_show_flag", "split_name")


@register("temporal_split_summary")
def temporal_split_summary(spark, sf_dir):
    return features.split_summary(_modeling(_f(spark, sf_dir)), BOOKING, TRAIN_YEARS, TEST_YEARS)


@register("import_summary")
def import_summary(spark, sf_dir):
    fr = _f(spark, sf_dir)
    parts = [
        fr.raw().agg(F.count(F.lit(1)).cast("bigint").alias("row_count_raw")),
        fr.clean().agg(
            F.count(F.lit(1)).cast("bigint").alias("row_count_clean"),
            F.count_if(~F.col("excluded_from_training")).cast("bigint").alias("row_count_training"),
            F.count_if(F.col("excluded_from_training")).cast("bigint").alias("row_count_excluded"),
        ),
    ]
    return reports.one_row(parts, ["row_count_raw", "row_count_clean", "row_count_training", "row_count_excluded"]).withColumn(
        "model_stage", F.lit(BOOKING.name)
    )


@register("status_distribution")
def status_distribution(spark, sf_dir):
    return (
        _f(spark, sf_dir).clean()
        .groupBy(F.coalesce("reservation_status", F.lit("MISSING")).alias("status"))
        .agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))
    )


@register("class_distribution")
def class_distribution(spark, sf_dir):
    return (
        _modeling(_f(spark, sf_dir))
        .groupBy("no_show_flag")
        .agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))
        .orderBy("no_show_flag")
    )


def _snapshot_clean(fr: Frames) -> DataFrame:
    return fr._get(
        "snapshot", lambda: cleanse.normalize_snapshot(adapter.snapshot_reservations(fr.spark, fr.sf_dir), DAY1)
    )


@register("snapshot_normalize")
def snapshot_normalize(spark, sf_dir):
    return _snapshot_clean(_f(spark, sf_dir)).select(
        "reservation_key", "source_row_number", "snapshot_stage", "arrival_date",
        cleanse.utc_ntz(spark, F.col("snapshot_at")).alias("snapshot_at"), "snapshot_year",
        "is_active_at_snapshot", "final_outcome", "no_show_flag", "excluded_from_training", "exclusion_reason",
        "lead_time_days", "days_since_booking", "days_to_arrival", "booking_changes_as_of_cutoff",
        "assigned_room_type_as_of_cutoff",
    )


@register("feature_asof_flags")
def feature_asof_flags(spark, sf_dir):
    feats = features.build_features(_snapshot_clean(_f(spark, sf_dir)), DAY1)
    return feats.select(
        "reservation_key", "feature_set_version", "snapshot_year", "lead_time_bucket", "total_nights",
        "has_any_booking_change_as_of_cutoff", "waiting_list_flag_as_of_cutoff", "room_assigned_flag_as_of_cutoff",
    )


# --- evaluation ---------------------------------------------------------------------------

LABEL, SCORE, BY = "actual_no_show_flag", "score", ["model_name"]
TIE_BREAK = ["reservation_id", "tie_line", "tie_part", "tie_supp"]


def _scored(fr: Frames) -> DataFrame:
    return fr.predictions().select(*BY, LABEL, SCORE, *TIE_BREAK)


def _metrics(fr: Frames) -> DataFrame:
    return fr._get("metrics", lambda: evaluate.classification_metrics(_scored(fr), LABEL, SCORE, by=BY))


@register("confusion_matrix")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_scored(_f(spark, sf_dir)), LABEL, SCORE, config.ACTION_THRESHOLD, BY)


@register("classification_metrics")
def classification_metrics(spark, sf_dir):
    return _metrics(_f(spark, sf_dir))


@register("threshold_sweep")
def threshold_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(_scored(_f(spark, sf_dir)), LABEL, SCORE, by=BY)


@register("topk_capture")
def topk_capture(spark, sf_dir):
    return evaluate.top_k_capture(_scored(_f(spark, sf_dir)), LABEL, SCORE, TIE_BREAK, by=BY)


@register("calibration_table")
def calibration_table(spark, sf_dir):
    return evaluate.calibration(_scored(_f(spark, sf_dir)), LABEL, SCORE, TIE_BREAK, by=BY)


@register("metrics_long")
def metrics_long(spark, sf_dir):
    return evaluate.metrics_long(_metrics(_f(spark, sf_dir)))


@register("model_comparison")
def model_comparison(spark, sf_dir):
    return evaluate.model_comparison(_metrics(_f(spark, sf_dir)))


@register("recommended_model")
def recommended_model(spark, sf_dir):
    return evaluate.recommended_model(evaluate.model_comparison(_metrics(_f(spark, sf_dir))))


@register("threshold_lookup")
def threshold_lookup(spark, sf_dir):
    sweep = evaluate.threshold_sweep(_scored(_f(spark, sf_dir)), LABEL, SCORE, by=BY)
    return queue.threshold_lookup(sweep, config.ACTION_THRESHOLD, by=BY)


# --- action log changes -------------------------------------------------------------------


@register("action_validation")
def action_validation(spark, sf_dir):
    fr = _f(spark, sf_dir)
    accepted, rejected = actions.create_actions(
        adapter.action_requests(spark, sf_dir), fr.clean(), fr.predictions(), adapter.PREDICTION_ORDER[1:]
    )
    return (
        accepted.select(F.lit("accepted").alias("outcome"))
        .unionByName(rejected.select(F.col("rejection_reason").alias("outcome")))
        .groupBy("outcome")
        .agg(F.count(F.lit(1)).cast("bigint").alias("request_count"))
    )


@register("action_asof_prediction")
def action_asof_prediction(spark, sf_dir):
    fr = _f(spark, sf_dir)
    accepted, _ = actions.create_actions(
        adapter.action_requests(spark, sf_dir), fr.clean(), fr.predictions(), adapter.PREDICTION_ORDER[1:]
    )
    return accepted.select("id", "reservation_id", "prediction_id", "action_type", "action_status", "acted_at")


@register("action_latest_state")
def action_latest_state(spark, sf_dir):
    state, _ = actions.apply_updates(_f(spark, sf_dir).actions(), adapter.action_updates(spark, sf_dir))
    return state.select("id", "reservation_id", "action_status", "action_note", "update_count", "last_updated_at")


@register("action_update_rejections")
def action_update_rejections(spark, sf_dir):
    _, rejected = actions.apply_updates(_f(spark, sf_dir).actions(), adapter.action_updates(spark, sf_dir))
    return rejected.select("update_id", "id", "rejection_reason")


# --- layers, keys, runs ---------------------------------------------------------------------


@register("layer_raw_payload")
def layer_raw_payload(spark, sf_dir):
    raw = layers.raw_layer(_f(spark, sf_dir).raw())
    j = lambda k: F.get_json_object("raw_payload", f"$.{k}")
    return raw.select(
        "source_file", "source_row_number", "property_code", "reservation_status", "reservation_status_date",
        j("Meal").alias("payload_meal"), j("DistributionChannel").alias("payload_channel"),
        j("Agent").alias("payload_agent"), j("LeadTime").alias("payload_lead_time"),
        F.size(F.json_object_keys("raw_payload")).cast("bigint").alias("payload_fields"),
    )


@register("layer_feature_payload")
def layer_feature_payload(spark, sf_dir):
    feat = layers.feature_layer(_features(_f(spark, sf_dir)))
    j = lambda k: F.get_json_object("feature_payload", f"$.{k}")
    return feat.select(
        "source_file", "source_row_number", "feature_set_version",
        j("lead_time_bucket").alias("lead_time_bucket"), j("country_code").alias("country_code"),
        j("adr_per_guest").cast("double").alias("adr_per_guest"),
        j("previous_cancel_ratio").cast("double").alias("previous_cancel_ratio"),
        F.size(F.json_object_keys("feature_payload")).cast("bigint").alias("payload_fields"),
    )


@register("layer_prediction_union")
def layer_prediction_union(spark, sf_dir):
    fr = _f(spark, sf_dir)
    preds = fr.predictions()  # keyed by entity id only; natural keys joined once after the union
    frames = {m: preds.filter(F.col("model_name") == m) for m in ("logistic_regression", "gbt")}
    pl = layers.prediction_layer(frames, attach_keys=lambda df: adapter.attach_entity_keys(spark, sf_dir, df))
    j = lambda k: F.get_json_object("metadata_payload", f"$.{k}")
    return pl.select(
        "prediction_id", "model_name", "score", "risk_class", "scoring_run_id",
        j("split_name").alias("meta_split_name"),
        j("actual_no_show_flag").cast("bigint").alias("meta_actual_no_show_flag"),
        j("reservation_key").alias("meta_reservation_key"),
        j("snapshot_at").alias("meta_snapshot_at"),
    )


@register("layer_row_counts")
def layer_row_counts(spark, sf_dir):
    fr = _f(spark, sf_dir)
    return layers.layer_counts(
        {
            "reservation_import_batches": layers.import_batch(fr.raw(), "driver_tables", config.FEATURE_SET_VERSION),
            "reservations_raw": fr.raw(),
            "reservations_clean": fr.clean(),
            "reservation_features": _features(fr),
            "predictions": fr.predictions(),
        }
    )


@register("import_batch")
def import_batch(spark, sf_dir):
    return layers.import_batch(_f(spark, sf_dir).raw(), "driver_tables", config.FEATURE_SET_VERSION)


@register("key_resolution")
def key_resolution(spark, sf_dir):
    fr = _f(spark, sf_dir)
    parts = [
        layers.resolve_keys(fr.clean(), fr.raw(), "clean_to_raw"),
        layers.resolve_keys(_features(fr), fr.clean(), "feature_to_clean"),
        layers.resolve_keys(fr.keyed_predictions(), fr.clean(), "prediction_to_clean"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("key_uniqueness")
def key_uniqueness(spark, sf_dir):
    fr = _f(spark, sf_dir)
    parts = [
        layers.duplicate_keys(fr.raw(), layers.NATURAL_KEY, "reservations_raw"),
        layers.duplicate_keys(fr.clean(), layers.NATURAL_KEY, "reservations_clean"),
        layers.duplicate_keys(fr.predictions(), ["prediction_id"], "predictions"),
        layers.duplicate_keys(fr.predictions(), ["reservation_id", "model_name", "scored_at"], "prediction_entity_time"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("latest_run_view")
def latest_run_view(spark, sf_dir):
    return layers.latest_run(_f(spark, sf_dir).predictions()).select(
        "prediction_id", "reservation_id", "model_name", "scoring_run_id", "score", "risk_class"
    )


@register("source_resolution")
def source_resolution(spark, sf_dir):
    return layers.source_resolution(_f(spark, sf_dir).predictions())


@register("csv_row_numbering")
def csv_row_numbering(spark, sf_dir):
    """Write the raw rows as CSV part files per source, scan them back as
    all-string and number rows per source (S1-S3, S6).  Rows-only check."""
    import uuid

    from riskloom.session import ensure_checkpoint_dir

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv_roundtrip/{uuid.uuid4().hex}"
    raw = _f(spark, sf_dir).raw()
    cols = list(adapter.RAW_COLUMNS)
    files.write_raw_csv_files(raw, base, "source_file", cols)
    back = files.read_raw_csv(spark, [base], columns=cols, source_col="source_file")
    return back.select("source_file", "source_row_number", "reservation_key", *cols)


@register("csv_row_summary")
def csv_row_summary(spark, sf_dir):
    """Per source of the CSV round trip: rows, range and number of row numbers, and a sum
    over hashes of all rows, which tells two multisets of rows apart."""
    rows = csv_row_numbering(spark, sf_dir)
    text = F.md5(F.concat_ws("|", *adapter.RAW_COLUMNS))
    return rows.groupBy("source_file").agg(
        F.count(F.lit(1)).cast("bigint").alias("row_count"),
        F.min("source_row_number").alias("first_row"),
        F.max("source_row_number").alias("last_row"),
        F.count_distinct("source_row_number").cast("bigint").alias("row_numbers"),
        F.sum(F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint")).cast("bigint").alias("row_hash_sum"),
    )


# --- model fitting and scoring (rows-only checks) ---------------------------------------------


def _ml_predictions(spark, sf_dir, kind: str) -> DataFrame:
    from riskloom import jobs

    fr = _f(spark, sf_dir)
    preds = jobs.train_and_score(_modeling(fr), BOOKING, TRAIN_YEARS, TEST_YEARS, "booking_time-adapter", kinds=[kind])
    return preds[kind].select(
        "reservation_key", "model_name", "actual_no_show_flag", "score", "risk_class", "split_name"
    )


@register("ml_logistic")
def ml_logistic(spark, sf_dir):
    return _ml_predictions(spark, sf_dir, "logistic_regression")


@register("ml_logistic_checks")
def ml_logistic_checks(spark, sf_dir):
    """The exact parts of scored rows: key, label, side, model, and that score and class agree."""
    return _score_checks(_ml_predictions(spark, sf_dir, "logistic_regression"))


def _score_checks(rows: DataFrame) -> DataFrame:
    in_range = F.col("score").between(0.0, 1.0)
    agrees = F.col("risk_class") == F.when(F.col("score") >= config.HIGH_RISK_THRESHOLD, "high").when(
        F.col("score") >= config.ACTION_THRESHOLD, "medium"
    ).otherwise("low")
    return rows.select(
        "reservation_key", "model_name", "actual_no_show_flag", "split_name",
        in_range.alias("score_in_range"), agrees.alias("class_agrees"),
    )


@register("ml_gbt_checks")
def ml_gbt_checks(spark, sf_dir):
    """As ``ml_logistic_checks``, for a few rounds of boosted trees."""
    from riskloom import jobs
    from riskloom.operators.ml import GBTParams

    preds = jobs.train_and_score(
        _modeling(_f(spark, sf_dir)), BOOKING, TRAIN_YEARS, TEST_YEARS, "booking_time-adapter", kinds=["gbt"],
        gbt=GBTParams(max_depth=3, max_iter=5),
    )
    return _score_checks(preds["gbt"])


@register("feature_medians")
def feature_medians(spark, sf_dir):
    """Exact median of every numeric feature over the training side (M1)."""
    from riskloom.operators.quantile import exact_quantiles
    from riskloom.session import stored

    train = features.split_rows(_modeling(_f(spark, sf_dir)), BOOKING, TRAIN_YEARS, TEST_YEARS).where("split_name = 'train'")
    names = BOOKING.columns("number")
    found = exact_quantiles(stored(train.select(*names)), names)
    return spark.createDataFrame(list(found.items()), "feature string, median double")


@register("ml_gbt")
def ml_gbt(spark, sf_dir):
    return _ml_predictions(spark, sf_dir, "gbt")


@register("benchmark_report")
def benchmark_report(spark, sf_dir):
    """Per model: status, version note, primary metrics and recommendation.

    Falls back to the planned/pending rows (R5) when no prediction exists.
    """
    fr = _f(spark, sf_dir)
    if fr.predictions().isEmpty():  # one-row probe: nothing scored yet -> planned rows
        return reports.bootstrap_benchmark(spark, TRAIN_YEARS, TEST_YEARS)
    metrics = _metrics(fr)
    comparison = evaluate.model_comparison(metrics)
    versions = fr.predictions().groupBy("model_name").agg(
        F.max_by("model_version", F.struct("scored_at", "model_version")).alias("model_version")  # of the newest rows
    )
    rows = comparison.join(versions, "model_name").select(
        "model_name",
        F.lit("trained").alias("status"),
        F.format_string(config.VERSION_NOTE, "model_version").alias("notes"),
        "pr_auc", "roc_auc", "precision", "recall", "f1", "brier_score",
        (F.col("comparison_rank") == 1).alias("is_recommended"),
        F.lit(reports.split_text(TRAIN_YEARS, TEST_YEARS)).alias("split_strategy"),
    )
    return rows


@register("presentation_labels")
def presentation_labels(spark, sf_dir):
    """Property breakdown with display label and percent text; top-K segment labels (J10, §2.8)."""
    from riskloom.functions import percent_text, property_label, segment_label

    fr = _f(spark, sf_dir)
    props = reports.dimension_breakdown(fr.store_rows(), "property_id").select(
        F.lit("property").alias("kind"), F.col("dimension_value").alias("code"),
        property_label("dimension_value").alias("label"), percent_text("no_show_rate").alias("value_text"),
    )
    segs = (
        evaluate.top_k_capture(_scored(fr), LABEL, SCORE, TIE_BREAK, by=BY)
        .select(
            F.concat_ws(":", F.lit("segment"), "model_name").alias("kind"), F.col("segment").alias("code"), segment_label("segment").alias("label"),
            percent_text("recall").alias("value_text"),
        )
    )
    return props.unionByName(segs)


@register("action_stream_ingest")
def action_stream_ingest(spark, sf_dir):
    """Action requests from the event table, landed as files and ingested by the
    micro-batch stream (D1 via Structured Streaming).  Rows-only check."""
    import uuid

    from riskloom.session import ensure_checkpoint_dir
    from riskloom.streaming.actions import REQUEST_SCHEMA, start_action_ingest

    fr = _f(spark, sf_dir)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/action_stream/{uuid.uuid4().hex}"
    requests = adapter.action_requests(spark, sf_dir).select(*[f.name for f in REQUEST_SCHEMA.fields])
    requests.write.parquet(f"{base}/requests")
    query = start_action_ingest(
        spark, f"{base}/requests", fr.clean().select("reservation_id"), fr.predictions(),
        f"{base}/accepted", f"{base}/rejected", adapter.PREDICTION_ORDER[1:], checkpoint=f"{base}/_checkpoint",
    )
    query.awaitTermination()  # availableNow ends by itself once all landed files are read
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return spark.read.parquet(f"{base}/accepted").select(
        "id", "reservation_id", "prediction_id", "action_type", "action_status", "acted_at"
    )


def queries() -> dict[str, Query]:
    from riskloom.plans import answers  # noqa: F401  registers the composed answers

    return dict(REGISTRY)


__all__ = ["queries", "REGISTRY"]
