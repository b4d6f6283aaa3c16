"""Where reports read from: the prediction store, else the newest finished run, else nothing scored yet.

``resolve`` tests the stored layers themselves and returns the rows to report
on together with the source's label and whether actions can be written (S21,
S22).  Each test is one path lookup and, for the store, a one-row probe.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import config
from riskloom.operators import queue
from riskloom.operators.latest import latest_per_key
from riskloom.operators.ranking import global_rank
from riskloom.sources import files, layers

KEY = list(layers.NATURAL_KEY)
NO_ROWS = (
    "reservation_id bigint, source_file string, source_row_number bigint, property_id string, arrival_date date, "
    "distribution_channel string, market_segment string, customer_type string, reservation_status string, "
    "is_canceled bigint, no_show_flag bigint"
)
NO_SCORES = (
    "prediction_id string, model_name string, model_version string, score double, risk_class string, "
    "threshold_used double, scored_at timestamp"
)
NO_ACTIONS = "id bigint, reservation_id bigint, action_type string, action_status string"


@dataclass(frozen=True)
class Source:
    """Rows of one source: ``rows`` are entities with their score (null: unscored).

    ``latest`` holds one prediction for each scored entity and ``predictions`` all of
    them; an artifact has neither, as its rows carry one model's scores, and no actions.
    """

    label: str
    rows: DataFrame
    entities: DataFrame
    latest: DataFrame | None = None
    predictions: DataFrame | None = None
    actions: DataFrame | None = None
    model_name: str | None = None
    model_version: str | None = None

    @property
    def status(self) -> str:
        return config.SCORING_STATUS[self.label]

    @property
    def writable(self) -> bool:
        """Actions refer to stored predictions, so only the store takes them."""
        return self.label == config.STORE_SOURCE


def store_source(
    entities: DataFrame, predictions: DataFrame, actions: DataFrame, keys: Sequence[str] = ("reservation_id",),
    newest_first: Sequence[str] = ("scored_at", "prediction_id"),
) -> Source:
    """Entities with the newest of their stored predictions."""
    latest = latest_per_key(predictions, list(keys), list(newest_first))
    cols = [*keys, *[c for c in queue.PREDICTION_FIELDS if c in latest.columns]]
    rows = entities.join(latest.select(*cols), list(keys), "left")
    return Source(config.STORE_SOURCE, rows, entities, latest, predictions, actions)


def artifact_source(clean: DataFrame, predictions: DataFrame, model_name: str, model_version: str | None) -> Source:
    """A finished run: the recommended model's rows joined onto its clean rows."""
    scored = predictions.where(F.col("model_name") == model_name)
    view = queue.entity_view(clean, scored, model_name, model_version, numbered=False)
    return Source(config.ARTIFACT_SOURCE, view, clean, model_name=model_name, model_version=model_version)


def bootstrap_source(spark: SparkSession, entities: DataFrame | None = None, actions: DataFrame | None = None) -> Source:
    """Nothing scored: the stored entities, if there are any."""
    entities = spark.createDataFrame([], NO_ROWS) if entities is None else entities
    scores = spark.createDataFrame([], NO_SCORES)
    rows = entities.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in scores.schema])
    actions = spark.createDataFrame([], NO_ACTIONS) if actions is None else actions
    return Source(config.BOOTSTRAP_SOURCE, rows, entities, actions=actions)


def stored_entities(spark: SparkSession, store: str) -> DataFrame | None:
    """Entities of the store: of several runs that imported a row the newest one's."""
    if not files.path_exists(spark, f"{store}/reservations_clean"):
        return None
    rows = latest_per_key(layers.read_layer(spark, store, "reservations_clean"), KEY, ["run_id"]).drop("run_id")
    if "reservation_id" not in rows.columns:
        rows = global_rank(rows, [("source_row_number", True)], ["source_file"], "reservation_id", continuous=True)
    return rows


def stored_layer(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """A layer that exists and holds a row."""
    if not files.path_exists(spark, f"{store}/{name}"):
        return None
    rows = layers.read_layer(spark, store, name)
    return None if rows.isEmpty() else rows


def resolve(spark: SparkSession, store: str | None = None, output_root: str | None = None) -> Source:
    """The source that serves reports now.

    Store: its ``predictions`` layer holds a row.  Artifact: a run under ``output_root``
    is finished and has its clean rows.  Otherwise bootstrap, over the store's entities.
    """
    store = store.rstrip("/") if store else None
    entities = stored_entities(spark, store) if store else None
    actions = stored_layer(spark, store, "actions") if store else None
    if entities is not None and (predictions := stored_layer(spark, store, "predictions")) is not None:
        actions = spark.createDataFrame([], NO_ACTIONS) if actions is None else actions
        return store_source(entities, predictions, actions, KEY)
    if output_root and files.artifacts_exist(spark, output_root):
        run = files.latest_run(spark, output_root)
        summary = files.read_summary(spark, f"{run}/reports/{files.SUMMARY}")
        name, version = files.recommended_model(summary)
        clean = files.read_artifact_clean(spark, f"{run}/datasets/reservations_clean")
        predictions = files.read_artifact_predictions(spark, f"{run}/predictions/predictions")
        return artifact_source(clean, predictions, name, version)
    return bootstrap_source(spark, entities, actions)
