"""Shared lazy frames for one (session, data folder): raw -> clean -> latest -> views.

Nothing here runs a job; each accessor returns a lazy DataFrame so every query
plan starts from the parquet scans and Catalyst prunes what it does not need.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from riskloom.config import stage
from riskloom.operators import cleanse, queue
from riskloom.operators.latest import latest_per_key
from riskloom.sources import adapter

ARTIFACT_MODEL = "logistic_regression"


@dataclass
class Frames:
    spark: SparkSession
    sf_dir: str
    _memo: dict = field(default_factory=dict)

    def _get(self, name, build):
        if name not in self._memo:
            self._memo[name] = build()
        return self._memo[name]

    def raw(self) -> DataFrame:
        return self._get("raw", lambda: adapter.raw_reservations(self.spark, self.sf_dir))

    def clean(self) -> DataFrame:
        return self._get("clean", lambda: cleanse.normalize_reservations(self.raw(), stage()))

    def predictions(self) -> DataFrame:
        """Prediction history keyed by entity id only (no natural-key join)."""
        return self._get("predictions", lambda: adapter.predictions(self.spark, self.sf_dir, with_keys=False))

    def keyed_predictions(self) -> DataFrame:
        """Prediction history with the entity's natural keys (for the artifact view and layers)."""
        return self._get("keyed_predictions", lambda: adapter.predictions(self.spark, self.sf_dir, with_keys=True))

    def latest(self) -> DataFrame:
        """Newest prediction per entity over all models."""
        return self._get(
            "latest", lambda: latest_per_key(self.predictions(), ["reservation_id"], adapter.PREDICTION_ORDER)
        )

    def model_latest(self, model_name: str = ARTIFACT_MODEL) -> DataFrame:
        """One model's scored rows: its newest prediction per entity."""
        return self._get(
            f"model_latest:{model_name}",
            # newest row per entity first, then the key join on one row per entity
            lambda: adapter.attach_entity_keys(
                self.spark,
                self.sf_dir,
                latest_per_key(
                    self.predictions().filter(f"model_name = '{model_name}'"), ["reservation_id"], adapter.PREDICTION_ORDER
                ),
            ),
        )

    def actions(self) -> DataFrame:
        return self._get("actions", lambda: adapter.action_log(self.spark, self.sf_dir))

    def store_rows(self) -> DataFrame:
        """Entities ⟕ latest prediction."""
        return self._get("store_rows", lambda: queue.with_latest(self.clean(), self.latest()))

    def view(self, model_name: str = ARTIFACT_MODEL, numbered: bool = False) -> DataFrame:
        """Artifact view: one model's rows right-joined onto entities (J3); dense ids (W2) on request."""
        return self._get(
            f"view:{model_name}:{numbered}",
            lambda: queue.entity_view(
                self.clean(), self.model_latest(model_name), model_name,
                join_on_id="reservation_id", numbered=numbered,
            ),
        )
