"""Persisted layers: import batch, raw payload, clean, features, predictions.

Each layer is an append-only table keyed by the natural key
``(source_file, source_row_number)``; JSON payload columns keep every source
field (nulls included) for lineage.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NATURAL_KEY = ("source_file", "source_row_number")
PREDICTION_META = (
    "model_stage", "snapshot_stage", "snapshot_at", "days_since_booking", "days_to_arrival", "split_name",
    "feature_set_version", "actual_no_show_flag", "reservation_key",
)


# Every field is kept, nulls and microseconds included.
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _json(cols) -> F.Column:
    return F.to_json(F.struct(*cols), JSON_OPTIONS)


def typed_payload(rows: DataFrame, payload: str, fields: T.StructType) -> DataFrame:
    """``rows`` with the JSON ``payload`` replaced by columns of the given names and types.

    The text is parsed once into a VARIANT and each field taken from it.  A field that
    is absent or JSON null, or whose value is not of its type, is null; so are all fields
    of a payload that is null or not JSON.  A name cannot hold both kinds of quotes.
    """
    rest = [c for c in rows.columns if c != payload]
    parsed = rows.withColumn("_variant", F.try_parse_json(payload))
    path = lambda name: f'$["{name}"]' if "'" in name else f"$['{name}']"
    taken = [F.try_variant_get("_variant", path(f.name), f.dataType.simpleString()).alias(f.name) for f in fields]
    return parsed.select(*rest, *taken)


def import_batch(raw: DataFrame, source_name: str, feature_set_version: str, errors: DataFrame | None = None) -> DataFrame:
    """One batch row: sorted distinct source files, row and error counts.

    Files count by rows and errors alike.  Rows are first combined to one per file, so
    the list holds file names only; an import has as many as it reads files.
    """
    records = raw.select("source_file", F.lit(1).alias("ok"))
    if errors is not None:
        records = records.unionByName(errors.select("source_file", F.lit(0).alias("ok")))
    files = records.groupBy("source_file").agg(F.sum("ok").alias("rows"), F.sum(1 - F.col("ok")).alias("errors"))
    return files.agg(
        F.lit(source_name).alias("source_name"),
        F.array_join(F.array_sort(F.collect_list("source_file")), ",").alias("source_files"),
        F.lit("completed").alias("status"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce(F.sum("errors"), F.lit(0)).cast("bigint").alias("error_count"),
        F.lit(feature_set_version).alias("feature_set_version"),
    )


def error_layer(errors: DataFrame) -> DataFrame:
    """Malformed records in quarantine: key, payload, code and message."""
    return errors.select(*NATURAL_KEY, _json(["raw_record"]).alias("raw_payload"), "error_code", "error_message")


def raw_layer(raw: DataFrame) -> DataFrame:
    """Raw rows with a JSON payload of all source columns."""
    source_cols = [c for c in raw.columns if c not in (*NATURAL_KEY, "reservation_key", "reservation_id")]
    return raw.select(
        *NATURAL_KEY,
        F.col("source_file").alias("property_code"),
        _json(source_cols).alias("raw_payload"),
        F.col("ReservationStatus").alias("reservation_status"),
        F.try_to_date(F.col("ReservationStatusDate"), "yyyy-MM-dd").alias("reservation_status_date"),
    )


def feature_layer(features: DataFrame) -> DataFrame:
    """Feature rows with a JSON payload of all but the keys and version."""
    skip = {*NATURAL_KEY, "reservation_key", "feature_set_version", "reservation_id"}
    return features.select(
        *NATURAL_KEY, "feature_set_version", _json([c for c in features.columns if c not in skip]).alias("feature_payload")
    )


def prediction_layer(frames: Mapping[str, DataFrame], attach_keys=None) -> DataFrame:
    """Union of every model's prediction rows with a metadata JSON.

    ``attach_keys`` (DataFrame -> DataFrame) adds the natural keys once, after
    the union, when the per-model frames carry only the entity id: one key
    join for all models instead of one per model.
    """
    union = None
    for df in frames.values():
        union = df if union is None else union.unionByName(df, allowMissingColumns=True)
    if attach_keys is not None:
        union = attach_keys(union)
    meta = [F.col(c) if c in union.columns else F.lit(None).alias(c) for c in PREDICTION_META]
    return union.select(
        "prediction_id", *NATURAL_KEY, "model_name", "model_version", "score", "risk_class", "threshold_used",
        "scoring_run_id", "scored_at", _json(meta).alias("metadata_payload"),
    )


def clean_layer(clean: DataFrame, raw: DataFrame) -> DataFrame:
    """Clean rows with the key of their raw row; a row without one is an error."""
    require_resolved(clean, raw, "clean rows")
    return clean.withColumn("raw_key", F.concat_ws(":", *NATURAL_KEY))


LAYERS = ("import_batches", "reservations_raw", "reservations_clean", "reservation_features", "predictions")
ERRORS = "import_errors"
NO_ERRORS = "source_file string, source_row_number bigint, raw_record string, error_code string, error_message string"


def append_run(
    spark, store: str, raw: DataFrame, clean: DataFrame, features: DataFrame, predictions: Mapping[str, DataFrame],
    feature_set_version: str, run_id: str, source_name: str = "source_files", errors: DataFrame | None = None,
) -> dict[str, int]:
    """Append a run's rows to the layers under ``store`` (S15-S20); rows by layer.

    Each layer is a Parquet folder partitioned by run, so a rerun of the same run
    replaces its own rows and no others.  The counts come from the footers of the
    run's own files: no column is read back.  ``errors`` are the run's malformed
    records, kept in a quarantine layer beside the others.
    """
    for rows, what in ((features, "feature rows"), *((p, f"{n} predictions") for n, p in predictions.items())):
        require_resolved(rows, clean, what)
    errors = spark.createDataFrame([], NO_ERRORS) if errors is None else errors
    frames = {
        "import_batches": import_batch(raw, source_name, feature_set_version, errors),
        "reservations_raw": raw_layer(raw),
        "reservations_clean": clean_layer(clean, raw),
        "reservation_features": feature_layer(features),
        "predictions": prediction_layer(predictions),
        ERRORS: error_layer(errors),
    }
    counts = {}
    for name, df in frames.items():
        path = f"{store.rstrip('/')}/{name}"
        kept = df.drop("scoring_run_id").withColumn("run_id", F.lit(run_id))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
        counts[name] = spark.read.schema(kept.schema).parquet(path).where(F.col("run_id") == run_id).count()
    # A dynamic overwrite without rows leaves what a former run of this name wrote.
    if errors.isEmpty() and counts[ERRORS]:
        drop_run(spark, store, ERRORS, run_id)
        counts[ERRORS] = 0
    return counts


def drop_run(spark, store: str, name: str, run_id: str) -> None:
    """Remove a run's rows from a layer."""
    jvm = spark.sparkContext._jvm
    part = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)
    path = jvm.org.apache.hadoop.fs.Path(f"{store.rstrip('/')}/{name}/run_id={part}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_layer(spark, store: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{store.rstrip('/')}/{name}")


def layer_counts(layers: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per layer (S20) in long form."""
    parts = [df.agg(F.lit(name).alias("layer"), F.count(F.lit(1)).cast("bigint").alias("row_count")) for name, df in layers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolve_keys(child: DataFrame, parent: DataFrame, name: str) -> DataFrame:
    """Natural-key resolution child -> parent (J4, J5): resolved / unresolved counts."""
    keys = parent.select(*NATURAL_KEY).distinct().withColumn("_hit", F.lit(True))
    joined = child.select(*NATURAL_KEY).join(keys, list(NATURAL_KEY), "left")
    return joined.agg(
        F.lit(name).alias("relation"),
        F.count(F.lit(1)).cast("bigint").alias("child_rows"),
        F.count_if(F.col("_hit").isNotNull()).cast("bigint").alias("resolved_rows"),
        F.count_if(F.col("_hit").isNull()).cast("bigint").alias("unresolved_rows"),
    )


def require_resolved(child: DataFrame, parent: DataFrame, name: str) -> DataFrame:
    """Mandatory key lookup (J5): raise if any child key has no parent row.

    The check is an anti join probed for one row; the child is returned unchanged.
    """
    missing = child.select(*NATURAL_KEY).join(parent.select(*NATURAL_KEY), list(NATURAL_KEY), "left_anti")
    first = missing.limit(1).collect()
    if first:
        raise KeyError(f"{name}: key {tuple(first[0])} has no parent row")
    return child


def duplicate_keys(df: DataFrame, keys, name: str) -> DataFrame:
    """Number of key values that occur more than once (uniqueness check, §1.4)."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return dup.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).cast("bigint").alias("duplicate_keys"))


def latest_run(predictions: DataFrame, run_col: str = "scoring_run_id") -> DataFrame:
    """Rows of the newest run only (S9): a one-row max joined back (broadcast scalar)."""
    newest = predictions.agg(F.max(run_col).alias(run_col))
    return predictions.join(F.broadcast(newest), run_col, "left_semi")


def source_resolution(predictions: DataFrame, artifacts_present: bool = True) -> DataFrame:
    """Which source serves reports (S21, S22): store if it has rows, else artifacts, else bootstrap."""
    has_rows = F.count(F.lit(1)) > 0
    return predictions.agg(
        F.when(has_rows, "database_prediction_store")
        .otherwise("artifact_fallback" if artifacts_present else "database_bootstrap")
        .alias("data_source"),
        has_rows.alias("action_support_enabled"),
        F.count(F.lit(1)).cast("bigint").alias("prediction_rows"),
    )
