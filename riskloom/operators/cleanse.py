"""Cleanse, type, label and rename raw reservation rows.

``normalize_reservations`` turns the all-string raw table into the canonical
clean table (one row per raw row, no shuffle: a single narrow projection).
``normalize_snapshot`` does the same for as-of-cutoff snapshot rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import config
from riskloom import functions as RF
from riskloom.config import Stage
from riskloom.functions.core import cleanse_text_sql, strip_sql, tolerant_number_sql
from riskloom.operators.contracts import require_columns


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def cleanse_strings(
    df: DataFrame, columns: Sequence[str] | None = None, tokens=config.NULL_TOKENS, numbers: Sequence[str] = ()
) -> DataFrame:
    """Strip every (or the given) string column and null out null tokens.

    ``numbers`` of them come back parsed; no null token is a number, so these are only
    stripped first.  Three projections, each over plain columns of the one below, so a
    column's source expression runs once however often its value is used.
    """
    targets = set(columns if columns is not None else string_columns(df))

    def each(value) -> list[str]:
        return [f"{value(c)} AS `{c}`" if c in targets or c in numbers else f"`{c}`" for c in df.columns]

    trimmed = df.selectExpr(*each(lambda c: f"trim(CAST(`{c}` AS STRING))" if c in targets else f"CAST(`{c}` AS STRING)"))
    stripped = trimmed.selectExpr(*each(lambda c: strip_sql(c) if c in targets else f"`{c}`"))
    return stripped.selectExpr(*each(lambda c: tolerant_number_sql(c) if c in numbers else cleanse_text_sql(c, tokens)))


def label_from_outcome(status: Column) -> Column:
    """1 for the positive status, 0 for the negative one, otherwise null."""
    return (
        F.when(status == config.LABEL_POSITIVE_STATUS, F.lit(1))
        .when(status == config.LABEL_NEGATIVE_STATUS, F.lit(0))
        .cast("bigint")
    )


def is_labelled(status: Column) -> Column:
    return F.coalesce(status.isin(config.LABEL_POSITIVE_STATUS, config.LABEL_NEGATIVE_STATUS), F.lit(False))


def normalize_reservations(raw: DataFrame, cfg: Stage | None = None) -> DataFrame:
    """Raw all-string rows -> typed, labelled canonical rows.

    Non-string pass-through columns (e.g. a stable ``reservation_id``) are kept.
    """
    cfg = cfg or config.stage()
    df = cleanse_strings(raw, numbers=config.RAW_NUMERIC_COLUMNS)
    status = F.col("ReservationStatus")
    excluded = ~is_labelled(status)
    month = RF.month_number("ArrivalDateMonth")
    keys = [F.col("reservation_id")] if "reservation_id" in raw.columns else []
    derived = [
        F.col("reservation_key").cast("string").alias("reservation_key"),
        F.col("source_file").cast("string").alias("source_file"),
        F.col("source_row_number").cast("bigint").alias("source_row_number"),
        RF.property_for_file("source_file").alias("property_id"),
        F.lit(cfg.name).alias("model_stage"),
        month.alias("arrival_month_number"),
        RF.date_from_parts("ArrivalDateYear", month, "ArrivalDateDayOfMonth").alias("arrival_date"),
        status.alias("reservation_status"),
        RF.parse_date("ReservationStatusDate").alias("reservation_status_date"),
        F.coalesce(F.col("IsCanceled"), F.lit(0.0)).cast("bigint").alias("is_canceled"),
        label_from_outcome(status).alias("no_show_flag"),
        excluded.alias("excluded_from_training"),
        F.when(status == config.CANCELED_STATUS, "canceled_status")
        .when(excluded, "unsupported_status")
        .alias("exclusion_reason"),
    ]
    renamed = [F.col(src).alias(dst) for src, dst in config.CANONICAL_NAMES.items()]
    return df.select(*keys, *derived, *renamed)


def normalize_snapshot(snapshot: DataFrame, cfg: Stage) -> DataFrame:
    """As-of-cutoff snapshot rows -> typed, labelled rows of one stage.

    Raises if required columns are missing (checked at plan time) or if the
    stage has no rows (one bounded ``isEmpty`` probe).
    """
    require_columns(snapshot, config.SNAPSHOT_REQUIRED_COLUMNS, f"Snapshot dataset for stage '{cfg.name}'")
    df = snapshot
    for c in config.SNAPSHOT_OPTIONAL_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    df = cleanse_strings(df, numbers=config.SNAPSHOT_NUMERIC_COLUMNS)
    # Spark reads a time-only string as "today"; require a leading calendar date.
    snap_at = F.when(F.col("snapshot_at").rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(F.col("snapshot_at")))
    active = RF.bool_token("is_active_at_snapshot")
    outcome = F.col("final_outcome")
    df = df.select(
        *[c for c in df.columns if c not in ("source_row_number", "arrival_date", "snapshot_at", "is_active_at_snapshot")],
        F.col("source_row_number").cast("bigint").alias("source_row_number"),
        RF.parse_date("arrival_date").alias("arrival_date"),
        snap_at.alias("snapshot_at"),
        F.year(_utc_wall_clock(snapshot.sparkSession, snap_at)).alias("snapshot_year"),
        active.alias("is_active_at_snapshot"),
        F.lit(cfg.name).alias("model_stage"),
    ).filter(F.col("snapshot_stage") == cfg.name)
    excluded = ~is_labelled(outcome) | ~F.col("is_active_at_snapshot")
    return df.select(
        "*",
        label_from_outcome(outcome).alias("no_show_flag"),
        excluded.alias("excluded_from_training"),
        F.when(outcome == config.CANCELED_STATUS, "canceled_before_or_after_snapshot")
        .when(~F.col("is_active_at_snapshot"), "inactive_at_snapshot")
        .alias("exclusion_reason"),
    )


def _utc_wall_clock(spark, ts: Column) -> Column:
    """Instant -> its UTC wall-clock, independent of the session time zone."""
    return F.to_utc_timestamp(ts, spark.conf.get("spark.sql.session.timeZone"))


def utc_ntz(spark, ts: Column) -> Column:
    """Instant -> timestamp without time zone holding the UTC wall-clock."""
    return _utc_wall_clock(spark, ts).cast("timestamp_ntz")


def require_stage_rows(df: DataFrame, cfg: Stage) -> DataFrame:
    """Fail when a stage filter left nothing (reads at most one row)."""
    if df.isEmpty():
        raise ValueError(f"Snapshot dataset does not contain rows for stage '{cfg.name}'.")
    return df
