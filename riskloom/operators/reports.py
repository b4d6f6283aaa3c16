"""Operational reports: KPI rows, operations summary, trends, breakdowns, action coverage.

Every report is one hash aggregation (partial on the map side, so only group
states cross the shuffle).  One-row reports that combine several inputs are
assembled by ``unionByName`` + a final global aggregate rather than joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config
from riskloom import functions as RF

DIMENSIONS = ("distribution_channel", "market_segment", "property_id")


def _bigint(c: Column) -> Column:
    return c.cast("bigint")


def is_canceled_store(flag: str = "is_canceled", status: str = "reservation_status") -> Column:
    """Flag set OR status equals 'canceled' in any case (P52); nulls are false."""
    return F.coalesce(F.col(flag) == 1, F.lit(False)) | F.coalesce(F.lower(F.col(status)) == "canceled", F.lit(False))


def is_canceled_artifact(status: str = "reservation_status") -> Column:
    return F.coalesce(F.col(status) == config.CANCELED_STATUS, F.lit(False))


def _is_no_show() -> Column:
    return F.coalesce(F.col("no_show_flag") == 1, F.lit(False))


def one_row(parts: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Merge one-row partial results that each fill some of ``columns``."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in columns])


def action_status_counts(actions: DataFrame) -> DataFrame:
    return actions.agg(
        _bigint(F.count_if(F.col("action_status") == "open")).alias("action_pending_count"),
        _bigint(F.count_if(F.col("action_status") == "completed")).alias("action_completed_count"),
        _bigint(F.count_if(F.col("action_status") == "follow_up")).alias("action_follow_up_count"),
    )


KPI_COLUMNS = (
    "total_reservations", "high_risk_reservations", "medium_risk_reservations", "latest_scored_at",
    "action_pending_count", "action_completed_count", "action_follow_up_count",
)


def kpis(entities: DataFrame, latest: DataFrame, predictions: DataFrame, actions: DataFrame) -> DataFrame:
    """Store KPI row (A1, A25): entity count, risk mix of latest scores, newest score time, action states."""
    parts = [
        entities.agg(_bigint(F.count(F.lit(1))).alias("total_reservations")),
        latest.agg(
            _bigint(F.count_if(F.col("risk_class") == "high")).alias("high_risk_reservations"),
            _bigint(F.count_if(F.col("risk_class") == "medium")).alias("medium_risk_reservations"),
        ),
        predictions.agg(F.max("scored_at").alias("latest_scored_at")),
        action_status_counts(actions),
    ]
    return one_row(parts, KPI_COLUMNS)


def kpis_artifact(view: DataFrame, model_name: str, model_version: str | None) -> DataFrame:
    """Artifact KPI row (A2): over one model's scored view, actions unavailable."""
    return view.agg(
        _bigint(F.count(F.lit(1))).alias("total_reservations"),
        _bigint(F.count_if(F.col("risk_class") == "high")).alias("high_risk_reservations"),
        _bigint(F.count_if(F.col("risk_class") == "medium")).alias("medium_risk_reservations"),
        F.max("scored_at").alias("latest_scored_at"),
        F.lit(model_name).alias("active_model_name"),
        F.lit(model_version).cast("string").alias("active_model_version"),
    )


SUMMARY_COLUMNS = (
    "total_reservations", "scored_reservations", "no_show_count", "canceled_count", "no_show_rate",
    "cancellation_rate", "high_risk_reservations", "action_pending_count", "action_completed_count",
    "action_follow_up_count",
)


def operations_summary(rows: DataFrame, actions: DataFrame | None = None, store_rules: bool = True) -> DataFrame:
    """Operations summary (A7 store / A8 artifact).

    ``store_rules``: canceled = flag or case-insensitive status, over all
    entities; otherwise exact status over the scored view, and action counts
    are zero because no action log exists there.
    """
    canceled = is_canceled_store() if store_rules else is_canceled_artifact()
    base = rows.agg(
        _bigint(F.count(F.lit(1))).alias("total_reservations"),
        _bigint(F.count_if(F.col("score").isNotNull())).alias("scored_reservations"),
        _bigint(F.count_if(_is_no_show())).alias("no_show_count"),
        _bigint(F.count_if(canceled)).alias("canceled_count"),
        _bigint(F.count_if(F.col("risk_class") == "high")).alias("high_risk_reservations"),
    )
    if actions is not None:
        base = one_row([base, action_status_counts(actions)], [c for c in SUMMARY_COLUMNS if "rate" not in c])
    else:
        base = base.withColumns(
            {c: F.lit(0).cast("bigint") for c in ("action_pending_count", "action_completed_count", "action_follow_up_count")}
        )
    out = base.withColumns(
        {
            "no_show_rate": RF.safe_rate("no_show_count", "total_reservations"),
            "cancellation_rate": RF.safe_rate("canceled_count", "total_reservations"),
        }
    ).select(*SUMMARY_COLUMNS)
    if not store_rules:
        out = out.withColumn(
            "note", F.lit(config.SUMMARY_NOTES[config.ARTIFACT_SOURCE])
        )
    return out


def trends(rows: DataFrame, store_rules: bool = True) -> DataFrame:
    """Monthly trend (A9/A10): period 'yyyy-MM', null date -> 'unknown'; ordered by period."""
    canceled = is_canceled_store() if store_rules else is_canceled_artifact()
    period = F.coalesce(F.date_format("arrival_date", "yyyy-MM"), F.lit("unknown"))
    return (
        rows.groupBy(period.alias("period"))
        .agg(
            _bigint(F.count(F.lit(1))).alias("total_reservations"),
            _bigint(F.count_if(_is_no_show())).alias("no_show_count"),
            _bigint(F.count_if(canceled)).alias("canceled_count"),
        )
        .withColumns(
            {
                "no_show_rate": RF.safe_rate("no_show_count", "total_reservations"),
                "cancellation_rate": RF.safe_rate("canceled_count", "total_reservations"),
            }
        )
        .orderBy("period")
    )


def dimension_breakdown(rows: DataFrame, dimension: str, store_rules: bool = True, decimals: int = 9) -> DataFrame:
    """Counts, rates and mean score per dimension value (A11-A13); total desc, value asc.

    Store rules strip the value; the artifact variant does not.  The mean is
    rounded to ``decimals`` so it does not depend on summation order.
    """
    if dimension not in DIMENSIONS:
        raise ValueError(f"Unsupported dimension: {dimension}")
    canceled = is_canceled_store() if store_rules else is_canceled_artifact()
    key = RF.dimension_key(dimension, trim=store_rules)
    return (
        rows.groupBy(key.alias("dimension_value"))
        .agg(
            _bigint(F.count(F.lit(1))).alias("total_reservations"),
            _bigint(F.count_if(F.col("score").isNotNull())).alias("scored_reservations"),
            _bigint(F.count_if(F.col("risk_class") == "high")).alias("high_risk_reservations"),
            _bigint(F.count_if(_is_no_show())).alias("no_show_count"),
            _bigint(F.count_if(canceled)).alias("canceled_count"),
            F.round(F.avg("score"), decimals).alias("average_score"),
        )
        .withColumns(
            {
                "no_show_rate": RF.safe_rate("no_show_count", "total_reservations"),
                "cancellation_rate": RF.safe_rate("canceled_count", "total_reservations"),
            }
        )
        .orderBy(F.col("total_reservations").desc(), F.col("dimension_value").asc())
    )


EFFECTIVENESS_COLUMNS = (
    "total_actions", "open_actions", "completed_actions", "follow_up_actions",
    "high_risk_with_action_count", "high_risk_without_action_count",
)


def action_effectiveness(rows: DataFrame, actions: DataFrame | None) -> DataFrame:
    """Action coverage of high-risk entities (J6, J7, A27-A29); one row.

    High-risk ids are split by a left join against the distinct acted-on ids
    (semi and anti join in one pass); with no action log all are uncovered.
    """
    high = rows.filter(F.col("risk_class") == "high").select("reservation_id").distinct()
    if actions is None:
        cov = high.agg(
            F.lit(0).cast("bigint").alias("high_risk_with_action_count"),
            _bigint(F.count(F.lit(1))).alias("high_risk_without_action_count"),
        )
        totals = cov.withColumns({c: F.lit(0).cast("bigint") for c in EFFECTIVENESS_COLUMNS[:4]})
        return totals.select(*EFFECTIVENESS_COLUMNS).withColumn(
            "note", F.lit(config.ACTION_NOTES[config.ARTIFACT_SOURCE])
        )
    acted = actions.select("reservation_id").distinct().withColumn("_acted", F.lit(True))
    flagged = high.join(acted, "reservation_id", "left")
    cov = flagged.agg(
        _bigint(F.count_if(F.col("_acted").isNotNull())).alias("high_risk_with_action_count"),
        _bigint(F.count_if(F.col("_acted").isNull())).alias("high_risk_without_action_count"),
    )
    tot = actions.agg(
        _bigint(F.count(F.lit(1))).alias("total_actions"),
        _bigint(F.count_if(F.col("action_status") == "open")).alias("open_actions"),
        _bigint(F.count_if(F.col("action_status") == "completed")).alias("completed_actions"),
        _bigint(F.count_if(F.col("action_status") == "follow_up")).alias("follow_up_actions"),
    )
    return one_row([tot, cov], EFFECTIVENESS_COLUMNS)


def action_breakdown(actions: DataFrame, by: str) -> DataFrame:
    """(label, count) by action status or type; count desc, label asc."""
    return (
        actions.groupBy(F.col(by).alias("label"))
        .agg(_bigint(F.count(F.lit(1))).alias("count"))
        .orderBy(F.col("count").desc(), F.col("label").asc())
    )


def action_counts_per_entity(actions: DataFrame) -> DataFrame:
    """Per-entity action status counts."""
    return actions.groupBy("reservation_id").agg(
        _bigint(F.count(F.lit(1))).alias("action_count"),
        _bigint(F.count_if(F.col("action_status") == "open")).alias("open_count"),
        _bigint(F.count_if(F.col("action_status") == "completed")).alias("completed_count"),
        _bigint(F.count_if(F.col("action_status") == "follow_up")).alias("follow_up_count"),
    )


BOOTSTRAP_MODELS = ("logistic_regression", "gbt")


def split_text(train_years, test_years) -> str:
    def span(years) -> str:
        return str(min(years)) if len(set(years)) == 1 else f"{min(years)}-{max(years)}"

    return config.SPLIT_NOTE % (span(train_years), span(test_years))


def bootstrap_benchmark(spark, train_years=config.TRAIN_YEARS, test_years=config.TEST_YEARS) -> DataFrame:
    """Benchmark rows before any model was evaluated (R5), with the columns of evaluated ones:
    planned models, metrics pending (null), none recommended."""
    schema = (
        "model_name string, status string, notes string, pr_auc double, roc_auc double, precision double, "
        "recall double, f1 double, brier_score double, is_recommended boolean, split_strategy string"
    )
    text = split_text(train_years, test_years)
    rows = [(m, "planned", "No evaluated predictions yet.", *[None] * 6, False, text) for m in BOOTSTRAP_MODELS]
    return spark.createDataFrame(rows, schema)
