"""Action log: validation, creation, updates as appended versions, as-of prediction attach.

The log is append-only (plain Parquet has no MERGE).  Updates are appended
as versions; the current state is the latest version per action id with
"only non-null fields overwrite" semantics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import config
from riskloom.operators import ranking


def rejection_reason(
    status: str = "action_status", action_type: str = "action_type", actor: str = "acted_by", note: str = "action_note"
) -> Column:
    """First failed rule of an action request, null when valid."""
    return (
        F.when(F.col(status).isNull() | ~F.col(status).isin(list(config.ACTION_STATUSES)), "invalid_status")
        .when(F.col(action_type).isNull() | ~F.length(action_type).between(2, 64), "invalid_action_type")
        .when(F.col(actor).isNull() | ~F.length(actor).between(2, 128), "invalid_acted_by")
        .when(F.col(note).isNotNull() & (F.length(note) > 500), "note_too_long")
    )


def validate(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests into (valid, quarantined-with-reason)."""
    tagged = requests.withColumn("rejection_reason", rejection_reason())
    return (
        tagged.filter(F.col("rejection_reason").isNull()).drop("rejection_reason"),
        tagged.filter(F.col("rejection_reason").isNotNull()),
    )


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    value: str,
    right_ties: Sequence[str] = (),
    out: str = "asof_value",
) -> DataFrame:
    """For each left row, ``value`` of the newest right row with the same key and
    ``right_time <= left_time`` (J8).  Ties at equal time: highest ``right_ties``.

    Both sides are laid out together by (key, time, side, ties) over range
    partitions, so a key with most of the rows, even all in one month, spans many
    tasks.  Inside a partition the last right value runs on; over partitions it is
    carried by one row for each partition and key.  No pairs are formed, and a null key
    has no partner.
    """
    ties = [f"_tie{i}" for i in range(len(right_ties))]
    cols = list(left.columns)
    rows = left.select(
        *cols, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v")
    ).unionByName(
        right.select(
            F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"),
            *[F.col(c).alias(n) for c, n in zip(right_ties, ties, strict=True)],
        ),
        allowMissingColumns=True,
    )
    # Right rows stand before left rows of the same time.
    parts = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = ranking.laid_out(rows, [("_t", True), ("_side", True), *[(c, True) for c in ties]], [key], parts)
    held = F.when(F.col("_side") == 0, F.struct("_v"))  # a struct, so that a null value is a value too
    local = Window.partitionBy("_rk_part", key).orderBy("_rk_place").rowsBetween(Window.unboundedPreceding, 0)
    laid = laid.withColumn("_in", F.last(held, ignorenulls=True).over(local))
    cells = laid.groupBy("_rk_part", key).agg(F.max_by("_in", F.when(F.col("_in").isNotNull(), F.col("_rk_place"))).alias("_last"))
    carry = Window.partitionBy(key).orderBy("_rk_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_rk_part", key, F.last("_last", ignorenulls=True).over(carry).alias("_before"))
    both = ranking.with_cells(laid.where("_side = 1"), cells, [key])
    found = F.when(F.col(key).isNotNull(), F.coalesce("_in", "_before")["_v"])
    return both.select(*cols, found.alias(out))


def create_actions(
    requests: DataFrame,
    entities: DataFrame,
    predictions: DataFrame,
    prediction_ties: Sequence[str] = (),
    key: str = "reservation_id",
) -> tuple[DataFrame, DataFrame]:
    """Accept action requests (D1): known entity, valid fields, default status
    ``open``, prediction attached as of request time.  Returns (accepted, rejected).
    """
    req = requests.withColumn("action_status", F.coalesce(F.col("action_status"), F.lit("open")))
    valid, rejected = validate(req)
    ids = entities.select(key).distinct().withColumn("_known", F.lit(True))
    told = valid.join(ids, key, "left")  # one join tells both sides
    known = told.where("_known").drop("_known")
    unknown = told.where("_known is null").drop("_known").withColumn("rejection_reason", F.lit("unknown_entity"))
    attached = asof_latest(
        known.drop("prediction_id"), predictions, key, "acted_at", "scored_at", "prediction_id",
        right_ties=prediction_ties, out="prediction_id",
    )
    return attached, rejected.unionByName(unknown)


def apply_updates(actions: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current action state after appended updates (D2) and the rejected updates.

    Per action, the newest non-null status and the newest non-null note win;
    updates to unknown ids are rejected.
    """
    known = updates.join(actions.select("id"), "id", "left_semi")
    unknown = updates.join(actions.select("id"), "id", "left_anti").withColumn(
        "rejection_reason", F.lit("unknown_action")
    )
    order = F.struct("updated_at", "update_id")
    latest = known.groupBy("id").agg(
        F.max_by("action_status", F.when(F.col("action_status").isNotNull(), order)).alias("_new_status"),
        F.max_by("action_note", F.when(F.col("action_note").isNotNull(), order)).alias("_new_note"),
        F.count(F.lit(1)).alias("version_count"),
        F.max("updated_at").alias("last_updated_at"),
    )
    state = actions.join(latest, "id", "left").select(
        *[c for c in actions.columns if c not in ("action_status", "action_note")],
        F.coalesce("_new_status", "action_status").alias("action_status"),
        F.coalesce("_new_note", "action_note").alias("action_note"),
        F.coalesce("version_count", F.lit(0)).cast("bigint").alias("update_count"),
        "last_updated_at",
    )
    return state, unknown
