"""Work queue, entity view, detail and filter options.

The store path joins every entity with its latest prediction (left outer);
the artifact path right-joins one model's scored rows onto the entities and
numbers them densely.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ranking import global_rank, keys_below
from riskloom.session import stored

MAX_PAGE_SIZE = 200
DEFAULT_PAGE_SIZE = 50
PREDICTION_FIELDS = ("prediction_id", "model_name", "model_version", "score", "risk_class", "threshold_used", "scored_at")


def check_page_size(limit: int) -> int:
    if not 1 <= int(limit) <= MAX_PAGE_SIZE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE_SIZE}")
    return int(limit)


def with_latest(entities: DataFrame, latest: DataFrame, key: str = "reservation_id", how: str = "left") -> DataFrame:
    """Entities ⟕ latest prediction (J1), or ⋈ with ``how='inner'``."""
    cols = [key, *[c for c in PREDICTION_FIELDS if c in latest.columns]]
    return entities.join(latest.select(*cols), key, how)


def right_join_suffixed(
    left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_prediction", how: str = "right"
) -> DataFrame:
    """Join on ``keys``; overlapping non-key right columns get ``suffix`` (left wins)."""
    overlap = (set(left.columns) & set(right.columns)) - set(keys)
    renamed = right.select(*[F.col(c).alias(c + suffix) if c in overlap else F.col(c) for c in right.columns])
    return left.join(renamed, keys, how)


def entity_view(
    clean: DataFrame,
    model_predictions: DataFrame,
    model_name: str,
    model_version: str | None = None,
    keys=("reservation_key", "source_file", "source_row_number"),
    join_on_id: str | None = None,
    numbered: bool = True,
) -> DataFrame:
    """One model's scored rows joined onto the entities.

    The join is a right outer join on the natural ``keys``; overlapping right
    columns get a ``_prediction`` suffix.  When both sides carry a stable entity
    id that the natural keys determine one-to-one, ``join_on_id`` joins on that
    id alone.

    ``numbered`` adds the dense id 1..n in (source_file, source_row_number) order,
    which lays the rows' keys out once (whole rows without ``join_on_id``).  Reports do not need it, and a page numbers only
    its own rows (``numbered_page``).
    """
    keys = list(keys)
    order = [("source_row_number", True)]
    if join_on_id:
        if numbered:
            # Only the keys are laid out; the numbers meet their rows by the stable id.
            slim = model_predictions.select(join_on_id, "source_file", "source_row_number")
            ids = global_rank(slim, order, ["source_file"], "_dense", continuous=True).select(join_on_id, "_dense")
            model_predictions = model_predictions.join(ids, join_on_id)
        view = right_join_suffixed(clean.drop(*keys), model_predictions, [join_on_id]).drop(join_on_id)
        if numbered:
            view = view.withColumnRenamed("_dense", "reservation_id")
    else:
        view = right_join_suffixed(clean.drop("reservation_id"), model_predictions.drop("reservation_id"), keys)
        if numbered:
            view = global_rank(view, order, ["source_file"], "reservation_id", continuous=True)
    version = F.col("model_version")
    if model_version:
        version = F.coalesce(version, F.lit(model_version))
    return view.withColumns(
        {
            "risk_class": F.coalesce(F.col("risk_class"), F.lit("unscored")),
            "model_name": F.lit(model_name),
            "model_version": version,
        }
    )


def numbered_page(view: DataFrame, limit: int, where: Column | None = None) -> DataFrame:
    """The first ``limit`` rows of ``view`` (that meet ``where``) with their dense ids.

    A row's id is the number of view rows up to it in (source_file,
    source_row_number) order, a null file first.  The view is computed once and kept;
    one pass over its keys tells in which interval between page keys each row lies, and
    the interval counts are summed upward.  Page and counts are joined in Spark.
    """
    kept = stored(view)
    page = kept if where is None else kept.where(where)
    page = stored(page.orderBy(*artifact_order()).limit(check_page_size(limit)))
    key = F.struct("source_file", "source_row_number")
    # The keys of a page: one small value.
    keys = page.agg(F.array_sort(F.collect_list(key)).alias("keys")).scalar()
    below = lambda rows: rows.withColumn("_keys", keys).withColumn("_at", keys_below(key, F.col("_keys"), MAX_PAGE_SIZE))
    counts = below(kept.select("source_file", "source_row_number")).groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    upward = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)  # at most MAX_PAGE_SIZE + 1 rows
    ids = counts.select("_at", F.sum("_n").over(upward).cast("bigint").alias("reservation_id"))
    return below(page).drop("_keys").join(F.broadcast(ids), "_at").drop("_at")


def artifact_order(with_arrival: bool = True) -> list[Column]:
    """Score desc, arrival desc, then the dense id ascending, told by what it numbers."""
    arrival = [F.col("arrival_date").desc_nulls_last()] if with_arrival else []
    return [F.col("score").desc_nulls_last(), *arrival, F.col("source_file").asc(), F.col("source_row_number").asc()]


def filter_condition(
    property_id: str | None = None,
    distribution_channel: str | None = None,
    risk_class: str | None = None,
    date_from: dt.date | str | None = None,
    date_to: dt.date | str | None = None,
) -> Column | None:
    """Conjunctive optional filters (P44); only given arguments become predicates."""
    conds: list[Column] = []
    if property_id:
        conds.append(F.col("property_id") == property_id)
    if distribution_channel:
        conds.append(F.col("distribution_channel") == distribution_channel)
    if risk_class:
        conds.append(F.col("risk_class") == risk_class)
    if date_from:
        conds.append(F.col("arrival_date") >= F.lit(date_from).cast("date"))
    if date_to:
        conds.append(F.col("arrival_date") <= F.lit(date_to).cast("date"))
    out = None
    for c in conds:
        out = c if out is None else out & c
    return out


def apply_filters(df: DataFrame, **filters) -> DataFrame:
    """Rows that meet ``filter_condition``."""
    cond = filter_condition(**filters)
    return df if cond is None else df.where(cond)


def queue_order(id_ascending: bool = False, id_col: str = "reservation_id") -> list[Column]:
    """Score desc, arrival desc (nulls last), id desc (store) or asc (artifact)."""
    idc = F.col(id_col).asc() if id_ascending else F.col(id_col).desc()
    return [F.col("score").desc_nulls_last(), F.col("arrival_date").desc_nulls_last(), idc]


def queue_page(df: DataFrame, limit: int = DEFAULT_PAGE_SIZE, id_ascending: bool = False) -> DataFrame:
    """Top-``limit`` page (TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*queue_order(id_ascending)).limit(check_page_size(limit))


def risky_page(df: DataFrame, limit: int, classes: tuple[str, ...] | None, id_ascending: bool, with_arrival: bool) -> DataFrame:
    if classes:
        df = df.filter(F.col("risk_class").isin(list(classes)))
    idc = F.col("reservation_id").asc() if id_ascending else F.col("reservation_id").desc()
    order = [F.col("score").desc_nulls_last()]
    if with_arrival:
        order.append(F.col("arrival_date").desc_nulls_last())
    return df.orderBy(*order, idc).limit(limit)


def filter_options(df: DataFrame, sep: str = "|") -> DataFrame:
    """Sorted distinct properties and channels, arrival range (A24); one row.

    ``collect_set`` holds distinct dimension values only (bounded by the
    dimension's cardinality, not by the row count).
    """
    return df.agg(
        F.array_join(F.array_sort(F.collect_set("property_id")), sep).alias("property_ids"),
        F.array_join(F.array_sort(F.collect_set("distribution_channel")), sep).alias("distribution_channels"),
        F.lit("high|medium|low").alias("risk_classes"),
        F.min("arrival_date").alias("min_arrival_date"),
        F.max("arrival_date").alias("max_arrival_date"),
    )


def filter_option_rows(df: DataFrame) -> DataFrame:
    """(option, value) of every property and channel that rows have, one row each.

    The same choices as ``filter_options``, as rows: free text with very many values
    stays distributed.
    """
    both = df.select(
        F.explode(
            F.array(
                F.struct(F.lit("property_id").alias("option"), F.col("property_id").alias("value")),
                F.struct(F.lit("distribution_channel").alias("option"), F.col("distribution_channel").alias("value")),
            )
        ).alias("o")
    )
    return both.select("o.*").where("value is not null").distinct()


def entity_detail(rows: DataFrame, actions: DataFrame | None, reservation_id: int) -> DataFrame:
    """One entity with its latest prediction, context and ordered action ids."""
    one = rows.filter(F.col("reservation_id") == reservation_id)
    has_pred = F.col("model_name").isNotNull() | F.col("score").isNotNull()
    out = one.select(
        "reservation_id", "property_id", "source_file", "arrival_date",
        F.col("lead_time_days").cast("bigint").alias("lead_time_days"),
        "distribution_channel", "market_segment", "customer_type", "reserved_room_type", "deposit_type",
        (F.col("no_show_flag") == 1).alias("no_show_flag"),
        F.coalesce(F.col("excluded_from_training"), F.lit(False)).alias("excluded_from_training"),
        "exclusion_reason",
        has_pred.alias("has_latest_prediction"),
        "score", "risk_class", "model_name", "model_version", "scored_at",
        "meal_plan",
        (F.col("is_repeated_guest") == 1).alias("is_repeated_guest"),
        F.col("total_special_requests").cast("bigint").alias("total_special_requests"),
        F.col("required_car_parking_spaces").cast("bigint").alias("required_car_parking_spaces"),
    )
    if actions is None:
        return out.withColumns(
            {"action_count": F.lit(0).cast("bigint"), "last_action_id": F.lit(None).cast("bigint"),
             "last_acted_at": F.lit(None).cast("timestamp_ntz")}
        )
    # The action list itself is ``entity_actions`` (a distributed sort); the
    # detail row carries only bounded aggregates, so a hot entity with
    # millions of actions never becomes one in-memory list.
    acts = (
        actions.filter(F.col("reservation_id") == reservation_id)
        .groupBy("reservation_id")
        .agg(
            F.count(F.lit(1)).alias("action_count"),
            F.max_by("id", F.struct("acted_at", "id")).alias("last_action_id"),
            F.max("acted_at").alias("last_acted_at"),
        )
    )
    return out.join(acts, "reservation_id", "left").select(
        *out.columns,
        F.coalesce(F.col("action_count"), F.lit(0)).cast("bigint").alias("action_count"),
        "last_action_id",
        "last_acted_at",
    )


def entity_actions(actions: DataFrame, reservation_id: int, entities: DataFrame | None = None) -> DataFrame:
    """Actions of one entity, newest first.

    With ``entities`` an unknown id raises ``LookupError`` (a one-row probe of
    the pushed-down point lookup), mirroring the source's not-found answer.
    """
    if entities is not None and entities.filter(F.col("reservation_id") == reservation_id).isEmpty():
        raise LookupError(f"Reservation {reservation_id} not found")
    return actions.filter(F.col("reservation_id") == reservation_id).orderBy(
        F.col("acted_at").desc(), F.col("id").desc()
    )


def threshold_lookup(sweep: DataFrame, target: float, by: list[str] | None = None, tol: float = 1e-4) -> DataFrame:
    """Sweep row closest to ``target`` within ``tol``, else the first row."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(
        (F.abs(F.col("threshold") - target) < tol).desc(), F.col("threshold").asc()
    )
    return sweep.withColumn("_pick", F.row_number().over(w)).filter("_pick = 1").drop("_pick")

