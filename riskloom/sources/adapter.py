"""Adapter from the driver's TPC-H-like tables onto the entity schemas.

The engine's real inputs are an all-string reservation file set, a prediction
history and an action log.  This module derives all three from
``orders ⋈ customer ⋈ nation`` (+ per-order ``lineitem`` aggregates),
``lineitem`` and ``events`` so every query's work grows with the tables.

Noise is injected deterministically from the keys (padded blanks, null tokens,
unparseable numbers, invalid calendar days, null statuses, an unknown source
file) so the cleansing operators see the cases they exist for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions import risk_class


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _s(c: Column) -> Column:
    return c.cast("string")


def order_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its customer, nation and source-file keys."""
    orders = read_table(
        spark, sf_dir, "orders",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    )
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    # nation is a fixed 25-row dimension: a broadcast of proven size.
    nation = F.broadcast(read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"]))
    cust = customer.join(nation, customer.c_nationkey == nation.n_nationkey).drop("c_nationkey", "n_nationkey")
    df = orders.join(cust, orders.o_custkey == cust.c_custkey).drop("c_custkey")
    source_file = (
        F.when(F.col("n_regionkey") <= 1, "H1.csv").when(F.col("n_regionkey") <= 3, "H2.csv").otherwise("H3.csv")
    )
    row_number = F.col("o_orderkey") + 1
    return df.select(
        "*",
        F.col("o_orderkey").alias("reservation_id"),
        source_file.alias("source_file"),
        row_number.alias("source_row_number"),
        F.concat(source_file, F.lit(":"), _s(row_number)).alias("reservation_key"),
    )


def _line_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_shipdate", "l_returnflag", "l_linestatus"])
    return lines.groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("first_ship"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.count_if(F.col("l_returnflag") != "R").alias("n_kept"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_open"),
        F.count_if(F.col("l_linestatus") == "F").alias("n_filled"),
    )


RAW_COLUMNS = (
    "IsCanceled", "LeadTime", "ArrivalDateYear", "ArrivalDateMonth", "ArrivalDateWeekNumber",
    "ArrivalDateDayOfMonth", "StaysInWeekendNights", "StaysInWeekNights", "Adults", "Children", "Babies",
    "Meal", "Country", "MarketSegment", "DistributionChannel", "IsRepeatedGuest", "PreviousCancellations",
    "PreviousBookingsNotCanceled", "ReservedRoomType", "AssignedRoomType", "BookingChanges", "DepositType",
    "Agent", "Company", "DaysInWaitingList", "CustomerType", "ADR", "RequiredCarParkingSpaces",
    "TotalOfSpecialRequests", "ReservationStatus", "ReservationStatusDate",
)


# Raw column -> Spark SQL expression over orders ⋈ customer ⋈ nation ⟕ line aggregates.
# Written as SQL text so each column is one JVM parse instead of dozens of
# py4j round trips.
_RAW_SQL = {
    "IsCanceled": "CASE WHEN o_orderkey % 89 = 0 THEN ' NULL' WHEN o_orderstatus = 'P' THEN '1' ELSE '0' END",
    "LeadTime": "CASE WHEN first_ship IS NULL THEN '       NULL' WHEN o_orderkey % 151 = 0 THEN concat('-', CAST(_lead AS STRING))"
    " ELSE CAST(_lead AS STRING) END",
    "ArrivalDateYear": "CAST(year(o_orderdate) AS STRING)",
    "ArrivalDateMonth": "CASE WHEN o_orderkey % 101 = 0 THEN lower(_month) ELSE _month END",
    "ArrivalDateWeekNumber": "CAST(weekofyear(o_orderdate) AS STRING)",
    "ArrivalDateDayOfMonth": "CASE WHEN o_orderkey % 211 = 0 THEN '31' ELSE CAST(dayofmonth(o_orderdate) AS STRING) END",
    "StaysInWeekendNights": "CASE WHEN first_ship IS NOT NULL THEN CAST(n_returned AS STRING) ELSE '' END",
    "StaysInWeekNights": "CASE WHEN first_ship IS NOT NULL THEN CAST(n_kept AS STRING) ELSE 'NaN' END",
    "Adults": "CASE WHEN first_ship IS NOT NULL THEN CAST(n_open AS STRING) ELSE '' END",
    "Children": "CASE WHEN o_orderkey % 13 = 0 THEN 'NA' WHEN first_ship IS NOT NULL THEN CAST(n_filled AS STRING) ELSE 'None' END",
    "Babies": "'0'",
    "Meal": "CASE o_custkey % 4 WHEN 0 THEN 'BB       ' WHEN 1 THEN 'HB' WHEN 2 THEN 'SC' ELSE 'Undefined' END",
    "Country": "n_name",
    "MarketSegment": "c_mktsegment",
    "DistributionChannel": "CASE WHEN o_orderkey % 53 = 0 THEN 'NULL'"
    " WHEN o_orderkey % 3 = 0 THEN concat('  ', o_orderpriority, ' \\t') ELSE o_orderpriority END",
    "IsRepeatedGuest": "CAST(o_custkey % 2 AS STRING)",
    "PreviousCancellations": "CAST(o_custkey % 4 AS STRING)",
    "PreviousBookingsNotCanceled": "CAST(o_custkey % 3 AS STRING)",
    "ReservedRoomType": "substring(c_mktsegment, 1, 1)",
    "AssignedRoomType": "substring(n_name, 1, 1)",
    "BookingChanges": "CAST(o_custkey % 5 AS STRING)",
    "DepositType": "CASE WHEN o_totalprice > 300000 THEN 'Non Refund' ELSE 'No Deposit' END",
    "Agent": "CASE WHEN o_custkey % 5 = 0 THEN 'NULL' ELSE CAST(o_custkey AS STRING) END",
    "Company": "CASE WHEN o_custkey % 7 = 0 THEN CAST(o_custkey AS STRING) ELSE 'NULL' END",
    "DaysInWaitingList": "CAST(o_orderkey % 3 AS STRING)",
    "CustomerType": "CASE o_custkey % 3 WHEN 0 THEN 'Transient' WHEN 1 THEN 'Contract' ELSE 'Group' END",
    "ADR": "CAST(o_totalprice AS STRING)",
    "RequiredCarParkingSpaces": "CASE WHEN o_orderkey % 10 = 0 THEN '1' ELSE '0' END",
    "TotalOfSpecialRequests": "CASE WHEN o_orderkey % 17 = 0 THEN '1.5d' ELSE CAST(o_orderkey % 4 AS STRING) END",
    "ReservationStatus": "CASE WHEN o_orderkey % 97 = 0 THEN '   ' WHEN o_orderstatus = 'F' THEN 'Check-Out'"
    " WHEN o_orderstatus = 'O' THEN 'No-Show' WHEN o_orderkey % 199 = 0 THEN 'canceled' ELSE 'Canceled' END",
    "ReservationStatusDate": "CASE WHEN first_ship IS NOT NULL THEN date_format(first_ship, 'yyyy-MM-dd') ELSE '' END",
}


def _reservation_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The columns cost far more than reading them: rows are dealt by key to all shuffle partitions,
    # as a small file, or a join that turns out small, would leave them to a few tasks.
    ent = order_entities(spark, sf_dir)
    ent = ent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    agg = _line_aggregates(spark, sf_dir)
    df = ent.join(agg, ent.o_orderkey == agg.l_orderkey, "left").selectExpr(
        "*",
        "abs(datediff(to_date(first_ship), to_date(o_orderdate))) % 500 AS _lead",
        "date_format(o_orderdate, 'MMMM') AS _month",
    )
    return df.selectExpr(
        *[f"{_RAW_SQL[c]} AS {c}" for c in RAW_COLUMNS],
        "source_file", "source_row_number", "reservation_key", "reservation_id",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS arrival_text",
    )


def raw_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string raw reservations (+ ``source_row_number`` bigint, stable ``reservation_id``)."""
    return _reservation_base(spark, sf_dir).drop("arrival_text")


def raw_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, value): the raw rows as CSV lines with all fields quoted.

    Every 61st order has a field too many, every 67th lacks its last two (one that is both
    has too many).
    """
    fields = [f"concat('\"', replace({c}, '\"', '\"\"'), '\"')" for c in RAW_COLUMNS]
    whole, cut = f"concat_ws(',', {', '.join(fields)})", f"concat_ws(',', {', '.join(fields[:-2])})"
    return raw_reservations(spark, sf_dir).selectExpr(
        "source_file",
        f"CASE WHEN reservation_id % 61 = 0 THEN concat({whole}, ',\"more, than asked\"')"
        f" WHEN reservation_id % 67 = 0 THEN {cut} ELSE {whole} END AS value",
    )


def predictions(spark: SparkSession, sf_dir: str, with_keys: bool = True) -> DataFrame:
    """Prediction history: one scored row per line item (two models by line status).

    ``with_keys`` attaches the entity's natural keys and arrival date (a join
    with the order entities).  Without it the frame comes from ``lineitem``
    alone; every line item belongs to an order (the schema's foreign key), so
    both variants hold the same rows, and plans that only need the entity id
    skip the join.
    """
    lines = read_table(
        spark, sf_dir, "lineitem",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag",
         "l_linestatus", "l_shipdate"],
    )
    if with_keys:
        ent = order_entities(spark, sf_dir).select(
            "o_orderkey", "reservation_id", "reservation_key", "source_file", "source_row_number",
            F.to_date("o_orderdate").alias("arrival_date"),
        )
        df = lines.join(ent, lines.l_orderkey == ent.o_orderkey)
        keys = ["reservation_id", "reservation_key", "source_file", "source_row_number", "arrival_date"]
    else:
        df = lines.withColumn("reservation_id", F.col("l_orderkey"))
        keys = ["reservation_id"]
    score = "l_quantity / 50.0"
    return df.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS prediction_id",
        *keys,
        "CAST(l_returnflag = 'R' AS BIGINT) AS actual_no_show_flag",
        f"'{config.FEATURE_SET_VERSION}' AS feature_set_version",
        "'test' AS split_name",
        "CASE WHEN l_linestatus = 'O' THEN 'logistic_regression' ELSE 'gbt' END AS model_name",
        "concat(CASE WHEN l_linestatus = 'O' THEN 'logreg' ELSE 'gbt' END, '_v', CAST(year(l_shipdate) - 1994 AS STRING))"
        " AS model_version",
        f"{score} AS score",
        f"CAST({config.ACTION_THRESHOLD} AS DOUBLE) AS threshold_used",
        "concat('booking_time-', date_format(l_shipdate, 'yyyyMM')) AS scoring_run_id",
        "l_shipdate AS scored_at",
        "'booking_time' AS model_stage",
        "'booking_time' AS snapshot_stage",
        "l_linenumber AS tie_line", "l_partkey AS tie_part", "l_suppkey AS tie_supp",
    ).withColumn("risk_class", risk_class(F.col("score")))


def attach_entity_keys(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Add natural keys + arrival date to rows keyed by ``reservation_id`` (one join)."""
    ent = order_entities(spark, sf_dir).select(
        "reservation_id", "reservation_key", "source_file", "source_row_number",
        F.to_date("o_orderdate").alias("arrival_date"),
    )
    return df.join(ent, "reservation_id")


# Total order of predictions of one entity: newest first, ties by the line keys.
PREDICTION_ORDER = ("scored_at", "tie_line", "tie_part", "tie_supp")


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action log: two events per entity become its follow-up actions."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    status = (
        F.when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "error", "follow_up")
        .otherwise("open")
    )
    return ev.select(
        F.col("event_id").alias("id"),
        F.floor(F.col("event_id") / 2).cast("bigint").alias("reservation_id"),
        F.lit(None).cast("string").alias("prediction_id"),
        F.col("event_type").alias("action_type"),
        status.alias("action_status"),
        F.when(F.col("value") > 90, F.format_string("value %.2f", F.col("value"))).alias("action_note"),
        F.when(F.col("user_id") % 97 == 0, F.lit("x")).otherwise(F.concat(F.lit("user_"), _s(F.col("user_id")))).alias("acted_by"),
        F.col("props").alias("payload"),
        F.col("ts").alias("acted_at"),
    )


def snapshot_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string as-of-cutoff snapshot rows (day-1 and day-2 stages)."""
    raw = _reservation_base(spark, sf_dir)
    k = F.col("reservation_id")
    stage = F.when(k % 3 == 2, "post_booking_day_2").otherwise("post_booking_day_1")
    arrival = F.when(k % 101 == 0, F.lit("not a date")).otherwise(F.col("arrival_text"))
    snap_at = F.concat(F.col("ReservationStatusDate"), F.lit("T06:30:00+02:00"))
    active = (
        F.when(k % 4 == 0, "false").when(k % 4 == 1, "1").when(k % 4 == 2, "true").otherwise("True")
    )
    final = F.col("ReservationStatus")
    return raw.select(
        "reservation_key", "source_file", _s(F.col("source_row_number")).alias("source_row_number"),
        F.col("source_file").alias("property_id"),
        arrival.alias("arrival_date"),
        F.col("LeadTime").alias("lead_time_days"),
        F.col("ArrivalDateYear").alias("arrival_year"),
        F.col("ArrivalDateMonth").alias("arrival_month_name"),
        F.col("ArrivalDateWeekNumber").alias("arrival_week_number"),
        F.col("ArrivalDateDayOfMonth").alias("arrival_day_of_month"),
        F.col("StaysInWeekendNights").alias("weekend_nights"),
        F.col("StaysInWeekNights").alias("week_nights"),
        F.col("Adults").alias("adults"),
        F.col("Children").alias("children"),
        F.col("Babies").alias("babies"),
        F.col("Meal").alias("meal_plan"),
        F.col("Country").alias("country_code"),
        F.col("MarketSegment").alias("market_segment"),
        F.col("DistributionChannel").alias("distribution_channel"),
        F.col("IsRepeatedGuest").alias("is_repeated_guest"),
        F.col("PreviousCancellations").alias("previous_cancellations"),
        F.col("PreviousBookingsNotCanceled").alias("previous_non_cancelled_bookings"),
        F.col("ReservedRoomType").alias("reserved_room_type"),
        F.col("DepositType").alias("deposit_type"),
        F.col("Agent").alias("agent_code"),
        F.col("Company").alias("company_code"),
        F.col("CustomerType").alias("customer_type"),
        F.col("ADR").alias("adr"),
        F.col("RequiredCarParkingSpaces").alias("required_car_parking_spaces"),
        F.col("TotalOfSpecialRequests").alias("total_special_requests"),
        stage.alias("snapshot_stage"),
        snap_at.alias("snapshot_at"),
        F.when(k % 3 == 2, "2").otherwise("1").alias("days_since_booking"),
        F.col("LeadTime").alias("days_to_arrival"),
        active.alias("is_active_at_snapshot"),
        final.alias("final_outcome"),
        F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(F.col("BookingChanges")).alias("booking_changes_as_of_cutoff"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("DaysInWaitingList")).alias("days_in_waiting_list_as_of_cutoff"),
        F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("AssignedRoomType")).alias("assigned_room_type_as_of_cutoff"),
    )


def action_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action requests replayed at creation time: the log's rows moved back 26
    years so the as-of prediction attach falls inside the scored period."""
    return action_log(spark, sf_dir).withColumn("acted_at", F.col("acted_at") - F.expr("INTERVAL 26 YEARS"))


def action_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended updates: purchase / error events close or flag the sibling action
    of the same entity; every 1000th event targets an unknown id."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"]).filter(
        F.col("event_type").isin("purchase", "error")
    )
    target = F.when(F.col("event_id") % 1000 == 999, F.col("event_id") + 1_000_000_000).otherwise(
        F.col("event_id").bitwiseXOR(F.lit(1))
    )
    return ev.select(
        F.col("event_id").alias("update_id"),
        target.alias("id"),
        F.when(F.col("event_type") == "purchase", "completed").otherwise("follow_up").alias("action_status"),
        F.when(F.col("value") > 95, F.lit("escalated")).alias("action_note"),
        F.col("ts").alias("updated_at"),
    )
