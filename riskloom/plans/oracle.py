"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans: plain SQL over the driver's tables
(pre-registered views).  Shared CTEs rebuild the adapter, the cleansing rules
and the latest-prediction view, then each query adds its final SELECT.
"""

from __future__ import annotations

from riskloom import config
from riskloom.sources import adapter

NULL_TOKENS_SQL = ", ".join("'" + t + "'" for t in config.NULL_TOKENS)
NUM_RE = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)$"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _clean(x: str) -> str:
    s = _strip(x)
    return f"(CASE WHEN {s} IN ({NULL_TOKENS_SQL}) THEN NULL ELSE {s} END)"


def _num(x: str) -> str:
    c = _clean(x)
    return f"(CASE WHEN regexp_full_match({c}, '{NUM_RE}') THEN TRY_CAST({c} AS DOUBLE) END)"


ENT = """
ent AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
         c.c_mktsegment, n.n_name,
         o.o_orderkey AS reservation_id,
         CASE WHEN n.n_regionkey <= 1 THEN 'H1.csv' WHEN n.n_regionkey <= 3 THEN 'H2.csv' ELSE 'H3.csv' END AS source_file,
         o.o_orderkey + 1 AS source_row_number
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

LINES = """
la AS (
  SELECT l_orderkey, min(l_shipdate) AS first_ship,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
         count(*) FILTER (WHERE l_returnflag <> 'R') AS n_kept,
         count(*) FILTER (WHERE l_linestatus = 'O') AS n_open,
         count(*) FILTER (WHERE l_linestatus = 'F') AS n_filled
  FROM lineitem GROUP BY l_orderkey
)"""

RAW = """
rawbase AS (
  SELECT e.*, la.*,
         abs(date_diff('day', CAST(e.o_orderdate AS DATE), CAST(la.first_ship AS DATE))) % 500 AS lead,
         strftime(e.o_orderdate, '%B') AS month_name
  FROM ent e LEFT JOIN la ON e.o_orderkey = la.l_orderkey
),
raw AS (
  SELECT
    CASE WHEN o_orderkey % 89 = 0 THEN ' NULL' WHEN o_orderstatus = 'P' THEN '1' ELSE '0' END AS IsCanceled,
    CASE WHEN first_ship IS NULL THEN '       NULL' WHEN o_orderkey % 151 = 0 THEN '-' || CAST(lead AS VARCHAR)
         ELSE CAST(lead AS VARCHAR) END AS LeadTime,
    CAST(year(o_orderdate) AS VARCHAR) AS ArrivalDateYear,
    CASE WHEN o_orderkey % 101 = 0 THEN lower(month_name) ELSE month_name END AS ArrivalDateMonth,
    CAST(weekofyear(o_orderdate) AS VARCHAR) AS ArrivalDateWeekNumber,
    CASE WHEN o_orderkey % 211 = 0 THEN '31' ELSE CAST(day(o_orderdate) AS VARCHAR) END AS ArrivalDateDayOfMonth,
    CASE WHEN first_ship IS NOT NULL THEN CAST(n_returned AS VARCHAR) ELSE '' END AS StaysInWeekendNights,
    CASE WHEN first_ship IS NOT NULL THEN CAST(n_kept AS VARCHAR) ELSE 'NaN' END AS StaysInWeekNights,
    CASE WHEN first_ship IS NOT NULL THEN CAST(n_open AS VARCHAR) ELSE '' END AS Adults,
    CASE WHEN o_orderkey % 13 = 0 THEN 'NA' WHEN first_ship IS NOT NULL THEN CAST(n_filled AS VARCHAR) ELSE 'None' END AS Children,
    '0' AS Babies,
    CASE o_custkey % 4 WHEN 0 THEN 'BB       ' WHEN 1 THEN 'HB' WHEN 2 THEN 'SC' ELSE 'Undefined' END AS Meal,
    n_name AS Country,
    c_mktsegment AS MarketSegment,
    CASE WHEN o_orderkey % 53 = 0 THEN 'NULL' WHEN o_orderkey % 3 = 0 THEN '  ' || o_orderpriority || ' ' || chr(9)
         ELSE o_orderpriority END AS DistributionChannel,
    CAST(o_custkey % 2 AS VARCHAR) AS IsRepeatedGuest,
    CAST(o_custkey % 4 AS VARCHAR) AS PreviousCancellations,
    CAST(o_custkey % 3 AS VARCHAR) AS PreviousBookingsNotCanceled,
    substring(c_mktsegment, 1, 1) AS ReservedRoomType,
    substring(n_name, 1, 1) AS AssignedRoomType,
    CAST(o_custkey % 5 AS VARCHAR) AS BookingChanges,
    CASE WHEN o_totalprice > 300000 THEN 'Non Refund' ELSE 'No Deposit' END AS DepositType,
    CASE WHEN o_custkey % 5 = 0 THEN 'NULL' ELSE CAST(o_custkey AS VARCHAR) END AS Agent,
    CASE WHEN o_custkey % 7 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'NULL' END AS Company,
    CAST(o_orderkey % 3 AS VARCHAR) AS DaysInWaitingList,
    CASE o_custkey % 3 WHEN 0 THEN 'Transient' WHEN 1 THEN 'Contract' ELSE 'Group' END AS CustomerType,
    CAST(o_totalprice AS VARCHAR) AS ADR,
    CASE WHEN o_orderkey % 10 = 0 THEN '1' ELSE '0' END AS RequiredCarParkingSpaces,
    CASE WHEN o_orderkey % 17 = 0 THEN '1.5d' ELSE CAST(o_orderkey % 4 AS VARCHAR) END AS TotalOfSpecialRequests,
    CASE WHEN o_orderkey % 97 = 0 THEN '   ' WHEN o_orderstatus = 'F' THEN 'Check-Out' WHEN o_orderstatus = 'O' THEN 'No-Show'
         WHEN o_orderkey % 199 = 0 THEN 'canceled' ELSE 'Canceled' END AS ReservationStatus,
    CASE WHEN first_ship IS NOT NULL THEN strftime(first_ship, '%Y-%m-%d') ELSE '' END AS ReservationStatusDate,
    source_file, source_row_number, source_file || ':' || CAST(source_row_number AS VARCHAR) AS reservation_key,
    reservation_id, strftime(o_orderdate, '%Y-%m-%d') AS arrival_text
  FROM rawbase
)"""

MONTH_CASE = "CASE {x} " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in config.MONTH_NUMBERS.items()) + " END"

_STR_COLS = {
    "Meal": "meal_plan", "Country": "country_code", "MarketSegment": "market_segment",
    "DistributionChannel": "distribution_channel", "ReservedRoomType": "reserved_room_type",
    "AssignedRoomType": "assigned_room_type", "DepositType": "deposit_type", "Agent": "agent_code",
    "Company": "company_code", "CustomerType": "customer_type", "ArrivalDateMonth": "arrival_month_name",
}
_NUM_COLS = {
    "LeadTime": "lead_time_days", "ArrivalDateYear": "arrival_year", "ArrivalDateWeekNumber": "arrival_week_number",
    "ArrivalDateDayOfMonth": "arrival_day_of_month", "StaysInWeekendNights": "weekend_nights",
    "StaysInWeekNights": "week_nights", "Adults": "adults", "Children": "children", "Babies": "babies",
    "IsRepeatedGuest": "is_repeated_guest", "PreviousCancellations": "previous_cancellations",
    "PreviousBookingsNotCanceled": "previous_non_cancelled_bookings", "BookingChanges": "booking_changes",
    "DaysInWaitingList": "days_in_waiting_list", "ADR": "adr", "RequiredCarParkingSpaces": "required_car_parking_spaces",
    "TotalOfSpecialRequests": "total_special_requests",
}


def _clean_cte() -> str:
    cols = [f"{_clean(src)} AS {dst}" for src, dst in _STR_COLS.items()]
    cols += [f"{_num(src)} AS {dst}" for src, dst in _NUM_COLS.items()]
    cols += [
        f"{_num('IsCanceled')} AS is_canceled_num",
        f"{_clean('ReservationStatus')} AS reservation_status",
        f"{_clean('ReservationStatusDate')} AS status_date_text",
        f"{_clean('source_file')} AS source_file",
        f"{_clean('reservation_key')} AS reservation_key",
        "source_row_number", "reservation_id",
    ]
    month = MONTH_CASE.format(x="arrival_month_name")
    return f"""
clean0 AS (SELECT {", ".join(cols)} FROM raw),
clean AS (
  SELECT *,
    CASE source_file WHEN 'H1.csv' THEN 'RESORT_H1' WHEN 'H2.csv' THEN 'CITY_H2' ELSE 'UNKNOWN_PROPERTY' END AS property_id,
    'booking_time' AS model_stage,
    {month} AS arrival_month_number,
    CASE WHEN arrival_year IS NOT NULL AND ({month}) IS NOT NULL AND arrival_day_of_month IS NOT NULL
              AND arrival_year = floor(arrival_year) AND arrival_day_of_month = floor(arrival_day_of_month)
              AND arrival_year BETWEEN 1 AND 9999
         THEN TRY(make_date(CAST(arrival_year AS BIGINT), {month}, CAST(arrival_day_of_month AS BIGINT))) END AS arrival_date,
    CAST(try_strptime(status_date_text, '%Y-%m-%d') AS DATE) AS reservation_status_date,
    CAST(coalesce(is_canceled_num, 0.0) AS BIGINT) AS is_canceled,
    CAST(CASE reservation_status WHEN 'No-Show' THEN 1 WHEN 'Check-Out' THEN 0 END AS BIGINT) AS no_show_flag,
    NOT coalesce(reservation_status IN ('No-Show', 'Check-Out'), false) AS excluded_from_training,
    CASE WHEN reservation_status = 'Canceled' THEN 'canceled_status'
         WHEN NOT coalesce(reservation_status IN ('No-Show', 'Check-Out'), false) THEN 'unsupported_status' END AS exclusion_reason
  FROM clean0
)"""


PRED = """
pred AS (
  SELECT concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS prediction_id,
         e.reservation_id, e.source_file || ':' || CAST(e.source_row_number AS VARCHAR) AS reservation_key,
         e.source_file, e.source_row_number, CAST(e.o_orderdate AS DATE) AS arrival_date,
         CAST(l.l_returnflag = 'R' AS BIGINT) AS actual_no_show_flag,
         CASE WHEN l.l_linestatus = 'O' THEN 'logistic_regression' ELSE 'gbt' END AS model_name,
         CASE WHEN l.l_linestatus = 'O' THEN 'logreg' ELSE 'gbt' END || '_v' || CAST(year(l.l_shipdate) - 1994 AS VARCHAR) AS model_version,
         l.l_quantity / 50.0 AS score,
         CASE WHEN l.l_quantity / 50.0 >= 0.5 THEN 'high' WHEN l.l_quantity / 50.0 >= 0.35 THEN 'medium' ELSE 'low' END AS risk_class,
         0.35 AS threshold_used,
         'booking_time-' || strftime(l.l_shipdate, '%Y%m') AS scoring_run_id,
         l.l_shipdate AS scored_at,
         l.l_linenumber AS tie_line, l.l_partkey AS tie_part, l.l_suppkey AS tie_supp
  FROM lineitem l JOIN ent e ON l.l_orderkey = e.o_orderkey
)"""

LATEST = """
latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY reservation_id
                                 ORDER BY scored_at DESC, tie_line DESC, tie_part DESC, tie_supp DESC) AS rn
    FROM pred) WHERE rn = 1
),
rows AS (
  SELECT c.*, p.prediction_id, p.model_name, p.model_version, p.score, p.risk_class, p.threshold_used, p.scored_at
  FROM clean c LEFT JOIN latest p ON c.reservation_id = p.reservation_id
)"""

MODEL_VIEW = """
mlatest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY reservation_id
                                 ORDER BY scored_at DESC, tie_line DESC, tie_part DESC, tie_supp DESC) AS rn
    FROM pred WHERE model_name = 'logistic_regression') WHERE rn = 1
),
view0 AS (
  SELECT c.* EXCLUDE (reservation_id, reservation_key, source_file, source_row_number),
         p.reservation_key, p.source_file, p.source_row_number,
         p.arrival_date AS arrival_date_prediction, p.prediction_id, p.model_version, p.score,
         p.risk_class AS risk_class0, p.scored_at, p.actual_no_show_flag
  FROM clean c RIGHT JOIN mlatest p
    ON c.reservation_key = p.reservation_key AND c.source_file = p.source_file AND c.source_row_number = p.source_row_number
),
view AS (
  SELECT * EXCLUDE (risk_class0),
         row_number() OVER (ORDER BY source_file, source_row_number) AS reservation_id,
         coalesce(risk_class0, 'unscored') AS risk_class,
         'logistic_regression' AS model_name
  FROM view0
)"""

ACTIONS = """
actions AS (
  SELECT event_id AS id, CAST(floor(event_id / 2) AS BIGINT) AS reservation_id, CAST(NULL AS VARCHAR) AS prediction_id,
         event_type AS action_type,
         CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'follow_up' ELSE 'open' END AS action_status,
         CASE WHEN value > 90 THEN printf('value %.2f', value) END AS action_note,
         CASE WHEN user_id % 97 = 0 THEN 'x' ELSE 'user_' || CAST(user_id AS VARCHAR) END AS acted_by,
         props AS payload, ts AS acted_at
  FROM events
)"""


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body


def base_clean() -> list[str]:
    return [ENT, LINES, RAW, _clean_cte()]


def base_rows() -> list[str]:
    return [*base_clean(), PRED, LATEST]


def base_view() -> list[str]:
    return [*base_clean(), PRED, MODEL_VIEW]


CANCELED_STORE = "(coalesce(is_canceled = 1, false) OR coalesce(lower(reservation_status) = 'canceled', false))"
CANCELED_ART = "coalesce(reservation_status = 'Canceled', false)"
NOSHOW = "coalesce(no_show_flag = 1, false)"


def _rate(n: str, d: str) -> str:
    return f"(CASE WHEN {d} <= 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END)"


def _breakdown(src: str, dim: str, trim: bool, canceled: str) -> str:
    if trim:
        key = f"coalesce(nullif({_strip(f'CAST({dim} AS VARCHAR)')}, ''), 'Unknown')"
    else:
        key = f"coalesce(nullif(CAST({dim} AS VARCHAR), ''), 'Unknown')"
    return f"""
SELECT dimension_value, total_reservations, scored_reservations, high_risk_reservations, no_show_count,
       canceled_count, average_score,
       {_rate('no_show_count', 'total_reservations')} AS no_show_rate,
       {_rate('canceled_count', 'total_reservations')} AS cancellation_rate
FROM (
  SELECT {key} AS dimension_value,
         CAST(count(*) AS BIGINT) AS total_reservations,
         CAST(count(*) FILTER (WHERE score IS NOT NULL) AS BIGINT) AS scored_reservations,
         CAST(count(*) FILTER (WHERE risk_class = 'high') AS BIGINT) AS high_risk_reservations,
         CAST(count(*) FILTER (WHERE {NOSHOW}) AS BIGINT) AS no_show_count,
         CAST(count(*) FILTER (WHERE {canceled}) AS BIGINT) AS canceled_count,
         round(avg(score), 9) AS average_score
  FROM {src} GROUP BY 1)
ORDER BY total_reservations DESC, dimension_value"""


def _trends(src: str, canceled: str) -> str:
    return f"""
SELECT period, total_reservations, no_show_count, canceled_count,
       {_rate('no_show_count', 'total_reservations')} AS no_show_rate,
       {_rate('canceled_count', 'total_reservations')} AS cancellation_rate
FROM (
  SELECT coalesce(strftime(arrival_date, '%Y-%m'), 'unknown') AS period,
         CAST(count(*) AS BIGINT) AS total_reservations,
         CAST(count(*) FILTER (WHERE {NOSHOW}) AS BIGINT) AS no_show_count,
         CAST(count(*) FILTER (WHERE {canceled}) AS BIGINT) AS canceled_count
  FROM {src} GROUP BY 1)
ORDER BY period"""


QUEUE_COLS = (
    "reservation_id, property_id, source_file, arrival_date, distribution_channel, customer_type, no_show_flag, "
    "score, risk_class, model_name, model_version, scored_at"
)
RISKY_COLS = "reservation_id, property_id, arrival_date, distribution_channel, risk_class, score, model_version"
DETAIL_ID = 4242


def _queries() -> dict[str, str]:
    q: dict[str, str] = {}
    c = base_clean()
    q["cleanse_text"] = with_ctes(*c, body="""
SELECT reservation_id, meal_plan, country_code, market_segment, distribution_channel, reserved_room_type,
       assigned_room_type, deposit_type, agent_code, company_code, customer_type, reservation_status FROM clean""")
    q["cleanse_numeric"] = with_ctes(*c, body="""
SELECT reservation_id, lead_time_days, weekend_nights, week_nights, adults, children, babies, is_repeated_guest,
       previous_cancellations, previous_non_cancelled_bookings, booking_changes, days_in_waiting_list, adr,
       required_car_parking_spaces, total_special_requests FROM clean""")
    q["cleanse_dates"] = with_ctes(*c, body="""
SELECT reservation_id, arrival_year, arrival_month_name, arrival_month_number, arrival_week_number,
       arrival_day_of_month, arrival_date, reservation_status_date FROM clean""")
    q["label_and_exclusion"] = with_ctes(*c, body=f"""
SELECT reservation_id, model_stage, reservation_status, is_canceled, no_show_flag, excluded_from_training,
       exclusion_reason, {CANCELED_STORE} AS canceled_flag FROM clean""")
    q["canonical_projection"] = with_ctes(*c, body="""
SELECT reservation_id, reservation_key, source_file, source_row_number, property_id, arrival_month_name,
       arrival_month_number, arrival_date FROM clean""")

    r = base_rows()
    q["latest_prediction"] = with_ctes(*r, body="""
SELECT reservation_id, prediction_id, model_name, model_version, score, risk_class, threshold_used, scored_at
FROM latest""")
    v = base_view()
    q["reservation_view"] = with_ctes(*v, body="""
SELECT reservation_id, reservation_key, source_file, source_row_number, property_id, arrival_date,
       distribution_channel, customer_type, no_show_flag, score, risk_class, model_name, model_version,
       scored_at, arrival_date_prediction FROM view""")
    q["queue_store"] = with_ctes(*r, body=f"""
SELECT {QUEUE_COLS} FROM rows
ORDER BY score DESC NULLS LAST, arrival_date DESC NULLS LAST, reservation_id DESC LIMIT 50""")
    q["queue_artifact"] = with_ctes(*v, body=f"""
SELECT {QUEUE_COLS} FROM view WHERE property_id = 'CITY_H2' AND risk_class = 'high'
ORDER BY score DESC NULLS LAST, arrival_date DESC NULLS LAST, reservation_id ASC LIMIT 50""")
    q["queue_count"] = with_ctes(*r, body="""
SELECT CAST(count(*) AS BIGINT) AS total FROM rows
WHERE property_id = 'RESORT_H1' AND arrival_date >= DATE '1996-01-01' AND arrival_date <= DATE '1999-12-31'
  AND risk_class = 'medium'""")
    q["filter_options"] = with_ctes(*v, body="""
SELECT string_agg(DISTINCT property_id, '|' ORDER BY property_id) AS property_ids,
       string_agg(DISTINCT distribution_channel, '|' ORDER BY distribution_channel) AS distribution_channels,
       'high|medium|low' AS risk_classes, min(arrival_date) AS min_arrival_date, max(arrival_date) AS max_arrival_date
FROM view""")
    q["filter_option_rows"] = with_ctes(*v, body="""
SELECT DISTINCT 'property_id' AS option, property_id AS value FROM view WHERE property_id IS NOT NULL
UNION ALL
SELECT DISTINCT 'distribution_channel', distribution_channel FROM view WHERE distribution_channel IS NOT NULL""")
    q["reservation_detail"] = with_ctes(*r, ACTIONS, body=f"""
SELECT d.*, CAST(coalesce(a.action_count, 0) AS BIGINT) AS action_count, a.last_action_id, a.last_acted_at
FROM (
  SELECT reservation_id, property_id, source_file, arrival_date, CAST(lead_time_days AS BIGINT) AS lead_time_days,
         distribution_channel, market_segment, customer_type, reserved_room_type, deposit_type,
         no_show_flag = 1 AS no_show_flag, coalesce(excluded_from_training, false) AS excluded_from_training,
         exclusion_reason, (model_name IS NOT NULL OR score IS NOT NULL) AS has_latest_prediction,
         score, risk_class, model_name, model_version, scored_at, meal_plan, is_repeated_guest = 1 AS is_repeated_guest,
         CAST(total_special_requests AS BIGINT) AS total_special_requests,
         CAST(required_car_parking_spaces AS BIGINT) AS required_car_parking_spaces
  FROM rows WHERE reservation_id = {DETAIL_ID}) d
LEFT JOIN (
  SELECT reservation_id, count(*) AS action_count, arg_max(id, (acted_at, id)) AS last_action_id,
         max(acted_at) AS last_acted_at
  FROM actions WHERE reservation_id = {DETAIL_ID} GROUP BY reservation_id) a
ON d.reservation_id = a.reservation_id""")
    q["risky_store"] = with_ctes(*r, body=f"""
SELECT {RISKY_COLS} FROM clean c JOIN latest p USING (reservation_id)
ORDER BY score DESC NULLS LAST, reservation_id DESC LIMIT 8""".replace(
        f"SELECT {RISKY_COLS}",
        "SELECT c.reservation_id, c.property_id, c.arrival_date, c.distribution_channel, p.risk_class, p.score, p.model_version",
    ))
    q["risky_artifact"] = with_ctes(*v, body=f"""
SELECT {RISKY_COLS} FROM view WHERE risk_class IN ('high', 'medium')
ORDER BY score DESC NULLS LAST, arrival_date DESC NULLS LAST, reservation_id ASC LIMIT 12""")

    q["dashboard_kpis"] = with_ctes(*r, ACTIONS, body="""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM clean) AS total_reservations,
       (SELECT CAST(count(*) FILTER (WHERE risk_class = 'high') AS BIGINT) FROM latest) AS high_risk_reservations,
       (SELECT CAST(count(*) FILTER (WHERE risk_class = 'medium') AS BIGINT) FROM latest) AS medium_risk_reservations,
       (SELECT max(scored_at) FROM pred) AS latest_scored_at,
       (SELECT CAST(count(*) FILTER (WHERE action_status = 'open') AS BIGINT) FROM actions) AS action_pending_count,
       (SELECT CAST(count(*) FILTER (WHERE action_status = 'completed') AS BIGINT) FROM actions) AS action_completed_count,
       (SELECT CAST(count(*) FILTER (WHERE action_status = 'follow_up') AS BIGINT) FROM actions) AS action_follow_up_count""")
    q["dashboard_kpis_artifact"] = with_ctes(*v, body="""
SELECT CAST(count(*) AS BIGINT) AS total_reservations,
       CAST(count(*) FILTER (WHERE risk_class = 'high') AS BIGINT) AS high_risk_reservations,
       CAST(count(*) FILTER (WHERE risk_class = 'medium') AS BIGINT) AS medium_risk_reservations,
       max(scored_at) AS latest_scored_at, 'logistic_regression' AS active_model_name,
       CAST(NULL AS VARCHAR) AS active_model_version
FROM view""")
    summary = """
SELECT total_reservations, scored_reservations, no_show_count, canceled_count,
       {r1} AS no_show_rate, {r2} AS cancellation_rate, high_risk_reservations,
       action_pending_count, action_completed_count, action_follow_up_count{note}
FROM (
  SELECT CAST(count(*) AS BIGINT) AS total_reservations,
         CAST(count(*) FILTER (WHERE score IS NOT NULL) AS BIGINT) AS scored_reservations,
         CAST(count(*) FILTER (WHERE {noshow}) AS BIGINT) AS no_show_count,
         CAST(count(*) FILTER (WHERE {canceled}) AS BIGINT) AS canceled_count,
         CAST(count(*) FILTER (WHERE risk_class = 'high') AS BIGINT) AS high_risk_reservations,
         {acts}
  FROM {src})"""
    acts_store = ", ".join(
        f"(SELECT CAST(count(*) FILTER (WHERE action_status = '{s}') AS BIGINT) FROM actions) AS {n}"
        for s, n in (("open", "action_pending_count"), ("completed", "action_completed_count"),
                     ("follow_up", "action_follow_up_count"))
    )
    acts_zero = "CAST(0 AS BIGINT) AS action_pending_count, CAST(0 AS BIGINT) AS action_completed_count, CAST(0 AS BIGINT) AS action_follow_up_count"
    rates = dict(r1=_rate("no_show_count", "total_reservations"), r2=_rate("canceled_count", "total_reservations"))
    q["operations_summary"] = with_ctes(*r, ACTIONS, body=summary.format(
        noshow=NOSHOW, canceled=CANCELED_STORE, acts=acts_store, src="rows", note="", **rates))
    q["operations_summary_artifact"] = with_ctes(*v, body=summary.format(
        noshow=NOSHOW, canceled=CANCELED_ART, acts=acts_zero, src="view",
        note=", 'Artifact fallback read-only mode. Action metrics become available after DB persistence.' AS note",
        **rates))
    q["no_show_trends"] = with_ctes(*r, body=_trends("rows", CANCELED_STORE))
    q["no_show_trends_artifact"] = with_ctes(*v, body=_trends("view", CANCELED_ART))
    q["channel_breakdown"] = with_ctes(*r, body=_breakdown("rows", "distribution_channel", True, CANCELED_STORE))
    q["segment_breakdown"] = with_ctes(*r, body=_breakdown("rows", "market_segment", True, CANCELED_STORE))
    q["property_breakdown"] = with_ctes(*r, body=_breakdown("rows", "property_id", True, CANCELED_STORE))
    q["channel_breakdown_artifact"] = with_ctes(*v, body=_breakdown("view", "distribution_channel", False, CANCELED_ART))

    q["action_effectiveness"] = with_ctes(*r, ACTIONS, body="""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM actions) AS total_actions,
       (SELECT CAST(count(*) FILTER (WHERE action_status = 'open') AS BIGINT) FROM actions) AS open_actions,
       (SELECT CAST(count(*) FILTER (WHERE action_status = 'completed') AS BIGINT) FROM actions) AS completed_actions,
       (SELECT CAST(count(*) FILTER (WHERE action_status = 'follow_up') AS BIGINT) FROM actions) AS follow_up_actions,
       (SELECT CAST(count(DISTINCT reservation_id) AS BIGINT) FROM rows WHERE risk_class = 'high'
          AND reservation_id IN (SELECT reservation_id FROM actions)) AS high_risk_with_action_count,
       (SELECT CAST(count(DISTINCT reservation_id) AS BIGINT) FROM rows WHERE risk_class = 'high'
          AND reservation_id NOT IN (SELECT reservation_id FROM actions)) AS high_risk_without_action_count""")
    q["action_effectiveness_artifact"] = with_ctes(*v, body="""
SELECT CAST(0 AS BIGINT) AS total_actions, CAST(0 AS BIGINT) AS open_actions, CAST(0 AS BIGINT) AS completed_actions,
       CAST(0 AS BIGINT) AS follow_up_actions, CAST(0 AS BIGINT) AS high_risk_with_action_count,
       CAST(count(DISTINCT reservation_id) AS BIGINT) AS high_risk_without_action_count,
       'Artifact fallback read-only mode. Action analytics require DB-backed action logs.' AS note
FROM view WHERE risk_class = 'high'""")
    for name, col in (("action_status_breakdown", "action_status"), ("action_type_breakdown", "action_type")):
        q[name] = with_ctes(ACTIONS, body=f"""
SELECT {col} AS label, CAST(count(*) AS BIGINT) AS count FROM actions GROUP BY 1 ORDER BY count DESC, label""")
    q["action_counts_per_entity"] = with_ctes(ACTIONS, body="""
SELECT reservation_id, CAST(count(*) AS BIGINT) AS action_count,
       CAST(count(*) FILTER (WHERE action_status = 'open') AS BIGINT) AS open_count,
       CAST(count(*) FILTER (WHERE action_status = 'completed') AS BIGINT) AS completed_count,
       CAST(count(*) FILTER (WHERE action_status = 'follow_up') AS BIGINT) AS follow_up_count
FROM actions GROUP BY reservation_id""")
    q["action_history"] = with_ctes(ACTIONS, body=f"""
SELECT id, reservation_id, action_type, action_status, action_note, acted_by, acted_at FROM actions
WHERE reservation_id = {DETAIL_ID // 2} ORDER BY acted_at DESC, id DESC""")
    return q


ZERO_FILL = config.ZERO_FILL_COLUMNS


def _bucket_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} <= {e} THEN '{lab}'" for e, lab in zip(config.LEAD_TIME_EDGES, config.LEAD_TIME_LABELS))
    return f"CASE {parts} WHEN {x} IS NOT NULL THEN '{config.LEAD_TIME_LABELS[-1]}' END"


def _features_cte(src: str, snapshot: bool, version: str) -> str:
    fill = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ZERO_FILL)
    guests = "(coalesce(adults, 0) + coalesce(children, 0) + coalesce(babies, 0))"
    extra = ""
    if snapshot:
        extra = """,
    CASE WHEN booking_changes_as_of_cutoff IS NOT NULL THEN CAST(booking_changes_as_of_cutoff > 0 AS INTEGER) END AS has_any_booking_change_as_of_cutoff,
    CASE WHEN days_in_waiting_list_as_of_cutoff IS NOT NULL THEN CAST(days_in_waiting_list_as_of_cutoff > 0 AS INTEGER) END AS waiting_list_flag_as_of_cutoff,
    CASE WHEN assigned_room_type_as_of_cutoff IS NOT NULL THEN 1 END AS room_assigned_flag_as_of_cutoff"""
    return f"""
filled AS (SELECT * REPLACE ({fill}) FROM {src}),
feat AS (
  SELECT *,
    weekend_nights + week_nights AS total_nights,
    {guests} AS total_guests,
    CAST((coalesce(children, 0) + coalesce(babies, 0)) > 0 AS INTEGER) AS has_children,
    CAST({guests} >= 3 AS INTEGER) AS is_family,
    {_bucket_sql('lead_time_days')} AS lead_time_bucket,
    CAST(agent_code IS NOT NULL AS INTEGER) AS has_agent,
    CAST(company_code IS NOT NULL AS INTEGER) AS has_company,
    CAST(total_special_requests > 0 AS INTEGER) AS special_request_flag,
    adr / greatest({guests}, 1) AS adr_per_guest,
    adr / greatest(weekend_nights + week_nights, 1) AS adr_per_night_proxy,
    CAST(coalesce(arrival_month_name IN ('July', 'August'), false) AS INTEGER) AS is_high_season,
    CAST(weekend_nights > week_nights AS INTEGER) AS is_weekend_heavy,
    previous_cancellations / (previous_cancellations + previous_non_cancelled_bookings + 1) AS previous_cancel_ratio,
    '{version}' AS feature_set_version{extra}
  FROM filled
)"""


BOOKING_FEATURES = config.stage().columns("feature")
FEATURE_SELECT = ", ".join(
    dict.fromkeys(
        ["reservation_id", "reservation_key", "source_file", "source_row_number", "property_id", "model_stage",
         "feature_set_version", *BOOKING_FEATURES, "arrival_date", "excluded_from_training",
         "exclusion_reason", "no_show_flag", "arrival_year"]
    )
)
MODELING_SELECT = ", ".join(
    dict.fromkeys(
        ["reservation_id", "reservation_key", "source_file", "source_row_number", "arrival_date", "model_stage",
         "feature_set_version", "arrival_year", "CAST(no_show_flag AS INTEGER) AS no_show_flag",
         *BOOKING_FEATURES]
    )
)
TRAIN_YEARS = (1995, 1996, 1997, 1998, 1999)
TEST_YEARS = (2000, 2001)


def _snapshot_ctes() -> list[str]:
    raw_cols = {
        "lead_time_days": "LeadTime", "arrival_year": "ArrivalDateYear", "arrival_month_name": "ArrivalDateMonth",
        "arrival_week_number": "ArrivalDateWeekNumber", "arrival_day_of_month": "ArrivalDateDayOfMonth",
        "weekend_nights": "StaysInWeekendNights", "week_nights": "StaysInWeekNights", "adults": "Adults",
        "children": "Children", "babies": "Babies", "meal_plan": "Meal", "country_code": "Country",
        "market_segment": "MarketSegment", "distribution_channel": "DistributionChannel",
        "is_repeated_guest": "IsRepeatedGuest", "previous_cancellations": "PreviousCancellations",
        "previous_non_cancelled_bookings": "PreviousBookingsNotCanceled", "reserved_room_type": "ReservedRoomType",
        "deposit_type": "DepositType", "agent_code": "Agent", "company_code": "Company", "customer_type": "CustomerType",
        "adr": "ADR", "required_car_parking_spaces": "RequiredCarParkingSpaces",
        "total_special_requests": "TotalOfSpecialRequests",
    }
    snap_raw = ", ".join(f"{src} AS {dst}" for dst, src in raw_cols.items())
    numeric = set(config.SNAPSHOT_NUMERIC_COLUMNS)
    strings = [c for c in list(raw_cols) + ["property_id", "agent_code"] if c not in numeric]
    clean_cols = [f"{_num(c)} AS {c}" for c in config.SNAPSHOT_NUMERIC_COLUMNS if c != "source_row_number"]
    clean_cols += [f"{_clean(c)} AS {c}" for c in dict.fromkeys(strings)]
    clean_cols += [f"{_clean(c)} AS {c}" for c in ("reservation_key", "source_file", "snapshot_stage", "final_outcome",
                                                   "assigned_room_type_as_of_cutoff")]
    clean_cols += [
        f"CAST({_num('source_row_number')} AS BIGINT) AS source_row_number",
        f"CAST(try_strptime({_clean('arrival_date')}, '%Y-%m-%d') AS DATE) AS arrival_date",
        f"TRY_CAST({_clean('snapshot_at')} AS TIMESTAMPTZ) AS snapshot_at",
        f"coalesce({_clean('is_active_at_snapshot')} IN ('1', 'true'), false) AS is_active_at_snapshot",
    ]
    return [
        f"""
snapraw AS (
  SELECT reservation_key, source_file, CAST(source_row_number AS VARCHAR) AS source_row_number, source_file AS property_id,
         CASE WHEN reservation_id % 101 = 0 THEN 'not a date' ELSE arrival_text END AS arrival_date, {snap_raw},
         CASE WHEN reservation_id % 3 = 2 THEN 'post_booking_day_2' ELSE 'post_booking_day_1' END AS snapshot_stage,
         ReservationStatusDate || 'T06:30:00+02:00' AS snapshot_at,
         CASE WHEN reservation_id % 3 = 2 THEN '2' ELSE '1' END AS days_since_booking,
         LeadTime AS days_to_arrival,
         CASE reservation_id % 4 WHEN 0 THEN 'false' WHEN 1 THEN '1' WHEN 2 THEN 'true' ELSE 'True' END AS is_active_at_snapshot,
         ReservationStatus AS final_outcome,
         CASE WHEN reservation_id % 6 = 0 THEN NULL ELSE BookingChanges END AS booking_changes_as_of_cutoff,
         CASE WHEN reservation_id % 5 = 0 THEN NULL ELSE DaysInWaitingList END AS days_in_waiting_list_as_of_cutoff,
         CASE WHEN reservation_id % 2 = 0 THEN NULL ELSE AssignedRoomType END AS assigned_room_type_as_of_cutoff,
         CAST(NULL AS VARCHAR) AS days_since_last_booking_change, CAST(NULL AS VARCHAR) AS days_since_room_assignment
  FROM raw
),
snap0 AS (SELECT {", ".join(clean_cols)} FROM snapraw),
snap AS (
  SELECT *, year(snapshot_at AT TIME ZONE 'UTC') AS snapshot_year, 'post_booking_day_1' AS model_stage,
         CAST(CASE final_outcome WHEN 'No-Show' THEN 1 WHEN 'Check-Out' THEN 0 END AS BIGINT) AS no_show_flag,
         (NOT coalesce(final_outcome IN ('No-Show', 'Check-Out'), false)) OR NOT is_active_at_snapshot AS excluded_from_training,
         CASE WHEN final_outcome = 'Canceled' THEN 'canceled_before_or_after_snapshot'
              WHEN NOT is_active_at_snapshot THEN 'inactive_at_snapshot' END AS exclusion_reason
  FROM snap0 WHERE snapshot_stage = 'post_booking_day_1'
)"""
    ]


def _ranked_cte() -> str:
    y = "actual_no_show_flag"
    return f"""
ranked AS (
  SELECT model_name, {y}, score,
         row_number() OVER (PARTITION BY model_name ORDER BY score DESC, reservation_id, tie_line, tie_part, tie_supp) AS r_desc,
         row_number() OVER (PARTITION BY model_name ORDER BY score ASC, reservation_id, tie_line, tie_part, tie_supp) AS r_asc,
         count(*) OVER (PARTITION BY model_name) AS n,
         count(*) FILTER (WHERE {y} = 1) OVER (PARTITION BY model_name) AS p,
         min(score) OVER (PARTITION BY model_name) < max(score) OVER (PARTITION BY model_name) AS varied
  FROM pred)"""


def _topk_union() -> str:
    y = "actual_no_show_flag"
    segs = [(f"top_{k}", f"least({k}, n)") for k in config.TOP_K_VALUES]
    segs += [(f"top_{int(round(pc * 100))}pct", f"greatest(1, ceil(n * {pc!r}))") for pc in config.TOP_PERCENT_VALUES]
    return " UNION ALL ".join(
        f"""SELECT model_name, '{name}' AS segment, CAST(max({cut}) AS BIGINT) AS selected_count,
       CAST(count(*) FILTER (WHERE r_desc <= {cut} AND {y} = 1) AS BIGINT) AS captured_no_show,
       CAST(max(p) AS BIGINT) AS total_no_show FROM ranked GROUP BY model_name"""
        for name, cut in segs
    )


def _more_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    c = base_clean()
    f = [*c, _features_cte("clean", False, config.FEATURE_SET_VERSION)]
    q["feature_dataset"] = with_ctes(*f, body=f"SELECT {FEATURE_SELECT} FROM feat")
    q["lead_time_bucket_counts"] = with_ctes(*f, body="""
SELECT lead_time_bucket, CAST(count(*) AS BIGINT) AS row_count FROM feat GROUP BY 1""")
    modeling = f"modeling AS (SELECT {MODELING_SELECT} FROM feat WHERE NOT excluded_from_training)"
    q["modeling_rows"] = with_ctes(*f, modeling, body="SELECT * FROM modeling")
    tr = ", ".join(f"{y}.0" for y in TRAIN_YEARS)
    te = ", ".join(f"{y}.0" for y in TEST_YEARS)
    q["temporal_split_rows"] = with_ctes(*f, modeling, body=f"""
SELECT * FROM (
  SELECT reservation_id, reservation_key, arrival_year, no_show_flag,
         CASE WHEN arrival_year IN ({tr}) THEN 'train' WHEN arrival_year IN ({te}) THEN 'test' END AS split_name
  FROM modeling) WHERE split_name IS NOT NULL""")
    q["ml_logistic_checks"] = with_ctes(*f, modeling, body=f"""
SELECT reservation_key, 'logistic_regression' AS model_name, CAST(no_show_flag AS BIGINT) AS actual_no_show_flag,
       'test' AS split_name, true AS score_in_range, true AS class_agrees
FROM modeling WHERE arrival_year IN ({te})""")
    q["ml_gbt_checks"] = q["ml_logistic_checks"].replace("'logistic_regression' AS model_name", "'gbt' AS model_name")
    numbers = config.stage().columns("number")
    medians = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(median({c}) AS DOUBLE) AS median FROM modeling WHERE arrival_year IN ({tr})" for c in numbers
    )
    q["feature_medians"] = with_ctes(*f, modeling.replace("modeling AS (", "modeling AS MATERIALIZED ("), body=medians)
    raw_text = ", '|', ".join(f'coalesce("{col}", \'\')' for col in adapter.RAW_COLUMNS)
    q["csv_row_summary"] = with_ctes(*c, body=f"""
SELECT source_file, CAST(count(*) AS BIGINT) AS row_count, CAST(1 AS BIGINT) AS first_row,
       CAST(count(*) AS BIGINT) AS last_row, CAST(count(*) AS BIGINT) AS row_numbers,
       CAST(sum(CAST('0x' || substr(md5(concat({raw_text})), 1, 8) AS BIGINT)) AS BIGINT) AS row_hash_sum
FROM raw GROUP BY source_file""")
    q["temporal_split_summary"] = with_ctes(*f, modeling, body=f"""
SELECT split_name, string_agg(DISTINCT CAST(CAST(arrival_year AS BIGINT) AS VARCHAR), ',' ORDER BY CAST(CAST(arrival_year AS BIGINT) AS VARCHAR)) AS years,
       CAST(count(*) AS BIGINT) AS row_count,
       CAST(count(*) FILTER (WHERE no_show_flag = 0) AS BIGINT) AS class_0_count,
       CAST(count(*) FILTER (WHERE no_show_flag = 1) AS BIGINT) AS class_1_count
FROM (SELECT *, CASE WHEN arrival_year IN ({tr}) THEN 'train' WHEN arrival_year IN ({te}) THEN 'test' END AS split_name
      FROM modeling)
WHERE split_name IS NOT NULL GROUP BY split_name""")
    q["import_summary"] = with_ctes(*c, body="""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM raw) AS row_count_raw, CAST(count(*) AS BIGINT) AS row_count_clean,
       CAST(count(*) FILTER (WHERE NOT excluded_from_training) AS BIGINT) AS row_count_training,
       CAST(count(*) FILTER (WHERE excluded_from_training) AS BIGINT) AS row_count_excluded,
       'booking_time' AS model_stage
FROM clean""")
    q["status_distribution"] = with_ctes(*c, body="""
SELECT coalesce(reservation_status, 'MISSING') AS status, CAST(count(*) AS BIGINT) AS row_count FROM clean GROUP BY 1""")
    q["class_distribution"] = with_ctes(*f, modeling, body="""
SELECT no_show_flag, CAST(count(*) AS BIGINT) AS row_count FROM modeling GROUP BY 1 ORDER BY 1""")
    sn = [*c, *_snapshot_ctes()]
    q["snapshot_normalize"] = with_ctes(*sn, body="""
SELECT reservation_key, source_row_number, snapshot_stage, arrival_date,
       CAST(snapshot_at AT TIME ZONE 'UTC' AS TIMESTAMP) AS snapshot_at, snapshot_year, is_active_at_snapshot,
       final_outcome, no_show_flag, excluded_from_training, exclusion_reason, lead_time_days, days_since_booking,
       days_to_arrival, booking_changes_as_of_cutoff, assigned_room_type_as_of_cutoff
FROM snap""")
    sf = [*sn, _features_cte("snap", True, "post_booking_day_1_v1")]
    q["feature_asof_flags"] = with_ctes(*sf, body="""
SELECT reservation_key, feature_set_version, snapshot_year, lead_time_bucket, total_nights,
       has_any_booking_change_as_of_cutoff, waiting_list_flag_as_of_cutoff, room_assigned_flag_as_of_cutoff
FROM feat""")

    # evaluation over the prediction history, per model
    e = [ENT, PRED]
    y = "actual_no_show_flag"
    cm = f"""
SELECT model_name, tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,
       0.35 AS threshold, tp + fp AS actioned_count,
       coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
       coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
       coalesce(CAST(2 * tp AS DOUBLE) / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1
FROM (SELECT model_name,
        CAST(count(*) FILTER (WHERE score >= 0.35 AND {y} = 1) AS BIGINT) AS tp,
        CAST(count(*) FILTER (WHERE score >= 0.35 AND NOT ({y} = 1)) AS BIGINT) AS fp,
        CAST(count(*) FILTER (WHERE NOT (score >= 0.35) AND NOT ({y} = 1)) AS BIGINT) AS tn,
        CAST(count(*) FILTER (WHERE NOT (score >= 0.35) AND {y} = 1) AS BIGINT) AS fn
      FROM pred GROUP BY model_name)"""
    q["confusion_matrix"] = with_ctes(*e, body=cm)
    groups = f"""
grp AS (SELECT model_name, score, count(*) FILTER (WHERE {y} = 1) AS pos, count(*) FILTER (WHERE NOT ({y} = 1)) AS neg
        FROM pred WHERE score IS NOT NULL GROUP BY model_name, score),
curve AS (
  SELECT model_name,
         CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
           CAST(sum((2 * CAST(neg_lt AS HUGEINT) + neg) * pos) AS DOUBLE) / (2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))
         END AS roc_auc,
         CASE WHEN sum(pos) > 0 THEN round(sum(pos * pos_ge / (pos_ge + neg_ge)) / sum(pos), 9) ELSE 0.0 END AS pr_auc
  FROM (SELECT *, sum(neg) OVER (PARTITION BY model_name ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_lt0,
               coalesce(sum(neg) OVER (PARTITION BY model_name ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_lt,
               CAST(sum(pos) OVER (PARTITION BY model_name ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS pos_ge,
               CAST(sum(neg) OVER (PARTITION BY model_name ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS neg_ge
        FROM grp)
  GROUP BY model_name),
brier AS (SELECT model_name, round(avg(power(CAST({y} AS DOUBLE) - score, 2)), 9) AS brier_score FROM pred GROUP BY model_name),
cm AS ({cm}),
metrics AS (
  SELECT cm.model_name, roc_auc, pr_auc, precision, recall, f1, brier_score, threshold, actioned_count,
         true_positives, false_positives, true_negatives, false_negatives
  FROM cm JOIN curve USING (model_name) JOIN brier USING (model_name))"""
    q["classification_metrics"] = with_ctes(*e, groups, body="SELECT * FROM metrics")
    q["metrics_long"] = with_ctes(*e, groups, body="""
SELECT model_name, name, value, CASE WHEN value IS NULL THEN 'pending' ELSE 'available' END AS status
FROM (UNPIVOT (SELECT model_name, pr_auc, roc_auc, precision, recall, f1, brier_score FROM metrics)
      ON pr_auc, roc_auc, precision, recall, f1, brier_score INTO NAME name VALUE value)""")
    comparison = """
comparison AS (
  SELECT model_name, roc_auc, pr_auc, precision, recall, f1, brier_score, threshold,
         CAST(row_number() OVER (ORDER BY pr_auc DESC NULLS LAST, roc_auc DESC NULLS LAST, model_name) AS BIGINT) AS comparison_rank
  FROM metrics)"""
    q["model_comparison"] = with_ctes(*e, groups, comparison, body="SELECT * FROM comparison")
    q["recommended_model"] = with_ctes(*e, groups, comparison, body="""
SELECT model_name AS recommended_model, threshold AS selected_threshold,
       printf('Recommended by latest artifact because it leads on PR-AUC (%.3f) under the current selection policy.', pr_auc)
         AS recommendation_reason
FROM comparison WHERE comparison_rank = 1""")
    sweep_rows = " UNION ALL ".join(
        f"""SELECT model_name, CAST({t!r} AS DOUBLE) AS threshold,
       count(*) FILTER (WHERE score >= {t!r} AND {y} = 1) AS tp, count(*) FILTER (WHERE score >= {t!r}) AS actioned,
       count(*) FILTER (WHERE {y} = 1) AS p FROM pred GROUP BY model_name"""
        for t in config.THRESHOLDS
    )
    sweep = f"""
sweep AS (
  SELECT model_name, threshold,
         coalesce(CAST(tp AS DOUBLE) / nullif(CAST(actioned AS DOUBLE), 0), 0.0) AS precision,
         coalesce(CAST(tp AS DOUBLE) / nullif(CAST(p AS DOUBLE), 0), 0.0) AS recall,
         coalesce(CAST(2 * tp AS DOUBLE) / nullif(CAST(2 * tp + (actioned - tp) + (p - tp) AS DOUBLE), 0), 0.0) AS f1,
         CAST(actioned AS BIGINT) AS actioned_count
  FROM ({sweep_rows}))"""
    q["threshold_sweep"] = with_ctes(*e, sweep, body="SELECT * FROM sweep")
    q["threshold_lookup"] = with_ctes(*e, sweep, body="""
SELECT model_name, threshold, precision, recall, f1, actioned_count FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY (abs(threshold - 0.35) < 0.0001) DESC, threshold) AS pick
  FROM sweep) WHERE pick = 1""")
    ranked = _ranked_cte()
    topk = _topk_union()
    q["topk_capture"] = with_ctes(*e, ranked, body=f"""
SELECT model_name, segment, selected_count, captured_no_show, total_no_show,
       coalesce(CAST(captured_no_show AS DOUBLE) / nullif(CAST(total_no_show AS DOUBLE), 0), 0.0) AS recall
FROM ({topk})""")
    q["calibration_table"] = with_ctes(*e, ranked, body=f"""
SELECT model_name, bin, CAST(count(*) AS BIGINT) AS sample_count, round(avg(score), 9) AS mean_predicted_probability,
       CAST(count(*) FILTER (WHERE {y} = 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS observed_positive_rate
FROM (SELECT *, CAST(CASE WHEN varied THEN greatest(0,
        CASE WHEN n > 1 THEN ((r_asc - 1) * least(10, n) + (n - 1) - 1) // (n - 1) END - 1) ELSE 0 END AS BIGINT) AS bin
      FROM ranked)
GROUP BY model_name, bin ORDER BY model_name, bin""")
    return q


REQUESTS = """
requests AS (SELECT * REPLACE (acted_at - INTERVAL 26 YEAR AS acted_at) FROM actions)"""

UPDATES = """
updates AS (
  SELECT event_id AS update_id,
         CASE WHEN event_id % 1000 = 999 THEN event_id + 1000000000 ELSE xor(event_id, 1) END AS id,
         CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'follow_up' END AS action_status,
         CASE WHEN value > 95 THEN 'escalated' END AS action_note, ts AS updated_at
  FROM events WHERE event_type IN ('purchase', 'error'))"""

REASON = """CASE WHEN action_status IS NULL OR action_status NOT IN ('open', 'completed', 'follow_up') THEN 'invalid_status'
     WHEN action_type IS NULL OR NOT (length(action_type) BETWEEN 2 AND 64) THEN 'invalid_action_type'
     WHEN acted_by IS NULL OR NOT (length(acted_by) BETWEEN 2 AND 128) THEN 'invalid_acted_by'
     WHEN action_note IS NOT NULL AND length(action_note) > 500 THEN 'note_too_long' END"""


def _action_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    c = base_clean()
    tagged = f"""
tagged AS (
  SELECT *, CASE WHEN reason0 IS NOT NULL THEN reason0
                 WHEN reservation_id NOT IN (SELECT reservation_id FROM clean) THEN 'unknown_entity' END AS reason
  FROM (SELECT * REPLACE (coalesce(action_status, 'open') AS action_status), {REASON.replace('action_status', "coalesce(action_status, 'open')")} AS reason0
        FROM requests))"""
    q["action_validation"] = with_ctes(*c, ACTIONS, REQUESTS, tagged, body="""
SELECT coalesce(reason, 'accepted') AS outcome, CAST(count(*) AS BIGINT) AS request_count FROM tagged GROUP BY 1""")
    q["action_asof_prediction"] = with_ctes(*c, PRED, ACTIONS, REQUESTS, tagged, body="""
SELECT t.id, t.reservation_id,
       (SELECT arg_max(p.prediction_id, (p.scored_at, p.tie_line, p.tie_part, p.tie_supp)) FROM pred p
        WHERE p.reservation_id = t.reservation_id AND p.scored_at <= t.acted_at) AS prediction_id,
       t.action_type, t.action_status, t.acted_at
FROM tagged t WHERE t.reason IS NULL""")
    upd = """
known AS (SELECT * FROM updates WHERE id IN (SELECT id FROM actions)),
latest_upd AS (
  SELECT id,
         arg_max(action_status, (updated_at, update_id)) FILTER (WHERE action_status IS NOT NULL) AS new_status,
         arg_max(action_note, (updated_at, update_id)) FILTER (WHERE action_note IS NOT NULL) AS new_note,
         count(*) AS n, max(updated_at) AS last_updated_at
  FROM known GROUP BY id)"""
    q["action_latest_state"] = with_ctes(ACTIONS, UPDATES, upd, body="""
SELECT a.id, a.reservation_id, coalesce(u.new_status, a.action_status) AS action_status,
       coalesce(u.new_note, a.action_note) AS action_note, CAST(coalesce(u.n, 0) AS BIGINT) AS update_count,
       u.last_updated_at
FROM actions a LEFT JOIN latest_upd u ON a.id = u.id""")
    q["action_update_rejections"] = with_ctes(ACTIONS, UPDATES, body="""
SELECT update_id, id, 'unknown_action' AS rejection_reason FROM updates WHERE id NOT IN (SELECT id FROM actions)""")

    q["layer_raw_payload"] = with_ctes(*c, body="""
SELECT source_file, source_row_number, source_file AS property_code, ReservationStatus AS reservation_status,
       CAST(try_strptime(ReservationStatusDate, '%Y-%m-%d') AS DATE) AS reservation_status_date,
       Meal AS payload_meal, DistributionChannel AS payload_channel, Agent AS payload_agent, LeadTime AS payload_lead_time,
       CAST(31 AS BIGINT) AS payload_fields
FROM raw""")
    f = [*c, _features_cte("clean", False, config.FEATURE_SET_VERSION)]
    n_payload = len(FEATURE_SELECT.split(", ")) - 5  # keys, version and id are not in the payload
    q["layer_feature_payload"] = with_ctes(*f, body=f"""
SELECT source_file, source_row_number, feature_set_version, lead_time_bucket, country_code, adr_per_guest,
       previous_cancel_ratio, CAST({n_payload} AS BIGINT) AS payload_fields
FROM feat""")
    q["layer_prediction_union"] = with_ctes(ENT, PRED, body="""
SELECT prediction_id, model_name, score, risk_class, scoring_run_id, 'test' AS meta_split_name,
       actual_no_show_flag AS meta_actual_no_show_flag, reservation_key AS meta_reservation_key,
       CAST(NULL AS VARCHAR) AS meta_snapshot_at
FROM pred""")
    counts = """
SELECT 'reservation_import_batches' AS layer, CAST(1 AS BIGINT) AS row_count
UNION ALL SELECT 'reservations_raw', CAST(count(*) AS BIGINT) FROM raw
UNION ALL SELECT 'reservations_clean', CAST(count(*) AS BIGINT) FROM clean
UNION ALL SELECT 'reservation_features', CAST(count(*) AS BIGINT) FROM clean
UNION ALL SELECT 'predictions', CAST(count(*) AS BIGINT) FROM pred"""
    q["layer_row_counts"] = with_ctes(*c, PRED, body=counts)
    q["import_batch"] = with_ctes(*c, body="""
SELECT 'driver_tables' AS source_name, string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS source_files,
       'completed' AS status, CAST(count(*) AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS error_count,
       'booking_time_v1' AS feature_set_version
FROM raw""")

    def resolve(child: str, parent: str, name: str) -> str:
        return f"""
SELECT '{name}' AS relation, CAST(count(*) AS BIGINT) AS child_rows,
       CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM {parent} p WHERE p.source_file = c.source_file
                                             AND p.source_row_number = c.source_row_number)) AS BIGINT) AS resolved_rows,
       CAST(count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.source_file = c.source_file
                                                 AND p.source_row_number = c.source_row_number)) AS BIGINT) AS unresolved_rows
FROM {child} c"""

    q["key_resolution"] = with_ctes(*c, PRED, body=" UNION ALL ".join(
        [resolve("clean", "raw", "clean_to_raw"), resolve("clean", "clean", "feature_to_clean"),
         resolve("pred", "clean", "prediction_to_clean")]))

    def dups(src: str, keys: str, name: str) -> str:
        return f"""
SELECT '{name}' AS table_name, CAST(count(*) AS BIGINT) AS duplicate_keys
FROM (SELECT {keys} FROM {src} GROUP BY {keys} HAVING count(*) > 1)"""

    q["key_uniqueness"] = with_ctes(*c, PRED, body=" UNION ALL ".join(
        [dups("raw", "source_file, source_row_number", "reservations_raw"),
         dups("clean", "source_file, source_row_number", "reservations_clean"),
         dups("pred", "prediction_id", "predictions"),
         dups("pred", "reservation_id, model_name, scored_at", "prediction_entity_time")]))
    q["latest_run_view"] = with_ctes(ENT, PRED, body="""
SELECT prediction_id, reservation_id, model_name, scoring_run_id, score, risk_class FROM pred
WHERE scoring_run_id = (SELECT max(scoring_run_id) FROM pred)""")
    q["source_resolution"] = with_ctes(ENT, PRED, body="""
SELECT CASE WHEN count(*) > 0 THEN 'database_prediction_store' ELSE 'artifact_fallback' END AS data_source,
       count(*) > 0 AS action_support_enabled, CAST(count(*) AS BIGINT) AS prediction_rows FROM pred""")
    return q


def _report_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    more = _more_queries()
    # benchmark: reuse the metric CTEs of classification_metrics
    metrics_sql = more["classification_metrics"]
    head, _, _ = metrics_sql.rpartition("SELECT * FROM metrics")
    q["benchmark_report"] = head + """,
comparison AS (
  SELECT *, row_number() OVER (ORDER BY pr_auc DESC NULLS LAST, roc_auc DESC NULLS LAST, model_name) AS comparison_rank
  FROM metrics),
versions AS (SELECT model_name, max(model_version) AS model_version FROM pred GROUP BY model_name)
SELECT c.model_name, 'trained' AS status, 'Version ' || v.model_version || ' evaluated from latest artifact.' AS notes,
       pr_auc, roc_auc, precision, recall, f1, brier_score, comparison_rank = 1 AS is_recommended,
       'time-based split: train on 1995-1999, test on 2000-2001' AS split_strategy
FROM comparison c JOIN versions v USING (model_name)"""
    r = base_rows()
    prop_label = r"""CASE WHEN code IS NULL OR trim(code) = '' THEN '-'
     WHEN regexp_matches(upper(trim(code)), '^(CITY|RESORT)_H(\d+)$') THEN
       (CASE regexp_extract(upper(trim(code)), '^(CITY|RESORT)_H(\d+)$', 1) WHEN 'CITY' THEN 'City Hotel' ELSE 'Resort Hotel' END)
       || ' ' || regexp_extract(upper(trim(code)), '^(CITY|RESORT)_H(\d+)$', 2)
     ELSE replace(trim(code), '_', ' ') END"""
    seg_label = r"""CASE WHEN regexp_matches(segment, '^top_(\d+)$') THEN 'Top ' || regexp_extract(segment, '^top_(\d+)$', 1)
     WHEN regexp_matches(segment, '^top_(\d+)(pct|_percent)$')
       THEN 'Top ' || regexp_extract(segment, '^top_(\d+)(pct|_percent)$', 1) || '%'
     ELSE replace(segment, '_', ' ') END"""
    q["presentation_labels"] = with_ctes(*r, _ranked_cte(), body=f"""
SELECT 'property' AS kind, code, {prop_label} AS label, printf('%.1f%%', rate * 100.0) AS value_text
FROM (SELECT coalesce(nullif({_strip('property_id')}, ''), 'Unknown') AS code,
             CAST(count(*) FILTER (WHERE {NOSHOW}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS rate
      FROM rows GROUP BY 1)
UNION ALL
SELECT 'segment:' || model_name AS kind, segment AS code, {seg_label} AS label,
       printf('%.1f%%', coalesce(CAST(captured_no_show AS DOUBLE) / nullif(CAST(total_no_show AS DOUBLE), 0), 0.0) * 100.0) AS value_text
FROM ({_topk_union()})""")
    return q


def oracle_sql() -> dict[str, str]:
    out = _queries()
    out.update(_report_queries())
    out.update(_more_queries())
    out.update(_action_queries())
    from riskloom.plans import answers, oracle_answers  # noqa: F401  the first registers what the second checks

    out.update(oracle_answers.queries(out))
    # the streaming ingest accepts exactly the batch path's rows
    out["action_stream_ingest"] = out["action_asof_prediction"]
    return out
