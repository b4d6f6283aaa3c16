"""Hand-written fixture rows shaped like the source application's tests."""

from pyspark.sql import types as T

RAW_COLUMNS = (
    "IsCanceled", "LeadTime", "ArrivalDateYear", "ArrivalDateMonth", "ArrivalDateWeekNumber",
    "ArrivalDateDayOfMonth", "StaysInWeekendNights", "StaysInWeekNights", "Adults", "Children", "Babies",
    "Meal", "Country", "MarketSegment", "DistributionChannel", "IsRepeatedGuest", "PreviousCancellations",
    "PreviousBookingsNotCanceled", "ReservedRoomType", "AssignedRoomType", "BookingChanges", "DepositType",
    "Agent", "Company", "DaysInWaitingList", "CustomerType", "ADR", "RequiredCarParkingSpaces",
    "TotalOfSpecialRequests", "ReservationStatus", "ReservationStatusDate", "source_file", "reservation_key",
)


def _raw_row(i, status, year, month, canceled, meal="BB       ", agent="       NULL", source="H1.csv"):
    vals = {
        "IsCanceled": canceled, "LeadTime": str(10 * i + 5), "ArrivalDateYear": str(year), "ArrivalDateMonth": month,
        "ArrivalDateWeekNumber": "27", "ArrivalDateDayOfMonth": "1", "StaysInWeekendNights": "1",
        "StaysInWeekNights": "2", "Adults": "2", "Children": "0", "Babies": "0", "Meal": meal, "Country": "PRT",
        "MarketSegment": "Online TA", "DistributionChannel": "TA/TO", "IsRepeatedGuest": "0",
        "PreviousCancellations": "0", "PreviousBookingsNotCanceled": "0", "ReservedRoomType": "A",
        "AssignedRoomType": "A", "BookingChanges": "0", "DepositType": "No Deposit", "Agent": agent,
        "Company": "NULL", "DaysInWaitingList": "0", "CustomerType": "Transient", "ADR": "100.5",
        "RequiredCarParkingSpaces": "0", "TotalOfSpecialRequests": "1", "ReservationStatus": status,
        "ReservationStatusDate": f"{year}-07-03", "source_file": source, "reservation_key": f"{source}:{i}",
    }
    return tuple(vals[c] for c in RAW_COLUMNS) + (i,)


def raw_fixture(spark):
    """Four raw rows: Check-Out 2015, No-Show 2016, Check-Out 2017, Canceled 2017; two files."""
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in RAW_COLUMNS] + [T.StructField("source_row_number", T.LongType())]
    )
    rows = [
        _raw_row(1, "Check-Out", 2015, "July", "0"),
        _raw_row(2, "No-Show", 2016, "August", "0", agent="9"),
        _raw_row(3, "Check-Out", 2017, "January", "0", source="H2.csv"),
        _raw_row(4, "Canceled", 2017, "March", "1", source="H2.csv"),
    ]
    return spark.createDataFrame(rows, schema)


SNAPSHOT_STRINGS = (
    "reservation_key", "source_file", "property_id", "arrival_month_name", "meal_plan", "country_code",
    "market_segment", "distribution_channel", "reserved_room_type", "deposit_type", "agent_code", "company_code",
    "customer_type", "snapshot_stage", "final_outcome", "arrival_date", "snapshot_at", "is_active_at_snapshot",
    "source_row_number", "lead_time_days", "arrival_year", "arrival_week_number", "arrival_day_of_month",
    "weekend_nights", "week_nights", "adults", "children", "babies", "is_repeated_guest", "previous_cancellations",
    "previous_non_cancelled_bookings", "required_car_parking_spaces", "total_special_requests",
    "days_since_booking", "days_to_arrival", "adr", "booking_changes_as_of_cutoff",
    "days_in_waiting_list_as_of_cutoff",
)


def snapshot_fixture(spark):
    """Four day-1 snapshot rows; one inactive and canceled; nulls in agent/company/optional columns."""
    def row(i, year, outcome, active, bc, wl):
        v = {
            "reservation_key": f"H1.csv:{i}", "source_file": "H1.csv", "property_id": "RESORT_H1",
            "arrival_month_name": "July", "meal_plan": "BB", "country_code": "PRT", "market_segment": "Direct",
            "distribution_channel": "Direct", "reserved_room_type": "A", "deposit_type": "No Deposit",
            "agent_code": None, "company_code": None, "customer_type": "Transient",
            "snapshot_stage": "post_booking_day_1", "final_outcome": outcome, "arrival_date": f"{year}-07-20",
            "snapshot_at": f"{year}-07-02T10:00:00+02:00", "is_active_at_snapshot": active,
            "source_row_number": str(i), "lead_time_days": "19", "arrival_year": str(year),
            "arrival_week_number": "29", "arrival_day_of_month": "20", "weekend_nights": "1", "week_nights": "2",
            "adults": "2", "children": "0", "babies": "0", "is_repeated_guest": "0", "previous_cancellations": "0",
            "previous_non_cancelled_bookings": "0", "required_car_parking_spaces": "0",
            "total_special_requests": "0", "days_since_booking": "1", "days_to_arrival": "18", "adr": "99.0",
            "booking_changes_as_of_cutoff": bc, "days_in_waiting_list_as_of_cutoff": wl,
        }
        return tuple(v[c] for c in SNAPSHOT_STRINGS)

    schema = T.StructType([T.StructField(c, T.StringType()) for c in SNAPSHOT_STRINGS])
    rows = [
        row(1, 2015, "Check-Out", "true", "0", None),
        row(2, 2016, "No-Show", "1", None, "3"),
        row(3, 2017, "Check-Out", "true", "2", "0"),
        row(4, 2017, "Canceled", "false", None, None),
    ]
    return spark.createDataFrame(rows, schema)
