from pyspark.sql import functions as F

from riskloom import functions as RF


def _one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(expr(F.col("x")).alias("y")).first()[0]


def test_cleanse_text_strips_unicode_whitespace_and_tokens(spark):
    df = spark.createDataFrame([("  BB\t ",), ("       NULL",), ("N/A",), ("NA ",), (" x ",), (None,)], "x string")
    out = [r[0] for r in df.select(RF.cleanse_text("x")).collect()]
    assert out == ["BB", None, None, None, "x", None]


def test_tolerant_number_rejects_spark_only_literals(spark):
    df = spark.createDataFrame([("12",), ("1.5d",), ("-3.25",), (".5",), ("1e3",), ("abc",), (None,)], "x string")
    out = [r[0] for r in df.select(RF.tolerant_number("x")).collect()]
    assert out == [12.0, None, -3.25, 0.5, 1000.0, None, None]


def test_date_from_parts_invalid_is_null(spark):
    df = spark.createDataFrame(
        [(2015.0, 2, 28.0), (2015.0, 2, 30.0), (None, 1, 1.0), (2016.0, None, 1.0), (2016.0, 2, 29.0), (2015.5, 1, 1.0)],
        "y double, m int, d double",
    )
    out = [r[0] for r in df.select(RF.date_from_parts("y", "m", "d")).collect()]
    assert [str(x) if x else None for x in out] == ["2015-02-28", None, None, None, "2016-02-29", None]


def test_lead_time_bucket_is_right_closed(spark):
    vals = [-5.0, 0.0, 1.0, 3.0, 4.0, 7.0, 14.0, 30.0, 31.0, 90.0, 180.0, 365.0, 366.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = [r[0] for r in df.select(RF.lead_time_bucket("x")).collect()]
    assert out == [
        "same_day", "same_day", "1_3_days", "1_3_days", "4_7_days", "4_7_days", "8_14_days", "15_30_days",
        "31_90_days", "31_90_days", "91_180_days", "181_365_days", "365_plus", None,
    ]


def test_risk_class_thresholds_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,), (0.35,), (0.3499,), (None,)], "x double")
    assert [r[0] for r in df.select(RF.risk_class("x")).collect()] == ["high", "medium", "medium", "low", None]


def test_safe_rate_zero_and_negative_denominator(spark):
    df = spark.createDataFrame([(1, 0), (1, -2), (1, 4)], "n long, d long")
    assert [r[0] for r in df.select(RF.safe_rate("n", "d")).collect()] == [0.0, 0.0, 0.25]


def test_dimension_key_trim_and_fallback(spark):
    df = spark.createDataFrame([(" TA/TO ",), ("",), (None,), ("  ",)], "x string")
    assert [r[0] for r in df.select(RF.dimension_key("x")).collect()] == ["TA/TO", "Unknown", "Unknown", "Unknown"]
    assert [r[0] for r in df.select(RF.dimension_key("x", trim=False)).collect()] == [" TA/TO ", "Unknown", "Unknown", "  "]


def test_labels(spark):
    df = spark.createDataFrame([("CITY_H2",), ("resort_h1",), ("UNKNOWN_PROPERTY",), (None,)], "x string")
    assert [r[0] for r in df.select(RF.property_label("x")).collect()] == [
        "City Hotel 2", "Resort Hotel 1", "UNKNOWN PROPERTY", "-",
    ]
    seg = spark.createDataFrame([("top_50",), ("top_5pct",), ("top_10_percent",), ("other_x",)], "x string")
    assert [r[0] for r in seg.select(RF.segment_label("x")).collect()] == ["Top 50", "Top 5%", "Top 10%", "other x"]
