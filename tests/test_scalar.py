"""Scalar functions (O-55..O-59, O-61, O-66)."""

import datetime as dt

from pyspark.sql import functions as F

from topicscope.functions.scalar import (epoch_to_ts, iso_to_ts, strip_unicode, truncate_cp,
                                         ts_to_iso)


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first().r


def test_truncate_counts_code_points(spark):
    s = "😀" * 400
    assert one(spark, s, truncate_cp) == "😀" * 300


def test_strip_unicode_whitespace(spark):
    assert one(spark, "   hi there\t　\n", strip_unicode) == "hi there"
    assert one(spark, "\t\t ", strip_unicode) == ""


def test_epoch_and_iso(spark):
    assert one(spark, 1.5, epoch_to_ts, "v double") == dt.datetime(1970, 1, 1, 0, 0, 1, 500000)
    assert one(spark, 0, epoch_to_ts, "v long") == dt.datetime(1970, 1, 1)
    assert one(spark, "2024-03-01T12:00:00+02:00", iso_to_ts) == dt.datetime(2024, 3, 1, 10)
    assert one(spark, "2024-03-01T12:00:00.250Z", iso_to_ts) == dt.datetime(2024, 3, 1, 12, 0, 0, 250000)
    assert one(spark, "2024-03-01T12:00:00", iso_to_ts) == dt.datetime(2024, 3, 1, 12)
    assert one(spark, "yesterday", iso_to_ts) is None
    assert one(spark, "2024-03-01", iso_to_ts) == dt.datetime(2024, 3, 1)
    assert one(spark, "2024-03-01T10:30Z", iso_to_ts) == dt.datetime(2024, 3, 1, 10, 30)
    assert one(spark, "2024-03-01T00:00:00.123456789Z", iso_to_ts) == dt.datetime(2024, 3, 1, 0, 0, 0, 123456)
    ts = dt.datetime(2024, 3, 1, 12, 0, 0, 42)
    assert one(spark, ts, ts_to_iso, "v timestamp_ntz") == "2024-03-01T12:00:00.000042+00:00"
    assert one(spark, dt.datetime(2024, 3, 1), ts_to_iso, "v timestamp_ntz") == "2024-03-01T00:00:00+00:00"


def test_time_functions_ignore_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        assert one(spark, "2024-03-01T12:00:00Z", iso_to_ts) == dt.datetime(2024, 3, 1, 12)
        assert one(spark, 60, epoch_to_ts, "v long") == dt.datetime(1970, 1, 1, 0, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_datetime_literals_ignore_session_and_process_zone(spark):
    from topicscope.operators.filters import lookback
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.createDataFrame([(dt.datetime(2024, 3, 1, 12),), (dt.datetime(2024, 3, 1, 9),)],
                                   "created_at timestamp_ntz")
        kept = [r.created_at for r in lookback(df, dt.datetime(2024, 3, 1, 13), hours=2).collect()]
        assert kept == [dt.datetime(2024, 3, 1, 12)]
        aware = dt.datetime(2024, 3, 1, 14, tzinfo=dt.timezone(dt.timedelta(hours=1)))  # 13:00 UTC
        kept = [r.created_at for r in lookback(df, aware, hours=2).collect()]
        assert kept == [dt.datetime(2024, 3, 1, 12)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
