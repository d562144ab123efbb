from datetime import datetime

from pyspark.sql import functions as F

from surgewatch.functions import timewin
from surgewatch.operators import rollup


def test_hour_bucket_types(spark):
    df = spark.createDataFrame([(datetime(2018, 6, 12, 8, 50, 1, 123456), "2018-06-12T08:50:01")],
                               "ntz timestamp_ntz, iso string")
    df = df.withColumn("ltz", F.col("ntz").cast("timestamp"))
    out = df.select(timewin.hour_bucket(F.col("ntz"), df.schema["ntz"].dataType).alias("a"),
                    timewin.hour_bucket(F.col("ltz"), df.schema["ltz"].dataType).alias("b"),
                    timewin.hour_bucket(F.col("iso"), df.schema["iso"].dataType).alias("c"))
    assert out.schema["a"].dataType.typeName() == "timestamp_ntz"
    r = out.collect()[0]
    assert r.a == datetime(2018, 6, 12, 8) == r.b == r.c


def test_hour_bucket_ignores_session_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30),)], "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        r = rollup.with_hour(df, "ts").collect()[0]
        e = df.select(timewin.epoch_seconds(F.col("ts"), df.schema["ts"].dataType).alias("e")).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r.hour == datetime(2024, 3, 10, 2)
    assert e.e == 1710037800   # wall-clock seconds, as if UTC


def _edges(spark):
    anchor = datetime(2018, 6, 12, 8, 50, 1)
    data = [(1, datetime(2018, 3, 14, 8, 50, 1)),   # exactly anchor - 90 d
            (2, datetime(2018, 3, 14, 8, 50, 2)),
            (3, datetime(2018, 6, 12, 8, 50, 0)),
            (4, anchor),                             # exactly the anchor
            (5, datetime(2018, 3, 14, 8, 50, 0))]
    return spark.createDataFrame(data, "id int, ts timestamp_ntz"), anchor


def test_lookback_bounds(spark):
    df, anchor = _edges(spark)
    dtype = df.schema["ts"].dataType

    def ids(bounds):
        return sorted(r.id for r in df.filter(timewin.lookback(F.col("ts"), dtype, anchor, 90, bounds)).collect())

    assert ids("[)") == [1, 2, 3]
    assert ids("(]") == [2, 3, 4]
    assert ids("[]") == [1, 2, 3, 4]
    assert ids("()") == [2, 3]


def test_lookback_is_pushed_to_parquet(spark, tmp_dir):
    df, anchor = _edges(spark)
    df.write.parquet(f"{tmp_dir}/e")
    back = spark.read.parquet(f"{tmp_dir}/e")
    plan = back.filter(timewin.lookback(F.col("ts"), back.schema["ts"].dataType, anchor, 90))._jdf \
        .queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan


def test_add_months_clips_day():
    assert timewin.add_months(datetime(2024, 3, 31, 5), -1) == datetime(2024, 2, 29, 5)
    assert timewin.add_months(datetime(2024, 1, 15), -1) == datetime(2023, 12, 15)
    assert timewin.add_months(datetime(2023, 12, 15), 1) == datetime(2024, 1, 15)


def test_relative_month_and_day_range(spark):
    data = [(1, datetime(2000, 3, 1, 0, 0)), (2, datetime(2000, 3, 1, 12, 0)), (3, datetime(2000, 4, 1, 0, 0)),
            (4, datetime(2000, 4, 1, 11, 59)), (5, datetime(2000, 4, 1, 12, 0))]
    df = spark.createDataFrame(data, "id int, ts timestamp_ntz")
    dtype = df.schema["ts"].dataType
    now = "2000-04-01T12:00:00"
    month = sorted(r.id for r in df.filter(timewin.relative_month(F.col("ts"), dtype, now)).collect())
    month_open = sorted(r.id for r in df.filter(timewin.relative_month(F.col("ts"), dtype, now, 1, "(]")).collect())
    days = sorted(r.id for r in df.filter(timewin.day_range(F.col("ts"), dtype, now)).collect())
    assert month == [2, 3, 4]
    assert month_open == [3, 4, 5]
    assert days == [1, 2]   # today's rows fall out with day-precision dates


def test_invalid_arguments_raise(spark):
    import pytest

    from surgewatch.operators import baseline
    from tests.helpers import HISTORY_SCHEMA

    df = spark.createDataFrame([(datetime(2024, 1, 1),)], "ts timestamp_ntz")
    with pytest.raises(ValueError, match="bounds"):
        timewin.lookback(F.col("ts"), df.schema["ts"].dataType, "2024-01-02T00:00:00", 1, "[[")
    hist = spark.createDataFrame([(1, "A", "2024-01", 1.0)], HISTORY_SCHEMA)
    with pytest.raises(ValueError, match="method"):
        baseline.latest_rows(hist, method="nope")
