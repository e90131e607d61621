import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronopanel.functions import time as T


@pytest.fixture(scope="module")
def calendar(spark):
    return T.number_sessions(T.exchange_calendar(spark, dt.date(2013, 1, 1), dt.date(2026, 12, 31))).cache()


def test_full_range_has_a_row_a_day_and_no_faults(calendar):
    assert calendar.count() == 5113
    assert T.calendar_faults(calendar).count() == 0


def test_holiday_early_close_and_weekend(calendar):
    days = {r["date"].isoformat(): r for r in calendar.where("date between '2024-07-03' and '2024-07-06'").select("*", F.date_format("session_close", "HH:mm").alias("at")).collect()}
    assert not days["2024-07-04"].is_session and not days["2024-07-06"].is_session
    assert days["2024-07-03"].is_early_close and days["2024-07-03"]["at"] == "17:00"


def test_advance_counts_sessions(calendar):
    got = {(r["date"].isoformat(), r.horizon): r.target.isoformat() for r in T.advance(calendar).where("date in ('2024-01-12', '2024-07-02', '2024-01-02')").collect()}
    assert got["2024-01-12", 5] == "2024-01-22" and got["2024-07-02", 5] == "2024-07-10"
    assert [got["2024-01-02", h] for h in T.HORIZONS] == ["2024-01-09", "2024-02-01", "2024-04-03", "2024-07-03", "2025-01-02"]


def test_other_horizons_are_an_error(calendar):
    with pytest.raises(ValueError):
        T.advance(calendar, (1,))


def test_a_gap_is_named(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, d), False, None) for d in (12, 13, 14, 16)], "date date, is_session boolean, session_close timestamp")
    assert [(r["date"].isoformat(), r.fault) for r in T.calendar_faults(rows).collect()] == [("2024-01-15", "missing")]


def test_policy_instants_follow_daylight_saving(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2024, 7, 2),)], "d date")
    got = [r[0] for r in days.select(F.date_format(T.date_at_time(F.col("d"), 18), "HH:mm")).collect()]
    assert got == ["23:00", "22:00"]
    with pytest.raises(ValueError):
        T.plus_duration(F.col("d"))
