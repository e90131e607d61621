"""Availability rules and session arithmetic as column expressions and small calendar tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

ZONE = "America/New_York"
HORIZONS = (5, 21, 63, 126, 252)


def date_at_time(day: Column, hour: int, minute: int = 0, zone: str = ZONE) -> Column:
    """The instant of a wall-clock time on a day in a zone."""
    return F.make_timestamp(F.year(day), F.month(day), F.day(day), F.lit(hour), F.lit(minute), F.lit(0), F.lit(zone))


def local_date(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone).cast("date")


def plus_duration(ts: Column, hours: int = 0, minutes: int = 0) -> Column:
    """ts + a duration, which must be positive."""
    if hours * 60 + minutes <= 0:
        raise ValueError("durations are positive")
    return ts + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(minutes))


def plus_duration_or(base: Column, after: tuple[int, int], fallback: Column, fallback_after: tuple[int, int] | None = None) -> Column:
    """base + duration, or the fallback where there is no base."""
    return F.coalesce(plus_duration(base, *after), plus_duration(fallback, *fallback_after) if fallback_after else fallback)


def market_timing(ts: Column, is_session: Column, zone: str = ZONE) -> Column:
    """bmo before 09:30, amc from 16:00, rth between, non_trading_day off sessions."""
    local = F.date_format(F.from_utc_timestamp(ts, zone), "HH:mm:ss")
    return F.when(~is_session, "non_trading_day").when(local < "09:30:00", "bmo").when(local >= "16:00:00", "amc").otherwise("rth")


def visible(available_at: Column, policy_at: Column, asof: Column) -> Column:
    """Known at ``asof`` by both the row's own instant and the policy's."""
    return F.greatest(available_at, policy_at) <= asof


def active(day: Column, valid_from: Column, valid_to: Column) -> Column:
    """Inclusive interval, open where valid_to is null."""
    return (valid_from <= day) & (valid_to.isNull() | (day <= valid_to))


def overlaps(start: Column, end: Column, valid_from: Column, valid_to: Column) -> Column:
    return (valid_from <= end) & (valid_to.isNull() | (valid_to >= start))


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    first = dt.date(year, month, 1)
    return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def _easter(year: int) -> dt.date:
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    x = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * x) // 451
    month, day = divmod(h + x - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


#: Single closings of the exchange in the supported years.
SPECIAL_CLOSINGS = [dt.date(2018, 12, 5), dt.date(2025, 1, 9)]


def exchange_holidays(year: int) -> set[dt.date]:
    """Full-day closings: observed on Friday or Monday at weekends, except New Year's Day on a Saturday."""
    fixed = [dt.date(year, 7, 4), dt.date(year, 12, 25)] + ([dt.date(year, 6, 19)] if year >= 2022 else [])
    observed = {d - dt.timedelta(1) if d.weekday() == 5 else d + dt.timedelta(d.weekday() == 6) for d in fixed}
    new_year = dt.date(year, 1, 1)
    if new_year.weekday() != 5:
        observed.add(new_year + dt.timedelta(new_year.weekday() == 6))
    last_may = dt.date(year, 5, 31)
    moving = [_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), _easter(year) - dt.timedelta(2), last_may - dt.timedelta(last_may.weekday()), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4)]
    return observed | {*moving} | {d for d in SPECIAL_CLOSINGS if d.year == year}


def early_closes(year: int) -> set[dt.date]:
    """13:00 closings: before Independence Day, after Thanksgiving, on Christmas Eve, where these are sessions."""
    days = {_nth(year, 11, 3, 4) + dt.timedelta(1)}
    if dt.date(year, 7, 4).weekday() not in (0, 5, 6):
        days.add(dt.date(year, 7, 3))
    if dt.date(year, 12, 24).weekday() < 4:
        days.add(dt.date(year, 12, 24))
    return {d for d in days if d.weekday() < 5 and d not in exchange_holidays(year)}


def exchange_calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """(date, is_session, session_close, is_early_close), one row a day; the rules above as a tiny table."""
    years = range(start.year, end.year + 1)
    closed = spark.createDataFrame([(d,) for y in years for d in sorted(exchange_holidays(y))], "holiday date")
    early = spark.createDataFrame([(d,) for y in years for d in sorted(early_closes(y))], "early date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    rows = days.join(F.broadcast(closed), F.col("date") == F.col("holiday"), "left").join(F.broadcast(early), F.col("date") == F.col("early"), "left")
    session = (F.weekday("date") < 5) & F.col("holiday").isNull()
    close = F.when(F.col("early").isNotNull(), date_at_time(F.col("date"), 13)).otherwise(date_at_time(F.col("date"), 16))
    rows = rows.select("date", session.alias("is_session"), F.when(session, close).alias("session_close"), (session & F.col("early").isNotNull()).alias("is_early_close"))
    return rows


def number_sessions(calendar: DataFrame) -> DataFrame:
    """Adds idx (sessions from 0, null on other days) and next_session (strictly after); a calendar is one row a day."""
    order = Window.orderBy("date")
    idx = F.sum(F.col("is_session").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    after = F.min(F.when(F.col("is_session"), F.col("date"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return calendar.withColumn("idx", F.when(F.col("is_session"), idx)).withColumn("next_session", after)


def advance(calendar: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(date, horizon, target): the session ``horizon`` sessions on, by an equi-join on session numbers."""
    if not set(horizons) <= set(HORIZONS):
        raise ValueError(f"horizons are {HORIZONS}")
    own = calendar.where("is_session").select("date", "idx", F.explode(F.array(*[F.lit(h).cast("bigint") for h in horizons])).alias("horizon"))
    target = calendar.where("is_session").select(F.col("date").alias("target"), F.col("idx").alias("t_idx"))
    return own.join(target, F.col("idx") + F.col("horizon") == F.col("t_idx")).select("date", "horizon", "target")


def advance_checked(days: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """``days`` (date) with ``target``; a day without a calendar row, one that is no session and one too near the end raise."""
    if horizon not in HORIZONS:
        raise ValueError(f"horizons are {HORIZONS}")
    own = calendar.select("date", "is_session", "idx")
    target = calendar.where("is_session").select(F.col("date").alias("target"), (F.col("idx") - horizon).alias("idx"))
    rows = days.join(own, "date", "left").join(target, "idx", "left")
    fault = F.when(F.col("is_session").isNull(), "no calendar row for ").when(~F.col("is_session"), "not a session: ").when(F.col("target").isNull(), "calendar ends after ")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col("date").cast("string"))).cast("date")).otherwise(F.col("target"))
    return rows.select("date", checked.alias("target"))


def candidate_dates(calendar: DataFrame, start=None, end=None, cutoff: Column | None = None, hour: int = 18) -> DataFrame:
    """Sessions within the bounds that are set, whose closing prices are visible by the cutoff, if there is one."""
    rows = calendar.where("is_session")
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    if cutoff is not None:
        rows = rows.where(date_at_time(F.col("date"), hour) <= cutoff)
    return rows.select("date", "idx")


def calendar_faults(calendar: DataFrame) -> DataFrame:
    """(date, fault): missing or repeated days, sessions without a close, other days with one."""
    bounds = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("date"))
    missing = days.join(calendar, "date", "left_anti").select("date", F.lit("missing").alias("fault"))
    repeated = calendar.groupBy("date").count().where("count > 1").select("date", F.lit("repeated").alias("fault"))
    close = calendar.where("is_session <> (session_close is not null)").select("date", F.lit("close").alias("fault"))
    return missing.union(repeated).union(close)


def next_session_open(day: Column, calendar: DataFrame, rows: DataFrame, hour: int = 9, minute: int = 30) -> DataFrame:
    """``rows`` with available_at: hour:minute at the first session strictly after ``day``; the calendar has one row a day."""
    keyed = calendar.select(F.col("date").alias("__day"), "next_session")
    return rows.join(keyed, day == F.col("__day"), "left").withColumn("available_at", date_at_time(F.col("next_session"), hour, minute)).drop("__day")
