"""Point-in-time features and labels: as-of rows see only what was known at their instant.

Prices carry ``known_at``, the later of the row's own availability and its policy's.  An as-of row is anchored at the
newest session that the policy shows by then; offsets count sessions back from the anchor, so every lookup is an equi-join
on (security_id, idx), and a price that was not known yet is as missing as one that never was.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronopanel.operators.income import income_features
from chronopanel.operators.panel import HORIZONS, by_security, label_availability


def anchored(asofs: DataFrame, sessions: DataFrame) -> DataFrame:
    """``asofs`` (security_id, asof) with ``anchor``: the number of the newest session visible at the instant, null before the first.

    sessions: idx, visible_at.  An as-of meets its own day's row of a table that has a row for every day of the calendar: the
    sessions that become visible on that day, and the newest one before it.  So as-ofs are neither sorted nor shuffled, and
    the table, a row a day, is what is sent to them."""
    day = lambda c: F.unix_date(c.cast("timestamp_ntz").cast("date"))
    own = sessions.groupBy(day(F.col("visible_at")).alias("day")).agg(F.collect_list(F.struct("visible_at", "idx")).alias("shown"), F.max("idx").alias("newest"))
    span = own.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", "b")).alias("day")).join(own, "day", "left")
    calendar = days.withColumn("before", F.max("newest").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)))
    last = own.agg(F.max("newest").alias("last"), F.max("day").alias("end"))
    rows = asofs.withColumn("__day", day(F.col("asof"))).join(F.broadcast(calendar.drop("newest").withColumnRenamed("day", "__day")), "__day", "left").join(F.broadcast(last), F.lit(True), "left")
    today = F.array_max(F.transform(F.filter("shown", lambda x: x["visible_at"] <= F.col("asof")), lambda x: x["idx"]))
    return rows.withColumn("anchor", F.when(F.col("__day") > F.col("end"), F.col("last")).otherwise(F.greatest(today, "before"))).drop("__day", "shown", "before", "last", "end")


def price_return_at(asofs: DataFrame, prices: DataFrame, lookback: int, skip: int = 0) -> DataFrame:
    """(security_id, asof, anchor, value, status, available_at) of anchored as-ofs; prices: security_id, idx, price, known_at."""
    if lookback <= 0 or not 0 <= skip < lookback:
        raise ValueError("lookback must be positive and skip lie below it")

    def at(name: str, back: int) -> DataFrame:
        return prices.where("price is not null").select("security_id", (F.col("idx") + back).alias("anchor"), F.col("price").alias(name), F.col("known_at").alias(f"{name}_at"))

    rows = asofs.join(at("late", skip), ["security_id", "anchor"], "left").join(at("early", lookback), ["security_id", "anchor"], "left")
    seen = lambda c: F.col(c).isNotNull() & (F.col(f"{c}_at") <= F.col("asof"))
    status = F.when(F.col("anchor").isNull() | (F.col("anchor") < lookback), "insufficient_history").when(~(seen("late") & seen("early")), "missing_price").otherwise("ok")
    return _valued(rows.withColumn("status", status), F.col("late") / F.col("early") - 1)


def _valued(rows: DataFrame, value) -> DataFrame:
    ok = F.col("status") == "ok"
    return rows.select("security_id", "asof", "anchor", F.when(ok, value).alias("value"), "status", F.when(ok, F.col("asof")).alias("available_at"))


def avg_dollar_volume_at(asofs: DataFrame, spine: DataFrame, sessions: int = 63) -> DataFrame:
    """The mean of price * volume over the last sessions up to the anchor, all of them known; spine: dense, with known_at."""
    frame = by_security().rowsBetween(1 - sessions, 0)
    rolled = spine.select(
        "security_id", F.col("idx").alias("anchor"), F.count("price").over(frame).alias("prices"), F.count("volume").over(frame).alias("volumes"),
        F.max("known_at").over(frame).alias("newest"), F.avg(F.col("price") * F.col("volume")).over(frame).alias("mean"))
    rows = asofs.join(rolled, ["security_id", "anchor"], "left")
    status = (
        F.when(F.col("anchor").isNull() | (F.col("anchor") < sessions - 1), "insufficient_history")
        .when(F.col("prices").isNull() | (F.col("prices") < sessions) | (F.col("newest") > F.col("asof")), "missing_price").when(F.col("volumes") < sessions, "missing_volume").otherwise("ok")
    )
    return _valued(rows.withColumn("status", status), F.col("mean"))


def realized_volatility_at(asofs: DataFrame, spine: DataFrame, returns: int = 63, sessions_a_year: int = 252) -> DataFrame:
    """The annualised sample deviation of the last simple returns up to the anchor, all their prices known."""
    steps = spine.withColumn("step", F.col("price") / F.lag("price").over(by_security()) - 1)
    frame, held = by_security().rowsBetween(1 - returns, 0), by_security().rowsBetween(-returns, 0)
    rolled = steps.select(
        "security_id", F.col("idx").alias("anchor"), F.count("step").over(frame).alias("present"), F.max("known_at").over(held).alias("newest"), F.stddev_samp("step").over(frame).alias("sd"))
    rows = asofs.join(rolled, ["security_id", "anchor"], "left")
    status = (
        F.when(F.col("anchor").isNull() | (F.col("anchor") < returns), "insufficient_history")
        .when(F.col("present").isNull() | (F.col("present") < returns) | (F.col("newest") > F.col("asof")), "missing_price").otherwise("ok")
    )
    return _valued(rows.withColumn("status", status), F.col("sd") * math.sqrt(sessions_a_year))


def income_feature(metrics: DataFrame, asofs: DataFrame, name: str) -> DataFrame:
    """``income.income_features`` of one name, without its column."""
    return income_features(metrics, asofs, (name,)).drop("feature")


def label_rows(asofs: DataFrame, calendar: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = HORIZONS, benchmark: DataFrame | None = None, cutoff=None) -> DataFrame:
    """One row per as-of and horizon: returns, when and by which policy they became known, or the first reason for none.

    asofs: security_id, label_date; calendar: date, is_session, idx, session_close; prices: security_id, date, price,
    available_at, policy; benchmark: date, price, available_at, policy.  Only prices available by ``cutoff`` are read, if
    there is one.  A label is known when its target session has closed and all its prices are available."""
    if cutoff is not None:
        prices = prices.where(F.col("available_at") <= cutoff)
        benchmark = benchmark.where(F.col("available_at") <= cutoff) if benchmark is not None else None
    rows = asofs.join(calendar.select(F.col("date").alias("label_date"), "is_session", "idx"), "label_date", "left")
    rows = rows.withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("bigint") for h in horizons])))
    target = calendar.where("is_session").select(F.col("idx").alias("t_idx"), F.col("date").alias("horizon_date"), F.col("session_close").alias("horizon_close"))
    rows = rows.join(target, F.col("idx") + F.col("horizon") == F.col("t_idx"), "left")

    def priced(rows: DataFrame, table: DataFrame, keys: list[str], place: str, name: str) -> DataFrame:
        side = table.select(*keys, F.col("date").alias(place), F.col("price").alias(name), F.col("available_at").alias(f"{name}_at"), F.col("policy").alias(f"{name}_policy"))
        return rows.join(side, [*keys, place], "left")

    rows = priced(priced(rows, prices, ["security_id"], "label_date", "p"), prices, ["security_id"], "horizon_date", "q")
    if benchmark is None:
        for c in ("b", "e"):
            rows = rows.withColumns({c: F.lit(None).cast("double"), f"{c}_at": F.lit(None).cast("timestamp"), f"{c}_policy": F.lit(None).cast("string")})
    else:
        rows = priced(priced(rows, benchmark, [], "label_date", "b"), benchmark, [], "horizon_date", "e")
    reason = (
        F.when(F.col("is_session").isNull(), "missing_calendar_row").when(~F.col("is_session"), "non_session_asof").when(F.col("p").isNull(), "missing_asof_price")
        .when(F.col("p") <= 0, "invalid_asof_price").when(F.col("horizon_date").isNull(), "insufficient_calendar_history").when(F.col("q").isNull(), "missing_target_price")
        .when(F.col("q") <= 0, "invalid_target_price").when(F.col("horizon_close").isNull(), "missing_target_session_close")
    )
    raw = F.when(reason.isNull(), F.col("q") / F.col("p") - 1)
    covered = (F.col("b") > 0) & (F.col("e") > 0)
    known, policy = label_availability(F.col("horizon_close"), [(F.col(f"{c}_at"), F.col(f"{c}_policy")) for c in ("q", "b", "e")])
    return rows.select(
        "security_id", "label_date", "horizon", "horizon_date", reason.alias("skip_reason"), raw.alias("raw_return"), F.when(reason.isNull() & covered, F.col("q") / F.col("p") - F.col("e") / F.col("b")).alias("excess_return"),
        F.when(reason.isNull(), known).alias("available_at"), F.when(reason.isNull(), policy).alias("policy"))
