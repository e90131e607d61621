"""Features and labels over a dense panel: every offset is a count of sessions."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.window import WindowSpec

HORIZONS = (5, 21, 63, 126, 252)
#: Named price features: (lookback, skip, direction of selection).
PRICE_FEATURES = {
    "momentum_12_1": (252, 21, "high"), "momentum_6_1": (126, 21, "high"), "return_63_0": (63, 0, "high"), "return_21_0": (21, 0, "low"),
}


def by_security() -> WindowSpec:
    return Window.partitionBy("security_id").orderBy("idx")


def definition_hash(name: str, version: int, kind: str, spec: dict) -> str:
    """SHA-256 of the definition as JSON with sorted keys and no spaces."""
    body = {"computation_spec": spec, "kind": kind, "name": name, "version": version}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def definition_hash_column(name: Column, version: Column, kind: Column, spec: Column) -> Column:
    """``definition_hash`` of rows; the fields of ``spec`` are in the order of their names."""
    body = F.struct(spec.alias("computation_spec"), kind.alias("kind"), name.alias("name"), version.alias("version"))
    return F.sha2(F.to_json(body), 256)


def price_return(spine: DataFrame, lookback: int, skip: int = 0) -> DataFrame:
    """Adds value and status: price[t - skip] / price[t - lookback] - 1, or why there is none."""
    if lookback <= 0 or not 0 <= skip < lookback:
        raise ValueError("lookback must be positive and skip lie below it")
    late, early = (F.lag("price", k).over(by_security()) if k else F.col("price") for k in (skip, lookback))
    rows = spine.withColumn("late", late).withColumn("early", early)
    status = F.when(F.col("idx") < lookback, "insufficient_history").when(F.col("late").isNull() | F.col("early").isNull(), "missing_price").otherwise("ok")
    return rows.withColumn("status", status).withColumn("value", F.when(F.col("status") == "ok", F.col("late") / F.col("early") - 1)).drop("late", "early")


def avg_dollar_volume(spine: DataFrame, sessions: int = 63) -> DataFrame:
    """Adds value and status: mean of price * volume over the last ``sessions``, all of them present."""
    frame = by_security().rowsBetween(1 - sessions, 0)
    rows = spine.withColumn("prices", F.count("price").over(frame)).withColumn("volumes", F.count("volume").over(frame))
    rows = rows.withColumn("mean", F.avg(F.col("price") * F.col("volume")).over(frame))
    status = (
        F.when(F.col("idx") < sessions - 1, "insufficient_history").when(F.col("prices") < sessions, "missing_price")
        .when(F.col("volumes") < sessions, "missing_volume").otherwise("ok")
    )
    return rows.withColumn("status", status).withColumn("value", F.when(F.col("status") == "ok", F.col("mean"))).drop("prices", "volumes", "mean")


def realized_volatility(spine: DataFrame, returns: int = 63, sessions_a_year: int = 252) -> DataFrame:
    """Adds value and status: annualised sample deviation of the last ``returns`` simple returns, none missing."""
    steps = spine.withColumn("step", F.col("price") / F.lag("price").over(by_security()) - 1)
    frame = by_security().rowsBetween(1 - returns, 0)
    rows = steps.withColumn("present", F.count("step").over(frame)).withColumn("sd", F.stddev_samp("step").over(frame))
    status = F.when(F.col("idx") < returns, "insufficient_history").when(F.col("present") < returns, "missing_price").otherwise("ok")
    value = F.when(F.col("status") == "ok", F.col("sd") * math.sqrt(sessions_a_year))
    return rows.withColumn("status", status).withColumn("value", value).drop("step", "present", "sd")


def forward_labels(spine: DataFrame, horizons: tuple[int, ...] = HORIZONS, benchmark: DataFrame | None = None) -> DataFrame:
    """One row per security, session and horizon: raw and excess forward return, or the first reason for none.

    benchmark: (session, b_price); an excess return needs both benchmark prices, and is null, never zero, without."""
    last = spine.agg(F.max("idx").alias("last_idx"))
    rows = spine.join(F.broadcast(last), F.lit(True))
    if benchmark is None:
        rows = rows.withColumn("b_price", F.lit(None).cast("double"))
    else:
        rows = rows.join(benchmark, "session", "left")  # one row a session; adaptive execution sees its size
    ahead = F.array(*[
        F.struct(F.lit(h).cast("bigint").alias("horizon"), F.lead("session", h).over(by_security()).alias("horizon_session"), F.lead("price", h).over(by_security()).alias("end_price"), F.lead("b_price", h).over(by_security()).alias("b_end"))
        for h in horizons
    ])
    rows = rows.withColumn("ahead", ahead).select("*", F.explode("ahead").alias("to")).select("*", "to.*").drop("ahead", "to")
    reason = (
        F.when(F.col("price").isNull(), "missing_asof_price").when(F.col("price") <= 0, "invalid_asof_price")
        .when(F.col("idx") + F.col("horizon") > F.col("last_idx"), "insufficient_calendar_history")
        .when(F.col("end_price").isNull(), "missing_target_price").when(F.col("end_price") <= 0, "invalid_target_price")
    )
    rows = rows.withColumn("skip_reason", reason).withColumn("raw_return", F.when(reason.isNull(), F.col("end_price") / F.col("price") - 1))
    measured = (F.col("b_price") > 0) & (F.col("b_end") > 0)
    return rows.withColumn("excess_return", F.when(measured, F.col("raw_return") - (F.col("b_end") / F.col("b_price") - 1)))


def samples(spine: DataFrame, lookback: int, skip: int, horizon: int, direction: str = "high") -> DataFrame:
    """(security_id, asof, idx, horizon_session, feature, ret): a price feature and its forward return in one window pass.

    The rows are those of the join of the feature's ``ok`` rows with the labels that aren't skipped."""
    ahead = price_return(spine, lookback, skip).withColumn("end_price", F.lead("price", horizon).over(by_security())).withColumn("horizon_session", F.lead("session", horizon).over(by_security()))
    rows = ahead.where("status = 'ok' and price > 0 and end_price > 0 and horizon_session is not null")
    value = -F.col("value") if direction == "low" else F.col("value")
    return rows.select("security_id", F.col("session").alias("asof"), "idx", "horizon_session", value.alias("feature"), (F.col("end_price") / F.col("price") - 1).alias("ret"))


def label_availability(close: Column, sources: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """(available_at, policy): the latest of the target close and the sources' instants; the first wins a tie."""
    latest = F.greatest(close, *[ts for ts, _ in sources])
    policy = F.lit("session_close")
    for ts, name in reversed(sources):
        policy = F.when(ts == latest, name).otherwise(policy)
    return latest, F.when(close == latest, F.lit("session_close")).otherwise(policy)


def coverage_status(asof: Column, target: Column) -> Column:
    """Why a benchmark return is or isn't there."""
    return (
        F.when(asof.isNull(), "missing_asof_price").when(target.isNull(), "missing_target_price")
        .when((asof <= 0) | (target <= 0), "unavailable_return").otherwise("covered")
    )


def newest_visible(events: DataFrame, asof: DataFrame, order: list[str], payload: list[str]) -> DataFrame:
    """As-of join: for each (security_id, ts) of ``asof``, the greatest ``order`` among events with ts at or before it.

    events: security_id, ts, order and payload columns.  Both sides are one stream per security and the running maximum
    is taken along it: no range join, one shuffle, and an old period that is published late doesn't displace a newer
    one."""
    packed = F.struct(*[F.col(c) for c in [*order, *payload]])
    stream = events.select("security_id", "ts", F.lit(0).alias("kind"), packed.alias("state")).unionByName(
        asof.select("security_id", "ts").withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    running = F.max("state").over(Window.partitionBy("security_id").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return stream.withColumn("seen", running).where("kind = 1").select("security_id", "ts", "seen.*")


def ratio_events(metrics: DataFrame, numerator: str, denominator: str = "revenue") -> DataFrame:
    """A period becomes usable when both metrics are visible and the denominator isn't zero."""
    key = ["security_id", "fiscal_year", "fiscal_period", "period_end"]
    both = metrics.where(F.col("metric_name").isin(numerator, denominator)).groupBy(*key).agg(
        F.max_by("metric_value", F.when(F.col("metric_name") == numerator, F.lit(1))).alias("top"),
        F.max_by("metric_value", F.when(F.col("metric_name") == denominator, F.lit(1))).alias("base"),
        F.max("available_at").alias("ts"),
    )
    return both.where("top is not null and base is not null and base <> 0").withColumn("value", F.col("top") / F.col("base")).select(*key, "ts", "value")


def growth_events(metrics: DataFrame, metric: str) -> DataFrame:
    """A period becomes usable when it and the same quarter a year before are visible and the latter isn't zero."""
    own = metrics.where(F.col("metric_name") == metric).select("security_id", "fiscal_year", "fiscal_period", "period_end", "available_at", "metric_value")
    prior = own.select("security_id", (F.col("fiscal_year") + 1).alias("fiscal_year"), "fiscal_period", F.col("available_at").alias("p_at"), F.col("metric_value").alias("p_value"))
    joined = own.join(prior, ["security_id", "fiscal_year", "fiscal_period"]).where("p_value <> 0")
    return joined.select("security_id", "fiscal_year", "fiscal_period", "period_end", F.greatest("available_at", "p_at").alias("ts"), (F.col("metric_value") / F.col("p_value") - 1).alias("value"))
