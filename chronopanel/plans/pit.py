"""Queries of point-in-time features, labels, calendars and policies, with their DuckDB equivalents."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from chronopanel.functions import policies
from chronopanel.functions import time as T
from chronopanel.operators import income as INC
from chronopanel.operators import panel as P
from chronopanel.operators import pit as PIT
from chronopanel.plans.catalogue import (
    BY, CAL, FUND, INCOME_MODIFIED, PD, PW, QUERIES, ORACLE_SQL, STAMP, big, income_metrics, income_sql, order_calendar, panel_of, query, quoted, r8, weekly,
)
from chronopanel.session import once
from chronopanel.sources import tables as S


def ny(day: str, hour: str) -> str:
    return f"timezone('UTC', timezone('America/New_York', CAST({day} AS TIMESTAMP) + INTERVAL ({hour}) HOUR))"


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# ---------------------------------------------------------------- price features

KNOWN = f"""{PW}, known AS (SELECT *, {ny('session', '18')} AS visible_at, {ny('session', '18')} + CASE WHEN (security_id + idx) % 11 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END AS known_at,
  CASE WHEN security_id % 7 = 3 AND idx % 97 = 0 THEN NULL ELSE volume END AS vol FROM spine),
vis AS (SELECT DISTINCT idx, visible_at FROM known),
asofs AS (SELECT security_id, {ny('session', 'h')} AS asof FROM spine, (SELECT unnest([12, 19]) AS h) WHERE idx % 10 = 5),
anch AS (SELECT a.security_id, a.asof, v.idx AS anchor FROM asofs a ASOF LEFT JOIN vis v ON a.asof >= v.visible_at)"""
SHOWN = f"security_id, {stamp('asof')} AS asof, anchor, round(CASE WHEN status = 'ok' THEN value END, 8) AS value, status, CASE WHEN status = 'ok' THEN {stamp('asof')} END AS available_at"


def known_panel(spark, sf_dir):
    """The weekly panel with the instant from which each price is known, some days late; and volumes with gaps."""

    def make():
        at = T.date_at_time(F.col("session"), 18)
        late = F.when((F.col("security_id") + F.col("idx")) % 11 == 0, F.make_dt_interval(F.lit(3))).otherwise(F.make_dt_interval(F.lit(0)))
        volume = F.when(~((F.col("security_id") % 7 == 3) & (F.col("idx") % 97 == 0)), F.col("volume"))
        return weekly(spark, sf_dir).withColumn("visible_at", at).withColumn("known_at", at + late).withColumn("volume", volume)

    return once(spark, f"known:{sf_dir}", make)


def price_asofs(spark, sf_dir):
    """Noon and evening of every tenth session, anchored."""
    grid = known_panel(spark, sf_dir)
    instants = F.explode(F.array(T.date_at_time(F.col("session"), 12), T.date_at_time(F.col("session"), 19))).alias("asof")
    return PIT.anchored(grid.where("idx % 10 = 5").select("security_id", instants), grid.select("idx", "visible_at").distinct())


def shown(rows):
    return rows.select("security_id", F.date_format("asof", STAMP).alias("asof"), "anchor", r8("value"), "status", F.date_format("available_at", STAMP).alias("available_at"))


def _pit_return(name: str, lookback: int, skip: int) -> None:
    def run(spark, sf_dir):
        return shown(PIT.price_return_at(price_asofs(spark, sf_dir), known_panel(spark, sf_dir), lookback, skip))

    QUERIES[f"pit_{name}"] = run
    ORACLE_SQL[f"pit_{name}"] = quoted(f"""WITH {KNOWN}, v AS (SELECT a.security_id, a.asof, anchor, l.price / e.price - 1 AS value,
  CASE WHEN anchor IS NULL OR anchor < {lookback} THEN 'insufficient_history' WHEN l.price IS NULL OR e.price IS NULL THEN 'missing_price' ELSE 'ok' END AS status
  FROM anch a LEFT JOIN known l ON l.security_id = a.security_id AND l.idx = anchor - {skip} AND l.known_at <= a.asof
  LEFT JOIN known e ON e.security_id = a.security_id AND e.idx = anchor - {lookback} AND e.known_at <= a.asof) SELECT {SHOWN} FROM v""")


for _name, (_lookback, _skip, _) in P.PRICE_FEATURES.items():
    _pit_return(_name, _lookback, _skip)


@query(f"""WITH {KNOWN}, w AS (SELECT security_id, idx, count(price) {BY} ROWS 62 PRECEDING) AS n, count(vol) {BY} ROWS 62 PRECEDING) AS vols, max(known_at) {BY} ROWS 62 PRECEDING) AS newest, avg(price * vol) {BY} ROWS 62 PRECEDING) AS value FROM known),
v AS (SELECT a.security_id, a.asof, anchor, value, CASE WHEN anchor IS NULL OR anchor < 62 THEN 'insufficient_history' WHEN n < 63 OR newest > a.asof THEN 'missing_price' WHEN vols < 63 THEN 'missing_volume' ELSE 'ok' END AS status
  FROM anch a LEFT JOIN w ON w.security_id = a.security_id AND w.idx = anchor) SELECT {SHOWN.replace('END, 8)', 'END, 6)')} FROM v""")
def pit_avg_dollar_volume_63(spark, sf_dir):
    rows = PIT.avg_dollar_volume_at(price_asofs(spark, sf_dir), known_panel(spark, sf_dir))
    return rows.select("security_id", F.date_format("asof", STAMP).alias("asof"), "anchor", F.round("value", 6).alias("value"), "status", F.date_format("available_at", STAMP).alias("available_at"))


@query(f"""WITH {KNOWN}, r AS (SELECT *, price / lag(price) {BY}) - 1 AS step FROM known),
w AS (SELECT security_id, idx, count(step) {BY} ROWS 62 PRECEDING) AS n, max(known_at) {BY} ROWS 63 PRECEDING) AS newest, stddev_samp(step) {BY} ROWS 62 PRECEDING) * sqrt(252) AS value FROM r),
v AS (SELECT a.security_id, a.asof, anchor, value, CASE WHEN anchor IS NULL OR anchor < 63 THEN 'insufficient_history' WHEN n < 63 OR newest > a.asof THEN 'missing_price' ELSE 'ok' END AS status
  FROM anch a LEFT JOIN w ON w.security_id = a.security_id AND w.idx = anchor) SELECT {SHOWN} FROM v""")
def pit_realized_volatility_63(spark, sf_dir):
    return shown(PIT.realized_volatility_at(price_asofs(spark, sf_dir), known_panel(spark, sf_dir)))


@query(f"WITH {KNOWN} SELECT DISTINCT {stamp('asof')} AS asof, anchor FROM anch")
def pit_anchor(spark, sf_dir):
    return price_asofs(spark, sf_dir).select(F.date_format("asof", STAMP).alias("asof"), "anchor").distinct()


# ---------------------------------------------------------------- fundamental features

INSTANTS = ["1994-01-01", "1995-05-12", "1996-03-31", "1997-02-10", "1998-02-11", "1999-12-31", "2001-06-30"]
FASOFS = f"fasofs AS (SELECT DISTINCT security_id, CAST(d AS TIMESTAMP) AS asof FROM wide, (SELECT unnest([{', '.join(f'DATE {d!r}' for d in INSTANTS)}]) AS d))"


def _pit_income(name: str) -> None:
    def run(spark, sf_dir):
        metrics = income_metrics(spark, sf_dir)
        asofs = S.fundamentals(spark, sf_dir).select(big("security_id")).distinct().select("security_id", F.explode(F.array(*[F.lit(d).cast("timestamp") for d in INSTANTS])).alias("asof"))
        rows = PIT.income_feature(metrics, asofs, name)
        return rows.select("security_id", F.date_format("asof", STAMP).alias("asof"), "fiscal_year", "fiscal_period", r8("value"), "status", F.date_format("available_at", STAMP).alias("available_at"))

    QUERIES[f"pit_{name}"] = run
    sql = f"WITH {FUND}, {INCOME_MODIFIED}, {FASOFS}, {income_sql(name, 'fasofs')} SELECT security_id, {stamp('asof')} AS asof, fiscal_year, fiscal_period, round(value, 8) AS value, status, {stamp('available_at')} AS available_at FROM income"
    ORACLE_SQL[f"pit_{name}"] = quoted(sql)


for _name in (*INC.MARGINS, *INC.GROWTH):
    _pit_income(_name)


# ---------------------------------------------------------------- labels

LABELS = f"""{CAL}, {PD},
lcal AS (SELECT date, is_session, idx, CASE WHEN is_session AND day(date) <> 13 THEN {ny('date', '16')} END AS close FROM numbered),
lp AS (SELECT security_id, session AS date, CASE WHEN (security_id + day(session)) % 29 = 0 THEN 0 ELSE price END AS price, {ny('session', '18')} + CASE WHEN security_id % 5 = 0 AND day(session) = 7 THEN INTERVAL 5 DAY ELSE INTERVAL 0 DAY END AS shown_at,
  CASE WHEN security_id % 5 = 0 AND day(session) = 7 THEN 'late_price' ELSE 'daily_price' END AS policy FROM pw),
lb AS (SELECT date, price, shown_at, 'benchmark_price' AS policy FROM lp WHERE security_id = 1),
la AS (SELECT security_id, date AS label_date FROM (SELECT DISTINCT security_id FROM pw), (SELECT date FROM numbered WHERE dayofyear(date) % 9 = 0 UNION ALL SELECT DATE '1990-01-01')),
lr AS (SELECT a.security_id, a.label_date, h AS horizon, t.date AS horizon_date, p.price AS p, q.price AS q, b.price AS b, e.price AS e, t.close, q.shown_at AS q_at, b.shown_at AS b_at, e.shown_at AS e_at, q.policy AS q_policy,
  CASE WHEN c.date IS NULL THEN 'missing_calendar_row' WHEN NOT c.is_session THEN 'non_session_asof' WHEN p.price IS NULL THEN 'missing_asof_price' WHEN p.price <= 0 THEN 'invalid_asof_price' WHEN t.date IS NULL THEN 'insufficient_calendar_history'
    WHEN q.price IS NULL THEN 'missing_target_price' WHEN q.price <= 0 THEN 'invalid_target_price' WHEN t.close IS NULL THEN 'missing_target_session_close' END AS skip_reason
  FROM la a CROSS JOIN (SELECT CAST(unnest([5, 21, 63, 126, 252]) AS BIGINT) AS h) LEFT JOIN lcal c ON c.date = a.label_date LEFT JOIN lcal t ON t.idx = c.idx + h
  LEFT JOIN lp p ON p.security_id = a.security_id AND p.date = a.label_date LEFT JOIN lp q ON q.security_id = a.security_id AND q.date = t.date LEFT JOIN lb b ON b.date = a.label_date LEFT JOIN lb e ON e.date = t.date),
lk AS (SELECT *, greatest(close, q_at, b_at, e_at) AS known FROM lr),
lab AS (SELECT security_id, label_date, horizon, horizon_date, skip_reason, CASE WHEN skip_reason IS NULL THEN q / p - 1 END AS raw_return, CASE WHEN skip_reason IS NULL AND b > 0 AND e > 0 THEN q / p - e / b END AS excess_return,
  CASE WHEN skip_reason IS NULL THEN known END AS available_at, CASE WHEN skip_reason IS NULL THEN CASE WHEN close = known THEN 'session_close' WHEN q_at = known THEN q_policy ELSE 'benchmark_price' END END AS policy FROM lk)"""


def labels_at(spark, sf_dir, cutoff=None):
    def make():
        days = once(spark, f"days:{sf_dir}", lambda: order_calendar(spark, sf_dir))
        calendar = days.withColumn("session_close", F.when(F.col("is_session") & (F.day("date") != 13), T.date_at_time(F.col("date"), 16)))
        prices = panel_of(spark, sf_dir, "day")
        late = (F.col("security_id") % 5 == 0) & (F.day("session") == 7)
        at = T.date_at_time(F.col("session"), 18) + F.when(late, F.make_dt_interval(F.lit(5))).otherwise(F.make_dt_interval(F.lit(0)))
        rows = prices.select(
            "security_id", F.col("session").alias("date"), F.when((F.col("security_id") + F.day("session")) % 29 == 0, 0.0).otherwise(F.col("price")).alias("price"), at.alias("available_at"), F.when(late, "late_price").otherwise("daily_price").alias("policy"))
        benchmark = rows.where("security_id = 1").select("date", "price", "available_at", F.lit("benchmark_price").alias("policy"))
        dates = days.where(F.dayofyear("date") % 9 == 0).select("date").union(spark.sql("SELECT DATE'1990-01-01'"))
        asofs = prices.select("security_id").distinct().join(dates.withColumnRenamed("date", "label_date"), F.lit(True))
        return PIT.label_rows(asofs, calendar, rows, benchmark=benchmark, cutoff=None if cutoff is None else F.lit(cutoff).cast("timestamp"))

    return once(spark, f"labels:{cutoff}:{sf_dir}", make)


@query(f"WITH {LABELS} SELECT security_id, label_date, horizon, horizon_date, round(raw_return, 8) AS raw_return, round(excess_return, 8) AS excess_return, {stamp('available_at')} AS available_at, policy FROM lab WHERE skip_reason IS NULL")
def pit_labels(spark, sf_dir):
    rows = labels_at(spark, sf_dir).where("skip_reason is null")
    return rows.select("security_id", "label_date", "horizon", "horizon_date", r8("raw_return"), r8("excess_return"), F.date_format("available_at", STAMP).alias("available_at"), "policy")


@query(f"WITH {LABELS} SELECT coalesce(skip_reason, 'ok') AS reason, horizon, count(*) AS n FROM lab GROUP BY 1, 2")
def pit_label_reasons(spark, sf_dir):
    return labels_at(spark, sf_dir).groupBy(F.coalesce("skip_reason", F.lit("ok")).alias("reason"), "horizon").agg(F.count("*").alias("n"))


CUTOFF = "1998-06-07 12:00:00"


CUT_LABELS = LABELS.replace("'daily_price' END AS policy FROM pw)", f"'daily_price' END AS policy FROM pw WHERE {ny('session', '18')} + CASE WHEN security_id % 5 = 0 AND day(session) = 7 THEN INTERVAL 5 DAY ELSE INTERVAL 0 DAY END <= TIMESTAMP '{CUTOFF}')")


@query(f"WITH {CUT_LABELS} SELECT coalesce(skip_reason, 'ok') AS reason, count(*) AS n, count(excess_return) AS excess, max({stamp('available_at')}) AS newest FROM lab GROUP BY 1")
def pit_label_cutoff(spark, sf_dir):
    """Labels from the prices that were available by a cutoff."""
    rows = labels_at(spark, sf_dir, CUTOFF)
    return rows.groupBy(F.coalesce("skip_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), F.count("excess_return").alias("excess"), F.date_format(F.max("available_at"), STAMP).alias("newest"))


@query(f"WITH {LABELS} SELECT min(label_date) AS first_label, max(label_date) AS last_label, count(DISTINCT security_id) AS securities, count(DISTINCT label_date) AS dates, min(horizon_date) AS first_target, max(horizon_date) AS last_target FROM lab WHERE skip_reason IS NULL")
def label_input_bounds(spark, sf_dir):
    rows = labels_at(spark, sf_dir).where("skip_reason is null")
    return rows.agg(F.min("label_date").alias("first_label"), F.max("label_date").alias("last_label"), F.countDistinct("security_id").alias("securities"), F.countDistinct("label_date").alias("dates"), F.min("horizon_date").alias("first_target"), F.max("horizon_date").alias("last_target"))


# ---------------------------------------------------------------- calendars and policies


@query(f"WITH {CAL} SELECT date, idx FROM numbered WHERE is_session AND date >= DATE '1997-03-01' AND {ny('date', '18')} <= TIMESTAMP '1997-09-10 12:00:00'")
def candidate_dates(spark, sf_dir):
    days = once(spark, f"days:{sf_dir}", lambda: order_calendar(spark, sf_dir))
    return T.candidate_dates(days, start="1997-03-01", cutoff=F.lit("1997-09-10 12:00:00").cast("timestamp"))


@query(f"WITH {CAL} SELECT date, idx FROM numbered WHERE is_session AND date <= DATE '1995-06-30'")
def calendar_to_end(spark, sf_dir):
    """The calendar up to a bound, the others being open."""
    return T.candidate_dates(once(spark, f"days:{sf_dir}", lambda: order_calendar(spark, sf_dir)), end="1995-06-30")


@query(f"WITH {CAL}, last AS (SELECT max(idx) AS idx FROM numbered WHERE is_session AND date <= DATE '1997-06-15') SELECT a.date AS last_session, b.date AS price_end FROM last JOIN numbered a ON a.idx = last.idx LEFT JOIN numbered b ON b.idx = last.idx + 252")
def label_price_end(spark, sf_dir):
    """The last session of a label range and the session up to which its longest horizon needs prices."""
    days = once(spark, f"days:{sf_dir}", lambda: order_calendar(spark, sf_dir))
    last = T.candidate_dates(days, end="1997-06-15").agg(F.max("date").alias("date"))
    return T.advance_checked(last, days, 252).select(F.col("date").alias("last_session"), F.col("target").alias("price_end"))


@query(f"""WITH {CAL} SELECT e.event_id, {stamp(ny('n.next_session', '9.5').replace('INTERVAL (9.5) HOUR', 'INTERVAL 570 MINUTE'))} AS available_at
FROM (SELECT event_id, ts - INTERVAL 9497 DAY AS ts FROM events) e LEFT JOIN numbered n ON n.date = CAST(timezone('America/New_York', timezone('UTC', e.ts)) AS DATE)""")
def pol_filing(spark, sf_dir):
    """Filings become usable at the open of the session after their New York date, from the instant of their acceptance."""
    days = once(spark, f"days:{sf_dir}", lambda: order_calendar(spark, sf_dir))
    rows = S.events(spark, sf_dir).select("event_id", (F.col("ts") - F.make_dt_interval(F.lit(9497))).alias("accepted_at"))
    return policies.apply(rows, policies.POLICIES["sec_10q_filing"], days).select("event_id", F.date_format("available_at", STAMP).alias("available_at"))


@query(f"""SELECT event_id, {stamp("CASE event_type WHEN 'click' THEN ts + INTERVAL 30 MINUTE WHEN 'view' THEN ts + INTERVAL 5 MINUTE WHEN 'purchase' THEN ts ELSE coalesce(CASE WHEN value >= 50 THEN ts END + INTERVAL 2 HOUR, ts) END")} AS available_at FROM events""")
def pol_by_name(spark, sf_dir):
    """Each kind of event by the policy of its name: durations, pass-through, and a duration with a fallback."""
    e = S.events(spark, sf_dir).withColumn("call_end_time", F.when(F.col("value") >= 50, F.col("ts")))
    named = {"click": "sec_8k_material", "view": "news_timestamped", "purchase": "fmp_profile_static_data"}
    columns = {"accepted_at": "ts", "published_at": "ts", "fetched_at": "ts"}
    out = None
    for kind, name in [*named.items(), (None, "earnings_call_transcript")]:
        rows = e.where(F.col("event_type") == kind) if kind else e.where(~F.col("event_type").isin(*named))
        part = policies.apply(rows, policies.POLICIES[name], columns=columns).select("event_id", F.date_format("available_at", STAMP).alias("available_at"))
        out = part if out is None else out.union(part)
    return out


#: Which policy dates an order, by its priority.
_BY_PRIORITY = {"1-URGENT": "sec_8k_material", "2-HIGH": "sec_10q_filing", "3-MEDIUM": "sec_10k_filing", "4-NOT SPECIFIED": "daily_price", "5-LOW": "corporate_action"}


@query("WITH p(name, rule_type) AS (VALUES " + ", ".join(f"('{n}', '{r['type']}')" for n, r in sorted(policies.POLICIES.items())) + "), m(priority, name) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _BY_PRIORITY.items()) + """)
SELECT p.name, CAST(1 AS BIGINT) AS version, rule_type, count(o_orderkey) AS orders FROM p LEFT JOIN m ON m.name = p.name LEFT JOIN orders ON o_orderpriority = priority GROUP BY ALL""")
def policy_table(spark, sf_dir):
    """The validated policy set, and how many orders each policy dates."""
    found = policies.validate(spark, policies.default_config())
    table = spark.createDataFrame([(p["name"], p["version"], p["rule"]["type"]) for p in found], "name string, version bigint, rule_type string")
    named = F.create_map(*[x for k, v in _BY_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    used = S.load(spark, sf_dir, "orders").groupBy(named[F.col("o_orderpriority")].alias("name")).agg(F.count("*").alias("orders"))
    return table.join(used, "name", "left").select("name", "version", "rule_type", F.coalesce("orders", F.lit(0)).alias("orders"))


_ODD = """k AS (SELECT c_custkey AS k, c_custkey // 4 AS config, c_custkey % 4 AS place FROM customer),
pol AS (SELECT *, CASE WHEN k % 9 = 8 THEN '' ELSE 'p' || (k // 2) END AS name, CASE WHEN k % 13 = 12 THEN 0 WHEN k % 10 < 2 THEN 1 ELSE 1 + k % 2 END AS version, ['date_at_time', 'fetched_at', 'timestamp_plus_duration', 'odd'][1 + k % 4] AS kind,
  CASE WHEN k % 17 = 16 THEN 'soon' ELSE '2010-01-01T00:00:00Z' END AS since, CASE WHEN k % 11 = 3 THEN '2009-01-01T00:00:00Z' WHEN k % 11 = 4 THEN '2020-01-01T00:00:00Z' END AS until FROM k)"""


@query(f"""WITH {_ODD}, f AS (SELECT config, place, name, unnest([CASE WHEN config % 5 = 4 AND place = 0 THEN 'set_version' END, CASE WHEN name = '' THEN 'no_name' END, CASE WHEN version = 0 THEN 'version' END, CASE WHEN kind = 'odd' THEN 'rule_type' END,
  CASE WHEN kind = 'fetched_at' AND k % 5 = 0 THEN 'rule_lacks' END, CASE WHEN kind = 'date_at_time' AND k % 7 = 0 OR kind = 'timestamp_plus_duration' AND k % 6 = 0 THEN 'rule_form' END, CASE WHEN since = 'soon' THEN 'valid_from' END,
  CASE WHEN until < since AND since <> 'soon' THEN 'valid_to' END, CASE WHEN count(*) OVER (PARTITION BY config, name, version) > 1 THEN 'repeated' END]) AS fault FROM pol)
SELECT CAST(config AS BIGINT) AS config, CAST(place AS BIGINT) AS place, name, fault FROM f WHERE fault IS NOT NULL UNION ALL SELECT CAST(config AS BIGINT), NULL, 'p0', 'missing' FROM pol GROUP BY config HAVING count(*) FILTER (WHERE name = 'p0' AND version = 1) = 0""")
def policy_faults(spark, sf_dir):
    """All faults of policy sets, a set of four for each four customers."""
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("date_at_time", "fetched_at", "timestamp_plus_duration", "odd"))), (k % 4 + 1).cast("int"))
    rule = F.create_map(
        F.lit("type"), kind, F.when((k % 4 == 1) & (k % 5 == 0), "other").otherwise("base"), F.lit("x"), F.lit("timezone"), F.lit(policies.NEW_YORK),
        F.lit("time"), F.when((k % 4 == 0) & (k % 7 == 0), "6pm").otherwise("18:00"), F.lit("duration"), F.when((k % 4 == 2) & (k % 6 == 0), "30m").otherwise("PT30M"))
    policy = F.struct(
        F.when(k % 9 == 8, "").otherwise(F.concat(F.lit("p"), F.expr("c_custkey div 2").cast("string"))).alias("name"), F.when(k % 13 == 12, 0).when(k % 10 < 2, 1).otherwise((1 + k % 2).cast("int")).alias("version"), rule.alias("rule"),
        F.when(k % 17 == 16, "soon").otherwise("2010-01-01T00:00:00Z").alias("valid_from"), F.when(k % 11 == 3, "2009-01-01T00:00:00Z").when(k % 11 == 4, "2020-01-01T00:00:00Z").alias("valid_to"))
    sets = S.load(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 4").alias("config")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", policy.alias("policy"))), lambda a, b: (a["c_custkey"] - b["c_custkey"]).cast("int")).alias("p"))  # four each
    version = F.when(F.col("config") % 5 == 4, 2).otherwise(1).alias("policy_set_version")
    configs = sets.select("config", F.to_json(F.struct(version, F.col("p.policy").alias("policies"))).alias("body"))
    return policies.policy_faults(policies.policy_rows(configs), ("p0",)).select("config", big("place"), "name", "fault")


@query("""SELECT e.event_id, CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 1 WHEN ts < TIMESTAMP '2024-01-15' THEN 2 WHEN ts >= TIMESTAMP '2024-01-20' THEN 3 END::BIGINT AS version FROM events e""")
def policy_versions_at(spark, sf_dir):
    """The version of a policy that held at each event: one after another, with a gap."""
    spans = [(1, "2010-01-01T00:00:00Z", "2024-01-10T00:00:00Z"), (2, "2024-01-08T00:00:00Z", "2024-01-15T00:00:00Z"), (3, "2024-01-20T00:00:00Z", None)]
    config = {"policy_set_version": 1, "policies": [{"name": "news", "version": v, "rule": {"type": "fetched_at", "base": "x"}, "valid_from": a, "valid_to": b} for v, a, b in spans]}
    rows = policies.policy_rows(spark.createDataFrame([(0, json.dumps(config))], "config int, body string"))
    e = S.events(spark, sf_dir).select(F.lit("news").alias("name"), F.col("ts").alias("at"), "event_id")
    return policies.active_policies(rows, e).select("event_id", big("version"))


#: Full-day closings of the exchange in 2024, and its early closes.
HOLIDAYS_2024 = ["2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25"]
EARLY_2024 = ["2024-07-03", "2024-11-29", "2024-12-24"]
_NY_DAYS = "ny AS (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS local FROM events), closed AS (SELECT CAST(unnest([" + ", ".join(f"'{d}'" for d in [*HOLIDAYS_2024, "2023-12-25"]) + "]) AS DATE) AS day)"


@query(f"""WITH {_NY_DAYS}, e AS (SELECT CAST(local AS DATE) AS day, count(*) AS n FROM ny GROUP BY 1), d AS (SELECT day, n, isodow(day) < 6 AND day NOT IN (SELECT day FROM closed) AS open FROM e)
SELECT CAST(year(day) AS BIGINT) AS year, CAST(month(day) AS BIGINT) AS month, count(*) AS days, count(*) FILTER (WHERE open) AS sessions, CAST(sum(n) AS BIGINT) AS events, CAST(coalesce(sum(n) FILTER (WHERE open), 0) AS BIGINT) AS on_sessions FROM d GROUP BY ALL""")
def exchange_years(spark, sf_dir):
    """Days with events by month, and how many of days and events are on sessions of the exchange."""
    e = S.events(spark, sf_dir).groupBy(T.local_date(F.col("ts")).alias("date")).agg(F.count("*").alias("n"))
    d = e.join(exchange_days(spark), "date")
    return d.groupBy(F.year("date").cast("bigint").alias("year"), F.month("date").cast("bigint").alias("month")).agg(
        F.count("*").alias("days"), F.count_if("is_session").alias("sessions"), F.sum("n").alias("events"), F.coalesce(F.sum(F.when(F.col("is_session"), F.col("n"))), F.lit(0)).alias("on_sessions"))


def exchange_days(spark):
    """The exchange's calendar of the years that events are of."""
    return T.exchange_calendar(spark, dt.date(2023, 1, 1), dt.date(2025, 12, 31))


@query(f"""WITH {_NY_DAYS} SELECT event_id, CASE WHEN isodow(local) > 5 OR CAST(local AS DATE) IN (SELECT day FROM closed) THEN 'non_trading_day' WHEN strftime(local, '%H:%M:%S') < '09:30:00' THEN 'bmo' WHEN strftime(local, '%H:%M:%S') >= '16:00:00' THEN 'amc' ELSE 'rth' END AS timing FROM ny""")
def release_timing(spark, sf_dir):
    """When a release was out against the session of its New York day, by the exchange's calendar."""
    e = S.events(spark, sf_dir).select("event_id", "ts", T.local_date(F.col("ts")).alias("date"))
    return e.join(exchange_days(spark).select("date", "is_session"), "date").select("event_id", T.market_timing(F.col("ts"), F.col("is_session")).alias("timing"))


@query("""WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders), d AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM b),
c AS (SELECT date, isodow(date) < 6 AS is_session, isodow(date) < 6 AND day(date) <> 13 AS has_close FROM d WHERE NOT (day(date) = 20 AND month(date) = 3) UNION ALL SELECT date, isodow(date) < 6, isodow(date) < 6 AND day(date) <> 13 FROM d WHERE day(date) = 5 AND month(date) = 7)
SELECT fault, count(*) AS n FROM (SELECT 'missing' AS fault FROM d WHERE day(date) = 20 AND month(date) = 3 AND date BETWEEN (SELECT min(date) FROM c) AND (SELECT max(date) FROM c) UNION ALL SELECT 'repeated' FROM c GROUP BY date HAVING count(*) > 1
UNION ALL SELECT 'close' FROM c WHERE is_session <> has_close) GROUP BY 1""")
def calendar_faults(spark, sf_dir):
    """A calendar with missing and repeated days and sessions without a close: what its check says."""
    days = once(spark, f"days:{sf_dir}", lambda: order_calendar(spark, sf_dir)).select("date", "is_session")
    close = F.when(F.col("is_session") & (F.day("date") != 13), T.date_at_time(F.col("date"), 16))
    broken = days.where(~((F.day("date") == 20) & (F.month("date") == 3))).union(days.where((F.day("date") == 5) & (F.month("date") == 7))).withColumn("session_close", close)
    return T.calendar_faults(broken).groupBy("fault").agg(F.count("*").alias("n"))

