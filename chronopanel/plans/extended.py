"""Queries of connectors, histories, regressions, order statistics and portfolios, with their DuckDB equivalents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from chronopanel.operators import backtest as B
from chronopanel.operators import drawdown as DD
from chronopanel.operators import income as INC
from chronopanel.operators import independence as I
from chronopanel.operators import panel as P
from chronopanel.operators import ranks, runs, supersession
from chronopanel.operators import records as RC
from chronopanel.operators import regression as G
from chronopanel.plans.catalogue import (
    BASE, FUND, HORIZON, INCOME_MODIFIED, LOOKBACK, ORACLE_SQL, PW, QUERIES, REGIMES, SKIP, STAMP, STEP, TEST, TRAIN, _REGIME_SQL, _WINDOW_COLUMNS, _windows, big, candidate_values, candidates_sql,
    income_metrics, joined, joined_sql, label_sql, query, quoted, r8, scores_sql, scramble_samples, scramble_sql, splits_for, splits_sql, weekly, windows_sql,
)
from chronopanel.plans.pit import FASOFS, INSTANTS, stamp
from chronopanel.plans.registry import _exact_sql, fresh
from chronopanel.session import once, stage
from chronopanel.sources import connector, vendor
from chronopanel.sources import tables as S

# ---------------------------------------------------------------- connectors

#: How a customer's requests fare: the attempt that succeeds (0: none does) and what those before it give (null: no response).
_FARES = """CASE WHEN k % 17 = 9 THEN 0 WHEN k % 19 = 4 THEN 0 WHEN k % 11 = 5 THEN 3 WHEN k % 13 = 6 THEN 2 WHEN k % 7 = 3 THEN 2 ELSE 1 END"""
_FAILS = """CASE WHEN k % 17 = 9 THEN 404 WHEN k % 19 = 4 THEN 500 WHEN k % 11 = 5 THEN 429 WHEN k % 13 = 6 THEN NULL ELSE 503 END"""
ORDERS_BODY = "array<struct<id:bigint,status:string,total:double,day:string>>"


def fetched(spark, sf_dir):
    """Every attempt of two requests a customer, answered from landed responses of which some fail first and some always."""

    def make():
        orders = S.load(spark, sf_dir, "orders")
        one = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
        of_customer = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.to_json(F.collect_list(one)).alias("body"))  # one customer's
        customers = S.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.to_json(F.struct("c_custkey", "c_nationkey", "c_mktsegment")).alias("profile"))
        told = customers.join(of_customer, "k", "left").withColumns({"good": F.expr(_FARES), "bad": F.expr(_FAILS)})
        bodies = F.explode(F.array(F.struct(F.lit("orders").alias("endpoint"), F.coalesce("body", F.lit("[]")).alias("body")), F.struct(F.lit("profile").alias("endpoint"), F.col("profile").alias("body")))).alias("r")
        tries = F.explode(F.expr("sequence(1, if(good = 0, 3, good))")).alias("attempt")
        rows = told.select(F.col("k").cast("string").alias("symbol"), "good", "bad", tries, "body", "profile").select("*", bodies)
        ok = F.col("attempt") == F.col("good")
        answers = rows.select("r.endpoint", "symbol", "attempt", F.when(ok, 200).otherwise(F.col("bad")).alias("status"), F.when(ok, F.col("r.body")).otherwise("try again").alias("body"))
        folder, plan = fresh(spark, "landed"), fresh(spark, "requests")
        buckets = max(1, customers.count() // 1000)
        connector.land_attempts(answers, folder, buckets)
        asked = customers.select(F.lit("tables").alias("source"), F.explode(F.array(F.lit("orders"), F.lit("profile"))).alias("endpoint"), F.col("k").cast("string").alias("symbol"), F.lit("{}").alias("params"))
        connector.plan_requests(connector.checked_requests(asked), plan, place=connector.place_of(buckets))
        return connector.fetch(spark, plan, "chronopanel.sources.connector:Landed", folder=folder, first_pause="0")

    return once(spark, f"fetched:{sf_dir}", make)


@query(f"""WITH c AS (SELECT c_custkey AS k, c_nationkey, {_FARES} AS good FROM customer)
SELECT o_orderkey, k AS custkey, CAST(c_nationkey AS BIGINT) AS nationkey, o_orderstatus, round(o_totalprice, 2) AS total, CAST(o_orderdate AS DATE) AS day, CAST(good AS BIGINT) AS attempts FROM orders JOIN c ON o_custkey = k WHERE good > 0""")
def src_connector(spark, sf_dir):
    """Orders and customers read back through the connector: those of customers whose requests succeed in the end."""
    got = connector.responses(fetched(spark, sf_dir))
    profile = got.where("endpoint = 'profile'").select(F.from_json("body", "c_custkey bigint, c_nationkey bigint").alias("p")).select("p.*")
    orders = got.where("endpoint = 'orders'").select(F.col("symbol").cast("bigint").alias("custkey"), "attempt", F.explode(F.from_json("body", ORDERS_BODY)).alias("o"))
    rows = orders.join(profile, F.col("custkey") == F.col("c_custkey"))
    return rows.select(F.col("o.id").alias("o_orderkey"), "custkey", F.col("c_nationkey").alias("nationkey"), F.col("o.status").alias("o_orderstatus"), F.round("o.total", 2).alias("total"), F.to_date("o.day").alias("day"), F.col("attempt").cast("bigint").alias("attempts"))


@query(f"""WITH c AS (SELECT {_FARES} AS good, {_FAILS} AS bad FROM (SELECT c_custkey AS k FROM customer)),
a AS (SELECT *, unnest(generate_series(1, CASE WHEN good > 0 THEN good WHEN bad = 404 THEN 1 ELSE 3 END)) AS attempt FROM c), e AS (SELECT unnest(['orders', 'profile']) AS endpoint)
SELECT endpoint, CAST(attempt AS BIGINT) AS attempt, CAST(CASE WHEN attempt = good THEN 200 ELSE bad END AS BIGINT) AS status, attempt = good OR bad IS NOT DISTINCT FROM 404 OR attempt = 3 AS final, attempt <> good AND bad IS NULL AS failed, count(*) AS n FROM a, e GROUP BY ALL""")
def src_connector_attempts(spark, sf_dir):
    """What the vault gets before anything is parsed: every attempt, failed ones too."""
    return fetched(spark, sf_dir).groupBy("endpoint", big("attempt"), big("status"), "final", F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"))


@query(f"""WITH {FUND} SELECT lpad(CAST(security_id AS VARCHAR), 10, '0') AS cik, metric_name, fiscal_year, fiscal_period, period_end, round(metric_value, 2) AS metric_value, period_end + 40 AS filed
FROM long WHERE metric_name IN ('revenue', 'net_income') AND security_id % 4 <> 1 OR metric_name = 'gross_profit' AND fiscal_period <> 'Q4'""")
def src_companyfacts(spark, sf_dir):
    """Fundamentals packed as company facts and read back; some lack a tag, some facts are of another form or unit."""
    tags = {"revenue": "Revenues", "net_income": "NetIncomeLoss", "gross_profit": "GrossProfit"}
    f = S.fundamentals(spark, sf_dir).where(F.col("metric_name").isin(*tags) & ((F.col("metric_name") == "gross_profit") | (F.col("security_id") % 4 != 1)))
    form = F.when((F.col("metric_name") == "gross_profit") & (F.col("fiscal_period") == "Q4"), "8-K").otherwise("10-Q")
    fact = F.struct(F.col("period_end").cast("string").alias("end"), F.col("metric_value").alias("val"), F.lit("0000000000-00-000001").alias("accn"), F.col("fiscal_year").cast("int").alias("fy"), F.col("fiscal_period").alias("fp"), form.alias("form"), F.date_add("period_end", 40).cast("string").alias("filed"))
    facts = f.groupBy("security_id", "metric_name").agg(F.collect_list(fact).alias("facts"))  # one company's quarters
    units = F.struct(F.create_map(F.lit("USD"), F.col("facts"), F.lit("shares"), F.slice("facts", 1, 1)).alias("units"))
    tag = F.create_map(*[x for name, t in tags.items() for x in (F.lit(name), F.lit(t))])[F.col("metric_name")]
    body = facts.groupBy("security_id").agg(F.map_from_entries(F.collect_list(F.struct(tag.alias("tag"), units.alias("u")))).alias("gaap"))
    payload = body.select(F.to_json(F.struct(F.col("security_id").cast("string").alias("cik"), F.create_map(F.lit("us-gaap"), F.col("gaap")).alias("facts"))).alias("body"))
    rows = vendor.companyfacts(payload, "body", {t: name for name, t in tags.items()})
    return rows.select("cik", "metric_name", big("fiscal_year"), "fiscal_period", "period_end", F.round("metric_value", 2).alias("metric_value"), "filed")


@query(f"""WITH {FUND} SELECT 'S' || security_id AS symbol, period_end, fiscal_year, fiscal_period, m.n AS metric_name, round(m.v, 2) AS metric_value FROM (SELECT *, unnest([{{'n': 'net_cash_from_operations', 'v': operating_income}}, {{'n': 'capital_expenditure', 'v': -net_income}}, {{'n': 'free_cash_flow', 'v': operating_income - net_income}}]) AS m FROM wide) WHERE m.v IS NOT NULL""")
def src_cash_flow(spark, sf_dir):
    """Cash-flow statements, a payload a symbol, each checked to be of the symbol that was asked for."""
    f = S.fundamentals(spark, sf_dir)
    wide = f.groupBy("security_id", "fiscal_year", "fiscal_period", "period_end").pivot("metric_name", ["operating_income", "net_income"]).agg(F.first("metric_value"))
    values = {"netCashProvidedByOperatingActivities": F.col("operating_income"), "capitalExpenditure": -F.col("net_income"), "freeCashFlow": F.col("operating_income") - F.col("net_income")}
    symbol = F.concat(F.lit("S"), F.col("security_id").cast("string"))
    one = F.struct(symbol.alias("symbol"), F.col("period_end").cast("string").alias("date"), F.col("fiscal_year").cast("string").alias("calendarYear"), F.col("fiscal_period").alias("period"), *[v.alias(k) for k, v in values.items()])
    payloads = wide.groupBy(F.lower(symbol).alias("asked")).agg(F.to_json(F.collect_list(one)).alias("body"))
    rows = vendor.statements(payloads, "body", vendor.CASH_FLOW_METRICS, 1900, expected="asked")
    return rows.select("symbol", "period_end", big("fiscal_year"), "fiscal_period", "metric_name", F.round("metric_value", 2).alias("metric_value"))


@query("SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS cik, count(*) AS filings, count(*) FILTER (WHERE event_type = 'click') AS amended, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM events GROUP BY 1")
def src_submissions(spark, sf_dir):
    """Filings packed as the parallel arrays of recent submissions, one payload a filer and day, and read back."""
    e = S.load(spark, sf_dir, "events")
    day = F.col("ts").cast("date").cast("string")
    one = F.struct(F.col("event_id").cast("string").alias("accessionNumber"), F.when(F.col("event_type") == "click", "8-K/A").otherwise("8-K").alias("form"), F.lit("2.02").alias("items"), day.alias("filingDate"), F.lit("").alias("acceptanceDateTime"), F.lit("a.htm").alias("primaryDocument"))
    packed = e.groupBy(F.col("user_id").cast("string").alias("cik"), day.alias("day")).agg(F.collect_list(one).alias("f"))  # one filer's day
    recent = F.struct(*[F.col(f"f.{n}").alias(n) for n in ("accessionNumber", "form", "items", "filingDate", "acceptanceDateTime", "primaryDocument")])
    rows = vendor.submissions(packed.select(F.to_json(F.struct("cik", F.struct(recent.alias("recent")).alias("filings"))).alias("body")), "body")
    return rows.groupBy("cik").agg(F.count("*").alias("filings"), F.count_if(F.col("form") == "8-K/A").alias("amended"), F.min("filing_date").alias("first_day"), F.max("filing_date").alias("last_day"))


# ---------------------------------------------------------------- supersession

#: Versions of an order: its lines, one superseding another; a fifth of them become known out of turn.
VERSIONS = """v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem),
fact AS (SELECT l_orderkey AS orderkey, l_orderkey * 1000 + nth AS id, CASE WHEN nth > 1 THEN l_orderkey * 1000 + nth - 1 END AS supersedes,
  CAST(l_shipdate AS TIMESTAMP) + (CASE WHEN (l_orderkey + nth) % 5 = 0 THEN 400 ELSE 1 END) * INTERVAL 1 DAY AS available_at, round(l_extendedprice, 2) AS amount FROM v)"""
_CLOSED = """RECURSIVE down AS (SELECT p.id, n.id AS later, n.available_at FROM fact p JOIN fact n ON n.supersedes = p.id UNION ALL SELECT d.id, n.id, n.available_at FROM down d JOIN fact n ON n.supersedes = d.later),
up AS (SELECT id, supersedes AS earlier, 1 AS hops FROM fact WHERE supersedes IS NOT NULL UNION ALL SELECT u.id, f.supersedes, hops + 1 FROM up u JOIN fact f ON f.id = u.earlier WHERE f.supersedes IS NOT NULL),
past AS (SELECT id, min(available_at) AS superseded_at FROM down GROUP BY id), first AS (SELECT id, max(hops) AS position, arg_max(earlier, hops) AS chain FROM up GROUP BY id),
hist AS (SELECT f.*, coalesce(chain, f.id) AS chain, CAST(coalesce(position, 0) AS BIGINT) AS position, superseded_at, superseded_at IS NULL AS is_current FROM fact f LEFT JOIN past USING (id) LEFT JOIN first USING (id))"""
HIST = f"WITH {_CLOSED.replace('RECURSIVE ', f'RECURSIVE {VERSIONS}, ', 1)}"


def order_history(spark, sf_dir):
    def make():
        rows = S.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        nth = F.expr("row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
        v = rows.withColumn("nth", nth)
        late = F.when((F.col("l_orderkey") + F.col("nth")) % 5 == 0, 400).otherwise(1)
        at = F.timestamp_add("DAY", late, F.col("l_shipdate").cast("timestamp"))
        number = F.col("l_orderkey") * 1000 + F.col("nth")
        fact = v.select(F.col("l_orderkey").alias("orderkey"), number.alias("id"), F.when(F.col("nth") > 1, number - 1).alias("supersedes"), at.alias("available_at"), F.round("l_extendedprice", 2).alias("amount"))
        return supersession.history(fact, "id", "supersedes", ["orderkey"])

    return once(spark, f"order_history:{sf_dir}", make)


@query(f"{HIST} SELECT id, orderkey, chain, position, {stamp('superseded_at')} AS superseded_at, is_current FROM hist")
def hist_chains(spark, sf_dir):
    """Each version's chain, place in it, and when it ceased to be current."""
    return order_history(spark, sf_dir).select("id", "orderkey", "chain", "position", F.date_format("superseded_at", STAMP).alias("superseded_at"), "is_current")


@query(f"{HIST} SELECT orderkey, id, amount, position FROM hist WHERE available_at <= TIMESTAMP '1998-06-30 12:00:00' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '1998-06-30 12:00:00')")
def hist_as_of(spark, sf_dir):
    """The version of each order that was current at an instant."""
    found = supersession.as_of(order_history(spark, sf_dir), F.lit("1998-06-30 12:00:00").cast("timestamp"))
    return found.select("orderkey", "id", F.col("amount"), "position")


@query(f"""{HIST}, ends AS (SELECT orderkey, max(id) AS last FROM fact GROUP BY 1), t AS (SELECT m AS instant FROM (SELECT unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '1999-01-01', INTERVAL 6 MONTH)) AS m))
SELECT {stamp('instant')} AS instant, count(*) AS current_rows, count(DISTINCT orderkey) AS orders, round(sum(amount), 2) AS amount FROM t JOIN hist ON available_at <= instant AND (superseded_at IS NULL OR superseded_at > instant) GROUP BY instant""")
def hist_by_instant(spark, sf_dir):
    """How many versions were current, of how many orders and of what amount, at five instants: never two of an order."""
    instants = F.expr("explode(sequence(timestamp'1997-01-01', timestamp'1999-01-01', interval 6 months))")
    found = order_history(spark, sf_dir)
    seen = F.expr("available_at <= instant and (superseded_at is null or superseded_at > instant)")
    rows = found.select("orderkey", "amount", "available_at", "superseded_at", instants.alias("instant")).where(seen)
    total = F.round(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double"), 2)
    return rows.groupBy("instant").agg(F.count("*").alias("current_rows"), F.countDistinct("orderkey").alias("orders"), total.alias("amount")).withColumn("instant", F.date_format("instant", STAMP))


# ---------------------------------------------------------------- trailing quarters


def ttm_sql(name: str, asofs: str) -> str:
    """CTEs that end in income, as ``income_sql`` has them, for features of four quarters against four."""
    metric, under = INC.TRAILING[name]
    base = under or metric
    pick = lambda m, c: f"arg_max({c}, (available_at, metric_value)) FILTER (WHERE metric_name = '{m}')"
    four = lambda c, a: f"CASE WHEN count(s.{c}) FILTER (WHERE n.t BETWEEN p.t - {a + 3} AND p.t - {a}) = 4 THEN sum(s.{c}) FILTER (WHERE n.t BETWEEN p.t - {a + 3} AND p.t - {a}) END"
    value = "a0 / nullif(b1, 0) - 1" if under is None else "a0 / nullif(b0, 0) - a1 / nullif(b1, 0)"
    zero = "a1 = 0" if under is None else "b0 = 0 OR b1 = 0"
    return f"""vis AS (SELECT a.security_id, a.asof, p.* EXCLUDE (security_id) FROM {asofs} a JOIN pm p ON p.security_id = a.security_id AND p.available_at <= a.asof),
per AS (SELECT security_id, asof, fiscal_year, fiscal_period, period_end, fiscal_year * 4 + CAST(substr(fiscal_period, 2, 1) AS BIGINT) - 1 AS t,
  {pick(metric, 'metric_value')} AS a, {pick(metric, 'available_at')} AS a_at, {pick(base, 'metric_value')} AS b, {pick(base, 'available_at')} AS b_at FROM vis GROUP BY ALL),
nw AS (SELECT security_id, asof, t, arg_max({{'a': a, 'b': b, 'at': greatest(a_at, b_at)}}, period_end) AS s FROM per GROUP BY 1, 2, 3),
cel AS (SELECT p.security_id, p.asof, p.fiscal_year, p.fiscal_period, p.period_end, {four('a', 0)} AS a0, {four('a', 4)} AS a1, {four('b', 0)} AS b0, {four('b', 4)} AS b1, max(s.at) AS known
  FROM per p JOIN nw n ON n.security_id = p.security_id AND n.asof = p.asof AND n.t BETWEEN p.t - 7 AND p.t GROUP BY ALL),
cmp AS (SELECT *, a0 IS NOT NULL AND b0 IS NOT NULL AS here, a1 IS NOT NULL AND b1 IS NOT NULL AS prior, {zero} AS zero, {value} AS value FROM cel),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id, asof ORDER BY period_end DESC, fiscal_year DESC, fiscal_period DESC) AS k FROM cmp WHERE here AND prior AND NOT zero) WHERE k = 1),
why AS (SELECT security_id, asof, bool_or(here AND prior AND zero) AS zero, bool_or(here AND NOT prior) AS no_prior FROM cmp GROUP BY 1, 2),
income AS (SELECT a.security_id, a.asof, b.fiscal_year, b.fiscal_period, b.value, b.known AS available_at, CASE WHEN b.security_id IS NOT NULL THEN 'ok' WHEN w.security_id IS NULL THEN 'no_visible_period' WHEN w.zero THEN 'zero_denominator'
  WHEN w.no_prior THEN 'missing_prior_year_metric' ELSE 'missing_current_metric' END AS status FROM {asofs} a LEFT JOIN best b ON b.security_id = a.security_id AND b.asof = a.asof LEFT JOIN why w ON w.security_id = a.security_id AND w.asof = a.asof)"""


def _pit_trailing(name: str) -> None:
    def run(spark, sf_dir):
        asofs = S.fundamentals(spark, sf_dir).select(big("security_id")).distinct().select("security_id", F.explode(F.array(*[F.lit(d).cast("timestamp") for d in INSTANTS])).alias("asof"))
        rows = INC.income_features(income_metrics(spark, sf_dir), asofs, (name,))
        return rows.select("security_id", F.date_format("asof", STAMP).alias("asof"), "fiscal_year", "fiscal_period", r8("value"), "status", F.date_format("available_at", STAMP).alias("available_at"))

    QUERIES[f"pit_{name}"] = run
    ORACLE_SQL[f"pit_{name}"] = quoted(f"WITH {FUND}, {INCOME_MODIFIED}, {FASOFS}, {ttm_sql(name, 'fasofs')} SELECT security_id, {stamp('asof')} AS asof, fiscal_year, fiscal_period, round(value, 8) AS value, status, {stamp('available_at')} AS available_at FROM income")


for _name in INC.TRAILING:
    _pit_trailing(_name)


# ---------------------------------------------------------------- independence: several controls at once

#: What is tested, and the controls it is tested against.
TARGET, CONTROLS = "avg_dollar_volume_63", ("return_21_0", "realized_volatility_63")
XS = ["k_adv", "k_mom", "k_vol"]
_KEYS = {"adv": TARGET, "mom": CONTROLS[0], "vol": CONTROLS[1]}


def ranked_sql() -> str:
    """CTEs that end in rkd: security_id, asof, idx, horizon_session, ret and the share of the date's members up to each rank."""
    share = lambda c: f"(rank() OVER (PARTITION BY asof ORDER BY {c}) + (count(*) OVER (PARTITION BY asof, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY asof) AS k_{c}"
    picks = ", ".join(f"max(value) FILTER (WHERE base_key = '{k}') AS {c}" for c, k in _KEYS.items())
    return candidates_sql() + f""", {label_sql(HORIZON)},
ctl AS (SELECT security_id, asof, idx, {picks} FROM cand WHERE status = 'ok' GROUP BY 1, 2, 3 HAVING adv IS NOT NULL AND mom IS NOT NULL AND vol IS NOT NULL),
joined AS (SELECT c.*, l.horizon_session, l.end_price / l.price - 1 AS ret FROM ctl c JOIN lab l ON l.security_id = c.security_id AND l.session = c.asof WHERE l.skip_reason IS NULL),
rkd AS (SELECT *, {', '.join(map(share, _KEYS))} FROM joined)"""


def ranked_controls(spark, sf_dir):
    """Target and controls of every security and date as shares of the date's ranks, with the forward return; written once."""

    def make():
        values = candidate_values(spark, sf_dir).where(F.col("status") == "ok")
        wide = values.groupBy("security_id", "asof", "idx").agg(*[F.max(F.when(F.col("base_key") == k, F.col("value"))).alias(c) for c, k in _KEYS.items()]).dropna(subset=list(_KEYS))
        labels = P.forward_labels(weekly(spark, sf_dir), (HORIZON,)).where("skip_reason is null")
        rows = stage(wide.join(labels.select("security_id", F.col("session").alias("asof"), "horizon_session", F.col("raw_return").alias("ret")), ["security_id", "asof"]), "controls")
        for c in _KEYS:
            rows = ranks.with_ranks(rows, c, ["asof"], f"k_{c}")
        n = rows.groupBy("asof").agg(F.count("*").alias("members"))
        return rows.join(n, "asof").withColumns({f"k_{c}": F.col(f"k_{c}") / F.col("members") for c in _KEYS}).drop("members")

    return once(spark, f"ranked_controls:{sf_dir}", make)


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'-+'[k % 2 == 0]} {m[0][k]} * {_det([r[:k] + r[k + 1:] for r in m[1:]])}" for k in range(len(m))) + ")"


def least_squares_sql(rows: str, y: str, xs: list[str], by: str) -> str:
    """Columns n, b1 ... bp, intercept and r_squared of least squares by Cramer's rule over centred products."""
    c = lambda a, b: f"covar_pop({a}, {b})"
    names = {(i, j): f"s{min(i, j)}_{max(i, j)}" for i in range(len(xs)) for j in range(len(xs))}
    products = ", ".join(f"{c(xs[i], xs[j])} AS {names[i, j]}" for i in range(len(xs)) for j in range(i, len(xs)))
    matrix = [[names[i, j] for j in range(len(xs))] for i in range(len(xs))]
    solve = lambda k: f"{_det([[f'g{i}' if j == k else matrix[i][j] for j in range(len(xs))] for i in range(len(xs))])} / {_det(matrix)}"
    told = " + ".join(f"b{k + 1} * g{k}" for k in range(len(xs)))
    return f"""SELECT *, my - ({' + '.join(f'b{k + 1} * m{k}' for k in range(len(xs)))}) AS intercept, CASE WHEN vy > 0 THEN ({told}) / vy END AS r_squared FROM (SELECT *, {', '.join(f'{solve(k)} AS b{k + 1}' for k in range(len(xs)))} FROM (
  SELECT {by}, count(*) AS n, avg({y}) AS my, var_pop({y}) AS vy, {', '.join(f'avg({x}) AS m{k}, {c(x, y)} AS g{k}' for k, x in enumerate(xs))}, {products} FROM {rows} GROUP BY {by}))"""


@query(f"""{ranked_sql()}, {splits_sql()}, tr AS (SELECT split, j.* FROM splits JOIN rkd j ON j.idx BETWEEN train_from AND train_to), m AS ({least_squares_sql('tr', 'ret', XS, 'split')})
SELECT split, n, round(b1, 6) AS b1, round(b2, 6) AS b2, round(b3, 6) AS b3, round(intercept, 6) AS intercept, round(r_squared, 6) AS r_squared FROM m""")
def ols_multi_by_split(spark, sf_dir):
    """Least squares of the return on three ranks in each split's training rows, merged from the moments of dates."""
    rows = ranked_controls(spark, sf_dir)
    per = G.moments(rows, "ret", XS, ["idx"])
    train = per.join(B.split_sessions(splits_for(spark, sf_dir, rows), "train").select("split", "idx"), "idx")
    m = G.fit(G.merged(train, len(XS) + 1, ["split"]), len(XS), ["split"])
    return m.select("split", "n", *[F.round(F.col("coefficients")[k], 6).alias(f"b{k + 1}") for k in range(3)], F.round("intercept", 6).alias("intercept"), F.round("r_squared", 6).alias("r_squared"))


_RESIDUAL = f"""{ranked_sql()}, rm AS ({least_squares_sql('rkd', 'k_adv', XS[1:], 'asof')}),
resid AS (SELECT r.security_id, r.asof, r.idx, r.horizon_session, r.ret, round(k_adv - (intercept + b1 * k_mom + b2 * k_vol), 9) AS feature FROM rkd r JOIN rm ON rm.asof = r.asof)"""


def _edge(rows_sql: str) -> str:
    return scores_sql().replace("FROM joined)", f"FROM {rows_sql})", 1)


def residual_rows(spark, sf_dir):
    left = G.residuals(ranked_controls(spark, sf_dir), "k_adv", XS[1:], ["asof"])
    return left.select("security_id", "asof", "idx", "horizon_session", "ret", F.round("residual", 9).alias("feature"))


@query(f"{_RESIDUAL}, {splits_sql()}, {_edge('resid')}, {windows_sql()} SELECT {_WINDOW_COLUMNS} FROM wins")
def residual_rank_windows(spark, sf_dir):
    """The target's rank without what the controls' ranks tell, scored in the same windows."""
    rows = residual_rows(spark, sf_dir)
    return _windows(B.window_scores(B.date_scores(rows), splits_for(spark, sf_dir, rows)))


@query(f"""{_RESIDUAL}, {splits_sql()}, {_edge('resid')}, {windows_sql()}
SELECT count(*) AS windows, count(*) FILTER (WHERE difference > 0) AS positive, round(avg(difference), 8) AS edge, CASE WHEN count(*) < 3 THEN 'insufficient_data' WHEN avg(difference) <= 0 OR count(*) FILTER (WHERE difference > 0) / count(*) < 0.6 THEN 'explained_by_controls' ELSE 'independent' END AS verdict FROM wins""")
def residual_rank_test(spark, sf_dir):
    rows = residual_rows(spark, sf_dir)
    return I.residual_verdict(B.window_scores(B.date_scores(rows), splits_for(spark, sf_dir, rows))).select("windows", "positive", r8("edge"), "verdict")


_HALVES = f"""{ranked_sql()}, half AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY asof ORDER BY mom, security_id) <= count(*) OVER (PARTITION BY asof) // 2 THEN 'low' ELSE 'high' END AS bucket FROM rkd),
hr AS (SELECT *, row_number() OVER (PARTITION BY bucket, asof ORDER BY adv DESC, security_id) AS rn, count(*) OVER (PARTITION BY bucket, asof) AS n FROM half),
hs AS (SELECT bucket, asof, idx, count(*) AS candidates, avg(ret) FILTER (WHERE rn <= greatest(1, n // 2)) - avg(ret) AS edge FROM hr GROUP BY 1, 2, 3), {splits_sql()},
hw AS (SELECT bucket, split, avg(edge) AS difference FROM splits JOIN hs ON idx BETWEEN test_from AND test_to GROUP BY bucket, split)"""


@query(f"{_HALVES} SELECT bucket, count(*) AS windows, count(*) FILTER (WHERE difference > 0) AS positive, round(avg(difference), 8) AS edge FROM hw GROUP BY bucket")
def within_control_buckets(spark, sf_dir):
    """Whether the target still tells within the low and the high half of a control."""
    rows = ranked_controls(spark, sf_dir)
    edges = I.within_buckets(rows.withColumn("feature", F.col("adv")), "mom", splits_for(spark, sf_dir, rows))
    return edges.select("bucket", "windows", "positive", r8("edge"))


_FACTORS = f"""{ranked_sql()}, sel AS (SELECT *, row_number() OVER (PARTITION BY asof ORDER BY mom DESC, security_id) <= greatest(1, count(*) OVER (PARTITION BY asof) // 2) AS top_mom,
  row_number() OVER (PARTITION BY asof ORDER BY adv DESC, security_id) <= greatest(1, count(*) OVER (PARTITION BY asof) // 2) AS top_adv, row_number() OVER (PARTITION BY asof ORDER BY vol DESC, security_id) <= greatest(1, count(*) OVER (PARTITION BY asof) // 2) AS top_vol FROM rkd),
fac AS (SELECT asof, idx, avg(ret) FILTER (WHERE top_mom) AS strategy, avg(ret) AS market, avg(ret) FILTER (WHERE top_adv) - avg(ret) FILTER (WHERE NOT top_adv) AS size, avg(ret) FILTER (WHERE top_vol) - avg(ret) FILTER (WHERE NOT top_vol) AS volatility FROM sel GROUP BY 1, 2 HAVING size IS NOT NULL AND volatility IS NOT NULL)"""


@query(f"""{_FACTORS}, {splits_sql()}, tr AS (SELECT split, f.* FROM splits JOIN fac f ON f.idx BETWEEN train_from AND train_to), m AS ({least_squares_sql('tr', 'strategy', ['market', 'size', 'volatility'], 'split')})
SELECT split, n AS dates, round(b1, 6) AS market, round(b2, 6) AS size, round(b3, 6) AS volatility, round(intercept, 8) AS alpha, round(r_squared, 6) AS r_squared FROM m""")
def factor_exposures(spark, sf_dir):
    """A strategy's dates on the market's and two spreads' returns, by split."""
    rows = ranked_controls(spark, sf_dir)
    factors = I.factor_returns(rows, "mom", {"size": "adv", "volatility": "vol"})
    train = G.moments(factors, "strategy", ["market", "size", "volatility"], ["idx"]).join(B.split_sessions(splits_for(spark, sf_dir, rows), "train").select("split", "idx"), "idx")
    m = G.fit(G.merged(train, 4, ["split"]), 3, ["split"])
    b = [F.round(F.col("coefficients")[k], 6).alias(c) for k, c in enumerate(("market", "size", "volatility"))]
    return m.select("split", F.col("n").alias("dates"), *b, r8("intercept").alias("alpha"), F.round("r_squared", 6).alias("r_squared"))


@query(f"""{ranked_sql()}, ry AS (SELECT *, rank() OVER (PARTITION BY asof ORDER BY ret) + (count(*) OVER (PARTITION BY asof, ret) - 1) / 2.0 AS k_ret FROM rkd),
ic AS (SELECT asof, covar_pop(k_adv, k_ret) / nullif(stddev_pop(k_adv) * stddev_pop(k_ret), 0) AS ic FROM ry GROUP BY asof)
SELECT count(ic) AS dates, round(avg(ic), 8) AS ic_mean, round(stddev_samp(ic), 8) AS ic_std, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS ic_t_stat, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE ic IS NOT NULL), 8) AS hit_rate FROM ic""")
def rank_ic(spark, sf_dir):
    """Mean, deviation and t of the dates' rank correlations of target and return."""
    found = I.information(ranks.spearman(ranked_controls(spark, sf_dir), "adv", "ret", ["asof"]))
    return found.select("dates", r8("ic_mean"), r8("ic_std"), F.round("ic_t_stat", 6).alias("ic_t_stat"), r8("hit_rate"))


# ---------------------------------------------------------------- sectors


_SECTORS = f"""{ranked_sql()}, sec AS (SELECT r.*, n_regionkey AS sector FROM rkd r JOIN nation ON n_nationkey = r.security_id)"""


@query(f"""{_SECTORS} SELECT security_id, asof, CAST(sector AS BIGINT) AS sector, round(mom - median(mom) OVER (PARTITION BY sector, asof), 8) AS relative, round((rank() OVER (PARTITION BY sector, asof ORDER BY adv) + (count(*) OVER (PARTITION BY sector, asof, adv) - 1) / 2.0) / count(*) OVER (PARTITION BY sector, asof), 8) AS sector_rank FROM sec""")
def feat_sector_relative(spark, sf_dir):
    """A feature less its sector's median, and a ratio's rank in its sector."""
    sector = S.load(spark, sf_dir, "nation").select(big("n_nationkey").alias("security_id"), big("n_regionkey").alias("sector"))
    rows = stage(ranked_controls(spark, sf_dir).select("security_id", "asof", "mom", "adv").join(sector, "security_id"), "sectors")
    found = I.sector_relative(rows, "mom", "adv")
    return found.select("security_id", "asof", "sector", r8("relative"), r8("sector_rank"))


@query("""SELECT l_returnflag, count(*) AS n, round(median(l_extendedprice), 8) AS median, round((SELECT median(l_extendedprice) FROM lineitem), 8) AS overall FROM lineitem GROUP BY l_returnflag""")
def exact_medians(spark, sf_dir):
    """Medians of a few very large groups and of a whole table, without a task that holds one."""
    rows = S.load(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    overall = ranks.medians(rows, "l_extendedprice", [], "overall").select(r8("overall"))
    return ranks.medians(rows, "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "n", r8("median")).join(F.broadcast(overall), F.lit(True))  # one row


# ---------------------------------------------------------------- drawdowns

_PATHS = f"""{BASE}, net AS (SELECT asof, m.s AS series, m.r AS ret FROM (SELECT asof, unnest([{{'s': 'strategy', 'r': strategy_net}}, {{'s': 'baseline', 'r': baseline_net}}]) AS m FROM scores WHERE idx % {HORIZON} = 0)),
eq AS (SELECT series, asof, product(1 + ret) OVER w AS equity FROM net WINDOW w AS (PARTITION BY series ORDER BY asof ROWS UNBOUNDED PRECEDING)),
path AS (SELECT *, greatest(1, max(equity) OVER (PARTITION BY series ORDER BY asof ROWS UNBOUNDED PRECEDING)) AS peak FROM eq)"""


def net_returns(spark, sf_dir):
    """Returns of periods that don't overlap, of strategy and baseline."""
    scores = B.date_scores(joined(spark, sf_dir)).where(F.col("idx") % HORIZON == 0)
    both = scores.select("asof", F.col("strategy_net").alias("strategy"), F.col("baseline_net").alias("baseline"))
    return both.unpivot(["asof"], ["strategy", "baseline"], "series", "ret").withColumnRenamed("asof", "date")


@query(f"{_PATHS} SELECT series, asof AS date, round(equity, 8) AS equity, round(peak, 8) AS peak, round(equity / peak - 1, 8) AS drawdown FROM path")
def equity_paths(spark, sf_dir):
    return DD.equity(net_returns(spark, sf_dir)).select("series", "date", r8("equity"), r8("peak"), r8("drawdown"))


@query(f"""{_PATHS}, worst AS (SELECT series, min(equity / peak - 1) AS depth, arg_min(asof, (equity / peak - 1, asof)) AS trough, arg_min(peak, (equity / peak - 1, asof)) AS height, arg_max(equity, asof) AS final FROM path GROUP BY series),
back AS (SELECT w.series, max(asof) FILTER (WHERE asof < trough AND equity >= height * (1 - 1e-12)) AS peak_date, min(asof) FILTER (WHERE asof > trough AND equity >= height * (1 - 1e-12)) AS recovered FROM worst w JOIN path USING (series) GROUP BY w.series)
SELECT series, round(depth, 8) AS max_drawdown, peak_date, trough AS trough_date, recovered AS recovered_date, CAST(date_diff('day', trough, recovered) AS BIGINT) AS recovery_days, round(final, 8) AS final_equity FROM worst JOIN back USING (series)""")
def drawdown_runs(spark, sf_dir):
    """The deepest fall of strategy and baseline, and how long it took to make up for it."""
    found = DD.drawdowns(DD.equity(net_returns(spark, sf_dir)))
    return found.select("series", r8("max_drawdown"), "peak_date", "trough_date", "recovered_date", "recovery_days", r8("final_equity"))


@query("""WITH r AS (SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS date, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END) AS DOUBLE) / (100 * count(*)) AS ret FROM lineitem GROUP BY 1, 2),
eq AS (SELECT *, product(1 + ret) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM r), path AS (SELECT *, greatest(1, max(equity) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING)) AS peak FROM eq)
SELECT series, count(*) AS dates, round(min(equity / peak - 1), 8) AS max_drawdown, round(arg_max(equity, date), 8) AS final_equity, round(max(peak), 8) AS peak FROM path GROUP BY series""")
def equity_of_days(spark, sf_dir):
    """Daily paths of a few long series."""
    side = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    r = S.load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series"), F.col("l_shipdate").cast("date").alias("date")).agg((F.sum(side).cast("double") / (F.count("*") * 100)).alias("ret"))
    path = DD.equity(r)
    return path.groupBy("series").agg(F.count("*").alias("dates"), F.round(F.min("drawdown"), 8).alias("max_drawdown"), F.round(F.max_by("equity", "date"), 8).alias("final_equity"), F.round(F.max("peak"), 8).alias("peak"))


# ---------------------------------------------------------------- records of runs: stored, replayed, reported

CONFIG = {"feature": "return_21_0", "lookback": str(LOOKBACK), "skip": str(SKIP), "horizon": str(HORIZON), "min_train": str(TRAIN), "test": str(TEST), "step": str(STEP), "cost_bps": "20", "seed": "44", "trials": "100"}
DEFINITION = P.definition_hash("return_21_0", 1, "numeric", {"lookback": LOOKBACK, "skip": SKIP})


def record_sql(name: str, where: str = "true") -> str:
    """CTEs that end in {name}: section, field, value of the run over the panel's rows that ``where`` keeps."""
    t = f"_{name}"
    num = lambda x: f"coalesce(printf('%.8f', round({x}, 8) + 0.0), 'n/a')"
    row = lambda section, pairs, source: " UNION ALL ".join(f"SELECT '{section}' AS section, '{k}' AS field, coalesce(CAST({v} AS VARCHAR), 'n/a') AS value FROM {source}" for k, v in pairs.items())
    base = joined_sql(tag=t).replace(f"joined{t} AS", f"every{t} AS")
    p, extreme = scramble_sql(f"smp{t}", "", 100, 44, f"drawn{t}"), "(count(*) FILTER (WHERE score >= observed) + 1)"
    for cte in ("masks", "put", "gmeans"):
        p = re.sub(rf"\b{cte}\b", f"{cte}{t}", p)
    return f"""{base}, joined{t} AS (SELECT * FROM every{t} WHERE {where}), {splits_sql(tag=t)}, {scores_sql(t)}, {windows_sql(t)},
cov{t} AS (SELECT count(*) AS n, count(DISTINCT security_id) AS s, count(DISTINCT asof) AS d, min(asof) AS a, max(asof) AS b, max(horizon_session) AS z FROM joined{t}),
mem{t} AS (SELECT count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation WHERE n_nationkey IN (SELECT security_id FROM joined{t})),
rowsh{t} AS (SELECT asof AS g, security_id AS o, sha256('=' || security_id || '|=' || asof || '|=' || horizon_session || '|=' || {_exact_sql('feature')} || '|=' || {_exact_sql('ret')}) AS h FROM joined{t}), grp{t} AS (SELECT g, sha256(string_agg(h, '' ORDER BY o)) AS h FROM rowsh{t} GROUP BY g),
fp{t} AS (SELECT sha256(string_agg(h, '' ORDER BY g)) AS f FROM grp{t}),
mw{t} AS (SELECT min(train_from) AS a, arg_min(train_to, split) AS b, arg_min(test_from, split) AS c, max(test_to) AS d FROM splits{t} WHERE split IN (SELECT split FROM wins{t})),
hd{t} AS (SELECT count(*) AS w, sum(test_dates) AS d, avg(strategy_net) AS s, avg(baseline_net) AS b, avg(difference) AS x, avg(CASE WHEN difference > 0 THEN 1.0 ELSE 0.0 END) AS r, stddev_samp(difference) AS sd FROM wins{t}),
rg{t} AS (SELECT name, count(asof) AS n, avg(strategy_net) AS s, avg(baseline_net) AS b, avg(strategy_net - baseline_net) AS x FROM regimes LEFT JOIN scores{t} ON asof BETWEEN a AND b GROUP BY name),
inside{t} AS (SELECT r.* FROM ranked{t} r JOIN splits{t} s ON r.idx BETWEEN test_from AND test_to WHERE split IN (SELECT split FROM wins{t})),
smp{t} AS (SELECT asof AS g, asof || '|' || security_id AS id, rn <= greatest(1, n // 2) AS chosen, ret FROM inside{t}), {p},
obs{t} AS (SELECT avg(m) AS observed FROM (SELECT g, avg(ret) FILTER (WHERE chosen) AS m FROM smp{t} GROUP BY g)),
ls{t} AS (SELECT observed, {extreme} AS rank, count(*) AS trials, {extreme} / 101 AS p FROM drawn{t}, obs{t} GROUP BY observed),
{name} AS ({row('config', {k: f"'{v}'" for k, v in CONFIG.items()}, '(SELECT 1)')} UNION ALL {row('coverage', {'rows': 'n', 'securities': 's', 'dates': 'd', 'first_asof': 'a', 'last_asof': 'b', 'last_outcome': 'z'}, f'cov{t}')}
UNION ALL {row('membership', {'members': 'n', 'tickers': 'names'}, f'mem{t}')} UNION ALL {row('identity', {'definition_hash': f"'{DEFINITION}'", 'feature_set_hash': f"sha256('return_21_0:1:{DEFINITION}')"}, '(SELECT 1)')} UNION ALL {row('inputs', {'fingerprint': 'f', 'target_kind': "'raw'"}, f'fp{t}')}
UNION ALL {row('model_window', {'train_from': 'a', 'train_to': 'b', 'test_from': 'c', 'test_to': 'd'}, f'mw{t}')}
UNION ALL {row('headline', {'windows': 'w', 'dates': 'CAST(d AS BIGINT)', 'mean_strategy': num('s'), 'mean_baseline': num('b'), 'mean_difference': num('x'), 'hit_rate': num('r'), 'sd_difference': num('sd'), 'mean_over_sd': num('x / nullif(sd, 0)')}, f'hd{t}')}
UNION ALL {row('costs', {'gross_strategy': num('s + 0.002'), 'gross_baseline': num('b + 0.002'), 'cost_multiple': num('x / 0.002')}, f'hd{t}')}
UNION ALL {' UNION ALL '.join(f"SELECT 'regimes', name || '.{k}', {v} FROM rg{t}" for k, v in {'dates': 'CAST(n AS VARCHAR)', 'strategy': num('s'), 'baseline': num('b'), 'difference': num('x')}.items())}
UNION ALL {row('label_scramble', {'observed': num('observed'), 'rank': 'rank', 'trials': 'trials', 'p_value': num('p'), 'passed': 'p <= 0.05'}, f'ls{t}')}
UNION ALL {row('comparisons', {'method': "'benjamini_hochberg'", 'alpha': "'0.05'", 'q_value': num('p')}, f'ls{t}')}
UNION ALL {row('status', {'run': "CASE WHEN w > 0 THEN 'succeeded' ELSE 'insufficient_data' END", 'verdict': "CASE WHEN w = 0 THEN 'insufficient_data' WHEN w < 3 OR r < 0.6 OR x <= 0 THEN 'rejected' WHEN p > 0.05 THEN 'rejected' ELSE 'promising' END", 'statement': f"'{RC.NO_CLAIM}'"}, f'hd{t}, ls{t}')})"""


def run_record(spark, sf_dir, rows=None):
    """The record of the ranking run over the weekly panel, or over some of its rows."""
    rows = stage(joined(spark, sf_dir) if rows is None else rows, "inputs")
    scores, splits = B.date_scores(rows), splits_for(spark, sf_dir, rows)
    w = stage(B.window_scores(scores, splits), "windows")
    head = B.headline(w)
    scored = B.split_sessions(splits.join(w.select("split"), "split", "left_semi"), "test").select("idx")
    scramble = stage(B.scramble_p_value(scramble_samples(B.select_top_half(rows).join(scored, "idx", "left_semi"))), "scramble")
    cover = rows.agg(F.count("*").alias("rows"), F.countDistinct("security_id").alias("securities"), F.countDistinct("asof").alias("dates"), F.min("asof").alias("first_asof"), F.max("asof").alias("last_asof"), F.max("horizon_session").alias("last_outcome"))
    members = S.universe(spark, sf_dir).join(rows.select("security_id").distinct(), "security_id", "left_semi").agg(F.count("*").alias("members"), F.array_join(F.sort_array(F.collect_list("ticker")), ",").alias("tickers"))
    digest = runs.fingerprint(rows, "asof", "security_id", [F.col("security_id"), F.col("asof"), F.col("horizon_session"), runs.exact(F.col("feature")), runs.exact(F.col("ret"))])
    window = runs.model_window(runs.planned_windows(scores, splits), rows.withColumn("outcome_idx", F.col("idx") + HORIZON))
    regimes = spark.createDataFrame(REGIMES, "name string, a string, b string").select("name", F.col("a").cast("date").alias("start_date"), F.col("b").cast("date").alias("end_date"))
    by_regime = runs.regime_metrics(scores, regimes).groupBy("name").pivot("measure", ["strategy_net", "baseline_net", "net_difference"]).agg(F.first("mean").alias("mean"), F.first("sample_count").alias("n"))
    one, c, t = spark.range(1), F.col, RC.text
    verdict = F.when(c("windows") == 0, "insufficient_data").when((c("windows") < 3) | (c("hit_rate") < 0.6) | (c("mean_difference") <= 0) | ~c("passed"), "rejected").otherwise("promising")
    return RC.together([
        RC.fields(one, "config", {k: F.lit(v) for k, v in CONFIG.items()}), RC.fields(cover, "coverage", {k: c(k) for k in cover.columns}), RC.fields(members, "membership", {k: c(k) for k in members.columns}),
        RC.fields(one, "identity", {"definition_hash": F.lit(DEFINITION), "feature_set_hash": F.sha2(F.lit(f"return_21_0:1:{DEFINITION}"), 256)}), RC.fields(digest, "inputs", {"fingerprint": c("fingerprint"), "target_kind": F.lit("raw")}),
        RC.fields(window, "model_window", {k: c(k) for k in ("train_from", "train_to", "test_from", "test_to")}),
        RC.fields(head, "headline", {"windows": c("windows"), "dates": c("dates"), **{k: t(c(k)) for k in ("mean_strategy", "mean_baseline", "mean_difference", "hit_rate", "sd_difference", "mean_over_sd")}}),
        RC.fields(head, "costs", {"gross_strategy": t(c("mean_strategy") + 0.002), "gross_baseline": t(c("mean_baseline") + 0.002), "cost_multiple": t(c("mean_difference") / 0.002)}),
        RC.fields(by_regime, "regimes", {"dates": c("strategy_net_n"), "strategy": t(c("strategy_net_mean")), "baseline": t(c("baseline_net_mean")), "difference": t(c("net_difference_mean"))}, c("name")),
        RC.fields(scramble, "label_scramble", {"observed": t(c("observed")), "rank": c("rank"), "trials": c("trials"), "p_value": t(c("p_value")), "passed": c("passed")}),
        RC.fields(scramble, "comparisons", {"method": F.lit("benjamini_hochberg"), "alpha": F.lit("0.05"), "q_value": t(c("p_value"))}),
        RC.fields(head.join(scramble, F.lit(True)), "status", {"run": F.when(c("windows") > 0, "succeeded").otherwise("insufficient_data"), "verdict": verdict, "statement": F.lit(RC.NO_CLAIM)}),
    ])


def stored_run(spark, sf_dir):
    """The registry's row of the run: its key and its record as JSON."""

    def make():
        record = stage(run_record(spark, sf_dir), "record")
        return record.join(RC.run_key(record, "backtest"), F.lit(True)).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("section", "field", "value"))).alias("rows")).select("key", F.to_json("rows").alias("metrics"))

    return once(spark, f"run:{sf_dir}", make)


_RECORD = f"WITH {PW}, {_REGIME_SQL}, {record_sql('rec')}"


@query(f"{_RECORD}, k AS (SELECT 'backtest-' || left(sha256(string_agg(section || '.' || field || '=' || value, '|' ORDER BY section || '.' || field || '=' || value)), 32) AS key FROM rec WHERE section IN ('config', 'identity', 'inputs')) SELECT key, section, field, value FROM rec, k")
def run_registry(spark, sf_dir):
    """Every field of the stored run under its deterministic key."""
    return RC.from_json(stored_run(spark, sf_dir)).select("key", "section", "field", "value")


@query(f"{_RECORD}, {record_sql('other', 'security_id <> 7')}, d AS (SELECT coalesce(a.section, b.section) AS section, coalesce(a.field, b.field) AS field, a.value AS stored, b.value AS rerun FROM rec a FULL JOIN other b ON a.section = b.section AND a.field = b.field)"
       " SELECT section, field, stored, rerun, CASE WHEN stored IS NULL THEN 'not_stored' WHEN rerun IS NULL THEN 'not_rerun' ELSE 'drifted' END AS fault FROM d WHERE stored IS DISTINCT FROM rerun")
def replay_fields(spark, sf_dir):
    """The stored run against a rerun over inputs that lack a security: every field that drifted, by name."""
    again = run_record(spark, sf_dir, joined(spark, sf_dir).where("security_id <> 7"))
    return RC.compare(RC.from_json(stored_run(spark, sf_dir)), again)


@query(f"{_RECORD} SELECT 'same' AS rerun, CASE WHEN count(*) > 0 THEN 'reproduced' END AS verdict, CAST(0 AS BIGINT) AS drifted, CAST(0 AS BIGINT) AS missing FROM rec UNION ALL SELECT 'altered', 'other_inputs', 2, 1 FROM (SELECT 1)")
def replay_verdicts(spark, sf_dir):
    """A replay of the stored run, and one against a claim of which a result, an input and a field were altered."""
    stored, again = RC.from_json(stored_run(spark, sf_dir)), stage(run_record(spark, sf_dir), "record")
    changed = F.when((F.col("section") == "headline") & (F.col("field") == "windows"), "-1").when(F.col("field") == "fingerprint", "none").otherwise(F.col("value"))
    altered = stored.where("field <> 'p_value'").withColumn("value", changed)
    out = RC.replay(stored, again).select(F.lit("same").alias("rerun"), "verdict", "drifted", "missing")
    return out.union(RC.replay(altered, again).select(F.lit("altered"), "verdict", "drifted", "missing"))


@query(f"{_RECORD}, s AS (SELECT unnest([{', '.join(repr(x) for x in RC.SECTIONS)}]) AS section, unnest(generate_series(1, {len(RC.SECTIONS)})) AS place) SELECT CAST(place AS BIGINT) AS place, s.section, row_number() OVER (PARTITION BY s.section ORDER BY field) - 1 AS line, coalesce(field || ': ' || value, CASE WHEN s.section = 'traceability' THEN 'agrees: true' END) AS text FROM s LEFT JOIN rec USING (section)")
def report_sections(spark, sf_dir):
    """All sections of the report of the stored run, with the outcome of tracing it to a rerun before it is written."""
    stored = RC.from_json(stored_run(spark, sf_dir)).drop("key")
    trace = RC.fields(RC.replay(stored, run_record(spark, sf_dir)), "traceability", {"agrees": F.col("verdict") == "reproduced"})
    return RC.report_rows(stored.unionByName(trace)).select("place", "section", "line", "text")
