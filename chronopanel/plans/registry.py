"""Queries of sources, sinks, registries and reports, with their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronopanel.operators import backtest as B
from chronopanel.operators import panel as P
from chronopanel.operators import reports as R
from chronopanel.operators import runs
from chronopanel.plans.catalogue import (
    ATTR, BASE, CANDIDATES, CAL, FUND, HORIZON, MEMBERS, OLS, PD, PRED, PW, REGIMES, STAMP, _LAYER_SQL, _REGIME_SQL, _layers, _WINDOW_COLUMNS, _windows, big, candidate_values, candidates_sql, cells, cells_sql, feature_sql, joined, joined_sql,
    label_sql, materializers, order_calendar, panel_of, query, r8, scores_sql, splits_for, splits_sql, sweep_cells, weekly, windows_for, windows_sql,
)
from chronopanel.plans.pit import LABELS, labels_at, stamp
from chronopanel.session import once, shared_root
from chronopanel.sources import landing, vault, vendor
from chronopanel.sources import tables as S


def fresh(spark, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def values(spark, columns: str, rows: list[tuple]):
    return spark.createDataFrame(rows, columns)


def sql_values(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE of literal rows."""
    shown = lambda v: "NULL" if v is None else ("true" if v is True else "false" if v is False else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'")
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + ")"


# ---------------------------------------------------------------- sources


@query(f"WITH {PW} SELECT CAST(security_id AS VARCHAR) AS symbol, session AS date, round(price * 0.99, 6) AS open, round(price * 1.02, 6) AS high, round(price * 0.98, 6) AS low, round(price, 6) AS close, round(price, 6) AS adj_close, CAST(volume AS BIGINT) AS volume FROM pw")
def src_legacy_prices(spark, sf_dir):
    p, at = panel_of(spark, sf_dir), fresh(spark, "landed")
    day = F.struct(F.col("session").cast("string").alias("date"), *[(F.col("price") * k).alias(n) for n, k in (("open", 0.99), ("high", 1.02), ("low", 0.98), ("close", 1.0), ("adjClose", 1.0))], "volume")
    body = p.groupBy(F.col("security_id").cast("string").alias("symbol")).agg(F.collect_list(day).alias("historical")).select(F.to_json(F.struct("symbol", "historical")).alias("body"), "symbol")
    landing.land(body.select(F.lit("vendor").alias("source"), F.lit("prices").alias("endpoint"), F.to_json(F.struct("symbol")).alias("params"), F.lit(200).alias("status"), "body"), at)
    rows = vendor.legacy_prices(landing.landed(spark, at, "prices"), "body")
    return rows.select("symbol", "date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "adj_close")], "volume")


@query(f"WITH {PW} SELECT CAST(security_id AS VARCHAR) AS symbol, session AS date, round(price, 6) AS close, round(price, 6) AS adj_close, CAST(volume AS BIGINT) AS volume FROM pw")
def src_stable_prices(spark, sf_dir):
    p = panel_of(spark, sf_dir)
    day = F.struct(F.col("security_id").cast("string").alias("symbol"), F.col("session").cast("string").alias("date"), *[F.col("price").alias(n) for n in ("adjOpen", "adjHigh", "adjLow", "adjClose")], "volume")
    body = p.groupBy("security_id").agg(F.to_json(F.collect_list(day)).alias("body"))
    return vendor.stable_prices(body, "body").select("symbol", "date", F.round("close", 6).alias("close"), F.round("adj_close", 6).alias("adj_close"), "volume")


@query(f"""WITH {PD}, bad AS (SELECT CASE WHEN security_id % 7 = 0 AND day(session) = 3 THEN -price ELSE price END AS open, CASE WHEN security_id % 7 = 1 AND day(session) = 4 THEN price / 2 ELSE price END AS high, price AS close, CASE WHEN security_id % 7 = 2 AND day(session) = 5 THEN -1 ELSE volume END AS volume FROM pw)
SELECT CASE WHEN least(open, high, close) <= 0 THEN 'not_positive' WHEN high < greatest(open, close) THEN 'range' WHEN volume < 0 THEN 'volume' END AS fault, count(*) AS n FROM bad GROUP BY 1 HAVING fault IS NOT NULL""")
def src_price_faults(spark, sf_dir):
    hit = lambda k, d: (F.col("security_id") % 7 == k) & (F.day("session") == d)
    p = panel_of(spark, sf_dir, "day").select(
        F.col("session").alias("date"), F.when(hit(0, 3), -F.col("price")).otherwise(F.col("price")).alias("open"), F.when(hit(1, 4), F.col("price") / 2).otherwise(F.col("price")).alias("high"),
        F.least("price", F.when(hit(1, 4), F.col("price") / 2).otherwise(F.col("price"))).alias("low"), F.col("price").alias("close"), F.col("price").alias("adj_close"), F.when(hit(2, 5), -1.0).otherwise(F.col("volume")).alias("volume"))
    return vendor.price_faults(p).groupBy("fault").agg(F.count("*").alias("n"))


@query(f"""WITH {FUND} SELECT CAST(security_id AS VARCHAR) AS symbol, period_end, CAST(fiscal_year AS BIGINT) AS fiscal_year, fiscal_period, {stamp("timezone('UTC', timezone('America/New_York', CAST(period_end + 40 AS TIMESTAMP) + INTERVAL 17 HOUR))")} AS accepted_at, m.n AS metric_name, round(m.v, 2) AS metric_value
FROM (SELECT *, unnest([{{'n': 'revenue', 'v': revenue}}, {{'n': 'gross_profit', 'v': gross_profit}}, {{'n': 'operating_income', 'v': operating_income}}, {{'n': 'net_income', 'v': net_income}}, {{'n': 'diluted_weighted_average_shares', 'v': shares}}]) AS m FROM wide)
WHERE fiscal_year >= 1997 AND m.v IS NOT NULL""")
def src_statements(spark, sf_dir):
    f = S.fundamentals(spark, sf_dir)
    wide = f.groupBy("security_id", "fiscal_year", "fiscal_period", "period_end").pivot("metric_name", list(vendor.INCOME_METRICS.values())).agg(F.first("metric_value"))
    fields = [F.col(m).alias(k) for k, m in vendor.INCOME_METRICS.items()]
    one = F.struct(
        F.col("security_id").cast("string").alias("symbol"), F.col("period_end").cast("string").alias("date"), F.col("fiscal_year").cast("string").alias("fiscalYear"), F.col("fiscal_period").alias("period"),
        F.concat(F.date_add("period_end", 40).cast("string"), F.lit(" 17:00:00")).alias("acceptedDate"), *fields)
    body = wide.groupBy("security_id").agg(F.to_json(F.collect_list(one)).alias("body"))
    rows = vendor.statements(body, "body", vendor.INCOME_METRICS, 1997)
    return rows.select("symbol", "period_end", big("fiscal_year"), "fiscal_period", F.date_format("accepted_at", STAMP).alias("accepted_at"), "metric_name", F.round("metric_value", 2).alias("metric_value"))


@query("SELECT CAST(page_id AS VARCHAR) AS accession, 'doc-' || page_id || CASE k WHEN 1 THEN '.htm' WHEN 2 THEN '-EX_99-1.HTM' ELSE '-complex991x.txt' END AS name, CASE WHEN k = 2 THEN NULL ELSE page_id * 10 + k END AS size FROM pages, (SELECT unnest([1, 2, 3]) AS k)")
def src_archive_index(spark, sf_dir):
    return archive_files(spark, sf_dir).select("accession", "name", "size")


def archive_files(spark, sf_dir):
    i = F.col("page_id")
    names = [F.concat(F.lit("doc-"), i.cast("string"), F.lit(x)) for x in (".htm", "-EX_99-1.HTM", "-complex991x.txt")]
    sizes = [(i * 10 + 1).cast("string"), F.lit(""), (i * 10 + 3).cast("string")]
    items = F.array(*[F.struct(n.alias("name"), s.alias("size")) for n, s in zip(names, sizes)])
    payload = S.load(spark, sf_dir, "pages").select(i.cast("string").alias("accession"), F.to_json(F.struct(F.struct(items.alias("item")).alias("directory"))).alias("body"))
    return vendor.archive_documents(payload, "body")


@query("SELECT CAST(page_id AS VARCHAR) AS accession, 'doc-' || page_id || '-EX_99-1.HTM' AS exhibit FROM pages WHERE page_id % 5 <> 0")
def src_exhibits(spark, sf_dir):
    files = archive_files(spark, sf_dir)
    primary = F.when(F.col("accession").cast("bigint") % 5 == 0, F.concat(F.lit("DOC-"), "accession", F.lit("-ex_99-1.htm"))).otherwise(F.concat(F.lit("doc-"), "accession", F.lit(".htm")))
    return vendor.earnings_exhibits(files.withColumn("primary_document", primary))


#: Texts of releases by an order's number, some of which tell nothing; places: year, word of the quarter, its end.
_RELEASES = ["Acme reports fiscal {y} {w} quarter financial results for the quarter ended {d}", "Earnings for the {w}  quarter; quarter ended {d}.", "Fiscal year ended {d}: earnings rose", "No news at all", "", "Q1 earnings of a full year, quarter ended {d}", "earnings of the {w} quarter", "{w} quarter earnings, year ended Mars 3, {y}"]
_RELEASE_SQL = "r AS (SELECT o_orderkey AS id, replace(replace(replace([" + ", ".join("'" + t + "'" for t in _RELEASES) + """][1 + o_orderkey % 8], '{y}', CAST(year(o_orderdate) AS VARCHAR)), '{w}', ['first', 'second', 'third', 'fourth'][quarter(o_orderdate)]),
  '{d}', strftime(last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)), '%B %-d, %Y')) AS text FROM orders)"""


def releases(spark, sf_dir):
    """(id, text): a release for each order."""
    day = F.col("o_orderdate")
    end = F.date_format(F.last_day(F.make_date(F.year(day), F.quarter(day) * 3, F.lit(1))), "MMMM d, yyyy")
    word = F.element_at(F.array(*[F.lit(w) for w in ("first", "second", "third", "fourth")]), F.quarter(day))
    text = F.element_at(F.array(*map(F.lit, _RELEASES)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    for place, value in (("{y}", F.year(day).cast("string")), ("{w}", word), ("{d}", end)):
        text = F.replace(text, F.lit(place), value)
    return S.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))


@query("WITH " + _RELEASE_SQL + r""", t AS (SELECT id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM r),
e AS (SELECT *, regexp_extract(text, '(?:quarter|fiscal year|year) ended ([A-Z][a-z]+ \d{1,2}, \d{4})', 1) AS ended, lower(text) AS low FROM t),
f AS (SELECT *, CAST(try_strptime(nullif(ended, ''), '%B %-d, %Y') AS DATE) AS period_end, CASE WHEN regexp_matches(low, '\bfirst\s+quarter\b') THEN 'Q1' WHEN regexp_matches(low, '\bsecond\s+quarter\b') THEN 'Q2' WHEN regexp_matches(low, '\bthird\s+quarter\b') THEN 'Q3'
  WHEN regexp_matches(low, '\bfourth\s+quarter\b') THEN 'Q4' WHEN regexp_matches(low, '\bfiscal\s+year\s+ended\b') THEN 'FY' END AS fiscal_period FROM e),
g AS (SELECT *, CASE WHEN text = '' THEN 'empty' WHEN NOT ((contains(low, 'financial results') OR contains(low, 'earnings')) AND (contains(low, 'quarter') OR contains(low, 'fiscal year'))) THEN 'not_earnings' WHEN period_end IS NULL THEN 'no_period_end' WHEN fiscal_period IS NULL THEN 'no_quarter' END AS fault FROM f)
SELECT id, CAST(CASE WHEN fault IS NULL THEN coalesce(CAST(nullif(regexp_extract(low, '\bfiscal\s+(\d{4})\b', 1), '') AS BIGINT), year(period_end)) END AS BIGINT) AS fiscal_year, CASE WHEN fault IS NULL THEN fiscal_period END AS fiscal_period, CASE WHEN fault IS NULL THEN period_end END AS period_end,
CASE WHEN fault IS NULL THEN CASE WHEN fiscal_period = 'FY' THEN 'medium' ELSE 'high' END END AS confidence, fault FROM g""")
def src_release_evidence(spark, sf_dir):
    return vendor.release_evidence(releases(spark, sf_dir), "text").select("id", F.col("fiscal_year").cast("bigint").alias("fiscal_year"), "fiscal_period", "period_end", "confidence", "fault")


@query(r"""SELECT 'accession' AS grammar, count(*) FILTER (WHERE regexp_full_match(lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-' || lpad(CAST(o_custkey % 130 AS VARCHAR), 2, '0') || '-000001', '[0-9]{10}-[0-9]{2}-[0-9]{6}')) AS ok, count(*) AS n FROM orders
UNION ALL SELECT 'cik', count(*) FILTER (WHERE regexp_full_match(c_name, '[0-9]{10}') OR regexp_full_match(lpad(CAST(c_custkey AS VARCHAR), 10, '0'), '[0-9]{10}') AND c_custkey % 2 = 0), count(*) FROM customer
UNION ALL SELECT 'ticker', count(*) FILTER (WHERE regexp_full_match(n_name, '[A-Z][A-Z0-9.]{0,9}')), count(*) FROM nation
UNION ALL SELECT 'hypothesis_key', count(*) FILTER (WHERE regexp_full_match(lower(n_name), '[a-z0-9][a-z0-9_-]{0,127}')), count(*) FROM nation""")
def grammar_checks(spark, sf_dir):
    o, c, n = (S.load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    pad = lambda x, k: F.lpad(x.cast("string"), k, "0")
    texts = o.select(F.lit("accession").alias("grammar"), F.concat(pad(F.col("o_orderkey"), 10), F.lit("-"), pad(F.col("o_custkey") % 130, 2), F.lit("-000001")).alias("text"))
    texts = texts.union(c.select(F.lit("cik"), F.when(F.col("c_custkey") % 2 == 0, pad(F.col("c_custkey"), 10)).otherwise(F.col("c_name"))))
    texts = texts.union(n.select(F.lit("ticker"), "n_name")).union(n.select(F.lit("hypothesis_key"), F.lower("n_name")))
    ok = F.lit(False)
    for name, pattern in vendor.GRAMMARS.items():
        ok = ok | ((F.col("grammar") == name) & F.col("text").rlike(pattern))
    return texts.groupBy("grammar").agg(F.count_if(ok).alias("ok"), F.count("*").alias("n"))


@query(f"WITH {CAL} SELECT date, is_session, CASE WHEN is_session THEN {stamp('''timezone('UTC', timezone('America/New_York', CAST(date AS TIMESTAMP) + INTERVAL 16 HOUR))''')} END AS session_close FROM numbered")
def calendar_csv(spark, sf_dir):
    """A calendar written as one ordered file with a header and read back strictly."""
    at = fresh(spark, "calendar")
    landing.write_calendar_csv(order_calendar(spark, sf_dir).withColumn("is_early_close", F.lit(False)), at)
    return vendor.read_calendar_csv(spark, at).select("date", "is_session", F.date_format("session_close", STAMP).alias("session_close"))


_RESPONSES = (408, 429, 503, 404, 200, 500, 301)


@query(f"""SELECT status, attempt, count(*) AS n, least(30.0, pow(2.0, attempt - 1)) AS pause, status IN (408, 429) OR status >= 500 AS retried FROM (SELECT CAST([{', '.join(map(str, _RESPONSES))}][1 + event_id % 7] AS BIGINT) AS status, 1 + user_id % 8 AS attempt FROM events) GROUP BY 1, 2""")
def src_retry_rules(spark, sf_dir):
    """Responses by status and attempt: whether they are tried again, and after how long."""
    status = F.element_at(F.array(*map(F.lit, _RESPONSES)), (F.col("event_id") % 7 + 1).cast("int"))
    rows = S.load(spark, sf_dir, "events").groupBy(status.cast("bigint").alias("status"), (F.col("user_id") % 8 + 1).alias("attempt")).agg(F.count("*").alias("n"))
    return rows.select("status", "attempt", "n", landing.pause_seconds(F.col("attempt")).alias("pause"), landing.retryable(F.col("status")).alias("retried"))


@query(f"WITH {PW} SELECT w.security_id, w.session, w.price FROM pw w WHERE w.security_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) AND w.session <= DATE '1998-01-01'")
def src_succeeded_runs(spark, sf_dir):
    """Prices of runs that succeeded, up to a bound: a nation's region stands for its run, region 2 for the one that failed."""
    nation = S.load(spark, sf_dir, "nation")
    done = nation.withColumn("status", F.when(F.col("n_regionkey") == 2, "failed").otherwise("succeeded")).where("status = 'succeeded'").select(F.col("n_nationkey").cast("bigint").alias("security_id"))
    return panel_of(spark, sf_dir).where("session <= date'1998-01-01'").join(done, "security_id", "left_semi").select("security_id", "session", "price")


@query(f"WITH {PW}, {MEMBERS} SELECT session, price FROM pw JOIN members USING (security_id) WHERE upper(ticker) = upper('Nation_7')")
def src_ticker_prices(spark, sf_dir):
    """One ticker's prices, whatever the case of its name."""
    m = S.universe(spark, sf_dir).where(F.upper("ticker") == F.upper(F.lit("Nation_7"))).select(big("security_id"))
    return panel_of(spark, sf_dir).join(m, "security_id").select("session", "price")


@query(f"WITH {PW}, {MEMBERS} SELECT DISTINCT w.security_id, w.session FROM pw w JOIN members m ON m.security_id = w.security_id AND w.session >= valid_from AND (valid_to IS NULL OR w.session <= valid_to)")
def src_label_dates(spark, sf_dir):
    m = S.universe(spark, sf_dir).select(F.col("security_id").alias("m_id"), "valid_from", "valid_to")
    p = panel_of(spark, sf_dir)
    active = (F.col("security_id") == F.col("m_id")) & (F.col("session") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("session") <= F.col("valid_to")))
    return p.join(m, active).select("security_id", "session").distinct()


@query(f"WITH {FUND} SELECT security_id, metric_name, count(*) AS n, max(period_end) AS newest FROM long WHERE fiscal_period <> 'Q4' AND available_day <= DATE '1998-05-01' GROUP BY 1, 2")
def src_metrics_cutoff(spark, sf_dir):
    """Quarterly metrics of periods and an availability cutoff."""
    f = S.fundamentals(spark, sf_dir).where((F.col("fiscal_period") != "Q4") & (F.date_add("period_end", 41) <= F.lit("1998-05-01").cast("date")))
    return f.groupBy(big("security_id"), "metric_name").agg(F.count("*").alias("n"), F.max("period_end").alias("newest"))


# ---------------------------------------------------------------- sinks


def _sink(spark, merged):
    """Counts of a merge whose outcome is written beside its source first."""
    held = merged.withColumn("done", F.col("action"))
    return vault.write_counts(vault.publish(held, fresh(spark, "table")).withColumnRenamed("done", "action"))


@query(f"""WITH {PW}, {feature_sql(21, 0)}, a AS (SELECT security_id, session, CASE WHEN security_id % 3 = 0 THEN value + 0.25 ELSE value END AS value FROM feat WHERE status = 'ok' AND idx < 200), b AS (SELECT security_id, session, value FROM feat WHERE status = 'ok' AND idx >= 100)
SELECT count(*) FILTER (WHERE a.session IS NULL) AS inserted, count(*) FILTER (WHERE a.session IS NOT NULL AND b.session IS NOT NULL AND a.value IS DISTINCT FROM b.value) AS updated, count(*) FILTER (WHERE a.session IS NOT NULL AND (b.session IS NULL OR a.value IS NOT DISTINCT FROM b.value)) AS kept
FROM a FULL JOIN b ON a.security_id = b.security_id AND a.session = b.session""")
def sink_features(spark, sf_dir):
    rows = P.price_return(weekly(spark, sf_dir), 21).where("status = 'ok'").select("security_id", "session", F.lit("return_21_0").alias("feature"), "value", F.col("session").cast("timestamp").alias("available_at"), "idx")
    old = rows.where("idx < 200").withColumn("value", F.when(F.col("security_id") % 3 == 0, F.col("value") + 0.25).otherwise(F.col("value"))).drop("idx")
    return _sink(spark, vault.upsert(old, rows.where("idx >= 100").drop("idx"), "features"))


@query(f"""WITH {PW}, {label_sql(5)}, l AS (SELECT security_id, session, idx, end_price / price - 1 AS r FROM lab WHERE skip_reason IS NULL), a AS (SELECT security_id, session, CASE WHEN security_id % 4 = 0 THEN NULL ELSE r END AS r FROM l WHERE idx < 150), b AS (SELECT * FROM l)
SELECT count(*) FILTER (WHERE a.session IS NULL) AS inserted, count(*) FILTER (WHERE a.session IS NOT NULL AND a.r IS DISTINCT FROM b.r) AS updated, count(*) FILTER (WHERE a.session IS NOT NULL AND a.r IS NOT DISTINCT FROM b.r) AS kept FROM a RIGHT JOIN b ON a.security_id = b.security_id AND a.session = b.session""")
def sink_labels(spark, sf_dir):
    rows = P.forward_labels(weekly(spark, sf_dir), (5,)).where("skip_reason is null").select("security_id", "session", "horizon", "raw_return", "excess_return", "idx")
    old = rows.where("idx < 150").withColumn("raw_return", F.when(F.col("security_id") % 4 != 0, F.col("raw_return"))).drop("idx")
    return _sink(spark, vault.upsert(old, rows.drop("idx"), "labels"))


@query(f"""WITH {FUND}, a AS (SELECT security_id, fiscal_year, fiscal_period, metric_name, CASE WHEN fiscal_year = 1996 THEN metric_value + 1 ELSE metric_value END AS v FROM long WHERE fiscal_year <= 1997), b AS (SELECT security_id, fiscal_year, fiscal_period, metric_name, metric_value AS v FROM long WHERE fiscal_year >= 1996)
SELECT count(*) FILTER (WHERE a.v IS NULL) AS inserted, count(*) FILTER (WHERE a.v IS NOT NULL AND b.v IS NOT NULL AND a.v <> b.v) AS updated, count(*) FILTER (WHERE a.v IS NOT NULL AND (b.v IS NULL OR a.v = b.v)) AS kept FROM a FULL JOIN b USING (security_id, fiscal_year, fiscal_period, metric_name)""")
def sink_fundamentals(spark, sf_dir):
    f = S.fundamentals(spark, sf_dir).select("security_id", "fiscal_year", "fiscal_period", "period_end", "metric_name", "metric_value")
    old = f.where("fiscal_year <= 1997").withColumn("metric_value", F.when(F.col("fiscal_year") == 1996, F.col("metric_value") + 1).otherwise(F.col("metric_value")))
    return _sink(spark, vault.upsert(old, f.where("fiscal_year >= 1996"), "fundamentals"))


@query("""SELECT count(*) FILTER (WHERE event_id % 2 = 1) AS inserted, count(*) FILTER (WHERE event_id % 6 = 0) AS updated, count(*) FILTER (WHERE event_id % 2 = 0 AND event_id % 6 <> 0) AS kept FROM events""")
def sink_releases(spark, sf_dir):
    e = S.events(spark, sf_dir).select(F.col("event_id").cast("string").alias("accession"), F.lit("8-K").alias("form"), F.col("ts").alias("accepted_at"), F.lit("amc").alias("timing"), "event_id")
    old = e.where("event_id % 2 = 0").withColumn("form", F.when(F.col("event_id") % 6 == 0, "8-K/A").otherwise(F.col("form"))).drop("event_id")
    return _sink(spark, vault.upsert(old, e.drop("event_id"), "releases"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS security_id, n_name AS ticker FROM nation")
def sink_reference(spark, sf_dir):
    table = S.universe(spark, sf_dir).select(big("security_id"), "ticker")
    return landing.write_reference(table, fresh(spark, "reference"), ["security_id"])


_RUNS_SQL = """c AS (SELECT c_custkey AS k, 'run-' || c_custkey AS key, '{"nation":' || c_nationkey || '}' AS metadata FROM customer),
o AS (SELECT key, metadata, CASE WHEN k % 4 = 1 THEN 'succeeded' ELSE 'running' END AS status FROM c WHERE k % 3 <> 0), n AS (SELECT key, metadata, 'running' AS status FROM c WHERE k % 2 = 0), done AS (SELECT key, CASE WHEN k % 10 = 0 THEN 'failed' ELSE 'succeeded' END AS status FROM c WHERE k % 5 = 0 AND (k % 3 <> 0 OR k % 2 = 0))"""


@query("WITH " + _RUNS_SQL + """,
r AS (SELECT coalesce(o.key, n.key) AS key, coalesce(n.metadata, o.metadata) AS metadata, coalesce(o.status, n.status) AS status, CASE WHEN o.key IS NULL THEN 'inserted' WHEN n.key IS NULL THEN 'kept' ELSE 'reused' END AS action FROM o FULL JOIN n ON o.key = n.key)
SELECT r.key, metadata, CASE WHEN r.status = 'running' THEN coalesce(done.status, r.status) ELSE r.status END AS status, action FROM r LEFT JOIN done ON done.key = r.key""")
def registry_runs(spark, sf_dir):
    """Runs known and arriving by key, then the outcomes of some."""
    k = F.col("c_custkey")
    metadata = F.concat(F.lit('{"nation":'), F.col("c_nationkey").cast("string"), F.lit("}"))
    c = S.load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("run-"), k.cast("string")).alias("key"), metadata.alias("metadata"))
    old = c.where(k % 3 != 0).select("key", "metadata", F.when(k % 4 == 1, "succeeded").otherwise("running").alias("status"))
    held = vault.register_runs(old, c.where(k % 2 == 0).select("key", "metadata", F.lit("running").alias("status")))
    done = c.where((k % 5 == 0) & ((k % 3 != 0) | (k % 2 == 0))).select("key", F.when(k % 10 == 0, "failed").otherwise("succeeded").alias("status"))
    return vault.finish_runs(held, done).select("key", "metadata", "status", "action")


@query("SELECT user_id AS run, arg_max(event_type, (ts, event_id)) AS status, count(*) AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started FROM events GROUP BY user_id")
def lineage_runs(spark, sf_dir):
    """Lineage as status rows that are only appended: the newest row of a run is its state."""
    e = S.events(spark, sf_dir)
    return e.groupBy(F.col("user_id").alias("run")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("rows"), F.date_format(F.min("ts"), STAMP).alias("started"))


@query("""WITH o AS (SELECT 'h' || p_partkey AS key, p_name AS name, 'old' AS thesis, CASE WHEN p_size > 25 THEN 'accepted' ELSE 'rejected' END AS status FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT 'h' || p_partkey AS key, p_name || ' again' AS name, p_type AS thesis, 'proposed' AS status FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(o.key, n.key) AS key, coalesce(n.name, o.name) AS name, coalesce(n.thesis, o.thesis) AS thesis, coalesce(o.status, n.status) AS status FROM o FULL JOIN n ON o.key = n.key""")
def registry_hypotheses(spark, sf_dir):
    """Hypotheses known and arriving: new texts win, a known one keeps its status."""
    key, k = F.concat(F.lit("h"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_partkey")
    p = S.load(spark, sf_dir, "part")
    old = p.where(k % 3 != 0).select(key, F.col("p_name").alias("name"), F.lit("old").alias("thesis"), F.when(F.col("p_size") > 25, "accepted").otherwise("rejected").alias("status"))
    return vault.upsert_hypotheses(old, p.where(k % 2 == 0).select(key, F.concat("p_name", F.lit(" again")).alias("name"), F.col("p_type").alias("thesis"), F.lit("proposed").alias("status")))


_DEFS_SQL = "d AS (SELECT p_brand || ' ' || p_type AS name, CAST(p_size AS BIGINT) AS version, sha256(CAST(max(p_partkey) AS VARCHAR)) AS hash FROM part GROUP BY 1, 2)"


@query(f"WITH {_DEFS_SQL} SELECT name, max(version) AS version, sha256(name || ':' || max(version) || ':' || arg_max(hash, version)) AS feature_set_hash FROM d GROUP BY name")
def latest_definitions(spark, sf_dir):
    """Definitions of which some are known by name, version and hash, and the newest version of each name."""
    rows = S.load(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("name"), big("p_size").alias("version")).agg(F.sha2(F.max("p_partkey").cast("string"), 256).alias("hash"))
    held = vault.ensure_definition(rows.where("version < 20"), rows)
    return runs.latest_version(held).select("name", "version", F.sha2(F.concat_ws(":", "name", "version", "hash"), 256).alias("feature_set_hash"))


@query(f"WITH {_DEFS_SQL} SELECT sha256(string_agg(name || ':' || version || ':' || hash, '|' ORDER BY name, version)) AS feature_set_hash, count(*) AS definitions, count(*) FILTER (WHERE version >= 20) AS new FROM d")
def feature_set_hash(spark, sf_dir):
    """The hash of a set of definitions, whatever the order of its rows."""
    rows = S.load(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("name"), big("p_size").alias("version")).agg(F.sha2(F.max("p_partkey").cast("string"), 256).alias("hash"))
    held = vault.ensure_definition(rows.where("version < 20"), rows)
    entry = F.struct("name", "version", F.concat_ws(":", "name", "version", "hash").alias("text"))
    joined_text = F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["text"]), "|")  # a set of definitions is a document's size
    return held.agg(F.sha2(joined_text, 256).alias("feature_set_hash"), F.count("*").alias("definitions"), F.count_if("is_new").alias("new"))


# ---------------------------------------------------------------- joins, sets and JSON


@query("SELECT c_custkey, o_orderkey, coalesce(CAST(o_custkey AS VARCHAR), 'none') AS model_key FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON coalesce(o_custkey, -1) = c_custkey")
def join_snapshots(spark, sf_dir):
    """Back-tests with the metadata of their models; a run without a model has a key of its own."""
    models = S.load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.coalesce("o_custkey", F.lit(-1)).alias("key"), F.col("o_custkey").cast("string").alias("model_key"))
    return S.load(spark, sf_dir, "customer").join(models, F.col("c_custkey") == F.col("key"), "left").select("c_custkey", "o_orderkey", F.coalesce("model_key", F.lit("none")).alias("model_key"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def require_customers(spark, sf_dir):
    """Orders of which every customer is known; an unknown one would be an error."""
    known = S.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    orders = S.load(spark, sf_dir, "orders")
    return runs.require_known(orders, known, ["o_custkey"]).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("""SELECT n_regionkey AS region, to_json(list({'key': n_nationkey, 'name': n_name} ORDER BY n_nationkey)) AS members, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS by_name FROM nation GROUP BY 1""")
def json_rollup(spark, sf_dir):
    n = S.load(spark, sf_dir, "nation")
    member, entry = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), F.struct(F.col("n_name"), F.col("n_nationkey"))
    return n.groupBy(F.col("n_regionkey").alias("region")).agg(F.to_json(F.sort_array(F.collect_list(member))).alias("members"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("by_name"))


@query(f"WITH {PW}, s AS (SELECT DISTINCT security_id FROM pw) SELECT CAST(x AS BIGINT) AS security_id, 'missing' AS fault FROM (SELECT unnest(generate_series(0, 26)) AS x) WHERE x NOT IN (SELECT security_id FROM s) UNION ALL SELECT security_id, 'unexpected' FROM s WHERE security_id > 26")
def set_equality(spark, sf_dir):
    """Securities of the panel against the expected universe of 27: what is missing or unexpected."""
    return runs.set_faults(panel_of(spark, sf_dir), spark.range(27).select(F.col("id").alias("security_id")), ["security_id"])


@query(f"WITH {PW}, {label_sql(252, 'l252')}, {label_sql(5, 'l5')} SELECT CAST(h AS BIGINT) AS horizon FROM (SELECT unnest([5, 21, 63, 126, 252, 400]) AS h) WHERE h > 357 OR (SELECT count(*) FROM ses) <= h")
def missing_horizons(spark, sf_dir):
    """Wanted horizons without a label."""
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(h).cast("bigint") for h in (*P.HORIZONS, 400)])).alias("horizon"))
    found = P.forward_labels(weekly(spark, sf_dir), (*P.HORIZONS, 400)).where("skip_reason is null").select("horizon").distinct()
    return wanted.join(found, "horizon", "left_anti")


@query(f"""WITH {PW}, {feature_sql(21, 0)}, {label_sql(21)}, bench AS (SELECT session, price AS b FROM spine WHERE security_id = 1 AND idx % 3 <> 0),
t AS (SELECT f.security_id, f.session AS asof, end_price / l.price - 1 AS raw, x.b AS b, y.b AS e FROM feat f JOIN lab l ON l.security_id = f.security_id AND l.session = f.session LEFT JOIN bench x ON x.session = f.session LEFT JOIN bench y ON y.session = l.horizon_session WHERE f.status = 'ok' AND l.skip_reason IS NULL)
SELECT security_id, asof, round(CASE WHEN b > 0 AND e > 0 THEN raw - (e / b - 1) ELSE raw END, 8) AS ret FROM t""")
def join_target_coalesce(spark, sf_dir):
    """Feature rows with the excess return where the benchmark has both prices, else the raw one."""
    grid = weekly(spark, sf_dir)
    bench = grid.where("security_id = 1 and idx % 3 <> 0").select("session", F.col("price").alias("b_price"))
    return B.feature_label_rows(P.price_return(grid, 21), P.forward_labels(grid, (21,), bench)).select("security_id", "asof", r8("ret"))


@query(f"WITH {LABELS} SELECT 'raw' AS targets, count(*) AS n, CAST(0 AS BIGINT) AS excess, CASE WHEN count(*) = 0 THEN 'none' ELSE 'raw' END AS kind FROM lab WHERE skip_reason IS NULL AND excess_return IS NULL UNION ALL SELECT 'excess', count(*), count(*), CASE WHEN count(*) = 0 THEN 'none' ELSE 'excess' END FROM lab WHERE skip_reason IS NULL AND excess_return IS NOT NULL")
def target_kinds(spark, sf_dir):
    """The kind of targets of labels without and with a benchmark; together they would be an error."""
    rows = labels_at(spark, sf_dir).where("skip_reason is null")
    a = runs.checked_target_kind(rows.where("excess_return is null")).select(F.lit("raw").alias("targets"), "n", "excess", "kind")
    return a.union(runs.checked_target_kind(rows.where("excess_return is not null")).select(F.lit("excess"), "n", "excess", "kind"))


@query(f"WITH {LABELS} SELECT DISTINCT policy AS name, CAST(1 AS BIGINT) AS version FROM lab WHERE skip_reason IS NULL")
def policy_versions(spark, sf_dir):
    rows = labels_at(spark, sf_dir).where("skip_reason is null").select(F.col("policy").alias("name"), F.lit(1).cast("bigint").alias("version"))
    return runs.checked_policies(rows)


# ---------------------------------------------------------------- falsifier results

GAPS = f"""WITH {PW}, {joined_sql().replace('joined AS', 'whole AS')}, joined AS (SELECT * FROM whole WHERE NOT (idx BETWEEN 140 AND 175)), {splits_sql()}, {scores_sql()},
plan AS (SELECT s.*, (SELECT sum(candidates) FROM scores WHERE idx BETWEEN train_from AND train_to) AS trained, (SELECT sum(candidates) FROM scores WHERE idx BETWEEN test_from AND test_to) AS tested,
  (SELECT avg(strategy_net) FROM scores WHERE idx BETWEEN test_from AND test_to) AS s, (SELECT avg(baseline_net) FROM scores WHERE idx BETWEEN test_from AND test_to) AS b, (SELECT count(*) FROM scores WHERE idx BETWEEN test_from AND test_to) AS dates FROM splits s)"""


def gapped(spark, sf_dir):
    return joined(spark, sf_dir).where("not (idx between 140 and 175)")


def planned(spark, sf_dir, rows):
    return runs.planned_windows(B.date_scores(rows), splits_for(spark, sf_dir, rows))


@query(f"""{GAPS}, t AS (SELECT count(*) AS planned, count(*) FILTER (WHERE trained IS NOT NULL AND tested IS NOT NULL) AS windows, count(*) FILTER (WHERE trained IS NULL) AS without_train, count(*) FILTER (WHERE trained IS NOT NULL AND tested IS NULL) AS without_test,
  avg(s) FILTER (WHERE trained IS NOT NULL) AS ms, avg(b) FILTER (WHERE trained IS NOT NULL) AS mb, sum(dates) FILTER (WHERE trained IS NOT NULL AND tested IS NOT NULL) AS dates FROM plan)
SELECT planned, windows, without_train, without_test, CAST(dates AS BIGINT) AS dates, round(ms, 8) AS mean_strategy, round(mb, 8) AS mean_baseline, CASE WHEN windows > 0 THEN 'succeeded' ELSE 'insufficient_data' END AS status,
array_to_string(list_filter([CASE WHEN without_train > 0 THEN 'windows_without_train' END, CASE WHEN without_test > 0 THEN 'windows_without_test' END, CASE WHEN dates > 0 AND dates < 5 THEN 'small_sample' END, CASE WHEN ms <= mb THEN 'baseline_not_exceeded' END], lambda x: x IS NOT NULL), ',') AS failure_modes FROM t""")
def fals_result(spark, sf_dir):
    rows = gapped(spark, sf_dir)
    r = runs.falsifier_result(planned(spark, sf_dir, rows), rows)
    return r.select("planned", "windows", "without_train", "without_test", "dates", r8("mean_strategy"), r8("mean_baseline"), "status", F.array_join("failure_modes", ",").alias("failure_modes"))


_FEW = (5, 63, 126, 252)


def _few_sql(h: int) -> str:
    t = f"_{h}"
    return f"{joined_sql(horizon=h, tag=t)}, {splits_sql(h, t)}, {scores_sql(t)}, {windows_sql(t)}"


@query(f"WITH {PW}, " + ", ".join(_few_sql(h).replace("lab_", "lab_") for h in _FEW) + " " + " UNION ALL ".join(f"""SELECT CAST({h} AS BIGINT) AS horizon, (SELECT count(*) FROM splits_{h}) AS planned, count(*) AS windows, CASE WHEN count(*) > 0 THEN 'succeeded' ELSE 'insufficient_data' END AS status,
CASE WHEN (SELECT count(*) FROM joined_{h}) = 0 THEN 'no_inputs' WHEN (SELECT count(*) FROM splits_{h}) = 0 THEN 'too_few_sessions' WHEN count(*) = 0 THEN 'no_scorable_window' WHEN avg(strategy_net) <= avg(baseline_net) THEN 'baseline_not_exceeded' ELSE '' END AS failure_modes FROM wins_{h}""" for h in _FEW))
def fals_insufficient(spark, sf_dir):
    """Runs at growing horizons, of which the last leave too few sessions for a window."""
    out = None
    for h in _FEW:
        rows = joined(spark, sf_dir, horizon=h)
        found = runs.falsifier_result(runs.planned_windows(B.date_scores(rows), splits_for(spark, sf_dir, rows, h)), rows)
        part = found.select(F.lit(h).cast("bigint").alias("horizon"), "planned", "windows", "status", F.array_join("failure_modes", ",").alias("failure_modes"))
        out = part if out is None else out.union(part)
    return out


@query(f"{GAPS} SELECT 'scorable' AS source, arg_min(train_from, split) AS train_from, arg_min(train_to, split) AS train_to, arg_min(test_from, split) AS test_from, max(test_to) AS test_to FROM plan WHERE trained IS NOT NULL AND tested IS NOT NULL UNION ALL SELECT 'inputs', min(idx), max(idx), max(idx) + 1, max(idx) + {HORIZON} FROM joined WHERE idx < 60")
def model_windows(spark, sf_dir):
    """The window of a run that has scorable windows, and of one whose inputs are too short to plan any."""
    out = None
    for rows in (gapped(spark, sf_dir), gapped(spark, sf_dir).where("idx < 60")):
        part = runs.model_window(planned(spark, sf_dir, rows), rows.withColumn("outcome_idx", F.col("idx") + HORIZON))
        out = part if out is None else out.union(part)
    return out


RANKED = """SELECT count(*) AS pairs, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rank FROM (SELECT rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY ret) + (count(*) OVER (PARTITION BY ret) - 1) / 2.0 AS ry FROM pred)"""
SPREAD = """SELECT avg(spread) AS gross FROM (SELECT asof, avg(ret) FILTER (WHERE k > m - b) - avg(ret) FILTER (WHERE k <= b) AS spread FROM (SELECT *, CASE WHEN greatest(1, CAST(floor(m * 0.2) AS BIGINT)) * 2 > m THEN m // 2 ELSE greatest(1, CAST(floor(m * 0.2) AS BIGINT)) END AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY asof ORDER BY {s}, security_id) AS k, count(*) OVER (PARTITION BY asof) AS m FROM pred)) WHERE b >= 1 GROUP BY 1)"""
COST = B.long_short_cost(HORIZON)


@query(f"{BASE}, {OLS}, {PRED}, a AS ({RANKED.format(s='score')}), b AS ({RANKED.format(s='feature')}), c AS ({SPREAD.format(s='score')}), d AS ({SPREAD.format(s='feature')}) SELECT a.pairs, round(a.rank, 6) AS model_rank, round(b.rank, 6) AS baseline_rank, round(c.gross, 8) AS model_gross, round(c.gross - {COST!r}, 8) AS model_net, round(d.gross, 8) AS baseline_gross, round(d.gross - {COST!r}, 8) AS baseline_net, round(a.rank - b.rank, 6) AS rank_delta, round(c.gross - d.gross, 8) AS net_delta FROM a, b, c, d")
def ols_pooled(spark, sf_dir):
    rows = joined(spark, sf_dir)
    splits = splits_for(spark, sf_dir, rows)
    m = runs.pooled_metrics(B.predictions(rows, splits, B.walk_forward_ols(rows, splits)), HORIZON, 0.2)
    return m.select("pairs", *[F.round(c, 6).alias(c) for c in ("model_rank", "baseline_rank")], *[r8(c) for c in ("model_gross", "model_net", "baseline_gross", "baseline_net")], F.round("rank_delta", 6).alias("rank_delta"), r8("net_delta"))


@query(f"""{BASE}, {_REGIME_SQL}, long AS (SELECT asof, 'strategy_net' AS measure, strategy_net AS v FROM scores UNION ALL SELECT asof, 'baseline_net', baseline_net FROM scores UNION ALL SELECT asof, 'net_difference', strategy_net - baseline_net FROM scores)
SELECT name, m AS measure, count(asof) AS sample_count, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS sd, round(avg(CASE WHEN v > 0 THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END), 8) AS hit_rate
FROM regimes CROSS JOIN (SELECT unnest(['strategy_net', 'baseline_net', 'net_difference']) AS m) LEFT JOIN long ON asof BETWEEN a AND b AND measure = m GROUP BY 1, 2""")
def regime_metrics(spark, sf_dir):
    regimes = values(spark, "name string, a string, b string", REGIMES).select("name", F.col("a").cast("date").alias("start_date"), F.col("b").cast("date").alias("end_date"))
    return runs.regime_metrics(B.date_scores(joined(spark, sf_dir)), regimes).select("name", "measure", "sample_count", *[r8(c) for c in ("mean", "sd", "hit_rate")])


@query("""WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS k, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1),
r AS (SELECT 'r' || CASE WHEN k % 11 = 5 THEN k - 1 ELSE k END AS name, a, CASE WHEN k % 7 = 3 THEN b + 10 WHEN k % 13 = 6 THEN a - 1 WHEN k % 5 = 2 THEN b - 10 ELSE b END AS b FROM m),
x AS (SELECT name, CASE WHEN a > b THEN 'reversed' WHEN a <= lag(b) OVER (ORDER BY a) THEN 'overlap' WHEN a - lag(b) OVER (ORDER BY a) > 1 THEN 'gap' WHEN count(*) OVER (PARTITION BY name) > 1 THEN 'repeated' END AS fault FROM r)
SELECT name, fault FROM x WHERE fault IS NOT NULL""")
def regime_faults(spark, sf_dir):
    """Regimes of a month of orders each, some reversed, overlapping, apart or of the same name."""
    k, a, b = F.col("k"), F.col("a"), F.col("b")
    m = S.load(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("k")).agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    end = F.when(k % 7 == 3, F.date_add(b, 10)).when(k % 13 == 6, F.date_add(a, -1)).when(k % 5 == 2, F.date_add(b, -10)).otherwise(b)
    return B.regime_faults(m.select(F.concat(F.lit("r"), F.when(k % 11 == 5, k - 1).otherwise(k).cast("string")).alias("name"), a.alias("start_date"), end.alias("end_date")))


def _exact_sql(x: str) -> str:
    """``runs.exact`` in SQL."""
    part = lambda k: f"CAST(floor(abs({x}) * {2.0 ** (30 * k)!r}) - floor(abs({x}) * {2.0 ** (30 * (k - 1))!r}) * {2.0 ** 30!r} AS BIGINT)" if k else f"CAST(floor(abs({x})) AS BIGINT)"
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '+' END || " + " || '.' || ".join(part(k) for k in range(4))


@query(f"{BASE}, rowsh AS (SELECT asof AS g, security_id AS o, sha256('=' || security_id || '|=' || asof || '|=' || horizon_session || '|=' || {_exact_sql('feature')} || '|=' || {_exact_sql('ret')}) AS h FROM joined), groups AS (SELECT g, sha256(string_agg(h, '' ORDER BY o)) AS h FROM rowsh GROUP BY g) "
       "SELECT sha256(string_agg(h, '' ORDER BY g)) AS fingerprint FROM groups")
def input_fingerprint(spark, sf_dir):
    """The same digest for the same inputs in any order of rows, and another for any other."""
    return runs.fingerprint(joined(spark, sf_dir), "asof", "security_id", [F.col("security_id"), F.col("asof"), F.col("horizon_session"), runs.exact(F.col("feature")), runs.exact(F.col("ret"))])


@query(f"{BASE} SELECT count(*) AS n, count(DISTINCT security_id) AS securities, count(DISTINCT asof) AS dates, min(asof) AS first_asof, max(asof) AS last_asof, max(horizon_session) AS last_outcome FROM joined")
def input_coverage(spark, sf_dir):
    return joined(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("security_id").alias("securities"), F.countDistinct("asof").alias("dates"), F.min("asof").alias("first_asof"), F.max("asof").alias("last_asof"), F.max("horizon_session").alias("last_outcome"))


@query(f"WITH {PW}, {MEMBERS}, {joined_sql()} SELECT (SELECT count(*) FROM members) AS members, (SELECT count(*) FROM feat WHERE status = 'ok') AS features, (SELECT count(*) FROM lab WHERE skip_reason IS NULL) AS labels, (SELECT count(*) FROM joined) AS joined")
def input_counts(spark, sf_dir):
    grid = weekly(spark, sf_dir)
    sides = [
        ("members", S.universe(spark, sf_dir)), ("features", P.price_return(grid, 21).where("status = 'ok'")), ("labels", P.forward_labels(grid, (HORIZON,)).where("skip_reason is null")), ("joined", joined(spark, sf_dir)),
    ]
    out = None
    for name, rows in sides:
        part = rows.agg(F.count("*").alias(name))
        out = part if out is None else out.join(part, F.lit(True))
    return out


@query(f"{BASE} SELECT split, 'difference' AS field FROM wins WHERE split % 5 = 2 AND split < (SELECT max(split) FROM wins) UNION ALL SELECT max(split), 'row' FROM wins")
def replay_drift(spark, sf_dir):
    """A replay against a stored claim of which some figures were altered and the last window is missing."""
    again = windows_for(spark, sf_dir)
    stored = once(spark, f"claim:{sf_dir}", lambda: again)
    last = stored.agg(F.max("split").alias("last"))
    altered = stored.join(F.broadcast(last), F.col("split") < F.col("last")).withColumn("difference", F.when(F.col("split") % 5 == 2, F.col("difference") + 1).otherwise(F.col("difference")))
    fields = ["train_rows", "test_dates", "test_rows", "test_start", "test_end", "strategy_net", "baseline_net", "difference"]
    rerun = again.select("split", *[F.round(c, 8).alias(c) if c in fields[-3:] else c for c in fields])
    held = altered.select("split", *[F.round(c, 8).alias(c) if c in fields[-3:] else c for c in fields])
    return runs.drifted(held, rerun, ["split"], fields).select("split", "field")


@query(f"{BASE} SELECT 'windows' AS field, '-1' AS expected, CAST(count(*) AS VARCHAR) AS found FROM wins")
def report_trace(spark, sf_dir):
    """What a report would claim that its stored run doesn't say."""
    stored = B.headline(windows_for(spark, sf_dir)).select("windows", F.lit("succeeded").alias("status"))
    return runs.trace_faults({"windows": -1, "status": "succeeded"}, stored)


@query(f"""{BASE}, h AS (SELECT count(*) AS w, sum(test_dates) AS d, avg(strategy_net) AS s, avg(baseline_net) AS b, avg(difference) AS x, avg(CASE WHEN difference > 0 THEN 1.0 ELSE 0.0 END) AS r, avg(difference) / nullif(stddev_samp(difference), 0) AS q FROM wins)
SELECT 'headline' AS section, CAST(0 AS BIGINT) AS line, 'windows: ' || w AS text FROM h UNION ALL SELECT 'headline', 1, 'dates: ' || CAST(d AS BIGINT) FROM h UNION ALL SELECT 'headline', 2, 'mean strategy: ' || printf('%+.4f%%', s * 100) FROM h UNION ALL SELECT 'headline', 3, 'mean baseline: ' || printf('%+.4f%%', b * 100) FROM h
UNION ALL SELECT 'headline', 4, 'mean difference: ' || printf('%+.4f%%', x * 100) FROM h UNION ALL SELECT 'headline', 5, 'hit rate: ' || printf('%+.1f%%', r * 100) FROM h UNION ALL SELECT 'headline', 6, 'mean over sd: ' || coalesce(printf('%.3f', q), 'n/a') FROM h UNION ALL SELECT 'windows', split, test_start || '..' || test_end || ' ' || printf('%+.4f%%', difference * 100) FROM wins""")
def report_lines(spark, sf_dir):
    w = windows_for(spark, sf_dir)
    return runs.report_lines(B.headline(w), w)


# ---------------------------------------------------------------- registry and reports


@query(f"""{_LAYER_SQL}, c AS (SELECT m.ticker, (SELECT count(*) FROM pw x WHERE x.security_id = m.security_id) AS p, (SELECT count(*) FROM f x WHERE x.security_id = m.security_id AND m.security_id % 6 <> 1) AS fr, (SELECT count(*) FROM l x WHERE x.security_id = m.security_id) AS lr,
  (SELECT count(*) FROM j x WHERE x.security_id = m.security_id AND m.security_id % 6 <> 1) AS jr, (SELECT count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM (SELECT * FROM f WHERE security_id % 6 <> 1)) x WHERE x.security_id = m.security_id) AS lf, (SELECT count(*) FROM (SELECT * FROM (SELECT * FROM f WHERE security_id % 6 <> 1) EXCEPT SELECT * FROM l) x WHERE x.security_id = m.security_id) AS fl FROM members m),
t AS (SELECT 'blocking' AS kind, 'prices_missing' AS message, ticker FROM c WHERE p = 0 UNION ALL SELECT 'blocking', 'features_missing', ticker FROM c WHERE fr = 0 UNION ALL SELECT 'blocking', 'labels_missing', ticker FROM c WHERE lr = 0 UNION ALL SELECT 'blocking', 'no_overlap', ticker FROM c WHERE jr = 0
  UNION ALL SELECT 'gap', 'labels_without_features', ticker FROM c WHERE lf > 0 UNION ALL SELECT 'gap', 'features_without_labels', ticker FROM c WHERE fl > 0)
SELECT kind, message, count(*) AS members, string_agg(ticker, ', ' ORDER BY ticker) AS tickers FROM t GROUP BY 1, 2""")
def diag_messages(spark, sf_dir):
    members = S.universe(spark, sf_dir).select(big("security_id"), "ticker")
    prices, f, ls, _ = _layers(spark, sf_dir)
    f = f.where("security_id % 6 <> 1")
    return runs.input_messages(R.coverage(members, prices, f, ls, f.join(ls, ["security_id", "session"])))


@query(f"{BASE} SELECT {_WINDOW_COLUMNS} FROM wins")
def explain_windows(spark, sf_dir):
    """The windows of a run from the JSON that its registry row holds."""
    w = windows_for(spark, sf_dir)
    held = w.agg(F.to_json(F.sort_array(F.collect_list(F.struct("split", "train_rows", "test_dates", "test_rows", "test_start", "test_end", "strategy_net", "baseline_net", "difference")))).alias("metrics"))
    schema = "array<struct<split:bigint,train_rows:bigint,test_dates:bigint,test_rows:bigint,test_start:date,test_end:date,strategy_net:double,baseline_net:double,difference:double>>"
    return _windows(held.select(F.inline(F.from_json("metrics", schema))))


@query(f"{BASE}, {ATTR} SELECT * FROM (SELECT 'strongest' AS side, split, round(difference, 8) AS difference FROM wins ORDER BY wins.difference DESC, split LIMIT 5) UNION ALL SELECT * FROM (SELECT 'weakest', split, round(difference, 8) FROM wins ORDER BY wins.difference, split LIMIT 5)")
def strongest_windows(spark, sf_dir):
    w = windows_for(spark, sf_dir)
    out = None
    for side, order in (("strongest", F.desc("difference")), ("weakest", F.asc("difference"))):
        part = w.orderBy(order, "split").limit(5).select(F.lit(side).alias("side"), "split", r8("difference"))
        out = part if out is None else out.union(part)
    return out


@query(f"{BASE} SELECT CAST(year(test_start) AS BIGINT) AS year, count(*) AS windows, round(sum(difference), 8) AS total, round(avg(difference), 8) AS mean, count(*) FILTER (WHERE difference > 0) AS positive, round(min(difference), 8) AS worst, round(max(difference), 8) AS best, round(sum(difference) / (SELECT sum(difference) FROM wins), 6) AS share FROM wins GROUP BY 1")
def year_drivers(spark, sf_dir):
    return R.year_drivers(windows_for(spark, sf_dir)).select("year", "windows", r8("total"), r8("mean"), "positive", r8("worst"), r8("best"), F.round("share", 6).alias("share"))


_STATUS_SQL = "r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE ['failed', 'insufficient_data', 'paused'][1 + o_orderkey % 3] END AS status, CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS pass, CASE WHEN o_custkey % 5 = 0 THEN 'walk_forward_unstable' END AS failure FROM orders)"


def run_statuses(spark, sf_dir):
    """(status, scramble_pass, failure): a run for each order."""
    late = F.element_at(F.array(*[F.lit(x) for x in ("failed", "insufficient_data", "paused")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise(late)
    k = F.col("o_custkey")
    return S.load(spark, sf_dir, "orders").select(status.alias("status"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("scramble_pass"), F.when(k % 5 == 0, "walk_forward_unstable").alias("failure"))


@query("WITH " + _STATUS_SQL + """ SELECT status, pass AS scramble_pass, CASE WHEN status = 'running' THEN 'running' WHEN status = 'failed' THEN 'failed' WHEN status = 'insufficient_data' THEN 'rejected' WHEN status = 'succeeded' AND pass = false THEN 'rejected' WHEN status = 'succeeded' AND pass THEN 'promising' ELSE 'failed' END AS evaluation,
CASE WHEN status = 'running' THEN NULL WHEN status = 'failed' THEN 'backtest_failed' WHEN status = 'insufficient_data' THEN 'insufficient_data' WHEN status = 'succeeded' AND pass = false THEN 'label_scramble_failed' WHEN status = 'succeeded' AND pass THEN NULL ELSE 'unsupported_backtest_status:' || status END AS reason, count(*) AS runs FROM r GROUP BY ALL""")
def evaluation_statuses(spark, sf_dir):
    rows = run_statuses(spark, sf_dir)
    told = rows.select("status", "scramble_pass", R.evaluation_status(F.col("status"), F.col("scramble_pass")).alias("evaluation"), R.evaluation_reason(F.col("status"), F.col("scramble_pass")).alias("reason"))
    return told.groupBy("status", "scramble_pass", "evaluation", "reason").agg(F.count("*").alias("runs"))


@query("WITH " + _STATUS_SQL + " SELECT CASE WHEN failure IS NOT NULL THEN 'rejected' WHEN pass = false THEN 'rejected' WHEN pass IS NULL THEN 'failed' END AS status, CASE WHEN failure IS NOT NULL THEN failure WHEN pass = false THEN 'label_scramble_failed' WHEN pass IS NULL THEN 'label_scramble_missing' END AS reason, count(*) AS runs FROM r GROUP BY 1, 2")
def harder_statuses(spark, sf_dir):
    rows = run_statuses(spark, sf_dir).select(R.harder_status(F.col("failure"), F.col("scramble_pass")).alias("h"))
    return rows.groupBy("h.status", "h.reason").agg(F.count("*").alias("runs"))


@query(cells_sql() + " SELECT base_key || '__h' || horizon AS hypothesis_key, base_key, CASE WHEN base_key IN ('revenue_growth_yoy', 'gross_margin', 'operating_margin', 'net_margin', 'diluted_shares_change_yoy') THEN 'fundamentals' ELSE 'price' END AS family, verdict FROM cells")
def hypothesis_families(spark, sf_dir):
    rows = cells(spark, sf_dir).withColumn("hypothesis_key", F.concat("base_key", F.lit("__h"), F.col("horizon").cast("string")))
    return rows.select("hypothesis_key", R.base_key(F.col("hypothesis_key")).alias("base_key"), R.family(R.base_key(F.col("hypothesis_key"))).alias("family"), "verdict")


@query(cells_sql() + " SELECT family, count(*) FILTER (WHERE verdict = 'accepted') AS accepted, count(*) FILTER (WHERE verdict = 'promising') AS promising, count(*) FILTER (WHERE verdict = 'rejected') AS rejected, count(*) FILTER (WHERE verdict NOT IN ('accepted', 'promising', 'rejected')) AS others FROM (SELECT *, CASE WHEN base_key IN ('revenue_growth_yoy', 'gross_margin', 'operating_margin', 'net_margin', 'diluted_shares_change_yoy') THEN 'fundamentals' ELSE 'price' END AS family FROM cells) GROUP BY 1")
def family_verdicts(spark, sf_dir):
    rows = cells(spark, sf_dir).withColumn("family", R.family(F.col("base_key")))
    wide = rows.groupBy("family").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("accepted", "promising", "rejected")], F.count_if(~F.col("verdict").isin("accepted", "promising", "rejected")).alias("others"))
    return wide


_EVALUATED = "horizon IN (5, 21) OR base_key = 'net_margin'"


@query(cells_sql() + f" SELECT base_key, horizon, verdict, reason, round(difference, 8) AS difference FROM cells WHERE NOT ({_EVALUATED})")
def sweep_remaining(spark, sf_dir):
    """The sweep after a part of the cells has been evaluated: those are left out before anything is scored."""
    done = cells(spark, sf_dir).where(_EVALUATED).select("base_key", "horizon")
    return sweep_cells(spark, sf_dir, done).select("base_key", "horizon", "verdict", "reason", r8("difference"))


@query(cells_sql() + " SELECT base_key, array_to_string(list(CAST(horizon AS VARCHAR) ORDER BY horizon), ',') AS untested FROM cells WHERE verdict = 'insufficient_data' GROUP BY 1")
def untested_cells(spark, sf_dir):
    rows = cells(spark, sf_dir).where("verdict = 'insufficient_data'")
    return rows.groupBy("base_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list("horizon")), lambda x: x.cast("string")), ",").alias("untested"))


@query(cells_sql() + """ SELECT reason, count(*) AS n, CASE reason WHEN 'passed' THEN 'beats the equal-weight baseline after costs' WHEN 'baseline_failed' THEN 'does not beat the equal-weight baseline after costs' WHEN 'insufficient_data' THEN 'too few sessions for a window' WHEN 'running' THEN 'not finished'
  WHEN 'insufficient_walk_forward_windows' THEN 'too few scored windows to tell' WHEN 'walk_forward_unstable' THEN 'too few windows beat the baseline, or their mean does not' WHEN 'label_scramble_failed' THEN 'permuted labels do as well' END AS meaning, min(base_key || '__h' || horizon) AS example FROM cells GROUP BY 1""")
def reason_glossary(spark, sf_dir):
    return R.glossary(cells(spark, sf_dir))


@query(candidates_sql() + ", w AS (SELECT *, list_contains([" + ", ".join(f"'{n}'" for n in CANDIDATES) + """], name) AS known FROM (SELECT DISTINCT CASE p_size % 6 WHEN 0 THEN 'price_to_moon' WHEN 1 THEN 'momentum_12_1' WHEN 2 THEN 'gross_margin' WHEN 3 THEN 'realized_volatility_63' WHEN 4 THEN 'net_margin' ELSE lower(p_type) END AS name FROM part))
SELECT name, known, count(base_key) AS ok_values FROM w LEFT JOIN (SELECT * FROM cand WHERE status = 'ok') c ON c.base_key = name GROUP BY 1, 2""")
def candidate_registry(spark, sf_dir):
    """Names that are asked for, looked up among the materializers: whether they are known, and their values."""
    size = F.col("p_size") % 6
    name = F.when(size == 0, "price_to_moon").when(size == 1, "momentum_12_1").when(size == 2, "gross_margin").when(size == 3, "realized_volatility_63").when(size == 4, "net_margin").otherwise(F.lower("p_type"))
    wanted = S.load(spark, sf_dir, "part").select(name.alias("name")).distinct()
    known = values(spark, "name string, known boolean", [(n, True) for n in materializers(spark, sf_dir) if n in CANDIDATES])
    found = candidate_values(spark, sf_dir).where("status = 'ok'").groupBy(F.col("base_key").alias("name")).agg(F.count("*").alias("ok_values"))
    return wanted.join(known, "name", "left").join(found, "name", "left").select("name", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("ok_values", F.lit(0)).alias("ok_values"))


@query(cells_sql() + """, p AS (SELECT base_key || '__h' || horizon AS key, p_value, row_number() OVER (ORDER BY p_value, base_key || '__h' || horizon) AS k, count(*) OVER () AS n FROM cells WHERE p_value IS NOT NULL),
q AS (SELECT *, least(1.0, min(p_value * n / k) OVER (ORDER BY k DESC)) AS q FROM p) SELECT key, round(p_value, 6) AS p_value, round(q, 6) AS q_value, q <= 0.05 AS rejected FROM q""")
def adjusted_p_values(spark, sf_dir):
    """The p-values of the sweep's cells as one family."""
    p = cells(spark, sf_dir).where("p_value is not null").select(F.concat_ws("__h", "base_key", "horizon").alias("key"), "p_value")
    return R.benjamini_hochberg(p, 0.05).select("key", F.round("p_value", 6).alias("p_value"), F.round("q_value", 6).alias("q_value"), "rejected")
