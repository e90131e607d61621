"""Named queries over the test tables and their DuckDB equivalents.

Figures are rounded to eight places on both sides, instants are given as UTC text, and counts are 64-bit.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronopanel.functions import time as T
from chronopanel.operators import backtest as B
from chronopanel.operators import income as INC
from chronopanel.operators import panel as P
from chronopanel.operators import ranks
from chronopanel.operators import reports as R
from chronopanel.session import once, stage
from chronopanel.sources import tables as S
from chronopanel.sources import vault, vendor

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Sizes that fit the test panel of 357 weeks: lookback, skip, horizon, minimal train, test and step sessions.
LOOKBACK, SKIP, HORIZON, TRAIN, TEST, STEP = 21, 0, 5, 60, 20, 20
REGIMES = [("early", "1990-01-01", "1996-12-31"), ("middle", "1997-01-01", "1998-12-31"), ("late", "1999-01-01", "2009-12-31"), ("after", "2010-01-01", "2019-12-31")]
STAMP = "yyyy-MM-dd HH:mm:ss"


def quoted(sql: str) -> str:
    """The name asof is a keyword in DuckDB, and stays one in ASOF JOIN."""
    return re.sub(r"\basof\b", '"asof"', sql)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = quoted(sql)
        return f

    return add


def r8(name: str):
    return F.round(F.col(name).cast("double"), 8).alias(name)


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


# ---------------------------------------------------------------- shared SQL

PW = """
pw AS (SELECT CAST(s_nationkey AS BIGINT) AS security_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS session,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS price,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
ses AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS idx FROM (SELECT DISTINCT session FROM pw)),
spine AS (SELECT a.security_id, ses.session, ses.idx, pw.price, pw.volume FROM (SELECT DISTINCT security_id FROM pw) a CROSS JOIN ses LEFT JOIN pw ON pw.security_id = a.security_id AND pw.session = ses.session)"""
PD = PW.replace("CAST(date_trunc('week', l_shipdate) AS DATE)", "CAST(l_shipdate AS DATE)").replace("ON l_suppkey = s_suppkey GROUP", "ON l_suppkey = s_suppkey WHERE isodow(l_shipdate) < 6 GROUP").replace(
    "(SELECT DISTINCT session FROM pw)", "(SELECT CAST(d AS DATE) AS session FROM (SELECT unnest(generate_series(min(session), max(session), INTERVAL 1 DAY)) AS d FROM pw) WHERE isodow(d) < 6)")
BY = "OVER (PARTITION BY security_id ORDER BY idx"


def feature_sql(lookback: int, skip: int, source: str = "spine", name: str = "feat") -> str:
    late = f"lag(price, {skip}) {BY})" if skip else "price"
    return f"""{name} AS (SELECT *, CASE WHEN status = 'ok' THEN late / early - 1 END AS value FROM (
  SELECT *, CASE WHEN idx < {lookback} THEN 'insufficient_history' WHEN late IS NULL OR early IS NULL THEN 'missing_price' ELSE 'ok' END AS status
  FROM (SELECT *, {late} AS late, lag(price, {lookback}) {BY}) AS early FROM {source})))"""


def label_sql(horizon: int, name: str = "lab", source: str = "spine") -> str:
    return f"""{name} AS (SELECT *, CASE WHEN price IS NULL THEN 'missing_asof_price' WHEN price <= 0 THEN 'invalid_asof_price'
  WHEN idx + {horizon} > last_idx THEN 'insufficient_calendar_history' WHEN end_price IS NULL THEN 'missing_target_price' WHEN end_price <= 0 THEN 'invalid_target_price' END AS skip_reason
  FROM (SELECT *, max(idx) OVER () AS last_idx, lead(price, {horizon}) {BY}) AS end_price, lead(session, {horizon}) {BY}) AS horizon_session FROM {source}))"""


def joined_sql(lookback: int = LOOKBACK, skip: int = SKIP, horizon: int = HORIZON, sign: str = "", tag: str = "") -> str:
    return f"""{feature_sql(lookback, skip, name='feat' + tag)}, {label_sql(horizon, 'lab' + tag)},
joined{tag} AS (SELECT f.security_id, f.session AS asof, f.idx, l.horizon_session, {sign}f.value AS feature, l.end_price / l.price - 1 AS ret
  FROM feat{tag} f JOIN lab{tag} l ON f.security_id = l.security_id AND f.session = l.session WHERE f.status = 'ok' AND l.skip_reason IS NULL)"""


def splits_sql(horizon: int = HORIZON, tag: str = "", train_from: str = "0") -> str:
    return f"""cover{tag} AS (SELECT idx FROM ses WHERE session BETWEEN (SELECT min(asof) FROM joined{tag}) AND (SELECT max(horizon_session) FROM joined{tag})),
splits{tag} AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS split, base + {train_from} AS train_from, base + pos - {horizon} - 1 AS train_to, base + pos AS test_from, base + pos + {TEST} - 1 AS test_to
  FROM (SELECT base, unnest(generate_series({TRAIN + horizon}, n - {TEST} - {horizon}, {STEP})) AS pos FROM (SELECT min(idx) AS base, count(*) AS n FROM cover{tag})))"""


def scores_sql(tag: str = "") -> str:
    return f"""ranked{tag} AS (SELECT *, row_number() OVER (PARTITION BY asof ORDER BY feature DESC, security_id) AS rn, count(*) OVER (PARTITION BY asof) AS n FROM joined{tag}),
scores{tag} AS (SELECT asof, idx, count(*) AS candidates, count(*) FILTER (WHERE rn <= greatest(1, n // 2)) AS selected,
  avg(ret) FILTER (WHERE rn <= greatest(1, n // 2)) - 0.002 AS strategy_net, avg(ret) - 0.002 AS baseline_net FROM ranked{tag} GROUP BY asof, idx)"""


def windows_sql(tag: str = "") -> str:
    return f"""wins{tag} AS (SELECT split, (SELECT sum(candidates) FROM scores{tag} t WHERE t.idx BETWEEN train_from AND train_to) AS train_rows,
  count(*) AS test_dates, sum(candidates) AS test_rows, min(asof) AS test_start, max(asof) AS test_end, avg(strategy_net) AS strategy_net, avg(baseline_net) AS baseline_net,
  avg(strategy_net) - avg(baseline_net) AS difference
  FROM splits{tag} JOIN scores{tag} ON idx BETWEEN test_from AND test_to GROUP BY split, train_from, train_to)"""


BASE = f"WITH {PW}, {joined_sql()}, {splits_sql()}, {scores_sql()}, {windows_sql()}"


# ---------------------------------------------------------------- shared plans


def panel_of(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """The price panel, aggregated once a session from the lines of orders."""
    return once(spark, f"panel:{grain}:{sf_dir}", lambda: S.panel(spark, sf_dir, grain).withColumn("security_id", F.col("security_id").cast("bigint")))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = panel_of(spark, sf_dir)
    return once(spark, f"weekly:{sf_dir}", lambda: S.spine(prices, S.sessions_of(prices)))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = panel_of(spark, sf_dir, "day")
    return once(spark, f"daily:{sf_dir}", lambda: S.spine(prices, S.weekdays_of(prices)))


def joined(spark: SparkSession, sf_dir: str, lookback: int = LOOKBACK, skip: int = SKIP, horizon: int = HORIZON, direction: str = "high") -> DataFrame:
    return P.samples(weekly(spark, sf_dir), lookback, skip, horizon, direction)


def splits_for(spark: SparkSession, sf_dir: str, rows: DataFrame, horizon: int = HORIZON, max_train: int | None = None) -> DataFrame:
    """Splits of the sessions from the first as-of to the last outcome, bounds and all in one plan."""
    bounds = rows.agg(F.min("idx").alias("base"), (F.max("idx") + horizon - F.min("idx") + 1).alias("n"))
    return B.splits_within(bounds, horizon, TRAIN, TEST, STEP, max_train)


def windows_for(spark: SparkSession, sf_dir: str, lookback: int = LOOKBACK, skip: int = SKIP, horizon: int = HORIZON, direction: str = "high") -> DataFrame:
    rows = joined(spark, sf_dir, lookback, skip, horizon, direction)
    return B.window_scores(B.date_scores(rows), splits_for(spark, sf_dir, rows, horizon))


# ---------------------------------------------------------------- sources and sinks


@query(f"WITH {PW} SELECT security_id, session, price, volume FROM pw")
def src_panel_weekly(spark, sf_dir):
    return panel_of(spark, sf_dir).select("security_id", "session", "price", "volume")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(props ->> 'k' AS BIGINT)) AS BIGINT) AS k_sum, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def src_json_props(spark, sf_dir):
    rows = S.load(spark, sf_dir, "events").select("event_type", "user_id", F.from_json("props", "k bigint").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k_sum"), F.countDistinct("user_id").alias("users"))


FUND = """
wide AS (SELECT CAST(c_nationkey AS BIGINT) AS security_id, CAST(year(o_orderdate) AS BIGINT) AS fiscal_year, 'Q' || quarter(o_orderdate) AS fiscal_period,
  last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS period_end,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
  CAST(sum(CASE WHEN substr(o_orderpriority, 1, 1) <= '3' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS gross_profit,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS operating_income,
  CAST(sum(CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS net_income, CAST(count(*) AS DOUBLE) AS shares
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4),
long AS (SELECT security_id, fiscal_year, fiscal_period, period_end, m.name AS metric_name, m.value AS metric_value, period_end + 41 AS available_day
  FROM (SELECT *, unnest([{'name': 'revenue', 'value': revenue}, {'name': 'gross_profit', 'value': gross_profit}, {'name': 'operating_income', 'value': operating_income}, {'name': 'net_income', 'value': net_income}, {'name': 'diluted_weighted_average_shares', 'value': shares}]) AS m FROM wide) WHERE m.value IS NOT NULL)"""


@query(f"WITH {FUND} SELECT security_id, fiscal_year, fiscal_period, period_end, metric_name, round(metric_value, 2) AS metric_value FROM long")
def src_unpivot_metrics(spark, sf_dir):
    return S.fundamentals(spark, sf_dir).select(big("security_id"), big("fiscal_year"), "fiscal_period", "period_end", "metric_name", F.round("metric_value", 2).alias("metric_value"))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY event_type")
def src_zip_arrays(spark, sf_dir):
    packed = S.load(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    rows = vendor.zip_columns(packed.select("user_id", F.col("e.event_id").alias("event_id"), F.col("e.event_type").alias("event_type")), ["event_id", "event_type"])
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


@query("""SELECT event_id, form, strftime(accepted_at, '%Y-%m-%d %H:%M:%S') AS accepted_at FROM (
  SELECT event_id, user_id, CASE WHEN value >= 50 THEN '8-K' ELSE '8-K/A' END AS form, event_type, timezone('UTC', timezone('America/New_York', ts)) AS accepted_at,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10') WHERE k <= 3""")
def src_release_filter(spark, sf_dir):
    rows = S.load(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(F.col("value") >= 50, "8-K").otherwise("8-K/A").alias("form"), F.when(F.col("event_type") == "click", "2.02, 9.01").otherwise("12.02").alias("items"),
        F.col("ts").cast("date").alias("filing_date"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("accepted"),
    )
    found = vendor.earnings_candidates(rows, "2024-01-10")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("accepted"), "event_id"))
    return found.withColumn("k", k).where("k <= 3").select("event_id", "form", F.date_format("accepted_at", STAMP).alias("accepted_at"))


@query("SELECT sha256(coalesce(text, '')) AS raw_hash, count(*) AS n FROM documents GROUP BY 1")
def vault_hash_counts(spark, sf_dir):
    return S.load(spark, sf_dir, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("raw_hash")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source, sha256(text) AS raw_hash FROM documents EXCEPT SELECT source, sha256(text) FROM documents WHERE doc_id % 3 = 0")
def vault_dedupe(spark, sf_dir):
    rows = S.load(spark, sf_dir, "documents").select("source", F.lit("documents").alias("endpoint"), F.lit("{}").alias("params"), F.col("text").alias("body"))
    held = S.load(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("source", F.lit("documents").alias("endpoint"), F.lit("{}").alias("params"), F.col("text").alias("body"))
    return vault.append_new(vault.vault_rows(held), rows).select("source", "raw_hash")


@query(r"""WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '#') > 0 THEN left(url, strpos(url, '#') - 1) ELSE url END AS base, CASE WHEN strpos(url, '#') > 0 THEN substr(url, strpos(url, '#')) ELSE '' END AS fragment
  FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '?client_secret=a%20b&x=1' WHEN 1 THEN '?b=2&a=%7E*+q&API_KEY=k#top' WHEN 2 THEN '?tokens=1&token=2&flag' ELSE '' END AS url FROM pages)),
parts AS (SELECT *, CASE WHEN strpos(base, '?') > 0 THEN left(base, strpos(base, '?') - 1) ELSE base END AS bare, CASE WHEN strpos(base, '?') > 0 THEN substr(base, strpos(base, '?') + 1) ELSE '' END AS query FROM cut),
items AS (SELECT page_id, list_sort(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: {'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(CASE WHEN strpos(x, '=') > 0 THEN substr(x, strpos(x, '=') + 1) ELSE '' END, '+', ' '))})) AS kv FROM parts)
SELECT p.page_id, bare || CASE WHEN len(kv) > 0 THEN '?' || array_to_string(list_transform(kv, lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(CASE WHEN replace(lower(trim(x.k)), '_', '-') IN ('access-token', 'api-key', 'apikey', 'authorization', 'client-secret', 'password', 'secret', 'token') THEN '[REDACTED]' ELSE x.v END), '%20', '+')), '&') ELSE '' END || fragment AS url
FROM parts p JOIN items i ON i.page_id = p.page_id""")
def vault_url_sanitize(spark, sf_dir):
    tail = F.element_at(F.array(F.lit("?client_secret=a%20b&x=1"), F.lit("?b=2&a=%7E*+q&API_KEY=k#top"), F.lit("?tokens=1&token=2&flag"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    return S.load(spark, sf_dir, "pages").select("page_id", vault.clean_url(F.concat("url", tail)).alias("url"))


@query(r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(replace(html, '<title>', '<title>A &amp; <b>B</b> &lt;'), '<title[^>]*>(.*?)</title>', 1, 'si'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title FROM pages""")
def html_title(spark, sf_dir):
    return S.load(spark, sf_dir, "pages").select("page_id", vendor.html_title(F.replace("html", F.lit("<title>"), F.lit("<title>A &amp; <b>B</b> &lt;"))).alias("title"))


@query(r"""WITH made AS (SELECT page_id, replace(html, '</body>', '<!-- <b> --><p>&#233;&#x4E2D; &copy;&unknown; &amp;lt; a&lt;b&nbsp;c<STYLE>p{}</STYLE></p></body>') AS html FROM pages),
bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script\b[^>]*>.*?(</script\s*>|$)', ' ', 'gis'), '<style\b[^>]*>.*?(</style\s*>|$)', ' ', 'gis'), '<[^>]+>', ' ', 'gs') AS t FROM made),
split AS (SELECT page_id, string_split(t, '&') AS p FROM bare),
told AS (SELECT page_id, p[1] || array_to_string(list_transform(p[2:], lambda x: CASE WHEN regexp_extract(x, '^(#[0-9]{1,7});', 1) <> '' THEN chr(CAST(regexp_extract(x, '^#([0-9]{1,7});', 1) AS INTEGER)) || regexp_replace(x, '^[^;]*;', '')
  WHEN regexp_extract(x, '^(#x[0-9A-F]{1,6});', 1) = '#x4E2D' THEN '中' || regexp_replace(x, '^[^;]*;', '')
  WHEN regexp_extract(x, '^([a-z]+);', 1) IN ('amp', 'lt', 'gt', 'quot', 'nbsp', 'copy', 'middot') THEN map {'middot': '·', 'amp': '&', 'lt': '<', 'gt': '>', 'quot': '"', 'nbsp': chr(160), 'copy': '©'}[regexp_extract(x, '^([a-z]+);', 1)] || regexp_replace(x, '^[^;]*;', '') ELSE '&' || x END), '') AS t FROM split)
SELECT page_id, trim(regexp_replace(t, '[\s\x{00A0}]+', ' ', 'g')) AS text FROM told""")
def html_text(spark, sf_dir):
    """The text of pages, with a comment, a style and all kinds of references put in."""
    more = '<!-- <b> --><p>&#233;&#x4E2D; &copy;&unknown; &amp;lt; a&lt;b&nbsp;c<STYLE>p{}</STYLE></p></body>'
    pages = S.load(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("</body>"), F.lit(more)))
    return pages.select("page_id", vendor.html_text("html").alias("text"))


@query("""WITH old AS (SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01'),
new AS (SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'),
m AS (SELECT CASE WHEN old.key IS NULL THEN 'inserted' WHEN new.key IS NOT NULL AND (new.status IS DISTINCT FROM old.status OR new.price IS DISTINCT FROM old.price) THEN 'updated' ELSE 'kept' END AS action,
  CASE WHEN new.key IS NOT NULL THEN new.status ELSE old.status END AS status FROM old FULL JOIN new ON old.key = new.key)
SELECT action, status, count(*) AS n FROM m GROUP BY 1, 2""")
def merge_upsert_changed(spark, sf_dir):
    rows = S.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "o_orderdate")
    old = rows.where("o_orderdate < timestamp_ntz'1998-06-01'").drop("o_orderdate")
    new = rows.where("o_orderdate >= timestamp_ntz'1997-01-01'").withColumn("status", F.when(F.col("status") == "O", "F").otherwise(F.col("status"))).drop("o_orderdate")
    return vault.merge_by_key(old, new, ["key"], ["status", "price"]).groupBy("action", "status").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- calendar and policies

CAL = """cal AS (SELECT CAST(d AS DATE) AS date, isodow(d) < 6 AS is_session FROM (SELECT unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY)) AS d FROM orders)),
numbered AS (SELECT *, CASE WHEN is_session THEN CAST(sum(CAST(is_session AS INT)) OVER (ORDER BY date) - 1 AS BIGINT) END AS idx,
  min(CASE WHEN is_session THEN date END) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_session FROM cal)"""


def order_calendar(spark, sf_dir):
    bounds = S.load(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("date"))
    session = F.weekday("date") < 5
    days = days.withColumn("is_session", session).withColumn("session_close", F.when(session, T.date_at_time(F.col("date"), 16)))
    return T.number_sessions(days)


@query(f"WITH {CAL} SELECT date, is_session, idx, next_session FROM numbered")
def cal_dense_sessions(spark, sf_dir):
    return order_calendar(spark, sf_dir).select("date", "is_session", "idx", "next_session")


@query(f"WITH {CAL} SELECT a.date, CAST(h AS BIGINT) AS horizon, b.date AS target FROM numbered a CROSS JOIN (SELECT unnest([5, 21, 63, 126, 252]) AS h) JOIN numbered b ON b.idx = a.idx + h")
def cal_advance_horizons(spark, sf_dir):
    return T.advance(order_calendar(spark, sf_dir))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, strftime(timezone('UTC', timezone('America/New_York', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 18 HOUR)), '%Y-%m-%d %H:%M:%S') AS available_at FROM orders")
def pol_date_at_time(spark, sf_dir):
    days = S.load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", F.date_format(T.date_at_time(F.col("day"), 18), STAMP).alias("available_at"))


@query(f"""WITH {CAL} SELECT o_orderkey, strftime(timezone('UTC', timezone('America/New_York', CAST(next_session AS TIMESTAMP) + INTERVAL 570 MINUTE)), '%Y-%m-%d %H:%M:%S') AS available_at
FROM orders LEFT JOIN numbered ON date = CAST(o_orderdate AS DATE)""")
def pol_next_session_open(spark, sf_dir):
    rows = S.load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return T.next_session_open(F.col("day"), order_calendar(spark, sf_dir), rows).select("o_orderkey", F.date_format("available_at", STAMP).alias("available_at"))


@query("""SELECT event_id, strftime(CASE WHEN event_type = 'click' THEN ts + INTERVAL 30 MINUTE ELSE ts + INTERVAL 5 MINUTE END, '%Y-%m-%d %H:%M:%S') AS available_at,
strftime(coalesce(CASE WHEN value >= 50 THEN ts + INTERVAL 2 HOUR END, ts), '%Y-%m-%d %H:%M:%S') AS call_at FROM events""")
def pol_plus_duration(spark, sf_dir):
    e = S.events(spark, sf_dir)
    at = F.when(F.col("event_type") == "click", T.plus_duration(F.col("ts"), 0, 30)).otherwise(T.plus_duration(F.col("ts"), 0, 5))
    call = T.plus_duration_or(F.when(F.col("value") >= 50, F.col("ts")), (2, 0), F.col("ts"))
    return e.select("event_id", F.date_format(at, STAMP).alias("available_at"), F.date_format(call, STAMP).alias("call_at"))


@query(f"""WITH {PD}, seen AS (SELECT security_id, session, price FROM pw WHERE CAST(session AS TIMESTAMP) + INTERVAL 18 HOUR <= TIMESTAMP '1997-06-30 18:00:00')
SELECT security_id, count(*) AS prices, max(session) AS newest, arg_max(price, session) AS price FROM seen GROUP BY security_id""")
def pit_visible_prices(spark, sf_dir):
    rows = panel_of(spark, sf_dir, "day")
    known = T.date_at_time(F.col("session"), 18)
    seen = rows.where(T.visible(known, known, T.date_at_time(F.lit("1997-06-30").cast("date"), 18)))
    return seen.groupBy(big("security_id")).agg(F.count("*").alias("prices"), F.max("session").alias("newest"), F.max_by("price", "session").alias("price"))


MEMBERS = """members AS (SELECT CAST(n_nationkey AS BIGINT) AS security_id, n_name AS ticker, CASE WHEN n_regionkey = 2 THEN DATE '1997-01-01' ELSE DATE '1990-01-01' END AS valid_from,
  CASE WHEN n_regionkey = 1 THEN DATE '1998-12-31' WHEN n_regionkey = 3 THEN DATE '2000-06-30' END AS valid_to FROM nation)"""


@query(f"WITH {PW}, {MEMBERS} SELECT session, count(*) AS members, CAST(sum(pw.security_id) AS BIGINT) AS id_sum FROM pw JOIN members m ON m.security_id = pw.security_id AND session >= valid_from AND (valid_to IS NULL OR session <= valid_to) GROUP BY session")
def universe_active(spark, sf_dir):
    m = S.universe(spark, sf_dir).withColumnRenamed("security_id", "m_id")
    p = panel_of(spark, sf_dir)
    rows = p.join(m, (F.col("security_id") == F.col("m_id")) & T.active(F.col("session"), F.col("valid_from"), F.col("valid_to")))
    return rows.groupBy("session").agg(F.count("*").alias("members"), F.sum("security_id").cast("bigint").alias("id_sum"))


@query(f"WITH {MEMBERS} SELECT security_id, ticker FROM members WHERE valid_from <= DATE '1999-12-31' AND (valid_to IS NULL OR valid_to >= DATE '1999-01-01')")
def universe_overlap(spark, sf_dir):
    m = S.universe(spark, sf_dir)
    window = [F.lit(d).cast("date") for d in ("1999-01-01", "1999-12-31")]
    return m.where(T.overlaps(*window, F.col("valid_from"), F.col("valid_to"))).select(big("security_id"), "ticker")


@query(f"WITH {PW}, {MEMBERS} SELECT security_id, session, price FROM pw WHERE EXISTS (SELECT 1 FROM members m WHERE m.security_id = pw.security_id AND valid_to IS NULL)")
def universe_semi(spark, sf_dir):
    open_ = S.universe(spark, sf_dir).where("valid_to is null").select("security_id")
    return panel_of(spark, sf_dir).join(open_, "security_id", "left_semi").select(big("security_id"), "session", "price")


# ---------------------------------------------------------------- features and labels


def _price_feature(name: str, lookback: int, skip: int) -> None:
    def run(spark, sf_dir):
        return P.price_return(weekly(spark, sf_dir), lookback, skip).select("security_id", "session", r8("value"), "status")

    QUERIES[f"feat_{name}"] = run
    ORACLE_SQL[f"feat_{name}"] = f"WITH {PW}, {feature_sql(lookback, skip)} SELECT security_id, session, round(value, 8) AS value, status FROM feat"


for _name, (_lookback, _skip, _) in P.PRICE_FEATURES.items():
    _price_feature(_name, _lookback, _skip)


@query(f"WITH {PD}, {feature_sql(63, 0)} SELECT status, count(*) AS n FROM feat GROUP BY status")
def feat_status_counts(spark, sf_dir):
    return P.price_return(daily(spark, sf_dir), 63).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {PW}, v AS (SELECT security_id, session, idx, count(price) {BY} ROWS 62 PRECEDING) AS n, avg(price * volume) {BY} ROWS 62 PRECEDING) AS m FROM spine)
SELECT security_id, session, round(CASE WHEN idx >= 62 AND n = 63 THEN m END, 6) AS value, CASE WHEN idx < 62 THEN 'insufficient_history' WHEN n < 63 THEN 'missing_price' ELSE 'ok' END AS status FROM v""")
def feat_avg_dollar_volume_63(spark, sf_dir):
    return P.avg_dollar_volume(weekly(spark, sf_dir)).select("security_id", "session", F.round("value", 6).alias("value"), "status")


@query(f"""WITH {PW}, r AS (SELECT *, price / lag(price) {BY}) - 1 AS step FROM spine), v AS (SELECT *, count(step) {BY} ROWS 62 PRECEDING) AS n, stddev_samp(step) {BY} ROWS 62 PRECEDING) AS sd FROM r)
SELECT security_id, session, round(CASE WHEN idx >= 63 AND n = 63 THEN sd * sqrt(252) END, 8) AS value, CASE WHEN idx < 63 THEN 'insufficient_history' WHEN n < 63 THEN 'missing_price' ELSE 'ok' END AS status FROM v""")
def feat_realized_vol_63(spark, sf_dir):
    return P.realized_volatility(weekly(spark, sf_dir)).select("security_id", "session", r8("value"), "status")


ASOF = "asofs AS (SELECT DISTINCT security_id, d AS ts FROM wide CROSS JOIN (SELECT unnest([DATE '1996-03-31', DATE '1997-02-10', DATE '1998-02-11', DATE '1999-12-31', DATE '2001-06-30']) AS d))"
DAYS = ["1996-03-31", "1997-02-10", "1998-02-11", "1999-12-31", "2001-06-30"]


def _fund(spark, sf_dir):
    """Fundamentals known on the day after their filing, and the as-of rows held against them."""
    f = S.fundamentals(spark, sf_dir).withColumn("available_at", F.date_add("period_end", 41))
    asofs = f.select("security_id").distinct().select("security_id", F.explode(F.array(*[F.lit(d).cast("date") for d in DAYS])).alias("ts"))
    return f, asofs


def _seen_sql(events: str) -> str:
    return f"""SELECT security_id, ts AS asof, fiscal_year, fiscal_period, round(value, 8) AS value FROM (
  SELECT a.security_id, a.ts, e.fiscal_year, e.fiscal_period, e.value, row_number() OVER (PARTITION BY a.security_id, a.ts ORDER BY e.period_end DESC NULLS LAST) AS k
  FROM asofs a LEFT JOIN {events} e ON e.security_id = a.security_id AND e.ts <= a.ts) WHERE k = 1"""


@query(f"""WITH {FUND}, {ASOF}, ev AS (SELECT t.security_id, t.fiscal_year, t.fiscal_period, t.period_end, t.period_end + 41 AS ts, t.gross_profit / t.revenue AS value FROM wide t WHERE t.gross_profit IS NOT NULL AND t.revenue <> 0)
{_seen_sql('ev')}""")
def feat_margins(spark, sf_dir):
    f, asofs = _fund(spark, sf_dir)
    seen = P.newest_visible(P.ratio_events(f, "gross_profit"), asofs, ["period_end", "fiscal_year", "fiscal_period"], ["value"])
    return seen.select(big("security_id"), F.col("ts").alias("asof"), big("fiscal_year"), "fiscal_period", r8("value"))


@query(f"""WITH {FUND}, {ASOF}, ev AS (SELECT a.security_id, a.fiscal_year, a.fiscal_period, a.period_end, greatest(a.period_end, b.period_end) + 41 AS ts, a.revenue / b.revenue - 1 AS value
  FROM wide a JOIN wide b ON a.security_id = b.security_id AND a.fiscal_period = b.fiscal_period AND a.fiscal_year = b.fiscal_year + 1 WHERE b.revenue <> 0)
{_seen_sql('ev')}""")
def feat_yoy_growth(spark, sf_dir):
    f, asofs = _fund(spark, sf_dir)
    seen = P.newest_visible(P.growth_events(f, "revenue"), asofs, ["period_end", "fiscal_year", "fiscal_period"], ["value"])
    return seen.select(big("security_id"), F.col("ts").alias("asof"), big("fiscal_year"), "fiscal_period", r8("value"))


_H3 = P.HORIZONS


@query(f"WITH {PW}, " + ", ".join(label_sql(h, f"l{h}") for h in _H3) + " " + " UNION ALL ".join(
    f"SELECT security_id, session, CAST({h} AS BIGINT) AS horizon, horizon_session, round(end_price / price - 1, 8) AS raw_return FROM l{h} WHERE skip_reason IS NULL" for h in _H3))
def label_forward_returns(spark, sf_dir):
    return P.forward_labels(weekly(spark, sf_dir), _H3).where("skip_reason is null").select("security_id", "session", "horizon", "horizon_session", r8("raw_return"))


@query(f"WITH {PD}, " + ", ".join(label_sql(h, f"l{h}") for h in _H3) + " SELECT horizon, reason, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT CAST({h} AS BIGINT) AS horizon, coalesce(skip_reason, 'ok') AS reason FROM l{h}" for h in _H3) + ") GROUP BY 1, 2")
def label_skip_reasons(spark, sf_dir):
    rows = P.forward_labels(daily(spark, sf_dir), _H3).select("horizon", F.coalesce("skip_reason", F.lit("ok")).alias("reason"))
    return rows.groupBy("horizon", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {PW}, {label_sql(5)}, bench AS (SELECT session, price AS b_price, lead(price, 5) {BY}) AS b_end FROM spine WHERE security_id = (SELECT min(security_id) FROM pw))
SELECT l.security_id, l.session, round(end_price / price - 1, 8) AS raw_return, round(CASE WHEN b_price > 0 AND b_end > 0 THEN end_price / price - 1 - (b_end / b_price - 1) END, 8) AS excess_return,
  CASE WHEN b_price IS NULL THEN 'missing_asof_price' WHEN b_end IS NULL THEN 'missing_target_price' WHEN b_price <= 0 OR b_end <= 0 THEN 'unavailable_return' ELSE 'covered' END AS coverage
FROM lab l LEFT JOIN bench b ON b.session = l.session WHERE skip_reason IS NULL""")
def label_excess(spark, sf_dir):
    grid = weekly(spark, sf_dir)
    first = grid.agg(F.min("security_id").alias("b_id"))
    bench = grid.join(F.broadcast(first), F.col("security_id") == F.col("b_id")).select("session", F.col("price").alias("b_price"))
    rows = P.forward_labels(grid, (5,), bench).where("skip_reason is null")
    return rows.select("security_id", "session", r8("raw_return"), r8("excess_return"), P.coverage_status(F.col("b_price"), F.col("b_end")).alias("coverage"))


# ---------------------------------------------------------------- joins and set operations


@query(f"WITH {PW}, {joined_sql(sign='-')}, {MEMBERS} SELECT j.security_id, asof, round(feature, 8) AS feature, round(ret, 8) AS ret FROM joined j JOIN members m ON m.security_id = j.security_id AND asof >= valid_from AND (valid_to IS NULL OR asof <= valid_to)")
def join_feature_label(spark, sf_dir):
    grid = weekly(spark, sf_dir)
    rows = B.feature_label_rows(P.price_return(grid, LOOKBACK, SKIP), P.forward_labels(grid, (HORIZON,)), S.universe(spark, sf_dir), "low")
    return rows.select("security_id", "asof", r8("feature"), r8("ret"))


@query(f"""WITH {FUND}, rel AS (SELECT DISTINCT security_id, fiscal_year, fiscal_period, period_end FROM long WHERE fiscal_period IN ('Q1', 'Q3'))
SELECT l.security_id, count(*) AS linked FROM rel JOIN long l USING (security_id, fiscal_year, fiscal_period, period_end) GROUP BY 1""")
def join_release_fundamentals(spark, sf_dir):
    f = S.fundamentals(spark, sf_dir)
    key = ["security_id", "fiscal_year", "fiscal_period", "period_end"]
    releases = f.where(F.col("fiscal_period").isin("Q1", "Q3")).select(*key).distinct()
    return releases.join(f, key).groupBy(big("security_id")).agg(F.count("*").alias("linked"))


@query(f"""WITH {PD}, {feature_sql(21, 0)}, {label_sql(5)}, f AS (SELECT security_id, session FROM feat WHERE status = 'ok'), l AS (SELECT security_id, session FROM lab WHERE skip_reason IS NULL)
SELECT coalesce(f.session, l.session) AS session, count(*) FILTER (WHERE l.session IS NULL) AS feature_only, count(*) FILTER (WHERE f.session IS NULL) AS label_only,
  count(*) FILTER (WHERE f.session IS NOT NULL AND l.session IS NOT NULL) AS paired FROM f FULL JOIN l ON f.security_id = l.security_id AND f.session = l.session GROUP BY 1""")
def join_full_outer_counts(spark, sf_dir):
    grid = daily(spark, sf_dir)
    f = P.price_return(grid, 21).where("status = 'ok'").select("security_id", "session", F.lit(True).alias("f"))
    ls = P.forward_labels(grid, (5,)).where("skip_reason is null").select("security_id", "session", F.lit(True).alias("l"))
    return f.join(ls, ["security_id", "session"], "full_outer").groupBy("session").agg(
        F.count_if(F.col("l").isNull()).alias("feature_only"), F.count_if(F.col("f").isNull()).alias("label_only"), F.count_if(F.col("f") & F.col("l")).alias("paired"))


@query(f"""WITH {PD}, {feature_sql(21, 0)}, {label_sql(5)}, f AS (SELECT security_id, session FROM feat WHERE status = 'ok'), l AS (SELECT security_id, session FROM lab WHERE skip_reason IS NULL)
SELECT 'label_without_feature' AS side, count(*) AS n FROM (SELECT * FROM l EXCEPT SELECT * FROM f) UNION ALL SELECT 'feature_without_label', count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM l)""")
def anti_coverage(spark, sf_dir):
    grid, key = daily(spark, sf_dir), ["security_id", "session"]
    f = P.price_return(grid, 21).where("status = 'ok'").select(*key)
    ls = P.forward_labels(grid, (5,)).where("skip_reason is null").select(*key)
    a, b = ls.join(f, key, "left_anti"), f.join(ls, key, "left_anti")
    return a.agg(F.count("*").alias("n")).select(F.lit("label_without_feature").alias("side"), "n").union(b.agg(F.count("*").alias("n")).select(F.lit("feature_without_label"), "n"))


@query("""SELECT c_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM customer LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) ON o_custkey = c_custkey AND k = 1""")
def lateral_latest(spark, sf_dir):
    latest = R.latest_per_key(S.load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return S.load(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(f"WITH {PW}, {joined_sql()} SELECT count(*) AS n, count(*) FILTER (WHERE ret IS NOT NULL) AS raw_targets, CASE WHEN count(*) = count(ret) THEN 'raw' ELSE 'mixed' END AS kind FROM joined")
def target_kind_check(spark, sf_dir):
    rows = joined(spark, sf_dir)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("ret").isNotNull()).alias("raw_targets"), F.when(F.count("*") == F.count("ret"), "raw").otherwise("mixed").alias("kind"))


@query("SELECT DISTINCT event_type AS policy FROM events UNION SELECT DISTINCT o_orderpriority FROM orders")
def policy_union(spark, sf_dir):
    a = S.load(spark, sf_dir, "events").select(F.col("event_type").alias("policy"))
    return a.union(S.load(spark, sf_dir, "orders").select("o_orderpriority")).distinct()


# ---------------------------------------------------------------- back-tests


@query(f"WITH {PW}, {joined_sql()}, {splits_sql()}, {splits_sql().replace('cover AS', 'cover2 AS').replace('splits AS', 'rolling AS').replace('base + 0 AS', f'base + greatest(0, pos - {HORIZON} - 1 - 39) AS').replace('FROM cover)', 'FROM cover2)')} "
       "SELECT 'expanding' AS kind, * FROM splits UNION ALL SELECT 'rolling', * FROM rolling")
def wf_splits(spark, sf_dir):
    rows = joined(spark, sf_dir)
    a, b = splits_for(spark, sf_dir, rows), splits_for(spark, sf_dir, rows, max_train=40)
    return a.select(F.lit("expanding").alias("kind"), "*").union(b.select(F.lit("rolling").alias("kind"), "*"))


@query(f"{BASE} SELECT asof, candidates, selected, round(strategy_net, 8) AS strategy_net, round(baseline_net, 8) AS baseline_net FROM scores")
def fals_date_scores(spark, sf_dir):
    return B.date_scores(joined(spark, sf_dir)).select("asof", "candidates", "selected", r8("strategy_net"), r8("baseline_net"))


_WINDOW_COLUMNS = "split, CAST(train_rows AS BIGINT) AS train_rows, test_dates, CAST(test_rows AS BIGINT) AS test_rows, test_start, test_end, round(strategy_net, 8) AS strategy_net, round(baseline_net, 8) AS baseline_net, round(difference, 8) AS difference"


def _windows(df):
    return df.select("split", "train_rows", "test_dates", "test_rows", "test_start", "test_end", r8("strategy_net"), r8("baseline_net"), r8("difference"))


@query(f"{BASE} SELECT {_WINDOW_COLUMNS} FROM wins")
def fals_windows(spark, sf_dir):
    return _windows(windows_for(spark, sf_dir))


@query(f"WITH {PW}, {joined_sql(sign='-')}, {splits_sql()}, {scores_sql()}, {windows_sql()} SELECT {_WINDOW_COLUMNS} FROM wins")
def fals_low_direction(spark, sf_dir):
    return _windows(windows_for(spark, sf_dir, direction="low"))


@query(f"""{BASE} SELECT count(*) AS windows, CAST(sum(test_dates) AS BIGINT) AS dates, round(avg(strategy_net), 8) AS mean_strategy, round(avg(baseline_net), 8) AS mean_baseline, round(avg(difference), 8) AS mean_difference,
round(avg(CASE WHEN difference > 0 THEN 1.0 ELSE 0.0 END), 8) AS hit_rate, round(stddev_samp(difference), 8) AS sd_difference, round(avg(difference) / nullif(stddev_samp(difference), 0), 6) AS mean_over_sd FROM wins""")
def fals_headline(spark, sf_dir):
    h = B.headline(windows_for(spark, sf_dir))
    return h.select("windows", "dates", r8("mean_strategy"), r8("mean_baseline"), r8("mean_difference"), r8("hit_rate"), r8("sd_difference"), F.round("mean_over_sd", 6).alias("mean_over_sd"))


OLS = "models AS (SELECT split, count(*) AS train_pairs, regr_slope(ret, feature) AS slope, regr_intercept(ret, feature) AS intercept FROM splits JOIN joined ON idx BETWEEN train_from AND train_to GROUP BY split)"


@query(f"{BASE}, {OLS} SELECT split, train_pairs, round(slope, 6) AS slope, round(intercept, 6) AS intercept, true AS fitted FROM models")
def ols_walk_forward(spark, sf_dir):
    rows = joined(spark, sf_dir)
    m = B.walk_forward_ols(rows, splits_for(spark, sf_dir, rows))
    return m.select("split", "train_pairs", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "fitted")


PRED = "pred AS (SELECT s.split, j.*, intercept + slope * feature AS score FROM splits s JOIN models m ON m.split = s.split JOIN joined j ON j.idx BETWEEN test_from AND test_to)"


@query(f"""{BASE}, {OLS}, {PRED}, rk AS (SELECT split, rank() OVER (PARTITION BY split ORDER BY feature) + (count(*) OVER (PARTITION BY split, feature) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY split ORDER BY ret) + (count(*) OVER (PARTITION BY split, ret) - 1) / 2.0 AS ry FROM pred)
SELECT split, count(*) AS pairs, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 8) AS rank_correlation FROM rk GROUP BY split""")
def spearman_by_split(spark, sf_dir):
    rows = joined(spark, sf_dir)
    splits = splits_for(spark, sf_dir, rows)
    pred = B.predictions(rows, splits, B.walk_forward_ols(rows, splits))
    return ranks.spearman(pred, "feature", "ret", ["split"]).select("split", "pairs", r8("rank_correlation"))


@query(f"""{BASE}, {OLS}, {PRED}, k AS (SELECT *, row_number() OVER (PARTITION BY split, asof ORDER BY feature, security_id) AS k, count(*) OVER (PARTITION BY split, asof) AS m FROM pred),
b AS (SELECT *, CASE WHEN greatest(1, CAST(floor(m * 0.2) AS BIGINT)) * 2 > m THEN m // 2 ELSE greatest(1, CAST(floor(m * 0.2) AS BIGINT)) END AS b FROM k),
d AS (SELECT split, asof, avg(ret) FILTER (WHERE k > m - b) - avg(ret) FILTER (WHERE k <= b) AS spread FROM b WHERE b >= 1 GROUP BY 1, 2)
SELECT split, count(*) AS dates, round(avg(spread), 8) AS spread, round(avg(spread) - {B.long_short_cost(HORIZON)!r}, 8) AS net_spread FROM d GROUP BY split""")
def long_short_spread(spark, sf_dir):
    rows = joined(spark, sf_dir)
    splits = splits_for(spark, sf_dir, rows)
    pred = B.predictions(rows, splits, B.walk_forward_ols(rows, splits))
    out = B.long_short(pred, "feature", 0.2, ["split"])
    return out.select("split", "dates", r8("spread"), F.round(F.col("spread") - B.long_short_cost(HORIZON), 8).alias("net_spread"))


@query(f"{BASE} SELECT count(*) AS train_pairs, count(*) FILTER (WHERE idx + {HORIZON} >= test_from) AS late FROM splits JOIN joined ON idx BETWEEN train_from AND train_to")
def pit_guards(spark, sf_dir):
    rows = joined(spark, sf_dir).withColumn("outcome_idx", F.col("idx") + HORIZON)
    splits = splits_for(spark, sf_dir, rows)
    late = B.guard_violations(rows, splits).agg(F.count("*").alias("late"))
    return B.walk_forward_ols(rows, splits).agg(F.sum("train_pairs").alias("train_pairs")).join(F.broadcast(late), F.lit(True))


_REGIME_SQL = "regimes(name, a, b) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in REGIMES) + ")"


@query(f"""{BASE}, {_REGIME_SQL} SELECT name, count(asof) AS sample_count, count(strategy_net) AS value_count, round(avg(strategy_net), 8) AS mean, round(stddev_samp(strategy_net), 8) AS sd, round(min(strategy_net), 8) AS low,
round(max(strategy_net), 8) AS high, round(avg(CASE WHEN strategy_net > 0 THEN 1.0 WHEN strategy_net IS NOT NULL THEN 0.0 END), 8) AS hit_rate FROM regimes LEFT JOIN scores ON asof BETWEEN a AND b GROUP BY name""")
def regime_summary(spark, sf_dir):
    values = ", ".join(f"('{n}', date'{a}', date'{b}')" for n, a, b in REGIMES)
    regimes = spark.sql(f"SELECT * FROM VALUES {values} AS t(name, start_date, end_date)")
    out = B.regime_summary(B.date_scores(joined(spark, sf_dir)), regimes, "asof", "strategy_net")
    return out.select("name", "sample_count", "value_count", *[r8(c) for c in ("mean", "sd", "low", "high", "hit_rate")])


def scramble_sql(samples: str, by: str, trials: int, seed: int, name: str = "drawn") -> str:
    """CTEs that end in {name}: by, t, score, the selected mean of each trial.  samples: by, g, id, chosen, ret."""
    p, keys = B._PRIME, f"{by}, g" if by else "g"
    step = lambda src, add: f"(SELECT * EXCLUDE x, y * (y % 65536 + {add}) % {p} AS x FROM (SELECT *, x * 48271 % {p} AS y FROM {src}))"
    first = f"(SELECT s.*, t, (('0x' || substr(md5('{seed}|' || id), 1, 8))::BIGINT + t * 1000003) % {p} AS x FROM {samples} s, (SELECT unnest(generate_series(1, {trials})) AS t))"
    mixed = step(step(first, 40014).replace("SELECT * EXCLUDE x,", "SELECT * EXCLUDE (x, y),"), 30011).replace("SELECT * EXCLUDE x,", "SELECT * EXCLUDE (x, y),")
    return f"""masks AS (SELECT {keys}, list(chosen ORDER BY id) AS mask FROM {samples} GROUP BY {keys}),
put AS (SELECT {keys}, t, ret, row_number() OVER (PARTITION BY {keys}, t ORDER BY x, id) AS slot FROM {mixed}),
gmeans AS (SELECT {keys}, t, avg(ret) AS m FROM put JOIN masks USING ({keys}) WHERE mask[slot] GROUP BY {keys}, t),
{name} AS (SELECT {by + ', ' if by else ''}t, avg(m) AS score FROM gmeans GROUP BY {by + ', ' if by else ''}t)"""


_EXTREME = {"greater": "score >= observed", "less": "score <= observed", "two_sided": "abs(score) >= abs(observed)"}
_SCRAMBLE = f"""{BASE}, smp AS (SELECT asof AS g, asof || '|' || security_id AS id, rn <= greatest(1, n // 2) AS chosen, ret FROM ranked), {scramble_sql('smp', '', 100, 44)},
obs AS (SELECT avg(m) AS observed FROM (SELECT g, avg(ret) FILTER (WHERE chosen) AS m FROM smp GROUP BY g))"""


def _scrambled(alternative: str) -> str:
    n = f"(count(*) FILTER (WHERE {_EXTREME[alternative]}) + 1)"
    return f"SELECT round(observed, 8) AS observed, {n} AS rank, count(*) AS trials, round({n} / 101, 8) AS p_value, {n} / 101 <= 0.05 AS passed FROM drawn, obs GROUP BY observed"


def scramble_samples(ranked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Scored rows with their selection as samples of a permutation test, grouped by date."""
    return ranked.select(*by, F.concat_ws("|", "asof", "security_id").alias("sample_id"), F.col("asof").cast("string").alias("group_key"), F.col("selected").cast("double").alias("feature"), F.col("ret").alias("label"))


@query(f"{_SCRAMBLE} {_scrambled('greater')}")
def scramble_pvalue(spark, sf_dir):
    samples = scramble_samples(B.select_top_half(joined(spark, sf_dir)))
    return B.scramble_p_value(samples).select(r8("observed"), "rank", "trials", r8("p_value"), "passed")


@query(f"{_SCRAMBLE} " + " UNION ALL ".join(f"SELECT '{a}' AS alternative, * FROM ({_scrambled(a)})" for a in _EXTREME))
def scramble_alternatives(spark, sf_dir):
    """The permutation test against each alternative."""
    samples, out = scramble_samples(B.select_top_half(joined(spark, sf_dir))), None
    for a in ("greater", "less", "two_sided"):
        part = B.scramble_p_value(samples, alternative=a).select(F.lit(a).alias("alternative"), r8("observed"), "rank", "trials", r8("p_value"), "passed")
        out = part if out is None else out.union(part)
    return out


# ---------------------------------------------------------------- reports

ATTR = """attr AS (SELECT security_id, count(*) FILTER (WHERE rn <= greatest(1, n // 2)) AS selected_rows, count(DISTINCT asof) FILTER (WHERE rn <= greatest(1, n // 2)) AS selected_dates,
  count(DISTINCT split) FILTER (WHERE rn <= greatest(1, n // 2)) AS windows, avg(ret) FILTER (WHERE rn <= greatest(1, n // 2)) AS mean_return FROM ranked JOIN splits ON idx BETWEEN test_from AND test_to GROUP BY security_id)"""


def _attribution(spark, sf_dir, lookback=LOOKBACK):
    rows = joined(spark, sf_dir, lookback)
    return R.attribution(B.select_top_half(rows), splits_for(spark, sf_dir, rows))


@query(f"{BASE}, {ATTR} SELECT security_id, selected_rows, selected_dates, windows, round(mean_return, 8) AS mean_return FROM attr")
def ticker_attribution(spark, sf_dir):
    return _attribution(spark, sf_dir).select("security_id", "selected_rows", "selected_dates", "windows", r8("mean_return"))


@query(f"""{BASE}, {ATTR}, t AS (SELECT sum(selected_rows) AS total FROM attr), top AS (SELECT sum(selected_rows) AS top5, max(selected_rows) AS top1 FROM (SELECT * FROM attr ORDER BY selected_rows DESC, windows DESC, mean_return DESC NULLS LAST, security_id DESC LIMIT 5))
SELECT CAST(total AS BIGINT) AS total, round(sum((selected_rows / total) * (selected_rows / total)), 8) AS hhi, round(1 / sum((selected_rows / total) * (selected_rows / total)), 6) AS effective, round(any_value(top1) / total, 8) AS top1_share, round(any_value(top5) / total, 8) AS top5_share
FROM attr, t, top GROUP BY total""")
def ticker_concentration(spark, sf_dir):
    c = R.concentration(_attribution(spark, sf_dir))
    return c.select("total", r8("hhi"), F.round("effective", 6).alias("effective"), r8("top1_share"), r8("top5_share"))


@query(f"""WITH {PW}, {joined_sql()}, {splits_sql()}, {scores_sql()}, {ATTR}, {joined_sql(63, 0, tag='2')}, {splits_sql(tag='2')}, {scores_sql('2')},
{ATTR.replace('attr AS', 'attr2 AS').replace('FROM ranked JOIN splits ON', 'FROM ranked2 JOIN splits2 ON')}
SELECT count(b.security_id) AS overlap, count(*) AS target, round(sum(CASE WHEN b.security_id IS NOT NULL THEN a.selected_rows ELSE 0 END) / sum(a.selected_rows), 8) AS covered_share
FROM (SELECT * FROM attr WHERE selected_rows > 0) a LEFT JOIN (SELECT * FROM attr2 WHERE selected_rows > 0) b ON a.security_id = b.security_id""")
def selection_overlap(spark, sf_dir):
    return R.selection_overlap(_attribution(spark, sf_dir), _attribution(spark, sf_dir, 63)).select("overlap", "target", r8("covered_share"))


def _layers(spark, sf_dir):
    grid = daily(spark, sf_dir)
    f = P.price_return(grid, 21).where("status = 'ok'").select("security_id", "session")
    ls = P.forward_labels(grid, (5,)).where("skip_reason is null").select("security_id", "session")
    return grid.where("price is not null").select("security_id", "session"), f, ls, f.join(ls, ["security_id", "session"])


_LAYER_SQL = f"WITH {PD}, {MEMBERS}, {feature_sql(21, 0)}, {label_sql(5)}, f AS (SELECT security_id, session FROM feat WHERE status = 'ok'), l AS (SELECT security_id, session FROM lab WHERE skip_reason IS NULL), j AS (SELECT * FROM f INTERSECT SELECT * FROM l)"


@query(f"""{_LAYER_SQL} SELECT m.security_id, m.ticker,
{', '.join(f"(SELECT count(*) FROM {t} x WHERE x.security_id = m.security_id) AS {n}_rows, (SELECT min(session) FROM {t} x WHERE x.security_id = m.security_id) AS {n}_start, (SELECT max(session) FROM {t} x WHERE x.security_id = m.security_id) AS {n}_end" for t, n in (('pw', 'price'), ('f', 'feature'), ('l', 'label'), ('j', 'joined')))},
(SELECT count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM f) x WHERE x.security_id = m.security_id) AS label_without_feature_rows,
(SELECT count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM l) x WHERE x.security_id = m.security_id) AS feature_without_label_rows FROM members m""")
def diag_coverage(spark, sf_dir):
    members = S.universe(spark, sf_dir).select(big("security_id"), "ticker")
    return R.coverage(members, *_layers(spark, sf_dir))


@query(f"WITH {PD}, " + ", ".join(label_sql(h, f"l{h}") for h in _H3) + " " + " UNION ALL ".join(
    f"SELECT CAST({h} AS BIGINT) AS horizon, count(*) AS label_rows, count(DISTINCT security_id) AS securities, min(session) AS first_session, max(session) AS last_session FROM l{h} WHERE skip_reason IS NULL" for h in _H3))
def diag_horizons(spark, sf_dir):
    rows = P.forward_labels(daily(spark, sf_dir), _H3).where("skip_reason is null")
    return rows.groupBy("horizon").agg(F.count("*").alias("label_rows"), F.countDistinct("security_id").alias("securities"), F.min("session").alias("first_session"), F.max("session").alias("last_session"))


@query(f"""{BASE}, e AS (SELECT count(*) AS scored, count(*) FILTER (WHERE difference > 0) AS positive, avg(difference) AS d FROM wins)
SELECT scored, positive, round(positive / scored, 8) AS positive_rate, round(d, 8) AS mean_difference,
CASE WHEN scored < 3 THEN 'insufficient_data' WHEN positive / scored < 0.6 OR d <= 0 THEN 'failed' ELSE 'passed' END AS status,
CASE WHEN scored < 3 THEN 'insufficient_walk_forward_windows' WHEN positive / scored < 0.6 OR d <= 0 THEN 'walk_forward_unstable' END AS failure_reason FROM e""")
def wf_evidence(spark, sf_dir):
    e = R.walk_forward_evidence(windows_for(spark, sf_dir), 3, 0.6, [])
    return e.select("scored", "positive", r8("positive_rate"), r8("mean_difference"), "status", "failure_reason")


INCOME_MODIFIED = """
pm AS (SELECT security_id, fiscal_year, fiscal_period, period_end, metric_name,
    CASE WHEN metric_name = 'revenue' AND security_id % 6 = 0 AND fiscal_period = 'Q2' THEN 0 ELSE metric_value END AS metric_value,
    CAST(period_end + 41 + CASE WHEN security_id % 4 = 1 AND metric_name = 'gross_profit' THEN 200 ELSE 0 END AS TIMESTAMP) AS available_at
  FROM long WHERE NOT (security_id % 5 = 2 AND fiscal_year % 2 = 0 AND metric_name = 'revenue')
  UNION ALL SELECT security_id, fiscal_year, fiscal_period, period_end, metric_name, metric_value * 1.25, CAST(period_end + 150 AS TIMESTAMP) FROM long WHERE security_id % 4 = 2 AND metric_name = 'revenue' AND security_id % 5 <> 2)"""


def income_metrics(spark, sf_dir):
    """Fundamentals with zero revenues, late gross profits, missing quarters and revised revenues among them."""

    def make():
        f = S.fundamentals(spark, sf_dir).withColumn("security_id", F.col("security_id").cast("bigint")).withColumn("fiscal_year", F.col("fiscal_year").cast("bigint"))
        name, sec = F.col("metric_name"), F.col("security_id")
        at = lambda days: F.date_add("period_end", days).cast("timestamp")
        value = F.when((name == "revenue") & (sec % 6 == 0) & (F.col("fiscal_period") == "Q2"), 0.0).otherwise(F.col("metric_value"))
        late = F.when((sec % 4 == 1) & (name == "gross_profit"), at(241)).otherwise(at(41))
        keys = ["security_id", "fiscal_year", "fiscal_period", "period_end", "metric_name"]
        first = f.where(~((sec % 5 == 2) & (F.col("fiscal_year") % 2 == 0) & (name == "revenue"))).select(*keys, value.alias("metric_value"), late.alias("available_at"))
        revised = f.where((sec % 4 == 2) & (name == "revenue") & (sec % 5 != 2)).select(*keys, (F.col("metric_value") * 1.25).alias("metric_value"), at(150).alias("available_at"))
        return first.union(revised)

    return once(spark, f"income:{sf_dir}", make)


def income_sql(name: str, asofs: str, tag: str = "") -> str:
    """CTEs that end in income{tag}: security_id, asof, fiscal_year, fiscal_period, value, status, available_at, every as-of against every period."""
    if name in INC.MARGINS:
        top, base = INC.MARGINS[name]
    else:
        top = base = INC.GROWTH[name]
    pick = lambda m, c: f"arg_max({c}, (available_at, metric_value)) FILTER (WHERE metric_name = '{m}')"
    seen = f"""vis{tag} AS (SELECT a.security_id, a.asof, p.* EXCLUDE (security_id) FROM {asofs} a JOIN pm p ON p.security_id = a.security_id AND p.available_at <= a.asof),
per{tag} AS (SELECT security_id, asof, fiscal_year, fiscal_period, period_end, {pick(top, 'metric_value')} AS top, {pick(top, 'available_at')} AS top_at, {pick(base, 'metric_value')} AS base, {pick(base, 'available_at')} AS base_at FROM vis{tag} GROUP BY ALL)"""
    if name in INC.MARGINS:
        rows = f"cmp{tag} AS (SELECT *, top IS NOT NULL AND base IS NOT NULL AS here, true AS prior, top / nullif(base, 0) AS value, greatest(top_at, base_at) AS known FROM per{tag})"
    else:
        rows = f"""old{tag} AS (SELECT security_id, asof, fiscal_year + 1 AS fiscal_year, fiscal_period, arg_max({{'v': top, 't': top_at}}, period_end) AS o FROM per{tag} GROUP BY 1, 2, 3, 4),
cmp{tag} AS (SELECT p.* REPLACE (o.o.v AS base), top IS NOT NULL AS here, o.o.v IS NOT NULL AS prior, top / nullif(o.o.v, 0) - 1 AS value, greatest(top_at, o.o.t) AS known
  FROM per{tag} p LEFT JOIN old{tag} o ON o.security_id = p.security_id AND o.asof = p.asof AND o.fiscal_year = p.fiscal_year AND o.fiscal_period = p.fiscal_period)"""
    return f"""{seen}, {rows},
best{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id, asof ORDER BY period_end DESC, fiscal_year DESC, fiscal_period DESC) AS k FROM cmp{tag} WHERE here AND prior AND base <> 0) WHERE k = 1),
why{tag} AS (SELECT security_id, asof, bool_or(here AND prior AND base = 0) AS zero, bool_or(here AND NOT prior) AS no_prior FROM cmp{tag} GROUP BY 1, 2),
income{tag} AS (SELECT a.security_id, a.asof, b.fiscal_year, b.fiscal_period, b.value, b.known AS available_at, CASE WHEN b.security_id IS NOT NULL THEN 'ok' WHEN w.security_id IS NULL THEN 'no_visible_period' WHEN w.zero THEN 'zero_denominator'
  WHEN w.no_prior THEN 'missing_prior_year_metric' ELSE 'missing_current_metric' END AS status FROM {asofs} a LEFT JOIN best{tag} b ON b.security_id = a.security_id AND b.asof = a.asof LEFT JOIN why{tag} w ON w.security_id = a.security_id AND w.asof = a.asof)"""


#: The candidate pack: a feature, and the direction in which it selects.
CANDIDATES = {
    **{name: direction for name, (_, _, direction) in P.PRICE_FEATURES.items()}, "avg_dollar_volume_63": "high", "realized_volatility_63": "low",
    "gross_margin": "high", "operating_margin": "high", "net_margin": "high", "revenue_growth_yoy": "high", "diluted_shares_change_yoy": "low",
}


def materializers(spark, sf_dir) -> dict:
    """Each candidate's table (security_id, session, idx, value, status) over the panel; nothing is computed before it is read."""
    grid = weekly(spark, sf_dir)
    known = {name: (lambda lookback=lookback, skip=skip: P.price_return(grid, lookback, skip)) for name, (lookback, skip, _) in P.PRICE_FEATURES.items()}
    known |= {"avg_dollar_volume_63": lambda: P.avg_dollar_volume(grid), "realized_volatility_63": lambda: P.realized_volatility(grid)}
    asofs = grid.select("security_id", F.col("session").cast("timestamp").alias("asof"))

    def income(name):
        found = once(spark, f"income_features:{sf_dir}", lambda: INC.income_features(income_metrics(spark, sf_dir), asofs, (*INC.MARGINS, *INC.GROWTH))).where(F.col("feature") == name)
        return found.select("security_id", F.col("asof").cast("date").alias("session"), "value", "status").join(grid.select("security_id", "session", "idx"), ["security_id", "session"])

    known |= {name: (lambda name=name: income(name)) for name in (*INC.MARGINS, *INC.GROWTH)}
    return {name: known[name] for name in CANDIDATES}


def candidate_values(spark, sf_dir):
    """(base_key, security_id, asof, idx, value, status) of the whole pack, written once a session."""

    def make():
        out = None
        for name, table in materializers(spark, sf_dir).items():
            part = table().select(F.lit(name).alias("base_key"), "security_id", F.col("session").alias("asof"), "idx", "value", "status")
            out = part if out is None else out.union(part)
        return out

    return once(spark, f"candidates:{sf_dir}", make)


@functools.lru_cache(maxsize=1)
def candidates_sql() -> str:
    """CTEs that end in cand: base_key, security_id, asof, idx, value, status."""
    ctes = [PW.strip(), FUND.strip(), INCOME_MODIFIED.strip(), "casofs AS (SELECT security_id, CAST(session AS TIMESTAMP) AS asof, idx FROM spine)"]
    rows = []
    for name, (lookback, skip, _) in P.PRICE_FEATURES.items():
        ctes.append(feature_sql(lookback, skip, name=f"f_{name}"))
        rows.append(f"SELECT '{name}' AS base_key, security_id, session AS asof, idx, value, status FROM f_{name}")
    ctes.append(f"adv AS (SELECT *, count(price) {BY} ROWS 62 PRECEDING) AS n, avg(price * volume) {BY} ROWS 62 PRECEDING) AS m FROM spine)")
    rows.append("SELECT 'avg_dollar_volume_63', security_id, session, idx, CASE WHEN idx >= 62 AND n = 63 THEN m END, CASE WHEN idx < 62 THEN 'insufficient_history' WHEN n < 63 THEN 'missing_price' ELSE 'ok' END FROM adv")
    ctes.append(f"rvr AS (SELECT *, price / lag(price) {BY}) - 1 AS step FROM spine), rv AS (SELECT *, count(step) {BY} ROWS 62 PRECEDING) AS n, stddev_samp(step) {BY} ROWS 62 PRECEDING) AS sd FROM rvr)")
    rows.append("SELECT 'realized_volatility_63', security_id, session, idx, CASE WHEN idx >= 63 AND n = 63 THEN sd * sqrt(252) END, CASE WHEN idx < 63 THEN 'insufficient_history' WHEN n < 63 THEN 'missing_price' ELSE 'ok' END FROM rv")
    for k, name in enumerate((*INC.MARGINS, *INC.GROWTH)):
        ctes.append(income_sql(name, "casofs", f"_i{k}"))
        rows.append(f"SELECT '{name}', i.security_id, CAST(i.asof AS DATE), c.idx, i.value, i.status FROM income_i{k} i JOIN casofs c ON c.security_id = i.security_id AND c.asof = i.asof")
    return "WITH " + ", ".join(ctes) + ", cand AS (" + " UNION ALL ".join(rows) + ")"


@query(candidates_sql() + " SELECT base_key, status, count(*) AS n FROM cand GROUP BY 1, 2")
def candidate_pack(spark, sf_dir):
    return candidate_values(spark, sf_dir).groupBy("base_key", "status").agg(F.count("*").alias("n"))


@functools.lru_cache(maxsize=1)
def cells_sql() -> str:
    low = ", ".join(f"'{n}'" for n, d in CANDIDATES.items() if d == "low")
    labels = " UNION ALL ".join(f"SELECT security_id, session AS asof, CAST({h} AS BIGINT) AS horizon, end_price / price - 1 AS ret FROM l{h} WHERE skip_reason IS NULL" for h in _H3)
    cost = 0.002
    return candidates_sql() + ", " + ", ".join(label_sql(h, f"l{h}") for h in _H3) + f""", labs AS ({labels}),
smp AS (SELECT c.base_key, horizon, c.security_id, c.asof, c.idx, CASE WHEN c.base_key IN ({low}) THEN -value ELSE value END AS feature, ret FROM cand c JOIN labs l ON l.security_id = c.security_id AND l.asof = c.asof WHERE status = 'ok'),
rnk AS (SELECT *, row_number() OVER (PARTITION BY base_key, horizon, asof ORDER BY feature DESC, security_id) AS rn, count(*) OVER (PARTITION BY base_key, horizon, asof) AS n FROM smp),
dates AS (SELECT base_key, horizon, asof, idx, count(*) AS candidates, avg(ret) FILTER (WHERE rn <= greatest(1, n // 2)) - {cost} AS s, avg(ret) - {cost} AS b FROM rnk GROUP BY ALL),
span AS (SELECT base_key, horizon, min(idx) AS base, max(idx) + horizon - min(idx) + 1 AS n FROM dates GROUP BY 1, 2),
spl AS (SELECT base_key, horizon, base, pos, base + pos - horizon - 1 AS train_to FROM (SELECT *, unnest(generate_series({TRAIN} + horizon, n - {TEST} - horizon, {STEP})) AS pos FROM span)),
trn AS (SELECT p.base_key, p.horizon, pos FROM spl p JOIN dates d ON d.base_key = p.base_key AND d.horizon = p.horizon AND d.idx BETWEEN base AND train_to GROUP BY ALL),
win AS (SELECT p.base_key, p.horizon, p.pos, avg(s) - avg(b) AS difference FROM spl p JOIN trn USING (base_key, horizon, pos) JOIN dates d ON d.base_key = p.base_key AND d.horizon = p.horizon AND d.idx BETWEEN base + p.pos AND base + p.pos + {TEST} - 1 GROUP BY 1, 2, 3),
got AS (SELECT base_key, horizon, count(*) AS scored, count(*) FILTER (WHERE difference > 0) AS positive, avg(difference) AS difference,
  CASE WHEN sum(difference) FILTER (WHERE difference > 0) > 0 THEN max(difference) / sum(difference) FILTER (WHERE difference > 0) END AS top_share FROM win GROUP BY 1, 2),
csmp AS (SELECT r.base_key || '__h' || r.horizon AS cell, r.asof AS g, r.asof || '|' || r.security_id AS id, rn <= greatest(1, n // 2) AS chosen, ret FROM rnk r JOIN spl p USING (base_key, horizon) JOIN win w ON w.base_key = p.base_key AND w.horizon = p.horizon AND w.pos = p.pos WHERE r.idx BETWEEN base + p.pos AND base + p.pos + {TEST} - 1),
{scramble_sql('csmp', 'cell', SWEEP_TRIALS, 44)},
cobs AS (SELECT cell, avg(m) AS observed FROM (SELECT cell, g, avg(ret) FILTER (WHERE chosen) AS m FROM csmp GROUP BY 1, 2) GROUP BY 1),
pv AS (SELECT cell, (count(*) FILTER (WHERE score >= observed) + 1) / {SWEEP_TRIALS + 1} AS p_value FROM drawn JOIN cobs USING (cell) GROUP BY 1),
grid AS (SELECT *, base_key || '__h' || horizon AS cell FROM (SELECT unnest([{', '.join(f"'{n}'" for n in CANDIDATES)}]) AS base_key), (SELECT CAST(unnest([5, 21, 63, 126, 252]) AS BIGINT) AS horizon)),
run AS (SELECT g.base_key, g.horizon, coalesce(scored, 0) AS scored, coalesce(positive, 0) AS positive, difference, top_share, p_value,
  CASE WHEN scored < 3 THEN 'insufficient_walk_forward_windows' WHEN positive / scored < 0.6 OR difference <= 0 THEN 'walk_forward_unstable' END AS failure FROM grid g LEFT JOIN got w ON w.base_key = g.base_key AND w.horizon = g.horizon LEFT JOIN pv ON pv.cell = g.cell),
cells AS (SELECT *, CASE WHEN scored = 0 THEN 'insufficient_data' WHEN failure IS NOT NULL OR p_value > 0.05 OR difference <= 0 THEN 'rejected' ELSE 'promising' END AS verdict,
  CASE WHEN scored = 0 THEN 'insufficient_data' WHEN failure IS NOT NULL THEN failure WHEN p_value > 0.05 THEN 'label_scramble_failed' WHEN difference <= 0 THEN 'baseline_failed' ELSE 'passed' END AS reason FROM run)"""


#: Trials of each cell's permutation test, enough for p-values well below the level of 0.05.
SWEEP_TRIALS = 39


def sweep_cells(spark, sf_dir, evaluated: DataFrame | None = None):
    """Verdicts of candidate x horizon, 55 cells as keys of one plan; cells in ``evaluated`` are left out before anything is scored."""
    cell = ("base_key", "horizon")
    labels = P.forward_labels(weekly(spark, sf_dir), _H3).where("skip_reason is null").select("security_id", F.col("session").alias("asof"), "horizon", F.col("raw_return").alias("ret"))
    low = F.col("base_key").isin(*[n for n, d in CANDIDATES.items() if d == "low"])
    values = candidate_values(spark, sf_dir).where("status = 'ok'").withColumn("feature", F.when(low, -F.col("value")).otherwise(F.col("value"))).drop("value", "status")
    horizons = F.explode(F.array(*[F.lit(h).cast("bigint") for h in _H3])).alias("horizon")
    grid = spark.createDataFrame([(n,) for n in CANDIDATES], "base_key string").select("base_key", horizons)
    if evaluated is not None:
        grid = grid.join(evaluated, list(cell), "left_anti")
    samples = stage(values.join(labels, ["security_id", "asof"]).join(grid, list(cell), "left_semi"), "samples")  # scored, and permuted
    scores = B.date_scores(samples, by=cell)
    bounds = scores.groupBy(*cell).agg(F.min("idx").alias("base"), (F.max("idx") + F.col("horizon") - F.min("idx") + 1).alias("n"))
    splits = B.splits_within(bounds, F.col("horizon"), TRAIN, TEST, STEP, by=cell)
    windows = stage(B.window_scores(scores, splits, cell), "windows")
    evidence = R.walk_forward_evidence(windows, 3, 0.6, [*cell]).withColumnRenamed("mean_difference", "difference").drop("status")
    scored = B.split_sessions(splits.join(windows.select(*cell, "split"), [*cell, "split"], "left_semi"), "test", cell).select(*cell, "idx")
    tests = B.scramble_p_value(scramble_samples(B.select_top_half(samples, cell).join(scored, [*cell, "idx"], "left_semi"), cell), SWEEP_TRIALS, by=cell).select(*cell, "p_value", F.col("passed").alias("scramble_pass"))
    run = grid.join(evidence, list(cell), "left").join(R.temporal_concentration(windows, cell).drop("windows"), list(cell), "left").join(tests, list(cell), "left")
    run = run.withColumns({"scored": F.coalesce("scored", F.lit(0)), "positive": F.coalesce("positive", F.lit(0))})
    # a cell's run succeeds where a window can be scored; its evaluation follows from the evidence and the permutation test
    run = run.withColumns({"run_id": F.sha2(F.concat_ws("__h", "base_key", "horizon"), 256), "status": F.when(F.col("scored") == 0, "insufficient_data").otherwise("succeeded")})
    harder = R.harder_status(F.col("failure_reason"), F.col("scramble_pass"))
    evaluation = F.coalesce(harder["status"], R.evaluation_status(F.col("status"), F.col("scramble_pass")))
    run = run.withColumns({"evaluation": evaluation, "failure": F.when(F.col("scored") > 0, harder["reason"])})
    return R.derived_verdict(run).select("base_key", "horizon", "scored", "positive", "difference", "p_value", "top_share", "evaluation", "verdict", "reason")


def cells(spark, sf_dir):
    return once(spark, f"cells:{sf_dir}", lambda: sweep_cells(spark, sf_dir))


@query(cells_sql() + " SELECT base_key, horizon, scored, positive, round(difference, 8) AS difference, round(p_value, 8) AS p_value, round(top_share, 8) AS top_share, verdict, reason FROM cells")
def verdicts(spark, sf_dir):
    return cells(spark, sf_dir).select("base_key", "horizon", "scored", "positive", r8("difference"), r8("p_value"), r8("top_share"), "verdict", "reason")


@query(cells_sql() + " SELECT base_key, " + ", ".join(f"coalesce(max(verdict) FILTER (WHERE horizon = {h}), 'pending') AS h{h}" for h in P.HORIZONS) + " FROM cells GROUP BY base_key")
def horizon_matrix(spark, sf_dir):
    return R.horizon_matrix(cells(spark, sf_dir))


@query(cells_sql() + " SELECT reason, verdict, count(*) AS n FROM cells GROUP BY 1, 2")
def verdict_reasons(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("reason", "verdict").agg(F.count("*").alias("n"))


_HEALTH = """, placed AS (SELECT *, list_position([5, 21, 63, 126, 252], horizon) AS place FROM cells), health AS (
SELECT a.*, CASE WHEN count(b.base_key) = 0 THEN 'unknown' WHEN bool_or(b.verdict IN ('accepted', 'promising')) THEN 'supportive' WHEN bool_or(b.difference IS NULL OR b.difference <= 0) THEN 'weak' ELSE 'mixed' END AS health
FROM placed a LEFT JOIN placed b ON a.base_key = b.base_key AND abs(a.place - b.place) = 1 GROUP BY ALL)"""


@query(cells_sql() + _HEALTH + " SELECT base_key, horizon, verdict, health FROM health")
def adjacent_health(spark, sf_dir):
    return R.adjacent_health(cells(spark, sf_dir)).select("base_key", "horizon", "verdict", "health")


@query(cells_sql() + _HEALTH + """ SELECT base_key, horizon, CASE WHEN difference / 0.002 IS NULL THEN 'unknown' WHEN difference / 0.002 >= 5 THEN 'low' WHEN difference / 0.002 >= 1 THEN 'medium' ELSE 'high' END AS cost_class,
CASE WHEN p_value IS NULL THEN 'watch' WHEN difference IS NULL THEN 'demote' WHEN difference / 0.002 < 1 THEN 'demote' WHEN positive / scored < 0.6 THEN 'demote' WHEN difference >= 0.01 AND difference / 0.002 >= 5 AND health <> 'weak' THEN 'deep_dive' ELSE 'watch' END AS recommendation,
CASE WHEN verdict <> 'promising' THEN 'demote' WHEN difference / 0.002 < 1 THEN 'demote' WHEN positive / scored < 0.6 THEN 'demote' WHEN positive / scored < 0.65 OR health <> 'supportive' OR top_share IS NULL OR top_share >= 0.2 THEN 'watch' ELSE 'continue' END AS deep_dive FROM health""")
def recommendation(spark, sf_dir):
    rows = R.adjacent_health(cells(spark, sf_dir)).withColumn("multiple", R.cost_multiple(F.col("difference"), F.lit(20.0))).withColumn("rate", F.try_divide("positive", "scored"))
    return rows.select(
        "base_key", "horizon", R.cost_class(F.col("multiple")).alias("cost_class"),
        R.promising_recommendation(F.col("difference"), F.col("p_value"), F.col("rate"), F.col("multiple"), F.col("health")).alias("recommendation"),
        R.deep_dive_recommendation(F.col("verdict"), F.col("difference"), F.col("rate"), F.col("multiple"), F.col("health"), F.col("top_share")).alias("deep_dive"),
    )


@query(f"""{BASE} SELECT CAST(year(test_start) AS BIGINT) AS year, string_agg(CASE WHEN difference > 0 THEN '+' ELSE '-' END, '' ORDER BY test_start) AS signs, round(sum(difference), 8) AS total, count(*) FILTER (WHERE difference > 0) AS positive FROM wins GROUP BY 1""")
def bucket_heatmap(spark, sf_dir):
    return R.bucket_heatmap(windows_for(spark, sf_dir)).select("year", "signs", r8("total"), "positive")


@query(f"{BASE} SELECT round(CASE WHEN sum(difference) FILTER (WHERE difference > 0) > 0 THEN max(difference) / sum(difference) FILTER (WHERE difference > 0) END, 8) AS top_share, count(*) AS windows FROM wins")
def temporal_concentration(spark, sf_dir):
    return R.temporal_concentration(windows_for(spark, sf_dir)).select(r8("top_share"), "windows")


@query(f"{BASE} SELECT split, test_start, round(difference, 8) AS difference FROM wins ORDER BY wins.difference, split LIMIT 5")
def weakest_windows(spark, sf_dir):
    return windows_for(spark, sf_dir).orderBy("difference", "split").limit(5).select("split", "test_start", r8("difference"))


@query("""SELECT p_brand, p_partkey, round(p_retailprice, 2) AS p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) AS k FROM part) WHERE k = 1""")
def registry_latest(spark, sf_dir):
    latest = R.latest_per_key(S.load(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_size"), F.desc("p_partkey")])
    return latest.select("p_brand", "p_partkey", F.round("p_retailprice", 2).alias("p_retailprice"))
