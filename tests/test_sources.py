import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chronopanel.operators import panel as P
from chronopanel.sources import vault, vendor


def test_price_payloads(spark):
    day = lambda d: {"date": f"2024-01-0{d}", "open": 1.0, "high": 3.0, "low": 0.5, "close": 2.0, "adjClose": 1.9, "volume": 10, "vwap": 5}
    body = spark.createDataFrame([(json.dumps({"symbol": "AAA", "historical": [day(4), day(2), day(3)]}),)], "body string")
    rows = vendor.legacy_prices(body, "body").orderBy("date").collect()
    assert [r["date"].day for r in rows] == [2, 3, 4] and rows[0].adj_close == 1.9
    assert vendor.price_faults(vendor.legacy_prices(body, "body")).count() == 0
    stable = spark.createDataFrame([(json.dumps([{"symbol": "AAA", "date": "2024-01-02", "adjOpen": 1, "adjHigh": 2, "adjLow": 1, "adjClose": 1.5, "volume": 7}]),)], "body string")
    assert vendor.stable_prices(stable, "body").first().close == 1.5


def test_statements_are_new_york_time_and_long(spark):
    s = {"symbol": "AAA", "date": "2024-09-28", "fiscalYear": "2024", "period": "FY", "acceptedDate": "2024-11-01 06:01:36", **{k: 1.0 for k in vendor.INCOME_METRICS}}
    body = spark.createDataFrame([(json.dumps([s, s | {"fiscalYear": "2010"}]),)], "body string")
    rows = vendor.statements(body, "body", vendor.INCOME_METRICS, 2014).select("metric_name", F.date_format("accepted_at", "HH:mm:ss").alias("t")).collect()
    assert [r.metric_name for r in rows] == list(vendor.INCOME_METRICS.values()) and {r.t for r in rows} == {"10:01:36"}


def test_parallel_arrays_must_match(spark):
    good = spark.createDataFrame([(1, [1, 2], ["a", "b"])], "k int, x array<int>, y array<string>")
    assert vendor.zip_columns(good, ["x", "y"]).count() == 2
    bad = spark.createDataFrame([(1, [1, 2], ["a"])], "k int, x array<int>, y array<string>")
    with pytest.raises(Exception, match="differ in length"):
        vendor.zip_columns(bad, ["x", "y"]).collect()


def test_release_candidates_exhibits_and_text(spark):
    f = spark.createDataFrame([("8-K", "2.02,9.01", dt.date(2026, 4, 30), "2026-04-30T16:30:41.000Z"), ("8-K", "12.02", dt.date(2026, 4, 30), "2026-04-30T16:30:41.000Z"), ("10-Q", "2.02", dt.date(2026, 4, 30), "2026-04-30T16:30:41.000Z")], "form string, items string, filing_date date, accepted string")
    got = vendor.earnings_candidates(f, "2014-01-01").select(F.date_format("accepted_at", "HH:mm:ss").alias("t")).collect()
    assert [r.t for r in got] == ["20:30:41"]
    files = spark.createDataFrame([("1", "a8-kex991q2202603282026.htm", "a.htm"), ("1", "a.htm", "a.htm"), ("1", "zex991.htm", "a.htm")], "accession string, name string, primary_document string")
    assert vendor.earnings_exhibits(files).first().exhibit == "a8-kex991q2202603282026.htm"
    none = spark.createDataFrame([("2", "EX-99_1.HTM", "ex-99_1.htm"), ("2", "exhibit99.txt", "a.htm"), ("2", "complex98.htm", "a.htm")], "accession string, name string, primary_document string")
    assert vendor.earnings_exhibits(none).count() == 0
    text = spark.createDataFrame([("Results for fiscal 2026 second quarter ended March 28, 2026",)], "t string")
    year, period, end = vendor.fiscal_fields(F.col("t"))
    r = text.select(year.alias("y"), period.alias("p"), end.alias("e")).first()
    assert (r.y, r.p, r.e) == (2026, "Q2", dt.date(2026, 3, 28))
    unsaid = spark.createDataFrame([("Q1 and the full year; year ended June 30, 2024",)], "t string").select(year.alias("y"), period.alias("p")).first()
    assert (unsaid.y, unsaid.p) == (2024, None)
    page = spark.createDataFrame([("<html><title> A <b>&amp;</b> b</title><script>x<1</script><p>c &amp; d</p></html>",)], "h string")
    r = page.select(vendor.html_title(F.col("h")).alias("t"), vendor.html_text("h").alias("x")).first()
    assert r.t == "A & b" and r.x == "A & b c & d"


def test_vault_and_merge(spark):
    schema = "source string, endpoint string, params string, body string"
    rows = spark.createDataFrame([("s", "e", None, "x"), ("s", "e", None, "x")], schema)
    held = vault.vault_rows(rows)
    assert held.count() == 1 and vault.append_new(held, rows).count() == 0
    assert vault.append_new(held, spark.createDataFrame([("s", "e", None, "y")], schema)).count() == 1
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "d"), (4, "e")], "k int, v string")
    got = {r.k: (r.v, r.action) for r in vault.merge_by_key(old, new, ["k"], ["v"]).collect()}
    assert got == {1: ("a", "kept"), 2: (None, "kept"), 3: ("d", "updated"), 4: ("e", "inserted")}
    assert vault.redact({"a": [{"apiKey": 1, "Access_Token": 2, "tokens": 3}], "b": 2}) == {"a": [{"apiKey": "[REDACTED]", "Access_Token": "[REDACTED]", "tokens": 3}], "b": 2}
    known = spark.createDataFrame([("n", 1, "h")], "name string, version int, hash string")
    with pytest.raises(Exception, match="definition changed"):
        vault.ensure_definition(known, spark.createDataFrame([("n", 1, "other")], "name string, version int, hash string")).collect()


def test_urls_lose_their_secrets_and_keep_their_fragment(spark):
    urls = ["x?client_secret=1&access_token=2&b=3", "https://h/p?b=2&a=1%20+%7E#f?g", "https://h/p?a", "https://h/p#t", "https://h/p?"]
    got = [r.u for r in spark.createDataFrame([(u,) for u in urls], "url string").select(vault.clean_url(F.col("url")).alias("u")).collect()]
    assert got == ["x?access_token=%5BREDACTED%5D&b=3&client_secret=%5BREDACTED%5D", "https://h/p?a=1++~&b=2#f?g", "https://h/p?a=", "https://h/p#t", "https://h/p"]


def test_registries_refuse_what_contradicts_them(spark):
    shape = "key string, metadata string, status string"
    old = spark.createDataFrame([("a", "{}", "running")], shape)
    with pytest.raises(Exception, match="other metadata"):
        vault.register_runs(old, spark.createDataFrame([("a", "{1}", "running")], shape)).collect()
    with pytest.raises(Exception, match="no run"):
        vault.finish_runs(old, spark.createDataFrame([("b", "failed")], "key string, status string")).collect()
    rows = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1.0, 2.0)] * 2, "security_id long, session date, price double, volume double")
    with pytest.raises(Exception, match="written twice"):
        vault.upsert(rows.limit(0), rows, "prices").collect()
    keys = [vault.run_key("falsifier", p) for p in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2})]
    assert keys[0] == keys[1] != keys[2]


def test_definition_hash_ignores_key_order():
    a = P.definition_hash("f", 1, "numeric", {"a": 1, "b": 2})
    assert a == P.definition_hash("f", 1, "numeric", {"b": 2, "a": 1}) and len(a) == 64
