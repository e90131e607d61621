"""The vendor data source over HTTP and over landed responses, and the parsers behind it."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from chronopanel.plans.registry import fresh
from chronopanel.sources import connector, landing, vendor

REQUESTS = "source string, endpoint string, symbol string, params string"


def planned(spark, rows, per_partition=2):
    path = fresh(spark, "requests")
    connector.plan_requests(connector.checked_requests(spark.createDataFrame(rows, REQUESTS)), path, per_partition)
    return path


def test_requests_over_http_are_retried_each_by_itself(spark):
    seen = []

    class Vendor(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers["User-Agent"]))
            name = self.path.split("symbol=")[-1].split("&")[0] if "symbol=" in self.path else self.path
            times = sum(p == self.path for p, _ in seen)
            status = {"SLOW": 503 if times < 3 else 200, "GONE": 404, "BUSY": 429}.get(name, 200)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"path": self.path}).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Vendor)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = [("v", "income_statement", s, '{"period":"quarter","limit":5}') for s in ("OK", "SLOW", "GONE", "BUSY", "É &")] + [("v", "companyfacts", "0000000042", "{}"), ("v", "archive_document", "42", '{"accession":"01","document":"a b.htm"}')]
    try:
        options = {"base": f"http://127.0.0.1:{server.server_address[1]}", "agent": "me@example.com", "key": "hush", "first_pause": "0"}
        got = connector.fetch(spark, planned(spark, rows), **options).collect()
        dead = connector.fetch(spark, planned(spark, rows[:1]), **(options | {"base": "http://127.0.0.1:9"})).collect()
    finally:
        server.shutdown()
    told = {}
    for r in sorted(got, key=lambda r: r["attempt"]):
        told.setdefault(r["symbol"], []).append((r["status"], r["final"]))
    assert told["SLOW"] == [(503, False), (503, False), (200, True)] and told["GONE"] == [(404, True)] and told["OK"] == [(200, True)]
    assert told["BUSY"] == [(429, False), (429, False), (429, True)] and len(got) == 11
    bodies = {r["symbol"]: json.loads(r["body"])["path"] for r in got if r["final"]}
    assert bodies["0000000042"] == "/api/xbrl/companyfacts/CIK0000000042.json?apikey=hush"
    assert bodies["42"] == "/Archives/edgar/data/42/01/a%20b.htm?apikey=hush"
    assert bodies["É &"] == "/stable/income-statement?limit=5&period=quarter&symbol=%C3%89+%26&apikey=hush"
    assert all(agent == "me@example.com" for _, agent in seen) and all("hush" not in (r["params"] or "") for r in got)
    assert [(r["status"], r["final"], r["error"] is None) for r in sorted(dead, key=lambda r: r["attempt"])] == [(None, False, False), (None, False, False), (None, True, False)]


def test_landed_responses_answer_requests(spark):
    folder = fresh(spark, "landed")
    rows = [("p", f"s{k}", 1, 200, f"[{k}]") for k in range(50)] + [("p", "é", 1, 503, ""), ("p", "é", 2, 200, "[]"), ("p", "", 1, None, "reset"), ("q", "s1", 1, 200, "other")]
    connector.land_attempts(spark.createDataFrame(rows, "endpoint string, symbol string, attempt int, status int, body string"), folder, 7)
    asked = [("v", "p", f"s{k}", None) for k in range(60)] + [("v", "p", "é", "{}"), ("v", "p", "", "{}"), ("v", "q", "s1", "{}")]
    got = connector.fetch(spark, planned(spark, asked, 10), "chronopanel.sources.connector:Landed", folder=folder, first_pause="0")
    assert got.rdd.getNumPartitions() >= 6
    found = {(r["endpoint"], r["symbol"], r["attempt"]): (r["status"], r["body"], r["error"] is not None) for r in got.collect()}
    assert all(found["p", f"s{k}", 1][:2] == ((200, f"[{k}]") if k < 50 else (404, "")) for k in range(60))
    assert found["p", "é", 1][0] == 503 and found["p", "é", 2][:2] == (200, "[]") and found["q", "s1", 1][1] == "other"
    assert found["p", "", 1] == (None, None, True) and found["p", "", 2][0] == 404
    assert connector.responses(got).count() == 52
    assert connector.fetch(spark, planned(spark, []), "chronopanel.sources.connector:Landed", folder=folder).count() == 0


def test_a_bucket_of_landed_responses_is_read_a_few_times(spark, monkeypatch):
    folder, plan = fresh(spark, "landed"), fresh(spark, "requests")
    rows = [("p", f"s{k}", 1, 200, f"[{k}]") for k in range(400)]
    connector.land_attempts(spark.createDataFrame(rows, "endpoint string, symbol string, attempt int, status int, body string"), folder, 20)
    asked = spark.createDataFrame([("v", "p", f"s{k}", "{}") for k in range(400)], REQUESTS)
    connector.plan_requests(connector.checked_requests(asked), plan, 50, connector.place_of(20))
    reads, read = [], connector.pq.read_table
    monkeypatch.setattr(connector.pq, "read_table", lambda *a, **k: reads.append(1) or read(*a, **k))
    reader = connector.VendorReader({"requests": plan, "folder": folder, "transport": "chronopanel.sources.connector:Landed"})
    parts = reader.partitions()
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["symbol"], r["status"], r["body"]) for r in got) == sorted((s, 200, b) for _, s, _, _, b in rows)
    assert len(parts) >= 8 and len(reads) <= 20 + len(parts)  # was one for almost each of 400 requests


@pytest.mark.parametrize(("params", "fault"), [('{"api_key":"x"}', "secret"), ("[1]", "no object"), ("{", "no object")])
def test_requests_with_secrets_or_bad_parameters_are_refused(spark, params, fault):
    with pytest.raises(Exception, match=fault):
        connector.checked_requests(spark.createDataFrame([("v", "p", "A", params)], REQUESTS)).collect()


def test_rules_for_one_response_are_those_for_columns(spark):
    statuses = [200, 301, 404, 408, 429, 499, 500, 503]
    rows = spark.createDataFrame([(s, k) for k, s in enumerate(statuses, 1)], "status int, attempt int")
    for r in rows.select("*", landing.retryable(rows["status"]).alias("again"), landing.pause_seconds(rows["attempt"]).alias("pause")).collect():
        assert r["again"] == landing.worth_retry(r["status"]) and r["pause"] == landing.pause_after(r["attempt"])


def test_statements_of_another_symbol_are_an_error(spark):
    body = json.dumps([{"symbol": "abc ", "date": "2024-03-31", "fiscalYear": "2024", "period": "Q1", "acceptedDate": "2024-05-01 16:05:00", "freeCashFlow": 2.5}])
    rows = spark.createDataFrame([("ABC", body)], "asked string, body string")
    got = vendor.statements(rows, "body", vendor.CASH_FLOW_METRICS, 2000, expected="asked").collect()
    assert [(r["metric_name"], r["metric_value"]) for r in got] == [("free_cash_flow", 2.5)]
    with pytest.raises(Exception, match="asked for XYZ, got abc"):
        vendor.statements(rows.selectExpr("'XYZ' as asked", "body"), "body", vendor.CASH_FLOW_METRICS, 2000, expected="asked").collect()


def test_companyfacts_need_facts(spark):
    fact = {"end": "2024-03-31", "val": 7.0, "accn": "1", "fy": 2024, "fp": "Q1", "form": "10-Q", "filed": "2024-05-01"}
    good = json.dumps({"cik": "42", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [fact, {**fact, "form": "8-K"}, {**fact, "val": None}], "EUR": [fact]}}}}})
    rows = vendor.companyfacts(spark.createDataFrame([(good,)], "body string"), "body", {"Revenues": "revenue", "Lacking": "other"}).collect()
    assert [(r["cik"], r["metric_name"], r["metric_value"], r["fiscal_year"]) for r in rows] == [("0000000042", "revenue", 7.0, 2024)]
    with pytest.raises(Exception, match="no facts of 43"):
        vendor.companyfacts(spark.createDataFrame([('{"cik": "43"}',)], "body string"), "body", {"Revenues": "revenue"}).collect()
