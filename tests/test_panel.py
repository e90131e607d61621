import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from chronopanel.functions import policies
from chronopanel.functions import time as T
from chronopanel.operators import panel as P
from chronopanel.operators import pit, runs


def grid(spark, prices, volumes=None):
    rows = [(1, dt.date(2020, 1, 1) + dt.timedelta(k), k, p, None if volumes is None else volumes[k]) for k, p in enumerate(prices)]
    return spark.createDataFrame(rows, "security_id long, session date, idx long, price double, volume double")


def test_momentum_uses_sessions(spark):
    prices = [100.0] * 253
    prices[231] = 133.33
    last = P.price_return(grid(spark, prices), 252, 21).orderBy(F.desc("idx")).first()
    assert last.status == "ok" and last.value == pytest.approx(0.3333)


def test_status_precedence(spark):
    got = [r.status for r in P.price_return(grid(spark, [None, 1.0, 2.0, None]), 2).orderBy("idx").collect()]
    assert got == ["insufficient_history", "insufficient_history", "missing_price", "missing_price"]
    with pytest.raises(ValueError):
        P.price_return(grid(spark, [1.0]), 5, 5)


def test_dollar_volume_and_volatility(spark):
    g = grid(spark, [10.0] * 63, [1000.0 + k for k in range(63)])
    assert P.avg_dollar_volume(g).orderBy(F.desc("idx")).first().value == pytest.approx(10310.0)
    prices = [100 + (k % 7) for k in range(64)]
    steps = [b / a - 1 for a, b in zip(prices, prices[1:])]
    mean = sum(steps) / 63
    want = math.sqrt(sum((s - mean) ** 2 for s in steps) / 62) * math.sqrt(252)
    assert P.realized_volatility(grid(spark, [float(p) for p in prices])).orderBy(F.desc("idx")).first().value == pytest.approx(want, rel=1e-12)


def test_labels_partition_and_benchmark(spark):
    g = grid(spark, [100.0 + k for k in range(260)])
    labels = P.forward_labels(g)
    assert labels.count() == 260 * 5
    assert [r.raw_return for r in labels.where("idx = 0").orderBy("horizon").collect()] == pytest.approx([h / 100 for h in P.HORIZONS])
    bench = g.select("session", (F.col("price") + 100).alias("b_price"))
    row = P.forward_labels(g, (5,), bench).where("idx = 0").first()
    assert row.excess_return == pytest.approx(0.025)
    cut = bench.where("session <> date'2020-01-06'")
    row = P.forward_labels(g, (5,), cut).where("idx = 0").first()
    assert row.raw_return == pytest.approx(0.05) and row.excess_return is None


def test_label_reasons(spark):
    got = {r.idx: r.skip_reason for r in P.forward_labels(grid(spark, [None, 1.0, 0.0, 1.0, 1.0, 1.0, None, 1.0, 2.0, 3.0]), (5,)).collect()}
    assert got[0] == "missing_asof_price" and got[1] == "missing_target_price" and got[2] == "invalid_asof_price" and got[3] is None and got[5] == "insufficient_calendar_history"


def test_label_availability_follows_the_latest_source(spark):
    row = spark.createDataFrame([(dt.datetime(2024, 1, 2, 21), dt.datetime(2024, 1, 2, 21), dt.datetime(2024, 1, 3))], "close timestamp, a timestamp, b timestamp")
    at, policy = P.label_availability(F.col("close"), [(F.col("a"), F.lit("price")), (F.col("b"), F.lit("benchmark"))])
    assert row.select(policy.alias("p")).first().p == "benchmark"
    at, policy = P.label_availability(F.col("close"), [(F.col("a"), F.lit("price"))])
    assert row.select(policy.alias("p")).first().p == "session_close"


def test_newest_period_wins_over_late_publication(spark):
    at = dt.datetime
    rows = [
        (1, 2024, "Q1", dt.date(2024, 3, 31), "revenue", 100.0, at(2024, 5, 1)), (1, 2024, "Q1", dt.date(2024, 3, 31), "gross_profit", 40.0, at(2024, 9, 1)),
        (1, 2024, "Q2", dt.date(2024, 6, 30), "revenue", 200.0, at(2024, 8, 1)), (1, 2024, "Q2", dt.date(2024, 6, 30), "gross_profit", 90.0, at(2024, 8, 2)),
        (1, 2025, "Q1", dt.date(2025, 3, 31), "revenue", 125.0, at(2025, 5, 1)),
    ]
    m = spark.createDataFrame(rows, "security_id long, fiscal_year int, fiscal_period string, period_end date, metric_name string, metric_value double, available_at timestamp")
    asof = spark.createDataFrame([(1, at(2024, 10, 1)), (1, at(2024, 7, 1)), (1, at(2025, 6, 1))], "security_id long, ts timestamp")
    order = ["period_end", "fiscal_year", "fiscal_period"]
    margins = {r.ts.month: r["value"] for r in P.newest_visible(P.ratio_events(m, "gross_profit"), asof, order, ["value"]).collect()}
    assert margins == {10: 0.45, 7: None, 6: 0.45}
    growth = {r.ts.month: r["value"] for r in P.newest_visible(P.growth_events(m, "revenue"), asof, order, ["value"]).collect()}
    assert growth[6] == pytest.approx(0.25) and growth[7] is None


def test_noon_and_evening_see_different_anchors(spark):
    """At noon the last session's price is not out yet; after it is, the anchor moves on."""
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(254)]
    prices = [100.0] * 254
    prices[231], prices[232] = 110.0, 250.0
    rows = spark.createDataFrame([(1, d, k, p) for k, (d, p) in enumerate(zip(days, prices))], "security_id long, session date, idx long, price double")
    rows = rows.withColumn("visible_at", T.date_at_time(F.col("session"), 18)).withColumn("known_at", F.col("visible_at"))
    last = spark.createDataFrame([(1, days[-1])], "security_id long, d date")
    asofs = last.select("security_id", F.explode(F.array(T.date_at_time(F.col("d"), 12), T.date_at_time(F.col("d"), 19))).alias("asof"))
    anchored = pit.anchored(asofs, rows.select("idx", "visible_at"))
    got = {r.anchor: (r.status, round(r["value"], 6)) for r in pit.price_return_at(anchored, rows, 252, 21).collect()}
    assert got == {252: ("ok", 0.1), 253: ("ok", 1.5)}
    late = rows.withColumn("known_at", F.when(F.col("idx") == 232, F.col("known_at") + F.expr("interval 90 days")).otherwise(F.col("known_at")))
    got = {r.anchor: r.status for r in pit.price_return_at(anchored, late, 252, 21).collect()}
    assert got == {252: "ok", 253: "missing_price"}


def metrics(spark, rows):
    return spark.createDataFrame(rows, "security_id long, fiscal_year int, fiscal_period string, period_end date, metric_name string, metric_value double, available_at timestamp")


def test_income_features_and_their_reasons(spark):
    at = dt.datetime
    rows = [
        (1, 2024, "Q1", dt.date(2024, 3, 31), "revenue", 100.0, at(2024, 5, 1)), (1, 2025, "Q1", dt.date(2025, 3, 31), "revenue", 125.0, at(2025, 5, 1, 20)),
        (1, 2025, "Q1", dt.date(2025, 3, 31), "gross_profit", 50.0, at(2025, 5, 1, 20, 5)), (1, 2024, "Q1", dt.date(2024, 3, 31), "revenue", 80.0, at(2026, 1, 1)),
        (2, 2024, "Q1", dt.date(2024, 3, 31), "revenue", 0.0, at(2024, 5, 1)), (2, 2024, "Q1", dt.date(2024, 3, 31), "net_income", 5.0, at(2024, 5, 1)), (2, 2025, "Q1", dt.date(2025, 3, 31), "revenue", 9.0, at(2025, 5, 1)),
    ]
    asofs = spark.createDataFrame([(s, t) for s in (1, 2, 3) for t in (at(2025, 5, 1, 19), at(2025, 5, 1, 21), at(2026, 6, 1))], "security_id long, asof timestamp")
    get = lambda name: {(r.security_id, r.asof): (r.status, r["value"], r.available_at) for r in pit.income_feature(metrics(spark, rows), asofs, name).collect()}
    growth = get("revenue_growth_yoy")
    assert growth[1, at(2025, 5, 1, 19)][0] == "missing_prior_year_metric" and growth[1, at(2025, 5, 1, 21)] == ("ok", 0.25, at(2025, 5, 1, 20))
    assert growth[1, at(2026, 6, 1)][1] == pytest.approx(125 / 80 - 1)  # the revision counts from when it was out
    assert growth[2, at(2025, 5, 1, 21)][0] == "zero_denominator" and growth[3, at(2026, 6, 1)][0] == "no_visible_period"
    margin = get("gross_margin")
    assert margin[1, at(2025, 5, 1, 19)][0] == "missing_current_metric" and margin[1, at(2025, 5, 1, 21)] == ("ok", 0.4, at(2025, 5, 1, 20, 5))
    assert get("net_margin")[2, at(2026, 6, 1)][0] == "zero_denominator"
    with pytest.raises(ValueError):
        pit.income_feature(metrics(spark, rows), asofs, "price_to_moon")


def test_policies_are_checked_and_applied(spark):
    config = policies.default_config()
    assert len(policies.validate(spark, config)) == 12
    for spoil in (lambda c: c.update(policy_set_version=2), lambda c: c["policies"].pop(), lambda c: c["policies"].append(c["policies"][0]), lambda c: c["policies"][0].update(rule={"type": "odd"}), lambda c: c["policies"][3].update(rule={"type": "timestamp_plus_duration", "base": "x"})):
        broken = policies.default_config()
        spoil(broken)
        with pytest.raises(ValueError):
            policies.validate(spark, broken)
    with pytest.raises(ValueError, match="sec_10k_filing rule_type odd.*late valid_to 2019"):
        policies.validate(spark, {"policy_set_version": 1, "policies": [
            {"name": "sec_10k_filing", "version": 1, "rule": {"type": "odd"}}, {"name": "late", "version": 1, "rule": {"type": "fetched_at", "base": "x"}, "valid_from": "2020-01-01T00:00:00Z", "valid_to": "2019-01-01T00:00:00Z"}]}, ())
    day = spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2024, 7, 2),)], "price_date date")
    got = [r.available_at.hour for r in policies.apply(day, policies.POLICIES["daily_price"]).orderBy("price_date").collect()]
    assert got == [23, 22]


def test_advance_refuses_what_is_no_session(spark):
    cal = T.number_sessions(T.exchange_calendar(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31)))
    on = lambda d: spark.createDataFrame([(d,)], "date date")
    assert T.advance_checked(on(dt.date(2024, 1, 12)), cal, 5).first().target == dt.date(2024, 1, 22)
    for day, why in ((dt.date(2024, 1, 13), "not a session"), (dt.date(2023, 1, 2), "no calendar row"), (dt.date(2024, 12, 30), "calendar ends")):
        with pytest.raises(Exception, match=why):
            T.advance_checked(on(day), cal, 5).collect()
    with pytest.raises(ValueError):
        T.advance_checked(on(dt.date(2024, 1, 12)), cal, 1)


def test_runs_refuse_contradictions(spark):
    pairs = spark.createDataFrame([("a", 1), ("a", 2)], "name string, version long")
    with pytest.raises(Exception, match="conflicting versions"):
        runs.checked_policies(pairs).collect()
    mixed = spark.createDataFrame([(0.1, 0.2), (0.1, None)], "raw_return double, excess_return double")
    with pytest.raises(Exception, match="mixed"):
        runs.checked_target_kind(mixed).collect()
    with pytest.raises(Exception, match="unknown: 3"):
        runs.require_known(spark.range(4), spark.range(3), ["id"]).collect()
    assert runs.set_faults(spark.range(3), spark.range(1, 4), ["id"]).count() == 2
    line = spark.createDataFrame([("headline", 0, "windows: 3")], "section string, line long, text string")
    assert runs.markdown(line, "Run") == "# Run\n\n## headline\n\n- windows: 3\n"
