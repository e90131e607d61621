"""Supersession chains, order statistics, least squares, drawdowns and trailing quarters against plain versions."""

import datetime as dt
import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import drawdown, income, independence, ranks, regression, supersession

FACTS = "id long, before long, k string, available_at timestamp"
DAY = dt.datetime(2024, 1, 1)


def at(days):
    return DAY + dt.timedelta(days=days)


def test_long_chains_late_rows_and_states_at_instants(spark):
    r = random.Random(2)
    rows = []
    for key, length in (("long", 200), ("short", 3), ("one", 1)):
        days = [r.randrange(300) for _ in range(length)]
        rows += [(hash(key) % 7 * 1000 + n, None if n == 0 else hash(key) % 7 * 1000 + n - 1, key, at(days[n])) for n in range(length)]
    rows = [(n, None if b is None else [x[0] for x in rows].index(b), k, t) for n, (_, b, k, t) in enumerate(rows)]
    found = supersession.history(spark.createDataFrame(rows, FACTS), "id", "before", ["k"])
    got = {x["id"]: x for x in found.collect()}
    of_key = {k: sorted(i for i, _, key, _ in rows if key == k) for k in ("long", "short", "one")}
    for i, _, k, t in rows:
        later = [rows[j][3] for j in of_key[k] if j > i]
        x = got[i]
        assert (x["chain"], x["position"], x["superseded_at"], x["is_current"]) == (of_key[k][0], i - of_key[k][0], min(later, default=None), not later)
    for day in (-1, 50, 299):
        current = {x["k"]: x["id"] for x in supersession.as_of(found, F.lit(at(day))).collect()}
        want = {k: max((j for j in of_key[k] if rows[j][3] <= at(day)), default=None) for k in of_key}
        assert current == {k: j for k, j in want.items() if j is not None}


@pytest.mark.parametrize(("rows", "fault"), [
    ([(1, 2, "a"), (2, 3, "a"), (3, 1, "a")], "in a circle"), ([(1, None, "a"), (2, 1, "a"), (3, 1, "a")], "superseded twice"), ([(1, 1, "a")], "supersedes itself"),
    ([(1, 9, "a")], "unknown row"), ([(1, None, "a"), (2, 1, "b")], "another key"), ([(1, None, "a"), (1, None, "a")], "an id twice"), ([(1, None, "a"), (2, None, "a")], "more than one current row of a"),
])
def test_faulty_chains_are_errors(spark, rows, fault):
    with pytest.raises(Exception, match=fault):
        supersession.history(spark.createDataFrame([(*x, DAY) for x in rows], FACTS), "id", "before", ["k"]).collect()


def test_short_chains_are_followed_without_joins(spark, monkeypatch):
    r, rows = random.Random(3), []
    for key in range(400):
        ids = r.sample(range(key * 100, key * 100 + 100), r.choice([1, 2, 7, 20]) if key != 5 else 15)
        rows += [(i, ids[n - 1] if n else None, None if key == 5 else f"k{key}", at(r.randrange(300)) if r.random() < 0.95 else None) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, FACTS).repartition(5)
    show = lambda found: sorted(map(str, found.select("id", "before", "k", "available_at", "chain", "position", "superseded_at", "is_current").collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # keys lie across batches
    try:
        mixed = show(supersession.history(df, "id", "before", ["k"], 10))
        monkeypatch.setattr(supersession, "follow", None)
        short = show(supersession.history(df, "id", "before", ["k"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert short == mixed and len(short) == len(rows)
    later = {i: [] for i, *_ in rows}
    for n, (i, b, _, t) in enumerate(rows):
        while b is not None:
            later[b].append(t)
            n, b = n - 1, rows[n - 1][1]
    for x in supersession.history(df, "id", "before", ["k"]).collect():
        assert x["superseded_at"] == min(filter(None, later[x["id"]]), default=None) and x["is_current"] == (not later[x["id"]])


def test_ranks_and_medians_of_any_size(spark):
    r = random.Random(4)
    rows = [("a" if r.random() < 0.8 else "b", r.choice([0.5, 1.0, r.random()]), r.random()) for _ in range(700)] + [("c", 3.0, 1.0), ("d", None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    for k, part in itertools.groupby(sorted(rows, key=lambda x: x[0]), key=lambda x: x[0]):
        values = [x for _, x, _ in part if x is not None]
        got = {m["g"]: (m["median"], m["n"]) for m in ranks.medians(df, "x", ["g"]).collect()}
        assert (got[k] == (statistics.median(values), len(values))) if values else k not in got
    for x in ranks.with_ranks(df, "x", ["g"], "k").collect():
        peers = [v for g, v, _ in rows if g == x["g"] and v is not None]
        assert x["k"] == (None if x["x"] is None else sum(v < x["x"] for v in peers) + (sum(v == x["x"] for v in peers) + 1) / 2)
    assert ranks.medians(df, "y", [], "m").first()["m"] == statistics.median(y for _, _, y in rows)


def test_a_rank_correlation_of_nothing_is_zero(spark):
    r, rows, g = random.Random(9), [], 0
    while g < 60:  # deals of which ranks have no covariance at all
        n = r.randrange(5, 26)
        y = r.sample(range(n), n)
        if sum((2 * k + 1 - n) * (2 * v + 1 - n) for k, v in enumerate(y)) == 0:
            rows += [(g, float(k), float(v)) for k, v in enumerate(y)]
            g += 1
    rows += [(-1, 1.0, 2.0), (-1, 2.0, 4.0), (-1, 3.0, 3.0), (-1, None, 9.0), (-2, 1.0, 2.0), (-2, 1.0, 3.0), (-3, None, 1.0)]
    got = {x["g"]: x["rank_correlation"] for x in ranks.spearman(spark.createDataFrame(rows, "g int, x double, y double").repartition(5), "x", "y", ["g"]).collect()}
    assert [got[k] for k in range(60)] == [0.0] * 60 and got[-2] is None and got[-3] is None
    assert got[-1] == pytest.approx((1 / 3) / ((2 / 3) ** 0.5 * 1.25 ** 0.5))


def test_least_squares_of_merged_moments(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 3)) * [1, 10, 0.1] + [1e6, 0, 5]
    y = x @ [2.0, -0.5, 3.0] + 7 + r.normal(size=400) * 0.1
    rows = [(k % 2, k % 11, *map(float, x[k]), float(2 * x[k, 0] - x[k, 1]), float(y[k])) for k in range(400)] + [(0, 0, None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, d int, a double, b double, c double, twin double, y double").withColumn("flat", F.lit(3.0))
    for names, used in ((["a", "b", "c"], [0, 1, 2]), (["a", "b", "twin", "flat", "c"], [0, 1, 4])):
        parts = regression.merged(regression.moments(df, "y", names, ["g", "d"]), len(names) + 1, ["g"])
        for m in regression.fit(parts, len(names), ["g"]).collect():
            own = np.arange(400) % 2 == m["g"]
            want, *_ = np.linalg.lstsq(np.c_[x[own] - x[own].mean(0), np.ones(own.sum())], y[own], rcond=None)
            assert np.allclose([m["coefficients"][k] for k in used], want[:3], rtol=1e-6) and m["n"] == own.sum() and 0.99 < m["r_squared"] <= 1
            assert all(c == 0 for k, c in enumerate(m["coefficients"]) if k not in used)
            assert np.isclose(m["intercept"], y[own].mean() - want[:3] @ x[own].mean(0), rtol=1e-5)
    left = regression.residuals(df.where("a is not null"), "y", ["a", "b", "c"], ["g"]).groupBy("g").agg(F.avg("residual").alias("m"), F.corr("residual", "b").alias("r"))
    assert all(abs(x["m"]) < 1e-6 and abs(x["r"]) < 1e-6 for x in left.collect())


def plain_path(returns):
    out, e, p = [], 1.0, 1.0
    for x in returns:
        e *= 1 + (x or 0.0)
        p = max(p, e)
        out.append((e, p))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_drawdowns_on_any_partitioning(spark, parts):
    r = random.Random(8)
    series = {"a": [r.gauss(0.001, 0.02) for _ in range(500)], "b": [-0.01] * 40, "c": [0.01, None, 0.02], "d": [-0.5, 1.0, 0.0]}
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(k), x) for s, xs in series.items() for k, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "series string, date date, ret double").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    try:
        path = drawdown.equity(df)
        got = {(x["series"], x["date"]): x for x in path.collect()}
        falls = {x["series"]: x for x in drawdown.drawdowns(path).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    day = lambda k: None if k is None else dt.date(2020, 1, 1) + dt.timedelta(k)
    for s, xs in series.items():
        want = plain_path(xs)
        for k, (e, p) in enumerate(want):
            assert got[s, day(k)]["equity"] == pytest.approx(e) and got[s, day(k)]["peak"] == pytest.approx(p)
        depth = [e / p - 1 for e, p in want]
        trough = min(range(len(xs)), key=lambda k: (round(depth[k], 12), k))
        height = want[trough][1] * (1 - 1e-12)
        back = next((k for k in range(trough + 1, len(xs)) if want[k][0] >= height), None)
        peak = max((k for k in range(trough) if want[k][0] >= height), default=None)
        x = falls[s]
        assert x["max_drawdown"] == pytest.approx(min(depth)) and x["final_equity"] == pytest.approx(want[-1][0])
        assert (x["trough_date"], x["recovered_date"], x["peak_date"], x["recovery_days"]) == (day(trough), day(back), day(peak), None if back is None else back - trough)


def plain_income(rows, asof, name):
    """A feature at an instant from all rows visible by then."""
    seen = [r for r in rows if r[6] <= asof]
    if not seen:
        return (None, "no_visible_period")
    cell = {}
    for _, year, quarter, end, metric, value, when in seen:
        held = cell.setdefault((end, year, quarter), {})
        held[metric] = max(held.get(metric, (when, value)), (when, value))

    def newest(year, quarter, metric):
        ends = [p for p in cell if p[1:] == (year, quarter)]
        return cell[max(ends)].get(metric) if ends else None

    def four(p, metric, back):
        index = p[1] * 4 + int(p[2][1]) - 1
        got = [newest((index - k) // 4, f"Q{(index - k) % 4 + 1}", metric) for k in range(back, back + 4)]
        return sum(g[1] for g in got) if all(got) else None

    kinds = set()
    for p in sorted(cell, reverse=True):
        if name in income.MARGINS:
            a, b = (cell[p].get(m) for m in income.MARGINS[name])
            here, prior, values = a and b, True, (a and a[1], b and b[1], 0)
        elif name in income.GROWTH:
            a, b = cell[p].get(income.GROWTH[name]), newest(p[1] - 1, p[2], income.GROWTH[name])
            here, prior, values = a, b, (a and a[1], b and b[1], 1)
        else:
            metric, under = income.TRAILING[name]
            a0, a1 = four(p, metric, 0), four(p, metric, 4)
            b0, b1 = (four(p, under, k) for k in (0, 4)) if under else (a0, a1)
            here, prior = a0 is not None and b0 is not None, a1 is not None and b1 is not None
            values = None
            if here and prior:
                zero = (a1 == 0) if not under else (b0 == 0 or b1 == 0)
                values = (0, 0, 0) if zero else ((a0 / a1 - 1) if not under else (a0 / b0 - a1 / b1), 1, 0)
        if not here:
            continue
        if not prior:
            kinds.add("no_prior")
        elif values[1] == 0:
            kinds.add("zero")
        else:
            return (values[0] / values[1] - values[2], "ok")
    return (None, "zero_denominator" if "zero" in kinds else "missing_prior_year_metric" if "no_prior" in kinds else "missing_current_metric")


def test_income_features_equal_a_plain_version_under_revisions(spark):
    r = random.Random(5)
    rows = []
    for security in range(6):
        for index in range(8080, 8094):
            year, quarter = index // 4, index % 4 + 1
            end = dt.date(year, quarter * 3, 28)
            for metric in ("revenue", "gross_profit", "operating_income", "diluted_weighted_average_shares"):
                if r.random() < 0.08:
                    continue
                for revision in range(r.choice([1, 1, 1, 2, 3])):
                    value = 0.0 if metric == "revenue" and r.random() < 0.12 else float(r.randrange(1, 100))
                    rows.append((security, year, f"Q{quarter}", end, metric, value, dt.datetime(end.year, end.month, end.day) + dt.timedelta(days=r.choice([20, 40, 40, 200]) + revision * r.choice([0, 30, 120]))))
                if r.random() < 0.05:  # the same quarter with another end
                    rows.append((security, year, f"Q{quarter}", end - dt.timedelta(1), metric, 5.0, dt.datetime(end.year, end.month, end.day) + dt.timedelta(days=r.choice([10, 300]))))
    df = spark.createDataFrame(rows, "security_id long, fiscal_year long, fiscal_period string, period_end date, metric_name string, metric_value double, available_at timestamp").repartition(5)
    instants = [dt.datetime(2019, 1, 1) + dt.timedelta(days=61 * k) for k in range(34)]
    asofs = spark.createDataFrame([(s, t) for s in range(7) for t in instants], "security_id long, asof timestamp")
    got = {(x["security_id"], x["asof"], x["feature"]): (x["value"], x["status"]) for x in income.income_features(df, asofs).collect()}
    assert len(got) == 7 * 34 * len(income.FEATURES)
    for s in range(7):
        own = [x for x in rows if x[0] == s]
        for t in instants:
            for name in income.FEATURES:
                value, status = plain_income(own, t, name)
                assert got[s, t, name][1] == status and got[s, t, name][0] == (None if value is None else pytest.approx(value, abs=1e-9)), (s, t, name)
    assert {x[1] for x in got.values()} >= {"ok", "zero_denominator", "missing_prior_year_metric", "missing_current_metric", "no_visible_period"} - {"zero_denominator"}


def test_verdicts_of_residuals(spark):
    def verdict(differences):
        return independence.residual_verdict(spark.createDataFrame([(x,) for x in differences], "difference double")).first()["verdict"]

    assert verdict([1.0, 1.0]) == "insufficient_data" and verdict([1.0, 1.0, 1.0]) == "independent" and verdict([9.0, -1.0, -1.0]) == "explained_by_controls" and verdict([-1.0] * 3) == "explained_by_controls"
