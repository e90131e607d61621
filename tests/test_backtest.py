import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronopanel.operators import backtest as B
from chronopanel.operators import ranks
from chronopanel.operators import reports as R


def test_splits_expanding_rolling_and_too_short(spark):
    got = [tuple(r) for r in B.plan_splits(spark.range(13).withColumnRenamed("id", "idx"), 2, 3, 2, 2).orderBy("split").collect()]
    assert got == [(0, 0, 2, 5, 6), (1, 0, 4, 7, 8), (2, 0, 6, 9, 10)]
    rolling = [(r.train_from, r.train_to) for r in B.plan_splits(spark.range(15).withColumnRenamed("id", "idx"), 2, 3, 2, 3, 4).orderBy("split").collect()]
    assert rolling[0][1] - rolling[0][0] == 2 and all(b - a == 3 for a, b in rolling[1:])
    assert B.plan_splits(spark.range(6).withColumnRenamed("id", "idx"), 2, 3, 2, 2).count() == 0


def panel(spark):
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(d), d, dt.date(2024, 1, 3) + dt.timedelta(d), s - 2 + 0.001 * d, 0.05 * (s - 2 + 0.001 * d)) for s in (1, 2, 3) for d in range(11)]
    return spark.createDataFrame(rows, "security_id long, asof date, idx long, horizon_session date, feature double, ret double")


def test_regression_runner(spark):
    rows, splits = panel(spark), B.plan_splits(spark.range(13).withColumnRenamed("id", "idx"), 2, 3, 2, 2)
    models = B.walk_forward_ols(rows, splits)
    assert models.agg(F.sum("train_pairs")).first()[0] == 45
    pred = B.predictions(rows, splits, models).withColumn("all", F.lit(0))
    assert pred.count() == 18
    assert ranks.spearman(pred, "score", "ret", ["all"]).first().rank_correlation == pytest.approx(1.0)
    assert B.long_short(pred, "score", 1 / 3, ["all"]).first().spread == pytest.approx(0.10)


def test_constant_feature_and_guards(spark):
    rows, splits = panel(spark).withColumn("feature", F.lit(1.0)), B.plan_splits(spark.range(13).withColumnRenamed("id", "idx"), 2, 3, 2, 2)
    model = B.walk_forward_ols(rows, splits).orderBy("split").first()
    assert model.slope == 0 and not model.fitted
    late = B.guard_violations(panel(spark).withColumn("outcome_idx", F.col("idx") + 3), splits)
    assert {r.fault for r in late.collect()} == {"train_label_late"}
    assert B.guard_violations(panel(spark).withColumn("outcome_idx", F.col("idx") + 2), splits).count() == 0


def test_regimes(spark):
    d = dt.date
    regimes = spark.createDataFrame([("jan", d(2024, 1, 1), d(2024, 1, 31)), ("feb", d(2024, 2, 1), d(2024, 2, 29)), ("mar", d(2024, 3, 1), d(2024, 3, 31))], "name string, start_date date, end_date date")
    samples = spark.createDataFrame([(d(2024, 1, 5), 0.03), (d(2024, 1, 6), -0.01), (d(2024, 3, 1), 0.02)], "day date, v double")
    got = {r.name: r for r in B.regime_summary(samples, regimes, "day", "v").collect()}
    assert got["jan"].mean == pytest.approx(0.01) and got["jan"].sd == pytest.approx(0.0282842712) and got["jan"].hit_rate == 0.5
    assert got["feb"].sample_count == 0 and got["feb"].mean is None and got["mar"].sd is None
    outside = spark.createDataFrame([(d(2025, 1, 5), 0.03)], "day date, v double")
    with pytest.raises(Exception, match="no regime covers"):
        B.regime_summary(outside, regimes, "day", "v").collect()
    assert B.regime_faults(regimes).count() == 0


def test_scramble_keeps_labels_in_their_groups(spark):
    rows = [(f"{g}-{k}", g, float(k == 2), (k + 1) / 100) for g in ("a", "b") for k in range(3)]
    samples = spark.createDataFrame(rows, "sample_id string, group_key string, feature double, label double")
    everyone = B.scramble_trials(samples.withColumn("feature", F.lit(1.0)), 5, 31).collect()
    assert len(everyone) == 10 and all(r.m == pytest.approx(0.02) for r in everyone)
    drawn = {r.m for r in B.scramble_trials(samples, 40, 31).collect()}
    assert drawn == {0.01, 0.02, 0.03}
    p = B.scramble_p_value(samples, 12, 31).first()
    assert p == B.scramble_p_value(samples.orderBy(F.desc("sample_id")), 12, 31).first()
    assert p.observed == pytest.approx(0.03) and p.p_value == pytest.approx(p["rank"] / 13)
    flat = B.scramble_p_value(samples.withColumn("label", F.lit(0.0)), 9, 31).first()
    assert flat["rank"] == 10 and flat.p_value == 1.0


def test_regression_is_stable_around_a_large_mean(spark):
    rows = panel(spark).withColumn("feature", F.col("feature") + 1e8)
    models = B.walk_forward_ols(rows, B.plan_splits(spark.range(13).withColumnRenamed("id", "idx"), 2, 3, 2, 2)).collect()
    assert all(m.fitted and m.slope == pytest.approx(0.05, rel=1e-6) for m in models)


def test_evidence_and_verdicts(spark):
    def evidence(values, least):
        rows = spark.createDataFrame([(v,) for v in values], "difference double")
        r = R.walk_forward_evidence(rows, least, 0.6, []).first()
        return r.status, r.failure_reason

    assert evidence([0.01, 0.02, -0.01], 3) == ("passed", None)
    assert evidence([0.01, -0.02, -0.01], 3) == ("failed", "walk_forward_unstable")
    assert evidence([0.01], 2) == ("insufficient_data", "insufficient_walk_forward_windows")
    schema = "run_id int, status string, evaluation string, failure string, scramble_pass boolean, difference double"
    cases = [
        ((None, None, None, None, None, None), ("untested", "not_run")), ((1, "running", None, None, None, None), ("running", "running")),
        ((1, "odd", None, None, None, None), ("failed", "unsupported_status:odd")), ((1, "succeeded", None, None, False, 0.1), ("rejected", "label_scramble_failed")),
        ((1, "succeeded", None, None, True, None), ("rejected", "baseline_missing")), ((1, "succeeded", None, None, True, -0.1), ("rejected", "baseline_failed")),
        ((1, "succeeded", "accepted", None, True, 0.1), ("accepted", "passed")), ((1, "succeeded", "rejected", "own", True, 0.1), ("rejected", "own")), ((1, "succeeded", None, None, None, 0.1), ("promising", "passed")),
    ]
    for row, want in cases:
        got = R.derived_verdict(spark.createDataFrame([row], schema)).first()
        assert (got.verdict, got.reason) == want
