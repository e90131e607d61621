"""Portfolios, calibration, snapshots and streams against plain versions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from chronopanel.operators import calibration, materialize, portfolio
from chronopanel.plans.registry import fresh
from chronopanel.session import stage
from chronopanel.sources import landing, snapshots
from chronopanel.streaming import landing as stream
from chronopanel.streaming import outcomes


def redistributed(scores, sectors, cap, sector_cap):
    """Weights by rounds: what is over a cap is handed to all that aren't full, in proportion to their scores."""
    w, full = {i: 0.0 for i in scores}, set()
    left = 1.0
    for _ in range(20_000):
        free = [i for i in scores if i not in full]
        if left < 1e-13 or not free:
            break
        total, spent = sum(scores[i] for i in free), 0.0
        step = min(left, 0.002)  # in small steps, so members and sectors fill up one after another
        for i in free:
            w[i] += step * scores[i] / total
        for i in free:
            if w[i] > cap:
                spent += w[i] - cap
                w[i] = cap
                full.add(i)
        for k in set(sectors.values()):
            own = [i for i in scores if sectors[i] == k]
            if (over := sum(w[i] for i in own) - sector_cap) >= -1e-15:
                open_ = [i for i in own if i not in full]
                part = sum(scores[i] for i in open_)
                for i in open_:
                    w[i] -= max(over, 0) * scores[i] / part
                spent += max(over, 0) if open_ else 0
                full.update(own)
        left += spent - step
    return w


@pytest.mark.parametrize(("n", "cap", "sector_cap"), [(12, 0.15, 0.4), (30, 0.05, 0.3), (5, 0.1, 0.3), (8, 1.0, 1.0)])
def test_weights_are_those_of_repeated_redistribution(spark, n, cap, sector_cap):
    r = random.Random(n)
    dates = {}
    for d in range(6):
        dates[d] = ({i: r.choice([1.0, 2.0, r.random() * 5]) for i in range(n)}, {i: r.randrange(4) for i in range(n)})
    rows = [(d, i, k[i], s[i]) for d, (s, k) in dates.items() for i in s] + [(0, 100, 0, 0.0), (0, 101, 0, None), (1, 102, 0, -1.0)]
    df = spark.createDataFrame(rows, "asof int, security_id long, sector int, score double")
    got = portfolio.capped_weights(df, "score", position_cap=cap, sector_cap=sector_cap)
    weights = {(x["asof"], x["security_id"]): x["weight"] for x in got.collect()}
    assert len(weights) == 6 * n
    for d, (s, k) in dates.items():
        want = redistributed(s, k, cap, sector_cap)
        assert all(weights[d, i] == pytest.approx(want[i], abs=2e-3) for i in s)
        room = sum(min(sector_cap, cap * list(k.values()).count(j)) for j in set(k.values()))
        assert sum(weights[d, i] for i in s) == pytest.approx(min(1.0, room)) and max(weights[d, i] for i in s) <= cap + 1e-12
        assert all(sum(weights[d, i] for i in s if k[i] == j) <= sector_cap + 1e-12 for j in range(4))
    faults = {(x["asof"], x["fault"]) for x in portfolio.weight_faults(got, position_cap=cap / 2, sector_cap=sector_cap).collect()}
    assert {d for d, fault in faults if fault == "position"} == {d for (d, _), w in weights.items() if w > cap / 2 + 1e-9}


def test_halts_row_by_row(spark):
    r = random.Random(3)
    rows, e = [], 1.0
    for k in range(200):
        e *= 1 + r.gauss(0, 0.02)
        rows.append(("a", dt.date(2024, 1, 1) + dt.timedelta(k * 2), e))
    got = {x["date"]: x for x in portfolio.halts(spark.createDataFrame(rows, "series string, date date, equity double")).collect()}
    halted, events = False, 0
    for _, day, e in rows:
        past = [x for _, d, x in rows if (day - d).days >= 30]
        rolling = e / past[-1] - 1 if past else None
        before, halted = halted, (True if rolling is not None and rolling < -0.1 else False if rolling is not None and rolling >= -0.05 else halted)
        want = "drawdown_halt" if halted and not before else "resumed" if before and not halted else None
        events += want is not None
        assert (got[day]["halted"], got[day]["event"]) == (halted, want) and (rolling is None or got[day]["rolling"] == pytest.approx(rolling))
    assert events >= 2


def test_capacity_is_the_largest_size_that_keeps_to_the_limits(spark):
    r = random.Random(5)
    dates = {d: ([(r.random(), 10 ** r.uniform(5, 9)) for _ in range(r.randrange(1, 9))], [0.02, 0.002, 0.2, -0.01][d % 4]) for d in range(12)}
    rows = [(d, w / sum(x for x, _ in p), adv, e) for d, (p, e) in dates.items() for w, adv in p] + [(0, 0.0, 1.0, 0.02)]
    for x in portfolio.capacity(spark.createDataFrame(rows, "asof int, weight double, adv double, expected double")).collect():
        own, e = [(w, a) for d, w, a, _ in rows if d == x["asof"] and w > 0], dates[x["asof"]][1]
        spread = sum(w * (5 if a > 1e8 else 15 if a > 1e7 else 40) for w, a in own)
        cost = lambda size: spread + sum(w * min(50, 10 * math.sqrt(w * size / a)) for w, a in own)
        assert x["liquidity"] == pytest.approx(min(0.05 * a / w for w, a in own))
        if x["impact"] is None:
            assert cost(1e30) <= e * 0.2 * 1e4 + 1e-9
        elif x["impact"] == 0:
            assert cost(0) >= e * 0.2 * 1e4
        else:
            assert cost(x["impact"]) == pytest.approx(e * 0.2 * 1e4) and cost(x["impact"] * 1.01) > cost(x["impact"])
        assert x["capacity"] == pytest.approx(min(x["liquidity"], x["liquidity"] if x["impact"] is None else x["impact"]))


def pooled(bins):
    """Pool adjacent violators."""
    blocks = []
    for n, y in bins:
        blocks.append([n, y, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            n1, y1, c1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n1, blocks[-1][1] + y1, blocks[-1][2] + c1]
    return [y / n for n, y, c in blocks for _ in range(c)]


def test_calibration_is_what_pooling_gives(spark):
    r = random.Random(6)
    rows = [(g, p, float(r.random() < p**g)) for g in (1, 2) for p in (r.random() for _ in range(500))] + [(1, 1.0, 1.0), (1, 0.0, 0.0), (1, 1.5, 1.0), (1, None, 1.0), (1, 0.5, None)]
    df = spark.createDataFrame(rows, "g int, p double, y double")
    table = calibration.bins(df, "p", "y", 20, ("g",))
    parts = [calibration.bins(df.where(F.col("p") < 0.4), "p", "y", 20, ("g",)), calibration.bins(df.where(F.col("p") >= 0.4), "p", "y", 20, ("g",))]
    both = parts[0].union(parts[1]).groupBy("g", "bin").agg(F.sum("n").alias("n"), F.sum("predicted").alias("predicted"), F.sum("outcome").alias("outcome"))
    for source in (table, both):
        fit = sorted(calibration.isotonic(source, ("g",)).collect(), key=lambda x: (x["g"], x["bin"]))
        for g in (1, 2):
            own = [x for x in fit if x["g"] == g]
            want = pooled([(x["n"], x["rate"] * x["n"]) for x in own])
            assert [x["fitted"] for x in own] == [pytest.approx(w) for w in want]
    assert sum(x["n"] for x in table.collect()) == 1002


@pytest.mark.parametrize("parts", [1, 5])
def test_distance_of_two_samples(spark, parts):
    r = random.Random(7)
    rows = [(g, float(r.randrange(40) + 3 * late * g), bool(late)) for g in (0, 1) for late in (0, 1) for _ in range(300)] + [(2, 1.0, True), (0, None, True)]
    got = {x["g"]: x for x in calibration.two_sample_distance(spark.createDataFrame(rows, "g int, v double, late boolean").repartition(parts), "v", F.col("late"), ["g"]).collect()}
    for g in (0, 1):
        a, b = ([v for h, v, late in rows if h == g and v is not None and late == side] for side in (False, True))
        gaps = {v: abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b}}
        assert got[g]["distance"] == pytest.approx(max(gaps.values())) and (got[g]["n_early"], got[g]["n_late"]) == (len(a), len(b))
        assert gaps[got[g]["at"]] == pytest.approx(max(gaps.values()))
    assert got[2]["distance"] is None


def test_snapshots_are_told_by_content_and_published_once(spark):
    root = fresh(spark, "snapshots")
    a = spark.createDataFrame([(k % 3, k, f"v{k}" if k else None) for k in range(30)], "part int, k long, v string")
    first = snapshots.freeze(a, root, "part")
    assert snapshots.freeze(a.repartition(7).select("part", "k", "v"), root, "part") == first
    second = snapshots.freeze(a.withColumn("v", F.when(F.col("k") == 7, "other").otherwise(F.col("v"))), root, "part")
    assert second != first and [x["rows"] for x in snapshots.manifest(spark, root, first).collect()] == [10, 10, 10]
    assert snapshots.version(spark, root, "n") == 0 and snapshots.publish(spark, root, "n", first, 0) == 1
    seen = snapshots.read(spark, root, "n")
    assert snapshots.publish(spark, root, "n", second, 1) == 2
    for over in (0, 1, 5):
        with pytest.raises(snapshots.Conflict):
            snapshots.publish(spark, root, "n", first, over)
    assert not snapshots._create(spark, f"{root}/names/n/000000000002", {})  # a writer that saw version 1 and comes too late
    assert seen.where("v = 'other'").count() == 0 and snapshots.read(spark, root, "n").where("v = 'other'").count() == 1
    assert snapshots.read(spark, root, "n", 1).where("v = 'other'").count() == 0
    with pytest.raises(Exception):
        snapshots.publish(spark, root, "n", "snapshot-none", 2)


def payloads(spark, rows):
    return spark.createDataFrame([("v", "e", f'{{"k":{k}}}', status, body) for k, status, body in rows], "source string, endpoint string, params string, status int, body string")


def test_a_batch_that_is_repeated_changes_nothing(spark):
    root = fresh(spark, "landing")
    landing.land(payloads(spark, [(1, 200, "a"), (1, 200, "a"), (2, 200, "b"), (3, 500, "no")]), f"{root}/in/1")
    run = lambda: stream.land_stream(stream.read_landed(spark, f"{root}/in/*"), f"{root}/out").awaitTermination()
    run()
    rows = lambda: sorted(tuple(x) for x in stream.vault(spark, f"{root}/out").select("params", "body", "batch").collect())
    once = rows()
    assert len(once) == 3
    run()
    assert rows() == once
    landing.land(payloads(spark, [(1, 200, "a"), (2, 200, "newer"), (4, 200, "d")]), f"{root}/in/2")
    run()
    after = rows()
    assert len(after) == 5 and once == [x for x in after if x[2] == 0]
    stream.take(f"{root}/out")(payloads(spark, [(1, 200, "a"), (2, 200, "newer"), (4, 200, "d")]), 1)
    assert rows() == after
    now = {x["params"]: x["body"] for x in stream.current(spark, f"{root}/out").collect()}
    assert now == {'{"k":1}': "a", '{"k":2}': "newer", '{"k":4}': "d"}


def test_streamed_outcomes_equal_the_batch_join(spark):
    root = fresh(spark, "outcomes")
    day = dt.datetime(2024, 1, 1)
    predictions = [(k, k % 5, (day + dt.timedelta(k)).date(), 5, 0.1 * (k % 3), day + dt.timedelta(k)) for k in range(60)]
    labels = [(k % 5, (day + dt.timedelta(k)).date(), 5, 0.1, day + dt.timedelta(k + (5 if k % 7 else -1 if k % 2 else 500))) for k in range(60) if k % 11]
    for a, b in ((0, 30), (30, 60)):
        spark.createDataFrame(predictions[a:b], outcomes.PREDICTIONS).coalesce(1).write.mode("append").parquet(f"{root}/p")
        spark.createDataFrame([x for x in labels if day.date() + dt.timedelta(a) <= x[1] < day.date() + dt.timedelta(b)], outcomes.LABELS).coalesce(1).write.mode("append").parquet(f"{root}/y")
        found = outcomes.scored(outcomes.read_stream(spark, f"{root}/p", outcomes.PREDICTIONS, 100), outcomes.read_stream(spark, f"{root}/y", outcomes.LABELS, 100), late="900 days")
        outcomes.run_available(found, f"{root}/scored", f"{root}/progress")
    batch = outcomes.scored(spark.createDataFrame(predictions, outcomes.PREDICTIONS), spark.createDataFrame(labels, outcomes.LABELS))
    key = lambda df: sorted(tuple(x) for x in df.select("prediction_id", "predicted", "realized", "error", "scored_at").collect())
    assert key(spark.read.parquet(f"{root}/scored")) == key(stage(batch, "batch")) and 30 < batch.count() < 60


def test_a_run_that_fails_leaves_what_was_published(spark):
    root = fresh(spark, "materialize")
    good = spark.range(6).select((F.col("id") % 2).alias("part"), "id")
    key, number = materialize.materialize(spark, root, "t", "label", {"cutoff": "x", "token": "hush"}, lambda: good, "part")
    with pytest.raises(Exception, match="broken"):
        materialize.materialize(spark, root, "t", "label", {"cutoff": "y"}, lambda: good.withColumn("id", F.raise_error(F.lit("broken")).cast("long")), "part")
    with pytest.raises(ValueError, match="no input"):
        materialize.materialize(spark, root, "t", "label", {"cutoff": "y"}, lambda: (_ for _ in ()).throw(ValueError("no input")), "part")
    rows = {r["key"]: r for r in materialize.lineage(spark, root).collect()}
    assert number == 1 and snapshots.read(spark, root, "t").count() == 6 and len(rows) == 3
    assert rows[key]["status"] == "succeeded" and "hush" not in rows[key]["parameters"] and sorted(r["status"] for r in rows.values()) == ["failed", "failed", "succeeded"]
    with pytest.raises(ValueError, match="is over"):
        materialize.finish_run(spark, root, key, "failed")
    left = materialize.create_run(spark, root, "label", {})
    assert {r["key"]: r["status"] for r in materialize.lineage(spark, root).collect()}[left] == "running"
