"""Queries of portfolios, calibration, snapshots and streams, with their DuckDB equivalents."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from chronopanel.operators import calibration as C
from chronopanel.operators import drawdown as DD
from chronopanel.operators import materialize as M
from chronopanel.operators import panel as P
from chronopanel.operators import portfolio as W
from chronopanel.operators import reports as R
from chronopanel.operators import runs
from chronopanel.plans.catalogue import PW, big, label_sql, panel_of, query, r8, weekly
from chronopanel.plans.extended import _PATHS, net_returns, ranked_controls, ranked_sql
from chronopanel.plans.registry import _exact_sql, fresh
from chronopanel.session import once, stage
from chronopanel.sources import landing, snapshots, vault
from chronopanel.sources import tables as S
from chronopanel.streaming import landing as SL
from chronopanel.streaming import outcomes as SO

# ---------------------------------------------------------------- portfolios

POSITION, SECTOR = 0.08, 0.25
#: Level at which a sum of slope * least(level, full) reaches a target, by trying every breakpoint.
_LEVEL = """{name} AS (SELECT {keys}, arg_min((target - held) / open, stop) AS level FROM (SELECT {of}, a.stop, any_value(a.target) AS target, coalesce(sum(b.slope * b.stop) FILTER (WHERE b.stop < a.stop), 0) AS held, sum(b.slope) FILTER (WHERE b.stop >= a.stop) AS open
  FROM (SELECT DISTINCT {keys}, stop, target FROM {rows}) a JOIN {rows} b ON {on} GROUP BY {of}, a.stop) WHERE held + stop * open >= target - 1e-15 GROUP BY {keys})"""


def _level_sql(name: str, rows: str, keys: str) -> str:
    return _LEVEL.format(name=name, rows=rows, keys=keys, of=", ".join(f"a.{k.strip()}" for k in keys.split(",")), on=" AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(",")))


_WEIGHTS = f"""{ranked_sql()}, sc AS (SELECT r.asof, r.security_id, CAST(n_regionkey AS BIGINT) AS sector, adv, adv / sum(adv) OVER (PARTITION BY r.asof) AS slope FROM rkd r JOIN nation ON n_nationkey = r.security_id WHERE adv > 0),
sl AS (SELECT asof, sector, security_id, slope, {POSITION} / slope AS stop, {SECTOR} AS target FROM sc), {_level_sql('sv', 'sl', 'asof, sector')},
al AS (SELECT sl.asof, security_id, sl.sector, slope, least(stop, coalesce(level, stop)) AS stop, 1.0 AS target FROM sl LEFT JOIN sv ON sv.asof = sl.asof AND sv.sector = sl.sector), {_level_sql('av', 'al', 'asof')},
wt AS (SELECT al.asof, security_id, sector, slope * least(stop, coalesce(level, stop)) AS weight FROM al LEFT JOIN av ON av.asof = al.asof)""".replace('asof', "asof")


def weights(spark, sf_dir):
    def make():
        sector = S.load(spark, sf_dir, "nation").select(big("n_nationkey").alias("security_id"), big("n_regionkey").alias("sector"))
        rows = ranked_controls(spark, sf_dir).select("asof", "security_id", "adv").join(sector, "security_id")
        return W.capped_weights(rows, "adv", position_cap=POSITION, sector_cap=SECTOR).join(rows.select("asof", "security_id", "adv"), ["asof", "security_id"])

    return once(spark, f"weights:{sf_dir}", make)


@query(f"{_WEIGHTS} SELECT asof, security_id, sector, round(weight, 8) AS weight FROM wt")
def portfolio_weights(spark, sf_dir):
    """Weights in proportion to a score under position and sector caps."""
    return weights(spark, sf_dir).select("asof", "security_id", "sector", r8("weight"))


@query(f"""{_WEIGHTS}, s AS (SELECT asof, sum(w) AS total, max(w) AS sector FROM (SELECT asof, sector, sum(weight) AS w FROM wt GROUP BY 1, 2) GROUP BY 1), p AS (SELECT asof, max(weight) AS most, sum(weight) FILTER (WHERE k <= 10) AS top FROM (SELECT *, row_number() OVER (PARTITION BY asof ORDER BY weight DESC) AS k FROM wt) GROUP BY 1)
SELECT fault, count(*) AS dates FROM (SELECT unnest([CASE WHEN most > {POSITION} + 1e-9 THEN 'position' END, CASE WHEN sector > {SECTOR} + 1e-9 THEN 'sector' END, CASE WHEN abs(total - 1) > 1e-9 THEN 'sum' END, CASE WHEN top > 0.5 + 1e-9 THEN 'top10' END]) AS fault FROM s JOIN p ON p.asof = s.asof) WHERE fault IS NOT NULL GROUP BY 1""")
def portfolio_faults(spark, sf_dir):
    """Dates on which caps can't be held, or a rule beyond the caps is broken."""
    return W.weight_faults(weights(spark, sf_dir), position_cap=POSITION, sector_cap=SECTOR, top10_cap=0.5).groupBy("fault").agg(F.count("*").alias("dates"))


_TRADED, _EXPECTED = 20_000.0, 0.02  # dollars for one of the table's, and a portfolio's expected return


@query(f"""{_WEIGHTS}, ps AS (SELECT wt.asof, weight AS w, r.adv * {_TRADED} AS adv FROM wt JOIN rkd r ON r.asof = wt.asof AND r.security_id = wt.security_id WHERE weight > 0),
tt AS (SELECT asof, min(0.05 * adv / w) AS liquidity, {_EXPECTED} * 0.2 * 10000 - sum(w * CASE WHEN adv > 100000000 THEN 5 WHEN adv > 10000000 THEN 15 ELSE 40 END) AS budget FROM ps GROUP BY 1),
im AS (SELECT ps.asof, w * 10 * sqrt(w / adv) AS slope, 50 / (10 * sqrt(w / adv)) AS stop, budget AS target FROM ps JOIN tt ON tt.asof = ps.asof WHERE budget > 0), {_level_sql('rt', 'im', 'asof')},
cp AS (SELECT tt.asof, liquidity, CASE WHEN budget <= 0 THEN 0 ELSE level * level END AS impact FROM tt LEFT JOIN rt ON rt.asof = tt.asof)
SELECT asof, round(liquidity, 2) AS liquidity, round(impact, 2) AS impact, round(least(liquidity, coalesce(impact, liquidity)), 2) AS capacity, CASE WHEN least(liquidity, coalesce(impact, liquidity)) < 1000000 THEN 'halted' WHEN least(liquidity, coalesce(impact, liquidity)) < 5000000 THEN 'degraded' ELSE 'normal' END AS mode FROM cp""")
def portfolio_capacity(spark, sf_dir):
    """The size that liquidity and costs allow on each date."""
    rows = weights(spark, sf_dir).select("asof", "weight", (F.col("adv") * _TRADED).alias("adv"), F.lit(_EXPECTED).alias("expected"))
    c = W.capacity(rows)
    return c.select("asof", *[F.round(x, 2).alias(x) for x in ("liquidity", "impact", "capacity")], W.capacity_mode(F.col("capacity")).alias("mode"))


@query(f"""{_PATHS}, ro AS (SELECT series, asof AS date, equity / last_value(equity) OVER (PARTITION BY series ORDER BY asof RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 30 DAYS PRECEDING) - 1 AS rolling FROM path),
st AS (SELECT *, coalesce(last_value(CASE WHEN rolling < -0.02 THEN true WHEN rolling >= -0.005 THEN false END IGNORE NULLS) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING), false) AS halted FROM ro)
SELECT series, date, round(rolling, 8) AS rolling, halted, CASE WHEN halted AND NOT coalesce(lag(halted) OVER (PARTITION BY series ORDER BY date), false) THEN 'drawdown_halt' WHEN NOT halted AND coalesce(lag(halted) OVER (PARTITION BY series ORDER BY date), false) THEN 'resumed' END AS event FROM st""")
def drawdown_halts(spark, sf_dir):
    """When losses over 30 days pause new entries, and when they go on."""
    found = W.halts(DD.equity(net_returns(spark, sf_dir)), 30, -0.02, -0.005)
    return found.select("series", "date", r8("rolling"), "halted", "event")


# ---------------------------------------------------------------- calibration and drift

_BINS = """e AS (SELECT user_id % 3 AS grp, value / 100 AS p, CASE WHEN (event_id * 7919) % 100 < value * 0.8 THEN 1.0 ELSE 0.0 END AS y FROM events WHERE value BETWEEN 0 AND 100),
b AS (SELECT grp, CAST(least(floor(p * 50), 49) AS INTEGER) AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM e GROUP BY 1, 2),
m AS (SELECT x.grp, x.bin AS a, z.bin AS z, sum(w.sy) / sum(w.n) AS mean FROM b x JOIN b z ON z.grp = x.grp AND z.bin >= x.bin JOIN b w ON w.grp = x.grp AND w.bin BETWEEN x.bin AND z.bin GROUP BY 1, 2, 3),
f AS (SELECT b.grp, b.bin, max(low) AS fitted FROM b JOIN (SELECT b.grp, b.bin AS at, a, min(mean) AS low FROM b JOIN m ON m.grp = b.grp AND m.a <= b.bin AND m.z >= b.bin GROUP BY 1, 2, 3) l ON l.grp = b.grp AND l.at = b.bin GROUP BY 1, 2)"""


def _fit(spark, sf_dir):
    e = S.load(spark, sf_dir, "events")
    y = F.when((F.col("event_id") * 7919) % 100 < F.col("value") * 0.8, 1.0).otherwise(0.0)
    rows = e.select((F.col("user_id") % 3).alias("grp"), (F.col("value") / 100).alias("p"), y.alias("y"))
    return C.isotonic(C.bins(rows, "p", "y", by=("grp",)), ("grp",))


@query(f"WITH {_BINS} SELECT b.grp, CAST(b.bin AS BIGINT) AS bin, n, round(sp / n, 8) AS mean_predicted, round(sy / n, 8) AS rate, round(fitted, 8) AS fitted FROM b JOIN f ON f.grp = b.grp AND f.bin = b.bin")
def calibration_curve(spark, sf_dir):
    """What came of predictions by bin, and the non-decreasing curve nearest to it."""
    return _fit(spark, sf_dir).select("grp", big("bin"), "n", r8("mean_predicted"), r8("rate"), r8("fitted"))


@query(f"WITH {_BINS} SELECT b.grp, CAST(sum(n) AS BIGINT) AS n, round(sum(abs(sp / n - fitted) * n) / sum(n), 8) AS error, round(max(abs(sp / n - fitted)), 8) AS worst FROM b JOIN f ON f.grp = b.grp AND f.bin = b.bin GROUP BY 1")
def calibration_errors(spark, sf_dir):
    return C.calibration_error(_fit(spark, sf_dir), ("grp",)).select("grp", "n", r8("error"), r8("worst"))


@query("""WITH e AS (SELECT event_type, value, ts >= TIMESTAMP '2024-01-16' AS late FROM events WHERE value IS NOT NULL), n AS (SELECT event_type, count(*) FILTER (WHERE NOT late) AS x, count(*) FILTER (WHERE late) AS y FROM e GROUP BY 1),
g AS (SELECT event_type, value, abs(sum(count(*) FILTER (WHERE NOT late)) OVER w / any_value(n.x) - sum(count(*) FILTER (WHERE late)) OVER w / any_value(n.y)) AS gap, any_value(n.x) AS x, any_value(n.y) AS y FROM e JOIN n USING (event_type) GROUP BY event_type, value WINDOW w AS (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING))
SELECT event_type, any_value(x) AS n_early, any_value(y) AS n_late, round(max(gap), 8) AS distance, min(value) FILTER (WHERE gap >= top - 1e-12) AS at FROM (SELECT *, max(gap) OVER (PARTITION BY event_type) AS top FROM g) GROUP BY 1""")
def drift_distance(spark, sf_dir):
    """How far apart values of the first and second half of the month are, by kind of event."""
    e = S.load(spark, sf_dir, "events")
    return C.two_sample_distance(e, "value", F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"), ["event_type"]).select("event_type", "n_early", "n_late", r8("distance"), "at")


# ---------------------------------------------------------------- snapshots

_SNAP = f"WITH {PW}, t AS (SELECT CAST(year(session) AS VARCHAR) AS part, session, '=' || security_id || '|=' || session || '|=' || {_exact_sql('price')} || '|=' || {_exact_sql('volume')} AS line FROM pw)"


def _frozen(spark, sf_dir):
    """A root with two snapshots of the panel under one name, the first without the last year; and the second's id."""
    rows = panel_of(spark, sf_dir).select("security_id", "session", "price", "volume", F.year("session").alias("year"))
    columns = [F.col("security_id"), F.col("session"), runs.exact(F.col("price")), runs.exact(F.col("volume"))]
    root = fresh(spark, "snapshots")
    last = rows.agg(F.max("year")).first()[0] or 0
    first, second = (snapshots.freeze(x, root, "year", columns) for x in (rows.where(F.col("year") < last), rows.repartition(5, "security_id")))
    for k, snapshot in enumerate((first, second)):
        snapshots.publish(spark, root, "panel", snapshot, k)
    return root, second


@query(f"{_SNAP} SELECT part, count(*) AS rows, CAST(sum(CAST(('0x' || substr(sha256(line), 1, 12)) AS BIGINT)) AS VARCHAR) AS digest FROM t GROUP BY 1")
def snapshot_manifest(spark, sf_dir):
    """The parts of a frozen table and their digests."""
    root, snapshot = _frozen(spark, sf_dir)
    return snapshots.manifest(spark, root, snapshot)


@query(f"{_SNAP} SELECT CAST(1 AS BIGINT) AS version, count(*) FILTER (WHERE part < (SELECT max(part) FROM t)) AS rows, max(session) FILTER (WHERE part < (SELECT max(part) FROM t)) AS newest FROM t UNION ALL SELECT 2, count(*), max(session) FROM t")
def snapshot_versions(spark, sf_dir):
    """What readers of a name see at each of its versions."""
    root, _ = _frozen(spark, sf_dir)
    parts = [snapshots.read(spark, root, "panel", k).agg(F.lit(k).cast("bigint").alias("version"), F.count("*").alias("rows"), F.max("session").alias("newest")) for k in (1, 2)]
    return parts[0].union(parts[1])


# ---------------------------------------------------------------- streams


@query("""WITH r AS (SELECT event_type AS endpoint, '{"user":' || user_id || '}' AS params, event_id, props || '#' || (event_id % 50) AS body, ts >= TIMESTAMP '2024-01-16' AS late FROM events),
k AS (SELECT endpoint, params, late, arg_max(body, event_id) AS body FROM r GROUP BY 1, 2, 3) SELECT endpoint, params, sha256(arg_max(body, late)) AS raw_hash FROM k GROUP BY 1, 2""")
def stream_landing(spark, sf_dir):
    """Payloads that land in two steps, taken in by a stream, and the newest of each request at the end."""
    e, folder, root = S.load(spark, sf_dir, "events"), fresh(spark, "landing"), fresh(spark, "taken")
    body = F.concat("props", F.lit("#"), (F.col("event_id") % 50).cast("string"))
    r = e.select(F.lit("events").alias("source"), F.col("event_type").alias("endpoint"), F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit("}")).alias("params"), "event_id", body.alias("body"), (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("late"))
    newest = stage(r.groupBy("source", "endpoint", "params", "late").agg(F.max_by("body", "event_id").alias("body")).withColumn("status", F.lit(200)), "payloads")
    for late in (False, True):
        landing.land(newest.where(F.col("late") == late), f"{folder}/{int(late)}")
        SL.land_stream(SL.read_landed(spark, f"{folder}/*"), root).awaitTermination()
    return SL.current(spark, root).select("endpoint", "params", "raw_hash")


@query(f"""{ranked_sql()}, o AS (SELECT k_adv * 0.02 - 0.01 AS predicted, ret AS realized FROM rkd WHERE horizon_session > asof + 1)
SELECT CAST(5 AS BIGINT) AS horizon, count(*) AS scored, round(avg(predicted - realized), 8) AS mean_error, round(avg(abs(predicted - realized)), 8) AS mean_abs_error, round(avg(CASE WHEN sign(predicted) = sign(realized) THEN 1.0 ELSE 0.0 END), 8) AS hit_rate FROM o HAVING count(*) > 0""")
def stream_outcomes(spark, sf_dir):
    """Predictions scored by a stream-stream join as their labels become known, in two steps; equal to the batch join."""
    rows = ranked_controls(spark, sf_dir)
    number = F.xxhash64("security_id", "asof")
    p = rows.select(number.alias("prediction_id"), "security_id", "asof", F.lit(5).cast("bigint").alias("horizon"), (F.col("k_adv") * 0.02 - 0.01).alias("predicted"), F.date_add("asof", 1).cast("timestamp").alias("predicted_at"), "idx")
    y = rows.select("security_id", "asof", F.lit(5).cast("bigint").alias("horizon"), F.col("ret").alias("realized"), F.col("horizon_session").cast("timestamp").alias("known_at"), "idx")
    root = fresh(spark, "outcomes")
    middle = rows.agg(F.expr("percentile(idx, 0.5)")).first()[0] or 0
    for step, test in enumerate((F.col("idx") <= middle, F.col("idx") > middle)):
        for name, table in (("predictions", p), ("labels", y)):
            table.where(test).drop("idx").write.mode("append").parquet(f"{root}/{name}")
        found = SO.scored(SO.read_stream(spark, f"{root}/predictions", SO.PREDICTIONS, 10_000), SO.read_stream(spark, f"{root}/labels", SO.LABELS, 10_000))
        SO.run_available(found, f"{root}/scored", f"{root}/progress")
    schema = "prediction_id long, security_id long, asof date, horizon long, predicted double, realized double, error double, scored_at timestamp"
    found = SO.summary(spark.read.schema(schema).parquet(f"{root}/scored"))
    return found.select("horizon", "scored", r8("mean_error"), r8("mean_abs_error"), r8("hit_rate"))


# ---------------------------------------------------------------- materialized labels with lineage, and what registries say


@query(f"""WITH {PW}, {label_sql(5)}, l AS (SELECT year(session) AS y, skip_reason, end_price / price - 1 AS r FROM lab WHERE session <= DATE '1998-12-31')
SELECT CAST(y AS BIGINT) AS year, coalesce(skip_reason, 'ok') AS outcome, count(*) AS rows, round(avg(r) FILTER (WHERE skip_reason IS NULL), 8) AS mean_return, CAST(1 AS BIGINT) AS version, 'failed' AS later FROM l GROUP BY 1, 2""")
def label_materialization(spark, sf_dir):
    """Labels up to a cutoff as a published table; a second run that fails leaves it and says so."""
    root = fresh(spark, "labels")
    rows = P.forward_labels(weekly(spark, sf_dir), (5,)).where("session <= date'1998-12-31'").select("security_id", "session", "horizon", "raw_return", "skip_reason", F.year("session").alias("year"))
    columns = [F.col("security_id"), F.col("session"), F.col("skip_reason"), runs.exact(F.coalesce("raw_return", F.lit(0.0)))]
    M.materialize(spark, root, "labels", "label", {"cutoff": "1998-12-31", "api_key": "hush"}, lambda: rows, "year", columns)
    broken = rows.withColumn("raw_return", F.when(F.col("security_id") >= 0, F.raise_error(F.lit("no prices")).cast("double")))
    with contextlib.suppress(Exception):
        M.materialize(spark, root, "labels", "label", {"cutoff": "1999-12-31"}, lambda: broken, "year", columns)
    later = M.lineage(spark, root).where("version is null").agg(F.max("status").alias("later"))  # one row
    table = snapshots.read(spark, root, "labels").join(F.broadcast(later), F.lit(True))
    ok = F.avg(F.when(F.col("skip_reason").isNull(), F.col("raw_return")))
    return table.groupBy(big("year"), F.coalesce("skip_reason", F.lit("ok")).alias("outcome"), "later").agg(F.count("*").alias("rows"), F.round(ok, 8).alias("mean_return")).withColumn("version", F.lit(snapshots.version(spark, root, "labels")).cast("bigint"))


@query(f"""WITH {PW}, {label_sql(21)}, bench AS (SELECT session, CASE WHEN idx % 7 = 3 THEN 0 ELSE price END AS b FROM spine WHERE security_id = 1 AND idx % 3 <> 0)
SELECT CASE WHEN x.b IS NULL THEN 'missing_asof_price' WHEN y.b IS NULL THEN 'missing_target_price' WHEN x.b <= 0 OR y.b <= 0 THEN 'unavailable_return' ELSE 'covered' END AS status, count(*) AS labels
FROM lab l LEFT JOIN bench x ON x.session = l.session LEFT JOIN bench y ON y.session = l.horizon_session WHERE skip_reason IS NULL GROUP BY 1""")
def benchmark_coverage(spark, sf_dir):
    """Why labels have a benchmark's return or not."""
    grid = weekly(spark, sf_dir)
    b = grid.where("security_id = 1 and idx % 3 <> 0").select("session", F.when(F.col("idx") % 7 == 3, 0.0).otherwise(F.col("price")).alias("b"))
    labels = P.forward_labels(grid, (21,)).where("skip_reason is null").select("session", "horizon_session")
    rows = labels.join(b, "session", "left").join(b.select(F.col("session").alias("horizon_session"), F.col("b").alias("e")), "horizon_session", "left")
    return rows.groupBy(P.coverage_status(F.col("b"), F.col("e")).alias("status")).agg(F.count("*").alias("labels"))


@query("""SELECT p_partkey, sha256('{"computation_spec":{"brand":"' || p_brand || '","size":' || p_size || '},"kind":"numeric","name":"' || p_name || '","version":' || (1 + p_partkey % 3) || '}') AS definition_hash FROM part""")
def definition_hashes(spark, sf_dir):
    """The hash of definitions as canonical JSON, computed in columns."""
    p = S.load(spark, sf_dir, "part")
    spec = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return p.select("p_partkey", P.definition_hash_column(F.col("p_name"), F.col("p_partkey") % 3 + 1, F.lit("numeric"), spec).alias("definition_hash"))


@query("""WITH e AS (SELECT o_custkey AS k, o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS day, o_totalprice AS score, o_orderpriority AS evaluation FROM orders),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day DESC, run DESC) AS n FROM e WHERE status = 'succeeded') WHERE n = 1), a AS (SELECT k, count(*) AS runs, count(*) FILTER (WHERE status = 'succeeded') AS succeeded FROM e GROUP BY 1)
SELECT c_custkey AS hypothesis, run, round(score, 2) AS score, coalesce(evaluation, 'not_evaluated') AS evaluation, coalesce(runs, 0) AS runs, coalesce(succeeded, 0) AS succeeded FROM customer LEFT JOIN l ON l.k = c_custkey LEFT JOIN a ON a.k = c_custkey""")
def research_results(spark, sf_dir):
    """Every hypothesis with the evaluation of its newest run that succeeded, and how many runs it has had."""
    o = S.load(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    e = o.select(F.col("o_custkey").alias("hypothesis"), F.col("o_orderkey").alias("run"), status.alias("status"), F.col("o_orderdate").alias("at"), F.round("o_totalprice", 2).alias("score"), F.col("o_orderpriority").alias("evaluation"))
    known = S.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hypothesis"))
    return R.research_results(known, e).select("hypothesis", "run", "score", "evaluation", "runs", "succeeded")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT date, CASE WHEN day(date) = 1 THEN NOT (isodow(date) < 6) ELSE isodow(date) < 6 END AS s FROM d WHERE month(date) <> 12), b AS (SELECT date, isodow(date) < 6 AS s FROM d WHERE month(date) >= 3)
SELECT count(*) FILTER (WHERE a.date IS NULL) AS inserted, count(*) FILTER (WHERE a.date IS NOT NULL AND b.date IS NOT NULL AND a.s <> b.s) AS updated, count(*) FILTER (WHERE a.date IS NOT NULL AND (b.date IS NULL OR a.s = b.s)) AS kept FROM a FULL JOIN b ON a.date = b.date""")
def sink_calendar(spark, sf_dir):
    """A calendar that is upserted by date."""
    d = S.load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    open_, none = F.weekday("date") < 5, F.lit(None).cast("timestamp")
    rows = lambda test, s: d.where(test).select("date", s.alias("is_session"), none.alias("session_close"), F.lit(False).alias("is_early_close"))
    old = rows(F.month("date") != 12, F.when(F.day("date") == 1, ~open_).otherwise(open_))
    return vault.write_counts(vault.upsert(old, rows(F.month("date") >= 3, open_), "calendar"))
