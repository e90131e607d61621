"""Quarterly features at as-of instants from a stream of what became known, with revisions that take their old values out.

Each metric row is an event at the instant it became available.  A feature's cell is what it says of one quarter, and the
events that bear on a cell make a short stream of its own: its own metrics, those of the quarter a year before, or those of
eight quarters, each sent to the cells that need it by an equi-join.  Windows over these streams give what each cell says
after each event.  A security's cell changes are then one stream in which a cell's old state is taken out and the new one put
in, and the newest cell that has a value is the top of a heap.  So the work is that of the events, not of instants times
quarters; all features are one plan, and as-of rows take the last state before them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Ratios of a quarter, (numerator, denominator); growth on the quarter a year before.
MARGINS = {"gross_margin": ("gross_profit", "revenue"), "operating_margin": ("operating_income", "revenue"), "net_margin": ("net_income", "revenue")}
GROWTH = {"revenue_growth_yoy": "revenue", "diluted_shares_change_yoy": "diluted_weighted_average_shares"}
#: Features of four quarters against the four before: growth of a sum, or the change of a ratio of sums.
TRAILING = {"revenue_growth_ttm": ("revenue", None), "gross_margin_change_ttm": ("gross_profit", "revenue")}
FEATURES = (*MARGINS, *GROWTH, *TRAILING)
CELL = ["security_id", "period_end", "fiscal_year", "fiscal_period"]
STATES = "security_id long, feature string, ts timestamp, fiscal_year long, fiscal_period string, value double, known timestamp, status string"


def events(metrics: DataFrame) -> DataFrame:
    """(CELL, metric_name, ts, value): one a metric, period and instant, the larger of equal ones; rows without a value are none."""
    keyed = metrics.where("metric_value is not null").withColumns({"fiscal_year": F.col("fiscal_year").cast("long"), "security_id": F.col("security_id").cast("long")})
    return keyed.groupBy(*CELL, "metric_name", F.col("available_at").alias("ts")).agg(F.max("metric_value").alias("value"))


def quarter_states(found: DataFrame, metric: str) -> DataFrame:
    """(security_id, fiscal_year, fiscal_period, ts, state): the metric of the newest visible period of a quarter, after each event.

    state: period_end, at and value; the newest period counts even if it lacks the metric, so then its value is null."""
    own = F.col("metric_name") == metric
    seen = F.struct("period_end", F.when(own, F.col("ts")).alias("at"), F.when(own, F.col("value")).alias("value"))
    rows = found.groupBy("security_id", "fiscal_year", "fiscal_period", "ts").agg(F.max(seen).alias("seen"))
    by_time = Window.partitionBy("security_id", "fiscal_year", "fiscal_period").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("state", F.max("seen").over(by_time)).drop("seen")


def after_each(parts: DataFrame, slots: list[str]) -> DataFrame:
    """(CELL, ts, slots...): what each slot held after each instant; parts: CELL, ts, slot, state (period_end, at, value)."""
    rows = parts.groupBy(*CELL, "ts").agg(*[F.max(F.when(F.col("slot") == s, F.col("state"))).alias(s) for s in slots])
    by_time = Window.partitionBy(*CELL).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*CELL, "ts", *[F.last(s, ignorenulls=True).over(by_time).alias(s) for s in slots])


def own_parts(found: DataFrame, metric: str, slot: str) -> DataFrame:
    state = F.struct("period_end", F.col("ts").alias("at"), "value")
    return found.where(F.col("metric_name") == metric).select(*CELL, "ts", F.lit(slot).alias("slot"), state.alias("state"))


def sent_parts(found: DataFrame, metric: str, backs: list[tuple[int, str]]) -> DataFrame:
    """The metric's quarter states at the cells that are so many quarters later, each in its slot; cells are of Q1 to Q4."""
    index = F.col("fiscal_year") * 4 + F.substring("fiscal_period", 2, 1).cast("long") - 1
    of_quarter = F.col("fiscal_period").rlike("^Q[1-4]$")
    slots = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("back"), F.lit(s).alias("slot")) for k, s in backs])).alias("s")
    sent = quarter_states(found.where(of_quarter), metric).select("security_id", index.alias("index"), "ts", "state", slots)
    cells = found.where(of_quarter).select(*CELL).distinct().withColumn("index", index)
    moved = sent.select("security_id", (F.col("index") + F.col("s.back")).alias("index"), "ts", "state", "s.slot")
    return moved.join(cells, ["security_id", "index"]).select(*CELL, "ts", "slot", "state")


def _ratio(top: Column, base: Column, less: float) -> tuple[Column, Column]:
    return F.when(base == 0, "zero").otherwise("ok"), F.try_divide(top, base) - less


def cells(found: DataFrame, name: str) -> DataFrame:
    """(security_id, feature, ts, period_end, fiscal_year, fiscal_period, kind, value, known): what each cell says after each event.

    kind: ok, zero for a denominator of zero, no_prior where the quarters before are missing, none."""
    has = lambda s: F.col(f"{s}.value").isNotNull()
    if name in MARGINS:
        top, base = MARGINS[name]
        rows = after_each(own_parts(found, top, "a").union(own_parts(found, base, "b")), ["a", "b"])
        kind, value = _ratio(F.col("a.value"), F.col("b.value"), 0.0)
        return _cell(rows, name, F.when(has("a") & has("b"), kind).otherwise("none"), value, ["a", "b"])
    if name in GROWTH:
        prior = quarter_states(found, GROWTH[name]).withColumn("fiscal_year", F.col("fiscal_year") + 1)
        sent = prior.join(found.select(*CELL).distinct(), ["security_id", "fiscal_year", "fiscal_period"]).select(*CELL, "ts", F.lit("b").alias("slot"), "state")
        rows = after_each(own_parts(found, GROWTH[name], "a").union(sent), ["a", "b"])
        kind, value = _ratio(F.col("a.value"), F.col("b.value"), 1.0)
        return _cell(rows, name, F.when(~has("a"), "none").when(~has("b"), "no_prior").otherwise(kind), value, ["a", "b"])
    metric, under = TRAILING[name]
    slots = {m: [f"{tag}{k}" for k in range(8)] for tag, m in (("a", metric), ("b", under)) if m}
    parts = None
    for m, names in slots.items():
        part = sent_parts(found, m, list(enumerate(names)))
        parts = part if parts is None else parts.union(part)
    rows = after_each(parts, [s for names in slots.values() for s in names])
    whole = lambda names: F.forall(F.array(*[has(s) for s in names]), lambda x: F.coalesce(x, F.lit(False)))

    def total(names: list[str]) -> Column:
        out = F.col(f"{names[0]}.value")
        for s in names[1:]:
            out = out + F.col(f"{s}.value")
        return out

    now, before = ([s for names in slots.values() for s in names[a : a + 4]] for a in (0, 4))
    a, b = slots[metric], slots.get(under)
    if under is None:
        kind, value = _ratio(total(a[:4]), total(a[4:]), 1.0)
    else:
        kind = F.when((total(b[:4]) == 0) | (total(b[4:]) == 0), "zero").otherwise("ok")
        value = F.try_divide(total(a[:4]), total(b[:4])) - F.try_divide(total(a[4:]), total(b[4:]))
    return _cell(rows, name, F.when(~whole(now), "none").when(~whole(before), "no_prior").otherwise(kind), value, [*now, *before])


def _cell(rows: DataFrame, name: str, kind: Column, value: Column, slots: list[str]) -> DataFrame:
    known = F.greatest(*[F.col(f"{s}.at") for s in slots])
    told = rows.select("security_id", F.lit(name).alias("feature"), "ts", "period_end", "fiscal_year", "fiscal_period", kind.alias("kind"), value.alias("value"), known.alias("known"))
    ok = F.col("kind") == "ok"
    return told.withColumns({"value": F.when(ok, F.col("value")), "known": F.when(ok, F.col("known"))})


def newest_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """STATES from cell changes in the order of security, feature and instant: after each instant, the newest cell that is ok.

    A cell's old state is taken out of the counts and the new one put in; a period that was taken out leaves the heap when it
    comes up.  Nothing but one security's cells of one feature is held."""
    key, at, cell_of, counts, heap, last, out = None, None, {}, {}, [], None, []
    reasons = (("zero", "zero_denominator"), ("no_prior", "missing_prior_year_metric"))

    def tell() -> None:
        nonlocal last
        while heap and cell_of[heap[0][-1]][0] != "ok":
            heapq.heappop(heap)
        if heap:
            period = heap[0][-1]
            now = (period[1], period[2], *cell_of[period][1:], "ok")
        else:
            now = (None, None, None, None, next((status for kind, status in reasons if counts.get(kind)), "missing_current_metric"))
        if now != last:
            out.append((*key, at, *now))
            last = now

    for batch in batches:
        for security, feature, ts, end, year, quarter, kind, value, known in batch.itertuples(index=False, name=None):
            if (security, feature) != key or ts != at:
                if key is not None:
                    tell()
                if (security, feature) != key:
                    cell_of, counts, heap, last = {}, {}, [], None
                key, at = (security, feature), ts
            if kind == "first":
                continue
            period = (end, year, quarter)
            if period in cell_of:
                counts[cell_of[period][0]] -= 1
            counts[kind] = counts.get(kind, 0) + 1
            cell_of[period] = (kind, value, known)
            if kind == "ok":
                heapq.heappush(heap, (-end.toordinal(), -year, [-ord(c) for c in quarter], period))
        if out:
            yield _frame(out)
            out.clear()
    if key is not None:
        tell()
    if out:
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STATES.split(", ")]).astype({"fiscal_year": "Int64", "value": "Float64"})


def states(metrics: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """STATES: each feature of each security whenever it changes, from the security's first metric on.

    metrics: security_id, fiscal_year, fiscal_period, period_end, metric_name, metric_value, available_at."""
    found = events(metrics)
    first = found.groupBy("security_id").agg(F.min("ts").alias("ts")).withColumn("feature", F.explode(F.array(*[F.lit(n) for n in names])))
    changes = first.withColumn("kind", F.lit("first"))
    for name in names:
        changes = changes.unionByName(cells(found, name), allowMissingColumns=True)
    columns = ["security_id", "feature", "ts", "period_end", "fiscal_year", "fiscal_period", "kind", "value", "known"]
    ordered = changes.select(*columns).repartition("security_id", "feature").sortWithinPartitions("security_id", "feature", "ts")
    return ordered.mapInPandas(newest_cells, STATES)


def income_features(metrics: DataFrame, asofs: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """(security_id, asof, feature, fiscal_year, fiscal_period, value, status, available_at) of the features of ``names`` at as-ofs.

    asofs: security_id, asof.  The newest visible quarter that has what is needed counts, older ones are fallbacks; without one
    the status says why, and before a security's first metric it is ``no_visible_period``."""
    for name in names:
        if name not in FEATURES:
            raise ValueError(f"no income feature {name}")
    wanted = F.explode(F.array(*[F.lit(n) for n in names])).alias("feature")
    asked = asofs.select("security_id", F.col("asof").alias("ts"), F.lit(1).alias("kind"), wanted)
    known = states(metrics, names).select("security_id", "ts", F.lit(0).alias("kind"), "feature", F.struct("fiscal_year", "fiscal_period", "value", "known", "status").alias("state"))
    last = F.last("state", ignorenulls=True).over(Window.partitionBy("security_id", "feature").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0))
    out = known.unionByName(asked, allowMissingColumns=True).withColumn("seen", last).where("kind = 1")
    return out.select(
        "security_id", F.col("ts").alias("asof"), "feature", "seen.fiscal_year", "seen.fiscal_period", "seen.value",
        F.coalesce("seen.status", F.lit("no_visible_period")).alias("status"), F.col("seen.known").alias("available_at"))
