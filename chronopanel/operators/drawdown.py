"""Equity paths, drawdowns and recoveries of return series of any length, by a scan over range partitions.

A stretch of returns is summed up by its growth and its highest point from its start, and such sums can be joined end to end.
Each range partition is summed up first; the sums of those before it give where it starts, and then each partition is walked
once.  The first walk and the table of sums are all that the second needs, so no task holds a whole series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronopanel.session import stage


def equity(returns: DataFrame, date: str = "date", value: str = "ret", by: str = "series") -> DataFrame:
    """(series, date, ret, equity, peak, drawdown): growth of 1, its highest value so far (1 at least), and how far below.

    A null return is none; dates of a series are distinct."""
    ordered = returns.select(F.col(by).alias("series"), F.col(date).alias("date"), F.coalesce(value, F.lit(0.0)).alias("ret")).repartitionByRange("series", "date").sortWithinPartitions("series", "date")
    held = stage(ordered.withColumn("part", F.spark_partition_id()), "returns")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[int, str], list[float]] = {}
        for part, series, rows in stretches(batches):
            grown = np.cumprod(1 + rows)
            s = state.setdefault((part, series), [1.0, 0.0])
            s[1] = max(s[1], s[0] * grown.max())
            s[0] *= grown[-1]
        if state:
            columns = zip(*[(p, s, g, h) for (p, s), (g, h) in state.items()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.float64(), pa.float64()))], ["part", "series", "growth", "high"])

    firsts = held.groupBy("part", "series").agg(F.min("date").alias("start"))
    one_each = held.repartition("part").sortWithinPartitions("part", "series", "date")
    sums = one_each.mapInArrow(summed, "part int, series string, growth double, high double").join(firsts, ["part", "series"])
    # a row for each partition that a series lies in
    path = Window.partitionBy("series").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.collect_list(F.struct("growth", "high")).over(path)
    start = F.aggregate(before, F.struct(F.lit(1.0).alias("e"), F.lit(1.0).alias("p")), lambda s, x: F.struct((s["e"] * x["growth"]).alias("e"), F.greatest(s["p"], s["e"] * x["high"]).alias("p")))
    carried = sums.select("part", "series", start.alias("s")).select("part", "series", F.col("s.e").alias("e0"), F.col("s.p").alias("p0"))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[int, str], tuple[float, float]] = {}
        for batch in batches:
            part, series = batch.column("part").to_numpy(), np.array(batch.column("series").to_pylist(), object)
            ret, e0, p0 = (batch.column(c).to_numpy() for c in ("ret", "e0", "p0"))
            e, p = np.empty(len(ret)), np.empty(len(ret))
            for a, b in spans(part, series):
                key = (int(part[a]), series[a])
                was = state.get(key, (e0[a], p0[a]))
                e[a:b] = was[0] * np.cumprod(1 + ret[a:b])
                p[a:b] = np.maximum(np.maximum.accumulate(e[a:b]), was[1])
                state = {key: (e[b - 1], p[b - 1])}
            yield pa.RecordBatch.from_arrays([batch.column("series"), batch.column("date"), batch.column("ret"), pa.array(e), pa.array(p), pa.array(e / p - 1)], ["series", "date", "ret", "equity", "peak", "drawdown"])

    rows = held.join(carried, ["part", "series"]).repartition("part").sortWithinPartitions("part", "series", "date")
    kind = returns.schema[date].dataType.simpleString()
    return rows.mapInArrow(walked, f"series string, date {kind}, ret double, equity double, peak double, drawdown double")


def spans(part: np.ndarray, series: np.ndarray) -> list[tuple[int, int]]:
    """Where neighbouring rows are of the same partition and series."""
    if not len(part):
        return []
    edge = np.nonzero((part[1:] != part[:-1]) | (series[1:] != series[:-1]))[0] + 1
    ends = [0, *edge.tolist(), len(part)]
    return list(zip(ends[:-1], ends[1:]))


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray]]:
    for batch in batches:
        part, series, ret = batch.column("part").to_numpy(), np.array(batch.column("series").to_pylist(), object), batch.column("ret").to_numpy()
        for a, b in spans(part, series):
            yield int(part[a]), series[a], ret[a:b]


def drawdowns(path: DataFrame) -> DataFrame:
    """(series, max_drawdown, peak_date, trough_date, recovered_date, recovery_days, final_equity) of ``equity``.

    The deepest fall from a peak, the first of equal ones; the peak is the last date at that height before the trough, null
    where it is the start; recovery is the first date after the trough at the peak's height again, null if there is none."""
    path = stage(path, "path")
    worst = path.groupBy("series").agg(F.min(F.struct("drawdown", F.col("date").alias("trough_date"), F.col("peak").alias("height"))).alias("w"), F.max_by("equity", "date").alias("final_equity")).select("series", "w.*", "final_equity")
    near = path.join(worst.select("series", "trough_date", (F.col("height") * (1 - 1e-12)).alias("height")), "series")  # products in another order
    dates = near.groupBy("series").agg(
        F.max(F.when((F.col("date") < F.col("trough_date")) & (F.col("equity") >= F.col("height")), F.col("date"))).alias("peak_date"),
        F.min(F.when((F.col("date") > F.col("trough_date")) & (F.col("equity") >= F.col("height")), F.col("date"))).alias("recovered_date"))
    days = F.datediff("recovered_date", "trough_date").cast("bigint")
    return worst.join(dates, "series").select("series", F.col("drawdown").alias("max_drawdown"), "peak_date", "trough_date", "recovered_date", days.alias("recovery_days"), "final_equity")
