"""Calibration and drift: isotonic fits over merged bins, and the distance of two samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronopanel.session import stage


def bins(rows: DataFrame, predicted: str, outcome: str, number: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bin, n, predicted, outcome): counts and sums of predictions in [0, 1] by equal bins; bins of two tables add up."""
    at = F.least(F.floor(F.col(predicted) * number), F.lit(number - 1)).cast("int")
    return rows.where(F.col(predicted).between(0, 1) & F.col(outcome).isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.sum(predicted).alias("predicted"), F.sum(outcome).alias("outcome"))


def isotonic(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bin, n, mean_predicted, rate, fitted): the rates of bins and their best non-decreasing fit.

    What pooling adjacent violators ends with is, at each bin, the greatest over starts up to it of the least over ends from
    it on of the mean between; means come from running sums, and there are at most bins * bins of them whatever the input."""
    order = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    t = stage(table.withColumns({"__n": F.sum("n").over(order), "__y": F.sum("outcome").over(order)}), "bins")
    starts = t.select(*by, F.col("bin").alias("__a"), (F.col("__n") - F.col("n")).alias("__n0"), (F.col("__y") - F.col("outcome")).alias("__y0"))
    ends = t.select(*by, F.col("bin").alias("__b"), "__n", "__y")
    on = [starts[c] == ends[c] for c in by] + [F.col("__a") <= F.col("__b")]
    spans = starts.join(ends, on).select(*[starts[c] for c in by], "__a", "__b", ((F.col("__y") - F.col("__y0")) / (F.col("__n") - F.col("__n0"))).alias("__mean"))
    # the least mean from each start to an end at or after a bin, then the greatest over starts up to the bin
    later = Window.partitionBy(*by, "__a").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, 0)
    least = spans.withColumn("__least", F.min("__mean").over(later)).groupBy(*by, F.col("__b").alias("bin")).agg(F.max("__least").alias("fitted"))
    return t.join(least, [*by, "bin"]).select(*by, "bin", "n", (F.col("predicted") / F.col("n")).alias("mean_predicted"), (F.col("outcome") / F.col("n")).alias("rate"), "fitted")


def calibration_error(fit: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, error, worst): the mean and the largest difference of predictions and fitted rates."""
    off = F.abs(F.col("mean_predicted") - F.col("fitted"))
    return fit.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(off * F.col("n")) / F.sum("n")).alias("error"), F.max(off).alias("worst"))


def two_sample_distance(rows: DataFrame, value: str, late: Column, by: list[str]) -> DataFrame:
    """(by..., n_early, n_late, distance, at): the largest difference of the distribution functions of early and late rows.

    Values are counted and put in order over range partitions; what a partition adds to each sample is known from counts of
    the partitions before it, so no task holds a group.  ``at``: the smallest value at which the distance is reached; the
    distance is null where a sample is empty."""
    one = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"), late.cast("boolean").alias("__late"))
    counted = one.groupBy(*by, "__v").agg(F.count_if(~F.col("__late")).alias("__x"), F.count_if(F.col("__late")).alias("__y"))
    held = stage(counted.repartitionByRange(*by, "__v").sortWithinPartitions(*by, "__v").withColumn("__part", F.spark_partition_id()), "values")
    group = Window.partitionBy(*by)
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy(*by, "__part").agg(F.sum("__x").alias("__px"), F.sum("__y").alias("__py"))
    parts = parts.select(*by, "__part", *[F.coalesce(F.sum(f"__p{c}").over(before), F.lit(0)).alias(f"__b{c}") for c in "xy"], *[F.sum(f"__p{c}").over(group).alias(f"__n{c}") for c in "xy"])
    within = Window.partitionBy(*by, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    share = {c: (F.col(f"__b{c}") + F.sum(f"__{c}").over(within)) / F.nullif(F.col(f"__n{c}"), F.lit(0)) for c in "xy"}
    gaps = held.join(parts, [*by, "__part"]).withColumn("__gap", F.abs(share["x"] - share["y"]))
    best = F.max(F.struct(F.col("__gap").alias("g"), (-F.col("__v")).alias("v")))
    out = gaps.groupBy(*by).agg(F.max("__nx").alias("n_early"), F.max("__ny").alias("n_late"), best.alias("b"))
    return out.select(*by, "n_early", "n_late", F.col("b.g").alias("distance"), F.when(F.col("b.g").isNotNull(), -F.col("b.v")).alias("at"))
