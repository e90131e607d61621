"""Order statistics of groups of any size: ranks and medians from range partitions with counts before them.

Rows are reduced to distinct values with counts, which are put in order over range partitions.  A partition's running count
plus what all partitions before it hold of the group is the exact place of a value, so no task holds a whole group, and ties
of any number are one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronopanel.session import stage


def placed_values(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., value, ties, below, n): each distinct value, how often it occurs, how many are smaller, and how many there are.

    Null values don't count."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    ordered = counted.repartitionByRange(*by, value).sortWithinPartitions(*by, value)
    held = stage(ordered.withColumn("__part", F.spark_partition_id()), "values")  # a written part number stays with a retry
    group = Window.partitionBy(*by)
    parts = held.groupBy(*by, "__part").agg(F.sum("ties").alias("__rows"))  # a row for each partition that a group lies in
    before = F.coalesce(F.sum("__rows").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*by, "__part", before.alias("__before"), F.sum("__rows").over(group).alias("n"))
    within = F.sum("ties").over(Window.partitionBy(*by, "__part").orderBy(value)) - F.col("ties")
    return held.withColumn("__within", within).join(parts, [*by, "__part"]).select(*by, value, "ties", (F.col("__before") + F.col("__within")).alias("below"), "n")


def with_ranks(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """``rows`` with the rank of ``value`` in its group, ties at their mean; null where the value is."""
    ranks = placed_values(rows, value, by).select(*by, value, (F.col("below") + (F.col("ties") + 1) / 2.0).alias(name))
    return rows.join(ranks, [*by, value], "left")


def medians(rows: DataFrame, value: str, by: list[str], name: str = "median") -> DataFrame:
    """(by..., name, n): the exact median of each group, the mean of the two middle values where n is even."""
    at = lambda k: F.max(F.when((F.col("below") < k) & (F.col("below") + F.col("ties") >= k), F.col(value)))
    middle = (at(F.expr("(n + 1) div 2")) + at(F.expr("n div 2 + 1"))) / 2.0
    return placed_values(rows, value, by).groupBy(*by).agg(middle.alias(name), F.max("n").alias("n"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., pairs, rank_correlation); null where a side is constant.

    Twice a rank is whole, so the covariance is one quotient of exact sums: a correlation of nothing is zero in any order of rows."""
    held = stage(rows.select(*by, x, y), "pairs")  # read for each of the ranks and once more
    ranked = with_ranks(with_ranks(held, x, by, "__rx"), y, by, "__ry")
    both = F.col("__rx").isNotNull() & F.col("__ry").isNotNull()
    whole = lambda c: F.when(both, (F.col(c) * 2).cast("decimal(18,0)"))
    n, a, b = F.count_if(both).cast("decimal(18,0)"), F.sum(whole("__rx")), F.sum(whole("__ry"))
    covariance = F.try_divide((n * F.sum(whole("__rx") * whole("__ry")) - a * b).cast("double"), n.cast("double") * n.cast("double") * 4)
    spread = F.stddev_pop("__rx") * F.stddev_pop("__ry")
    return ranked.groupBy(*by).agg(F.count("*").alias("pairs"), F.try_divide(covariance, F.nullif(spread, F.lit(0.0))).alias("rank_correlation"))
