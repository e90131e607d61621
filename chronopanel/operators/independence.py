"""Whether a ranking tells more than simpler ones: residual ranks, buckets of a control, factor returns, sectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronopanel.operators import backtest as B
from chronopanel.operators import ranks


def residual_verdict(windows: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """One row: windows, positive ones, mean edge, and whether the residual still tells something."""
    totals = windows.agg(F.count("*").alias("windows"), F.count_if(F.col("difference") > 0).alias("positive"), F.avg("difference").alias("edge"))
    weak = (F.col("edge") <= 0) | (F.col("positive") / F.col("windows") < share)
    return totals.withColumn("verdict", F.when(F.col("windows") < least, "insufficient_data").when(weak, "explained_by_controls").otherwise("independent"))


def within_buckets(rows: DataFrame, control: str, splits: DataFrame) -> DataFrame:
    """(bucket, windows, positive, edge): the selection by ``feature`` against all within each half of a control.

    rows: security_id, asof, idx, ret, feature; a date's lower half has n div 2 members."""
    by_date = Window.partitionBy("asof")
    low = F.row_number().over(by_date.orderBy(control, "security_id")) <= F.expr("n div 2")
    halves = rows.withColumn("n", F.count("*").over(by_date)).withColumn("bucket", F.when(low, "low").otherwise("high")).drop("n")
    scores = B.date_scores(halves, cost_bps=0.0, by=("bucket",)).withColumn("edge", F.col("strategy_net") - F.col("baseline_net"))
    tested = scores.join(B.split_sessions(splits, "test").select("split", "idx"), "idx").groupBy("bucket", "split").agg(F.avg("edge").alias("difference"))
    return tested.groupBy("bucket").agg(F.count("*").alias("windows"), F.count_if(F.col("difference") > 0).alias("positive"), F.avg("difference").alias("edge"))


def factor_returns(rows: DataFrame, strategy: str, factors: dict[str, str]) -> DataFrame:
    """(asof, idx, strategy, market, factors...): mean returns of the strategy's and all members, and of each factor's upper
    half less its lower one; dates without a lower half are left out."""
    by_date = Window.partitionBy("asof")
    half = F.greatest(F.lit(1), F.expr("n div 2"))
    marked = rows.withColumn("n", F.count("*").over(by_date))
    for name, column in {"__s": strategy, **{f"__{k}": c for k, c in factors.items()}}.items():
        marked = marked.withColumn(name, F.row_number().over(by_date.orderBy(F.desc(column), "security_id")) <= half)
    mean = lambda test: F.avg(F.when(test, F.col("ret")))
    spreads = [(mean(F.col(f"__{k}")) - mean(~F.col(f"__{k}"))).alias(k) for k in factors]
    return marked.groupBy("asof", "idx").agg(mean(F.col("__s")).alias("strategy"), F.avg("ret").alias("market"), *spreads).dropna(subset=list(factors))


def information(correlations: DataFrame) -> DataFrame:
    """One row of the dates' rank correlations: dates, ic_mean, ic_std, ic_t_stat, hit_rate."""
    ic = F.col("rank_correlation")
    error = F.stddev_samp(ic) / F.sqrt(F.count(ic))
    return correlations.agg(
        F.count(ic).alias("dates"), F.avg(ic).alias("ic_mean"), F.stddev_samp(ic).alias("ic_std"), F.try_divide(F.avg(ic), F.nullif(error, F.lit(0.0))).alias("ic_t_stat"),
        F.avg(F.when(ic > 0, 1.0).when(ic.isNotNull(), 0.0)).alias("hit_rate"))


def sector_relative(rows: DataFrame, feature: str, ratio: str) -> DataFrame:
    """``rows`` (security_id, asof, sector, ...) with ``relative``, the feature less its sector's median, and ``sector_rank``,
    the share of the sector up to the ratio's rank."""
    keys = ["sector", "asof"]
    middle = ranks.medians(rows, feature, keys).select(*keys, "median")
    ranked = ranks.with_ranks(rows, ratio, keys, "__rank")
    size = rows.where(F.col(ratio).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__n"))
    out = ranked.join(middle, keys, "left").join(size, keys, "left")
    return out.withColumns({"relative": F.col(feature) - F.col("median"), "sector_rank": F.col("__rank") / F.col("__n")}).drop("median", "__rank", "__n")
