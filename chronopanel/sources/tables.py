"""Scans of the test tables and the panels derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

MONEY = "decimal(18,2)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts: Column) -> Column:
    return ts.cast("timestamp_ntz").cast("date")


def panel(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """(security_id, session, price, volume): traded price of a supplier nation per week or weekday.

    Sums are exact decimals and meet as doubles in one division, so any order of rows gives the same prices."""
    lines = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    supplier = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    session = day(F.date_trunc("week", "l_shipdate")) if grain == "week" else day(F.col("l_shipdate"))
    rows = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("session", session)
    if grain != "week":
        rows = rows.where(F.weekday("session") < 5)
    value, volume = (F.sum(F.col(c).cast(MONEY)).cast("double") for c in ("l_extendedprice", "l_quantity"))
    return rows.groupBy(F.col("s_nationkey").alias("security_id"), "session").agg((value / volume).alias("price"), volume.alias("volume"))


def sessions_of(prices: DataFrame) -> DataFrame:
    """(session, idx): the sessions that occur, numbered from 0.  One row a session, so the unpartitioned window is small."""
    return prices.select("session").distinct().withColumn("idx", (F.row_number().over(Window.orderBy("session")) - 1).cast("bigint"))


def weekdays_of(prices: DataFrame) -> DataFrame:
    """(session, idx): every weekday between the first and last session."""
    bounds = prices.agg(F.min("session").alias("a"), F.max("session").alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("session")).where(F.weekday("session") < 5)
    return days.withColumn("idx", (F.row_number().over(Window.orderBy("session")) - 1).cast("bigint"))


def spine(prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Dense (security x session) rows with null prices where nothing traded, so row offsets are session offsets.

    The calendar is the broadcast side: one row a session whatever the size of the panel."""
    securities = prices.select("security_id").distinct()
    grid = securities.join(F.broadcast(sessions), F.lit(True))
    return grid.join(prices, ["security_id", "session"], "left")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(security_id, ticker, valid_from, valid_to): nations as members, by region with closed and open intervals."""
    nation = load(spark, sf_dir, "nation")
    ends = F.when(F.col("n_regionkey") == 1, F.lit("1998-12-31")).when(F.col("n_regionkey") == 3, F.lit("2000-06-30"))
    starts = F.when(F.col("n_regionkey") == 2, F.lit("1997-01-01")).otherwise(F.lit("1990-01-01"))
    return nation.select(F.col("n_nationkey").alias("security_id"), F.col("n_name").alias("ticker"), starts.cast("date").alias("valid_from"), ends.cast("date").alias("valid_to"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly metrics by customer nation in long form, with the instant each was accepted.

    security_id, fiscal_year, fiscal_period, period_end, metric_name, metric_value, accepted_at."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    price = F.col("o_totalprice").cast(MONEY)
    wide = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("security_id"), F.year("o_orderdate").alias("fiscal_year"), F.quarter("o_orderdate").alias("q"))
        .agg(
            F.sum(price).cast("double").alias("revenue"),
            F.sum(F.when(F.substring("o_orderpriority", 1, 1) <= "3", price)).cast("double").alias("gross_profit"),
            F.sum(F.when(F.col("o_orderstatus") == "F", price)).cast("double").alias("operating_income"),
            F.sum(F.when(F.substring("o_orderpriority", 1, 1) == "1", price)).cast("double").alias("net_income"),
            F.count("*").cast("double").alias("diluted_weighted_average_shares"),
        )
    )
    end = F.last_day(F.make_date("fiscal_year", F.col("q") * 3, F.lit(1)))
    accepted = F.to_utc_timestamp(F.timestamp_add("HOUR", F.lit(17), F.date_add(end, 40).cast("timestamp")), "America/New_York")
    keyed = wide.withColumn("fiscal_period", F.concat(F.lit("Q"), "q")).withColumn("period_end", end).withColumn("accepted_at", accepted)
    ids = ["security_id", "fiscal_year", "fiscal_period", "period_end", "accepted_at"]
    return keyed.unpivot(ids, ["revenue", "gross_profit", "operating_income", "net_income", "diluted_weighted_average_shares"], "metric_name", "metric_value").where("metric_value is not null")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with ``ts`` as an instant (the file has wall-clock UTC)."""
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
