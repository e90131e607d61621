"""Landed vendor responses: files of payloads in, rows with a request and a body out.

Nothing here makes a request: ``connector`` does, with the rules below for what to try again; its responses are landed one
JSON object a line with endpoint, params, status and body, and everything after that is a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANDED = "source string, endpoint string, params string, status int, body string"


def landed(spark: SparkSession, path: str, endpoint: str | None = None) -> DataFrame:
    """Successful responses of an endpoint; a line that isn't such an object fails the read."""
    rows = spark.read.schema(LANDED).option("mode", "FAILFAST").json(path)
    rows = rows.where(F.col("status").between(200, 299))
    return rows if endpoint is None else rows.where(F.col("endpoint") == endpoint)


def retryable(status: Column) -> Column:
    """Whether a response is worth another try: a timeout, too many requests, or the server's fault."""
    return status.isin(408, 429) | (status >= 500)


def pause_seconds(attempt: Column, first: float = 1.0, most: float = 30.0) -> Column:
    """The exponential wait before the next try, from attempt 1."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), attempt - 1))


def worth_retry(status: int) -> bool:
    """``retryable`` for a single response."""
    return status in (408, 429) or status >= 500


def pause_after(attempt: int, first: float = 1.0, most: float = 30.0) -> float:
    """``pause_seconds`` for a single request."""
    return min(most, first * 2.0 ** (attempt - 1))


def land(rows: DataFrame, path: str) -> None:
    """Write responses in the landed form."""
    rows.select("source", "endpoint", "params", F.col("status").cast("int").alias("status"), "body").write.json(path)


def write_calendar_csv(calendar: DataFrame, path: str) -> None:
    """One file with a header, in the order of dates; a calendar is a few thousand rows."""
    columns = ["date", "is_session", "session_close", "is_early_close"]
    calendar.select(*columns).coalesce(1).sortWithinPartitions("date").write.option("header", True).csv(path)


def write_reference(table: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """A small reference table, written whole to a new path; a key that occurs twice is an error."""
    n = table.groupBy(*keys).agg(F.count("*").alias("__n"))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    ok = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("twice: "), name)).cast("boolean")).otherwise(F.lit(True))
    table.join(n.where(ok), keys).drop("__n").write.mode("errorifexists").parquet(path)
    return table.sparkSession.read.parquet(path)
