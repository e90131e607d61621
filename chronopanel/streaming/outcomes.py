"""Predictions and their outcomes as streams: a prediction is scored when its label becomes known.

Both sides carry the instant at which a row is known.  A label comes a bounded time after its prediction, so the join keeps
predictions only that long, and the watermarks of both streams let finished ones go: state grows with what is open, not
with what has been.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTIONS = "prediction_id long, security_id long, asof date, horizon long, predicted double, predicted_at timestamp"
LABELS = "security_id long, asof date, horizon long, realized double, known_at timestamp"


def scored(predictions: DataFrame, labels: DataFrame, wait: str = "400 days", late: str = "10 days") -> DataFrame:
    """(prediction_id, security_id, asof, horizon, predicted, realized, error, scored_at), an inner join of streams or tables.

    ``wait``: how long after its prediction a label may become known; ``late``: how far rows of either stream may be behind.
    A label that is known before its prediction, or longer after it, scores nothing."""
    if predictions.isStreaming:
        predictions, labels = predictions.withWatermark("predicted_at", late), labels.withWatermark("known_at", late)
    p, y = predictions.alias("p"), labels.alias("y")
    same = (F.col("p.security_id") == F.col("y.security_id")) & (F.col("p.asof") == F.col("y.asof")) & (F.col("p.horizon") == F.col("y.horizon"))
    timely = (F.col("y.known_at") > F.col("p.predicted_at")) & (F.col("y.known_at") <= F.col("p.predicted_at") + F.expr(f"interval {wait}"))
    rows = p.join(y, same & timely)
    return rows.select("p.prediction_id", "p.security_id", "p.asof", "p.horizon", "p.predicted", "y.realized", (F.col("p.predicted") - F.col("y.realized")).alias("error"), F.col("y.known_at").alias("scored_at"))


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 4) -> DataFrame:
    """A stream of Parquet files of a folder, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(rows: DataFrame, path: str, progress: str) -> None:
    """Append to ``path`` what the files that are there give, and end; a later call goes on from where this one was."""
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def summary(found: DataFrame) -> DataFrame:
    """(horizon, scored, mean_error, mean_abs_error, hit_rate) of scored predictions."""
    hit = F.when(F.signum("predicted") == F.signum("realized"), 1.0).otherwise(0.0)
    return found.groupBy("horizon").agg(F.count("*").alias("scored"), F.avg("error").alias("mean_error"), F.avg(F.abs("error")).alias("mean_abs_error"), F.avg(hit).alias("hit_rate"))
