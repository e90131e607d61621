"""Incremental landing: files that arrive are taken into the vault and into current tables, each micro-batch once.

A batch writes to a folder named by its id, whole or not at all as seen by readers, and from that folder's rows and those of
earlier batches alone; so a batch that is repeated after a failure writes the same again and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronopanel.sources.landing import LANDED
from chronopanel.sources.vault import vault_rows

BATCHED = "source string, endpoint string, params string, status int, body string, raw_hash string, params_hash string, arrival bigint, batch bigint"


def read_landed(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of the responses in files of a folder (one JSON object a line), some files a batch."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_a_batch).json(folder)


def vault(spark: SparkSession, root: str) -> DataFrame:
    """All payloads that were taken in, of batches that are whole."""
    return spark.read.schema(BATCHED).option("basePath", f"{root}/vault").parquet(f"{root}/vault/batch=*")


def take(root: str):
    """What a stream does with each batch: new payloads go into ``root``/vault/batch=<id>, known ones don't."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        numbered = rows.withColumn("arrival", F.monotonically_increasing_id())
        arriving = vault_rows(numbered)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/vault")
        known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        if known:
            earlier = vault(spark, root).where(F.col("batch") < batch)
            keys = ["source", "endpoint", "params_hash", "raw_hash"]
            arriving = arriving.join(earlier.select(*keys), keys, "left_anti")
        columns = [c.split()[0] for c in BATCHED.split(", ")][:-1]
        arriving.select(*columns).write.mode("overwrite").parquet(f"{root}/vault/batch={batch}")

    return write


def land_stream(landed: DataFrame, root: str):
    """Take in what has arrived by now and end: a query over ``landed`` that keeps its progress under ``root``."""
    return landed.writeStream.foreachBatch(take(root)).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest successful payload of each request: an upsert by what was asked for, of all batches that are whole."""
    ok = vault(spark, root).where(F.col("status").between(200, 299))
    newest = Window.partitionBy("source", "endpoint", "params_hash").orderBy(F.desc("batch"), F.desc("arrival"), "raw_hash")
    return ok.withColumn("__k", F.row_number().over(newest)).where("__k = 1").drop("__k")
