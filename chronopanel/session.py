"""Session construction: UTC clock, adaptive execution, Arrow for the few Python stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName("chronopanel")
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error, as executors would each
    write to their own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = getattr(spark, "_chronopanel_scratch", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="chronopanel-")
            spark._chronopanel_scratch = root
    return root.rstrip("/")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a long plan ends there, and a retry gives the same rows."""
    path = f"{shared_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of a session read: made and written to the shared folder at its first use.

    ``name`` tells the table and the inputs it is made of, which are taken to stay as they are while the session lives."""
    known = getattr(spark, "_chronopanel_tables", None)
    if known is None:
        known = spark._chronopanel_tables = {}
    if name not in known:
        df = make()
        path = f"{shared_root(spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        known[name] = (path, df.schema)
    path, schema = known[name]
    return spark.read.schema(schema).parquet(path)
