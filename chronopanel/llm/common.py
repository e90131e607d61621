"""Shared pieces: table reading, lineage cuts in the shared folder, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.session import shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs a reread."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._chronopanel_path = path
    return back


def forget(*written: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more, because what came of them is written."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._chronopanel_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unique_ids(docs: DataFrame, id_col: str = "doc_id", name: str = "__row") -> DataFrame:
    """``docs`` with ``name``, a number of each row: its id, where it has one of its own, and one above all ids elsewhere.

    Rows without an id and those that share one are numbered in a written copy, so numbers don't change with a retry."""
    again = docs.groupBy(F.col(id_col).alias("__id")).count().where("count > 1 or __id is null").select("__id", F.lit(True).alias("__again"))
    if not again.limit(1).count():
        return docs.withColumn(name, F.col(id_col).cast("long"))
    top = docs.agg(F.max(F.col(id_col).cast("long"))).first()[0] or 0
    rows = cut(docs.withColumn("__n", F.monotonically_increasing_id()), "numbered")
    joined = rows.join(again, rows[id_col].eqNullSafe(again["__id"]), "left")
    fresh = F.lit(top + 1) + F.col("__n")
    return joined.withColumn(name, F.when(F.col("__again"), fresh).otherwise(F.col(id_col).cast("long"))).drop("__n", "__id", "__again")


def lookup(rows: DataFrame, values: DataFrame, keys: list[str], n: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row a key and in ``n`` its number of rows; others are dropped.

    A key with one in ``share`` of all rows or more is a hot one: there can be ``share`` of them at most, so these
    few rows of ``values`` are sent to the rows where they are, and only the rest is shuffled."""
    total = values.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(values.where(F.col(n) * share >= total))
    rest = rows.join(F.broadcast(values.where(F.col(n) * share >= total).select(*keys)), keys, "left_anti").join(values, keys)
    found = rows.join(hot, keys)
    return found.unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is the smallest node reachable.

    Min-label propagation with pointer jumping: every round takes the smallest label among the neighbours and then
    the label of that label, so rounds grow with the logarithm of a chain's length.  Labels are rewritten to the
    shared folder each round; only one counter comes to the driver.  Raises if ``max_rounds`` don't suffice.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("theirs")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        )
        moved = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "theirs").alias("component"))
        parent = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = cut(moved.join(parent, "component", "left").select("node", "old", F.least("component", F.coalesce("above", "component")).alias("component")), "labels")
        changed = new.where("component <> old").limit(1).count()
        forget(labels)
        labels = new
        if not changed:
            forget(both)
            return labels.select("node", "component")
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
