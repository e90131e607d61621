"""Frozen tables: content-addressed snapshots, and names that move from one to the next in one step.

A snapshot is written to a folder of its own and described by a manifest: rows and a digest of each part, whatever order they
came in.  Its id is the hash of that, so the same content is the same snapshot and is kept once.  A name is a row of numbered
pointer files, of which the highest counts.  Publishing creates the next number, and only one writer can create it, so one of
two that started from the same version fails, and a reader sees the old snapshot or the new one.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.sources.vault import canonical_json, run_key


class Conflict(RuntimeError):
    """Another writer published first."""


def row_number_of(columns: list[Column]) -> Column:
    """48 bits of the SHA-256 of a row's text, as a number; nulls are told from empty texts."""
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(20,0)")


def manifest_rows(rows: DataFrame, part: Column, columns: list[Column]) -> DataFrame:
    """(part, rows, digest): the sum of the rows' numbers, so the order of rows and files doesn't matter but each row does."""
    return rows.groupBy(part.cast("string").alias("part")).agg(F.count("*").alias("rows"), F.sum(row_number_of(columns)).cast("string").alias("digest"))


def _fs(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _create(spark: SparkSession, path: str, content: dict) -> bool:
    """Write a new small file; whether there was none of that name."""
    fs, found = _fs(spark, path)
    try:
        out = fs.create(found, False)
    except Py4JJavaError as failed:
        if "FileAlreadyExists" in str(failed.java_exception.getClass().getName()) or fs.exists(found):
            return False
        raise
    out.write(bytearray(json.dumps(content), "utf-8"))
    out.close()
    return True


def freeze(rows: DataFrame, root: str, part: str, columns: list[Column] | None = None) -> str:
    """Write a snapshot of ``rows`` under ``root`` and return its id; one of the same content is found, not written again.

    ``columns``: what a row's digest is taken of, in order; all columns as text if not told."""
    spark = rows.sparkSession
    parts = manifest_rows(rows, F.col(part), columns or [F.col(c) for c in sorted(rows.columns)]).orderBy("part").collect()  # a row a part
    schema = json.loads(rows.schema.json())
    snapshot = run_key("snapshot", {"parts": [list(p) for p in parts], "schema": canonical_json(schema)}, 40)
    fs, done = _fs(spark, f"{root}/manifests/{snapshot}.json")
    if not fs.exists(done):
        rows.write.mode("overwrite").parquet(f"{root}/data/{snapshot}")
        _create(spark, f"{root}/manifests/{snapshot}.json", {"snapshot": snapshot, "schema": schema, "parts": [p.asDict() for p in parts]})
    return snapshot


def open_snapshot(spark: SparkSession, root: str, snapshot: str) -> DataFrame:
    _read(spark, f"{root}/manifests/{snapshot}.json")  # one without a manifest isn't whole
    return spark.read.parquet(f"{root}/data/{snapshot}")


def manifest(spark: SparkSession, root: str, snapshot: str) -> DataFrame:
    """(part, rows, digest) of a snapshot as it was frozen."""
    return spark.createDataFrame([(p["part"], p["rows"], p["digest"]) for p in _read(spark, f"{root}/manifests/{snapshot}.json")["parts"]], "part string, rows long, digest string")


def version(spark: SparkSession, root: str, name: str) -> int:
    """The number of the pointer that counts, 0 for a name that was never published."""
    fs, folder = _fs(spark, f"{root}/names/{name}")
    if not fs.exists(folder):
        return 0
    return max((int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()), default=0)


def publish(spark: SparkSession, root: str, name: str, snapshot: str, over: int) -> int:
    """Move a name from version ``over`` to the snapshot; Conflict if it isn't at that version any more."""
    _read(spark, f"{root}/manifests/{snapshot}.json")
    if version(spark, root, name) != over or not _create(spark, f"{root}/names/{name}/{over + 1:012d}", {"snapshot": snapshot, "over": over}):
        raise Conflict(f"{name} was published after version {over}")
    return over + 1


def read(spark: SparkSession, root: str, name: str, at: int | None = None) -> DataFrame:
    """The table that a name stands for, now or at a version."""
    number = version(spark, root, name) if at is None else at
    return open_snapshot(spark, root, _read(spark, f"{root}/names/{name}/{number:012d}")["snapshot"])
