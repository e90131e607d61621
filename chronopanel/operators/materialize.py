"""Tables that are computed, frozen and published as one step of lineage: done, or as if it hadn't been tried.

A run is a row of lineage from before its work starts.  Its result becomes visible when a name moves to its snapshot; where
anything fails before that, readers keep what they had, and the lineage says that the run failed and why.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from chronopanel.sources import snapshots
from chronopanel.sources.vault import redact, run_key

LINEAGE = "key string, kind string, parameters string, status string, snapshot string, version long, error string"


def create_run(spark: SparkSession, root: str, kind: str, parameters: dict) -> str:
    """The key of a new run, which is running; the same kind and parameters again are an attempt of their own."""
    shown = redact(parameters)
    attempt = 0
    while True:
        key = run_key(kind, {"parameters": shown, "attempt": attempt})
        if snapshots._create(spark, f"{root}/runs/{key}.running", {"key": key, "kind": kind, "parameters": shown}):
            return key
        attempt += 1


def finish_run(spark: SparkSession, root: str, key: str, status: str, **facts: object) -> None:
    """End a run; one that is over already keeps its outcome, which is an error to change."""
    if not snapshots._create(spark, f"{root}/runs/{key}.over", {"key": key, "status": status, **facts}):
        raise ValueError(f"{key} is over")


def materialize(spark: SparkSession, root: str, name: str, kind: str, parameters: dict, make: Callable[[], DataFrame], part: str, columns: list[Column] | None = None) -> tuple[str, int]:
    """(run key, version): compute a table, freeze it and move ``name`` to it; any failure leaves the name where it is."""
    over = snapshots.version(spark, root, name)
    key = create_run(spark, root, kind, parameters)
    try:
        snapshot = snapshots.freeze(make(), root, part, columns)
        number = snapshots.publish(spark, root, name, snapshot, over)
    except Exception as failed:
        finish_run(spark, root, key, "failed", error=f"{type(failed).__name__}: {str(failed)[:200]}")
        raise
    finish_run(spark, root, key, "succeeded", snapshot=snapshot, version=number)
    return key, number


def lineage(spark: SparkSession, root: str) -> DataFrame:
    """LINEAGE: every run and its outcome; a run without one is running, or its driver was lost."""
    shape = "key string, kind string, parameters string, status string, snapshot string, version long, error string"
    rows = lambda ending: spark.read.schema(shape).option("pathGlobFilter", f"*.{ending}").json(f"{root}/runs")
    begun, over = rows("running").select("key", "kind", "parameters"), rows("over").select("key", "status", "snapshot", "version", "error")
    return begun.join(over, "key", "left").fillna({"status": "running"}).select(*[c.split()[0] for c in LINEAGE.split(", ")])
