"""Operator 2, sharding: balanced label propagation under capacity quotas.

Documents of a group (equal texts here, any membership table in general) are linked through their group, never by pairs.
Every document starts in the shard its id hashes to.  In each round, joins tell the members of a group which shards hold
most of it and the members elsewhere ask to move there; a shards x shards table of requests, the only thing the driver
sees, is cut down to what the capacities allow, and each request is granted by a hash threshold.  At the end, linked
documents keep their shard as far as its quota reaches, and the unlinked rest fills the free places exactly, so row
counts differ by at most one.  A group larger than a shard wants as many shards as it fills.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, lookup, table

#: Resolution of the share of requests that is granted.
GRAIN = 1 << 20


def _bucket(spark: SparkSession) -> Column:
    return F.pmod(F.xxhash64("rid"), F.lit(max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def number(df: DataFrame, part: str) -> DataFrame:
    """Adds ``n``: rows of each ``part`` numbered from 0 without gaps, by hash bucket and then ``rid``.

    Only per-bucket counts are summed over a whole part; each row is numbered within a bucket."""
    rows = df.withColumn("bucket", _bucket(df.sparkSession))
    before = Window.partitionBy(part).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(part, "bucket").count().select(part, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy(part, "bucket").orderBy("rid"))
    return rows.withColumn("local", local).join(offsets, [part, "bucket"]).withColumn("n", F.col("offset") + F.col("local") - 1).drop("local", "offset", "bucket")


def granted(asked: np.ndarray, held: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The share of each request (from, to) that fits: no shard ends with more than its capacity, or than it had."""
    grant = asked.astype(float)
    for _ in range(200):
        after = held - grant.sum(1) + grant.sum(0)
        over = np.maximum(0, after - np.maximum(capacity, 0))
        if over.max(initial=0) < 0.5:
            break
        into = grant.sum(0)
        grant *= np.where(into > 0, np.maximum(0, 1 - over / np.maximum(into, 1e-9)), 1)[None, :]
    return np.divide(grant, asked, out=np.zeros_like(grant), where=asked > 0)


def propagate(members: DataFrame, sizes: DataFrame, shards: int, capacity: np.ndarray, rounds: int) -> DataFrame:
    """(rid, gid, shard) after ``rounds`` of label propagation.  members: rid, gid, shard; sizes: gid, members."""
    room = int(capacity.min()) or 1
    for step in range(rounds):
        there = members.groupBy("gid", "shard").agg(F.count("*").alias("here"))
        order = F.struct((-F.col("here")).alias("less"), F.xxhash64("gid", "shard").alias("tie"), "shard")
        wanted = cut(
            there.groupBy("gid").agg(F.sort_array(F.collect_list(order)).alias("ranked"), F.sum("here").alias("n"))
            .select("gid", "n", F.expr(f"transform(slice(ranked, 1, least({shards}, cast(ceil(n / {room}) as int))), x -> x.shard)").alias("homes")),
            "wanted",
        )
        pick = F.expr("homes[cast(pmod(xxhash64(rid), size(homes)) as int)]")
        asks = lookup(members, wanted, ["gid"], "n").select("rid", "gid", "shard", F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(pick).alias("target"))
        asks = cut(asks, "asks")
        asked, held = np.zeros((shards, shards)), np.zeros(shards)
        for row in asks.groupBy("shard", "target").count().collect():  # at most shards * shards rows
            held[row["shard"]] += row["count"]
            if row["shard"] != row["target"]:
                asked[row["shard"], row["target"]] += row["count"]
        share = granted(asked, held, capacity)
        limits = F.array(*[F.lit(int(x * GRAIN)) for x in share.ravel()])
        limit = F.get(limits, F.col("shard") * shards + F.col("target"))
        grant = F.pmod(F.xxhash64("rid", F.lit(step)), F.lit(GRAIN)) < limit
        members = asks.select("rid", "gid", F.when(grant, F.col("target")).otherwise(F.col("shard")).alias("shard"))
        if not asked.any():
            break
    return members


def balanced_shards(docs: DataFrame, shards: int, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row with its shard and slot: doc_id, size, text_crc32, shard, slot.

    Row counts of shards differ by at most one and slots are gapless from 0.  A null text has no bytes and is equal to
    an empty one; repeated ids and rows without one are separate rows, told apart by a number in a written copy; texts of
    any length count whole; an empty table gives no rows; other columns are ignored.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.concat_ws("-", F.hex(F.xxhash64(body)), F.hex(F.hash(body)), F.octet_length(body), F.hex(F.crc32(body.cast("binary")))).alias("gid"),
    )
    base = cut(base.withColumn("rid", F.monotonically_increasing_id()), "shardbase")
    total = base.count()
    capacity = np.array([total // shards + (k < total % shards) for k in range(shards)])
    groups = cut(base.groupBy("gid").agg(F.count("*").alias("members")).where("members > 1"), "groups")
    members = cut(lookup(base, groups, ["gid"], "members").select("rid", "gid", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")), "members")
    members = propagate(members, groups, shards, capacity, rounds)

    ranked = cut(number(members.select("rid", "shard"), "shard"), "ranked")
    caps = F.array(*[F.lit(int(x)) for x in capacity])
    kept = ranked.where(F.col("n") < F.get(caps, F.col("shard"))).select("rid", "shard", F.col("n").alias("slot"))
    placed = np.zeros(shards, np.int64)
    for row in ranked.groupBy("shard").count().collect():  # one row a shard
        placed[row["shard"]] = min(row["count"], capacity[row["shard"]])
    ends = np.cumsum(capacity - placed)
    rest = number(base.join(kept, "rid", "left_anti").select("rid", F.lit(0).alias("all")), "all")
    rest = rest.withColumn("shard", F.size(F.filter(F.array(*[F.lit(int(x)) for x in ends]), lambda end: end <= F.col("n"))))
    shift = F.array(*[F.lit(int(p - (e - c + p))) for p, e, c in zip(placed, ends, capacity)])
    rest = rest.select("rid", "shard", (F.col("n") + F.get(shift, F.col("shard"))).alias("slot"))
    return base.join(kept.union(rest), "rid").select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def cut_links(placed: DataFrame, group: str) -> DataFrame:
    """One row: documents outside the shard that holds most of their group, as a measure of the cut."""
    per = placed.groupBy(group, "shard").count()
    return per.groupBy(group).agg((F.sum("count") - F.max("count")).alias("outside")).agg(F.sum("outside").alias("outside"))


def op2_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``balanced_shards`` of all documents, 40 of them: see there for nulls, repeats, empty texts and columns."""
    placed = balanced_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
