"""Centroid clustering (operator 12): weighted deduplication before exact integer Lloyd rounds.

Vectors become integers, equal ones are one row with a multiplicity, and every round works on these distinct vectors only:
workers assign their rows and hand back one weighted sum a cluster, Spark adds those up, and the driver holds nothing but
the centroids, k x dims numbers whatever the table's size.  At the end the assignment of each distinct vector goes back to
the vec_ids that hold it; vectors of very many ids are looked up, so such a crowd isn't shuffled.

All arithmetic is in integers, so any order of rows and any retry gives the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, lookup, table

#: Components stay below this, so that a squared distance of 64 of them fits in 63 bits.
LARGEST = 1 << 27


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as an int; one of 2**27 or more is an error, as distances wouldn't fit a long."""
    scaled = lambda x: F.floor(F.lit(scale) * x.cast("double"))
    fits = lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < LARGEST
    whole = lambda x: F.when(fits(x), scaled(x).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for squared distances in a long")).cast("int"))
    return F.transform(vector, whole)


def is_whole(vector: Column, dims: int) -> Column:
    """Whether the vector has ``dims`` components, all of them finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, finite), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, ties to the smaller number, and the squared distance, exactly."""
    best, cluster = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        d = np.einsum("ij,ij->i", d, d)
        nearer = d < best
        best[nearer], cluster[nearer] = d[nearer], k
    return cluster, best


def sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[list[int], int]]:
    """For each cluster that has vectors, the weighted sum of its components and its weight."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = [[0] * dims for _ in range(k)], [0] * k  # Python's integers: of any size
        for batch in batches:
            x, w = matrix(batch.column(0), dims), batch.column(1).to_numpy()
            cluster, _ = nearest(x, centroids)
            for j in np.unique(cluster).tolist():
                own = cluster == j
                heavy = int(np.abs(x[own]).max()) * int(w[own].sum()) >= 1 << 62
                part = (x[own].astype(object) * w[own, None].astype(object)).sum(axis=0) if heavy else (x[own] * w[own, None]).sum(axis=0)
                total[j] = [a + int(b) for a, b in zip(total[j], part)]
                weight[j] += int(w[own].sum())
        rows = [(j, [str(v) for v in total[j]], weight[j]) for j in range(k) if weight[j]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.list_(pa.string()), pa.int64()))], ["cluster", "total", "weight"])

    parts = distinct.mapInArrow(run, "cluster int, total array<string>, weight long")
    added = parts.select("cluster", "weight", F.posexplode("total").alias("at", "value")).groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("weight").alias("weight"))
    found: dict[int, tuple[list[int], int]] = {}
    for row in added.collect():  # k x dims rows
        found.setdefault(row["cluster"], ([0] * dims, row["weight"]))[0][row["at"]] = int(row["value"])
    return found


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds, or after fewer where a round changes nothing, as then none would."""
    for _ in range(rounds):
        new = centroids.copy()
        for j, (total, weight) in sums(distinct, centroids).items():
            new[j] = [t // weight for t in total]
        if (new == centroids).all():
            return centroids
        centroids = new
    return centroids


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``distinct`` (q, n) with the cluster and squared distance of each vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(matrix(batch.column(0), dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["q", "n", "cluster", "distance"])

    return distinct.mapInArrow(run, "q array<int>, n long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """``id_col``, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each row whose vector is whole.

    Rows with a vector that is null, of another length or with a null or non-finite component aren't in the result; a
    component of 2**27 / ``scale`` or more ends the query with an error.  Repeated rows count and come back each for itself.
    A row without an id is clustered but is no starting centroid; of starting rows with the same id, those with the smaller
    vector come first.  Fewer than ``k`` vectors make fewer clusters, none an empty result.  Other columns are ignored."""
    spark = vectors.sparkSession
    v = F.col(vector_col)
    kept = vectors.where(is_whole(v, dims)).select(F.col(id_col).cast("long").alias("vec_id"), quantised(v, scale).alias("q"))
    distinct = cut(kept.groupBy("q").agg(F.count("*").alias("n")), "distinct")
    by_hash = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    seeds = kept.where("vec_id is not null").select(by_hash.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    shape = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds and not kept.limit(1).count():
        return spark.createDataFrame([], shape)
    if not seeds:
        raise ValueError("no vector has an id, so there are no starting centroids")
    centroids = lloyd(distinct, np.array([list(s["q"]) for s in seeds], np.int64), rounds)
    placed = cut(assigned(distinct, centroids), "placed")
    forget(distinct)
    weighed = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("inertia")).collect()  # k rows
    inertia = {r["cluster"]: int(r["inertia"]) for r in weighed}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(j, x, sum(inertia.values()), digests[j]) for j, x in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    back = lookup(kept, placed, ["q"], "n").join(F.broadcast(facts), "cluster")
    return back.select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` in 8 clusters after 10 rounds, see ``cluster_vectors``."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def lloyd_sql(dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:") -> str:
    """The same for DuckDB, over rows (vector, component, value) and a table of centroids for each round."""
    steps = [f"""kept AS (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
    WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
cells AS MATERIALIZED (SELECT r, unnest(generate_series(1, {dims})) AS p, unnest(q) AS x FROM kept),
c0 AS MATERIALIZED (SELECT k, unnest(generate_series(1, {dims})) AS p, unnest(q) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), q) - 1 AS k, q FROM kept WHERE vec_id IS NOT NULL) WHERE k < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (SELECT r, k, sum((cells.x - c{i}.x) * (cells.x - c{i}.x))::BIGINT AS d FROM cells JOIN c{i} USING (p) GROUP BY r, k),
a{i} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT k, p, sum(x)::BIGINT AS s, count(*) AS n FROM cells JOIN a{i} USING (r) GROUP BY k, p),
c{i + 1} AS MATERIALIZED (SELECT k, p, coalesce(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END, c{i}.x)::BIGINT AS x FROM c{i} LEFT JOIN m{i} USING (k, p))""")
    return "WITH " + ",\n".join(steps) + f""",
digests AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS h FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN digests USING (k)"""


OP12_SQL = lloyd_sql()
