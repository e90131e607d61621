"""Approximate nearest neighbours (operator 13): a block matrix join of int8 tiles with error bounds, so nothing is missed.

Every vector x is s * q + e with int8 components q.  For two of them, x.y differs from s_x s_y (q_x . q_y) by at most
|e_x| |y| + |s_x q_x| |e_y|, and these norms are kept beside q.  Query blocks meet candidate blocks in a grid of cells of
bounded size.  In a cell, tiles of q are multiplied; a pair survives if its upper bound reaches the query's k-th best lower
bound or the worst of its heap; survivors are computed again from the original vectors and go into the query's heap.  The
heaps of a query's cells are merged at last.  The bound is proven, so the result equals that of all pairs.

Equal vectors are searched once as queries, and as candidates only the first k + 1 of them by id take part: no more can be
among k nearest, as ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lookup, table

#: Most components of the queries and of the candidates of a cell, which bound a task's memory, and the size of the tiles in it.
QUERY_BLOCK, CANDIDATE_BLOCK = 1 << 19, 1 << 22
TILE_QUERIES, TILE_CANDIDATES = 256, 4096
#: Components that are added in single precision, where sums of products of int8 stay whole: 127 * 127 * 1024 < 2**24.
EXACT = 1024


def takes_part(vector: Column) -> Column:
    """Whether the vector has components, all finite and not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def norms(x: np.ndarray) -> np.ndarray:
    """Upper bounds of the rows' lengths, safe from squares that are too small or too large for a double."""
    most = np.abs(x).max(axis=1, initial=0)
    unit = x / np.where(most > 0, most, 1)[:, None]
    return most * np.sqrt(np.einsum("ij,ij->i", unit, unit)) * (1 + 1e-9)


class Block:
    """Vectors of one length as int8 with a scale each, the norms that the bound needs, and the originals."""

    def __init__(self, x: np.ndarray):
        self.x = x  # double precision
        self.scale = np.abs(x).max(axis=1, initial=0) / 127
        self.scale[self.scale == 0] = 1
        self.q = np.rint(x / self.scale[:, None]).astype(np.int8)
        held = self.q * self.scale[:, None]
        # sums and products in double precision are off by less than these margins
        self.norm, self.held, self.off = norms(x), norms(held), norms(x - held) + np.abs(x).max(axis=1, initial=0) * 1e-12

    def bounds(self, other: Block, mine: slice, theirs: slice) -> tuple[np.ndarray, np.ndarray]:
        """Products of the tiles' int8 forms, scaled, and how far at most they are from the true ones."""
        near = np.zeros((mine.stop - mine.start, theirs.stop - theirs.start))
        for at in range(0, self.q.shape[1], EXACT):
            near += self.q[mine, at : at + EXACT].astype(np.float32) @ other.q[theirs, at : at + EXACT].astype(np.float32).T
        near *= self.scale[mine, None] * other.scale[None, theirs]
        off = self.off[mine, None] * other.norm[None, theirs] + self.held[mine, None] * other.off[None, theirs]
        return near, off + self.norm[mine, None] * other.norm[None, theirs] * 1e-12


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows, added from the first component to the last in double precision."""
    out = np.zeros(len(x))
    for at in range(x.shape[1]):
        out += x[:, at] * y[:, at]
    return out


def search(queries: Block, candidates: Block, order: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """Of each query the ``k`` best candidates as (-score, place in ``order``), best first; ``order`` ranks ties."""
    for a in range(0, len(queries.x), TILE_QUERIES):
        mine = slice(a, min(a + TILE_QUERIES, len(queries.x)))
        heaps: list[list[tuple[float, int]]] = [[] for _ in range(mine.stop - a)]  # worst first: (score, -order)
        floor = np.full(mine.stop - a, -np.inf)
        for b in range(0, len(candidates.x), TILE_CANDIDATES):
            theirs = slice(b, min(b + TILE_CANDIDATES, len(candidates.x)))
            near, off = queries.bounds(candidates, mine, theirs)
            low = near - off
            if low.shape[1] >= k:  # k candidates are at least this near
                floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            rows, columns = np.nonzero(near + off >= floor[:, None])
            for start in range(0, len(rows), TILE_CANDIDATES * 16):  # survivors, a bounded number at a time
                r, c = rows[start : start + TILE_CANDIDATES * 16], columns[start : start + TILE_CANDIDATES * 16]
                score = products(queries.x[a + r], candidates.x[b + c])
                alive = score >= floor[r]
                r, c, score = r[alive], b + c[alive], score[alive]
                best = np.lexsort((order[c], -score, r))
                r, c, score = r[best], c[best], score[best]
                head = np.nonzero(np.r_[True, r[1:] != r[:-1]])[0] if len(r) else np.zeros(0, int)
                first = np.arange(len(r)) - np.repeat(head, np.diff(np.r_[head, len(r)])) < k
                for i, j, s in zip(r[first].tolist(), order[c[first]].tolist(), score[first].tolist()):
                    heap = heaps[i]
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -j))
                    elif (s, -j) > heap[0]:
                        heapq.heapreplace(heap, (s, -j))
            full = [heap[0][0] if len(heap) == k else -np.inf for heap in heaps]
            floor = np.maximum(floor, full)
        for i, heap in enumerate(heaps):
            yield a + i, sorted((-s, -j) for s, j in heap)


def block(column: pa.Array, dims: int) -> Block:
    return Block(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims))


def nearest_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, cells: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id ``every`` divides, the ``k`` other rows of the largest inner product.

    The inner product is that of double precision, added from the first component on; ties go to the smaller id, and a row
    without an id, which is a candidate but no query, comes after those with one.  A row is its own only: repeated ids are
    rows and queries each for itself, with ranks of their own.  Vectors that are null, empty, zero or hold a null or
    non-finite component take no part; vectors of different lengths aren't compared.  An empty table gives no rows; other
    columns are ignored.  ``cells``: candidate blocks at least, for parallelism; the result doesn't depend on it."""
    spark, ids = vectors.sparkSession, F.col(id_col).cast("long")
    numbered = vectors.where(takes_part(F.col(vector_col))).select(ids.alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = cut(numbered.withColumn("row", F.monotonically_increasing_id()), "vectors")  # a written number stays with a retry
    same = Window.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    # within a cell, ties go by vec_id, those without one last, then by the row's number
    candidates = cut(rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).select("vec_id", "row", "x", F.size("x").alias("dims")), "candidates")
    asked = rows.where(F.col("vec_id") % every == 0)
    groups = cut(asked.groupBy("x").agg(F.min("row").alias("g"), F.count("*").alias("n")).withColumn("dims", F.size("x")), "queries")
    size = candidates.agg(F.count("*"), F.coalesce(F.sum("dims"), F.lit(0))).first()
    asked_size = groups.agg(F.coalesce(F.sum("dims"), F.lit(0))).first()[0]
    width = max(-(-size[1] // CANDIDATE_BLOCK), min(cells or 4 * spark.sparkContext.defaultParallelism, -(-size[0] // 512)), 1)
    height = max(-(-asked_size // QUERY_BLOCK), 1)
    left = groups.select("g", "x", "dims", F.pmod(F.xxhash64("g"), F.lit(height)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("cb"))
    right = candidates.select("vec_id", "row", "x", "dims", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("qb"), F.pmod(F.xxhash64("row"), F.lit(width)).cast("int").alias("cb"))

    def cell(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: tuple[list[int], list[float], list[int], list[int | None]] = ([], [], [], [])
        if mine.num_rows and theirs.num_rows:
            dims = mine.column("dims")[0].as_py()
            ordered = theirs.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls last
            to = block(ordered.column("x").combine_chunks(), dims)
            g, number, name = mine.column("g").to_pylist(), ordered.column("row").to_pylist(), ordered.column("vec_id").to_pylist()
            for i, best in search(block(mine.column("x").combine_chunks(), dims), to, np.arange(len(number)), k + 1):
                for minus, j in best:
                    for column, value in zip(out, (g[i], -minus, number[j], name[j])):
                        column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["g", "score", "row", "vec_id"])

    key = ["dims", "qb", "cb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, "g long, score double, row long, vec_id long")
    # the heaps of a query, k + 1 rows a cell, are merged in the order of the result
    by_rank = Window.partitionBy("g").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    merged = found.withColumn("nth", F.row_number().over(by_rank)).where(F.col("nth") <= k + 1)
    best = merged.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("nth", "row", "vec_id", "score"))).alias("best"))  # k + 1 entries at most
    answers = cut(groups.join(best, "g").select("x", "n", "best"), "answers")
    own = lookup(asked.select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), "x"), answers, ["x"], "n")
    others = F.slice(F.filter("best", lambda b: b["row"] != F.col("own")), 1, k)
    listed = own.select("query_id", F.posexplode(others).alias("at", "b"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector of ``embeddings`` among all others, see ``nearest_vectors``."""
    return nearest_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score, c.r AS other FROM v q JOIN v c ON len(q.x) = len(c.x) AND q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM pairs) WHERE rank <= 20
"""
