"""Operator 7, suffix-array dedup with sparse suffixes.

Suffixes are kept at minimiser positions only: the smallest shingle of every ``WINDOW`` consecutive ones, so every passage
of ``PASSAGE`` words holds one among its first ``WINDOW`` words, with ``PREFIX`` of the passage's words still to come.
They are sorted by the rank of their first PREFIX words and then by their surroundings, all words of the passages that
hold the minimiser there, and neighbours are compared.  Where suffixes of equal rank differ around it, those that differ
(one of each kind) are ranked again by every passage that holds the minimiser, so equal ranks mean an equal passage, and
neighbours in that order are linked.  Links on one alignment are joined and extended to the left and right, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, forget, lookup, table
from .tokens import PLACE, RUNS, Words, link_equal_runs, mix, run_batch, sliding_min, span_hashes, text_chunks, word_slices

PASSAGE, SHINGLE, WINDOW = 50, 5, 16
#: Words after a passage's first minimiser that are certain to belong to it.
PREFIX = PASSAGE - WINDOW + 1
#: Words that a match is extended by at either end at most.  What matches beyond holds minimisers of its own, whose
#: passages are linked to the nearest document there, if to another one.
REACH = 2 * WINDOW


def suffixes(docs: DataFrame) -> DataFrame:
    """RUNS: minimiser positions ``at`` with the rank ``key`` of their first PREFIX words; passages that hold the minimiser
    start from at + low to at + high.  Texts of any length; of equal shingles the first is the minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            words = Words(texts)
            shingles = words.runs(SHINGLE)
            own = words.whole(WINDOW + SHINGLE - 1)
            if not len(own):
                continue
            packed = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) & ~PLACE) | np.arange(len(shingles), dtype=np.uint64)
            at = np.unique((sliding_min(packed, WINDOW) & PLACE).astype(np.int64)[own])
            key = words.runs(PREFIX)
            at = at[at < len(key)]
            at = at[words.whole(PREFIX)[at]]
            doc = words.doc[at]
            low = np.maximum(words.first[doc] - at, 1 - WINDOW)
            high = np.minimum(words.first[doc + 1] - at - PASSAGE, 0)
            fits = low <= high
            at, doc, low, high = at[fits], doc[fits], low[fits], high[fits]
            if len(at):
                covered = span_hashes(words.hashes, at + low, at + high + PASSAGE)
                yield run_batch(part.column(0), doc, key[at], low, high, covered, at - words.first[doc])

    return docs.mapInArrow(run, RUNS)


def passage_ranks(docs: DataFrame, variants: DataFrame) -> DataFrame:
    """RUNS with one row for every passage of ``variants`` (RUNS), the key being a hash of the passage and its place."""
    places = variants.select("doc_id", (F.col("at") + F.col("low")).alias("at"), (F.col("high") - F.col("low") + PASSAGE).alias("n"), F.struct("at", "low").alias("tag"))

    def ranks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = batch.column("n").to_numpy().astype(np.int64)
        flat = np.frombuffer(b"".join(batch.column("slice").to_pylist()), "<u4").astype(np.uint64)
        starts = sizes - PASSAGE + 1
        each = np.repeat(np.arange(len(sizes)), starts)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(starts) - starts, starts)
        first = np.repeat(np.cumsum(sizes) - sizes, starts) + nth
        at, low = (column.to_numpy().astype(np.int64)[each] for column in batch.column("tag").flatten())
        low = low + nth
        ranks = mix(span_hashes(mix(flat), first, first + PASSAGE) ^ (low + (1 << 20)).astype(np.uint64))
        yield run_batch(batch.column("doc_id"), each, ranks, low, low, np.zeros(len(low), np.int64), at)

    return word_slices(docs, places, 0, ranks, RUNS)


def links_of(told: DataFrame) -> DataFrame:
    """(doc_id, other, diagonal, a, b): equal words [a, b) of the rows of ``link_equal_runs`` that have a partner."""
    return told.where("other is not null").select("doc_id", "other", (F.col("at") - F.col("o_at")).alias("diagonal"), (F.col("at") + F.col("low")).alias("a"), (F.col("at") + F.col("high") + PASSAGE).alias("b"))


def chained(told: DataFrame) -> DataFrame:
    """Links between the few rows of a key that stood next to the ends of partitions, each with the one before it."""
    order = Window.partitionBy("key").orderBy("doc_id", "at")
    edges = told.where("other is null").select("*", F.lag("doc_id").over(order).alias("p_doc"), F.lag("at").over(order).alias("p_at")).where("p_doc < doc_id")
    return links_of(edges.withColumn("other", F.col("p_doc")).withColumn("o_at", F.col("p_at")).select(*told.columns))


def islands(links: DataFrame) -> DataFrame:
    """(doc_id, other, diagonal, a, b): links on one alignment that overlap or touch, joined."""
    merged = F.expr("""
        aggregate(parts, cast(array() as array<struct<a:int,b:int>>),
          (done, x) -> if(size(done) > 0 and x.a <= element_at(done, -1).b,
            concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).a as a, greatest(element_at(done, -1).b, x.b) as b))),
            concat(done, array(struct(x.a as a, x.b as b)))))""")
    part = F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    parts = links.groupBy("doc_id", "other", F.col("diagonal").cast("int").alias("diagonal")).agg(F.sort_array(F.collect_set(part)).alias("parts"))
    return parts.select("doc_id", "other", "diagonal", F.explode(merged).alias("part")).select("doc_id", "other", "diagonal", "part.a", "part.b")


def extended(docs: DataFrame, found: DataFrame, reach: int = REACH) -> DataFrame:
    """``found`` with [a, b) grown by up to ``reach`` equal words at either end."""
    mine = found.select("doc_id", F.explode(F.array("a", "b")).alias("at"))
    theirs = found.select(F.col("other").alias("doc_id"), F.explode(F.array(F.col("a") - F.col("diagonal"), F.col("b") - F.col("diagonal"))).alias("at"))
    places = mine.union(theirs).distinct().select("doc_id", "at", F.lit(reach).alias("n"), F.lit(0).alias("tag"))
    slices = cut(word_slices(docs, places, reach), "ends")

    def at_place(doc: str, place: str, name: str) -> DataFrame:
        return slices.select(F.col("doc_id").alias(doc), F.col("at").alias(place), F.col("slice").alias(name))

    whole = found.withColumn("oa", F.col("a") - F.col("diagonal")).withColumn("ob", F.col("b") - F.col("diagonal"))
    whole = whole.join(at_place("doc_id", "a", "left_own"), ["doc_id", "a"]).join(at_place("doc_id", "b", "right_own"), ["doc_id", "b"])
    whole = whole.join(at_place("other", "oa", "left_other"), ["other", "oa"]).join(at_place("other", "ob", "right_other"), ["other", "ob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, 2 * reach) for c in ("left_own", "left_other", "right_own", "right_other")]
            same = [(a == b) & (a != 0) for a, b in zip(pieces[::2], pieces[1::2])]
            left = np.cumprod(same[0][:, :reach][:, ::-1], axis=1).sum(1)
            right = np.cumprod(same[1][:, reach:], axis=1).sum(1)
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            grown = [(a - left).astype(np.int32), (b + right).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "other", "diagonal")], *map(pa.array, grown)], ["doc_id", "other", "diagonal", "a", "b"])

    return whole.select("doc_id", "other", "diagonal", "a", "b", "left_own", "left_other", "right_own", "right_other").mapInArrow(run, "doc_id long, other long, diagonal int, a int, b int")


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_words, other, other_start): passages of at least PASSAGE words that two documents share exactly.

    Words are compared with A-Z lowered.  Every passage that a document shares with others lies in a row of it, as
    ``doc_id`` or ``other``, and the documents that share a passage are linked by a chain of rows over it.  Shorter, null
    and empty texts give nothing; very long texts are whole; an empty table gives no rows; repeats inside one document
    are not told; rows without an id are left out; rows with one id are one document, each text of which is held against
    other documents; repeated rows say nothing new; other columns are ignored.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    told = cut(link_equal_runs(suffixes(rows)), "suffixes")
    shared = cut(told.where("other is null").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("n > 1 and a < b").select("key", "n"), "keys")
    variants = lookup(told.where("other is null"), shared, ["key"], "n").select(*told.columns)
    ranked = cut(link_equal_runs(passage_ranks(rows, variants)), "ranked")
    found = cut(islands(links_of(told).union(links_of(ranked)).union(chained(ranked))), "islands")
    forget(told, shared, ranked)
    return islands(extended(rows, found)).select("doc_id", F.col("a").alias("start"), (F.col("b") - F.col("a")).alias("n_words"), "other", (F.col("a") - F.col("diagonal")).alias("other_start"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repeated_substrings`` of all documents: see there for nulls, repeats, empty and very long texts and columns."""
    return repeated_substrings(table(spark, sf_dir, "documents"))
