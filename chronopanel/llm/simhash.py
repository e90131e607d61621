"""Operator 8, SimHash near-duplicates: segment-popcount embedding and a grid range join.

Fingerprints at Hamming distance d have per-segment bit counts at Manhattan distance at most d.  The counts (32 segments
of two bits, packed in one long) are cut into ``max_distance + 3`` blocks; two vectors within the distance agree in all
but ``max_distance`` blocks, so they meet in a grid cell made of the other blocks.  The join on cells then applies the
Manhattan bound and the exact Hamming distance.  Cells with many members are split further, by the bits behind the
counts.  Only distinct fingerprints take part, so copies cost nothing here.

``similar_components`` links texts by the similarity of their shingles instead: the same counts in more and wider cells
give the candidates, and the shingles of both texts decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, forget, lookup, table, unique_ids
from .tokens import Words, span_hashes, text_chunks

PAIRS = 0x5555555555555555
#: Cells with more members than this are split by blocks of their bits.
CROWD = 256
#: Blocks of bits in a split; what is left of a cell differs in ``max_distance`` blocks only, 256 fingerprints for two bits.
SPLIT = 16


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of one text, as an unsigned integer; 0 where there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    width = min(width, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), (starts[width:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), np.uint64, len(first))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per input row, null and word-less texts with fingerprint 0; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_signed(fingerprint(t.as_py(), width, seed)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, packed two bits each."""
    upper = F.shiftrightunsigned(fp, 1)
    both, one = fp.bitwiseAND(upper).bitwiseAND(F.lit(PAIRS)), fp.bitwiseXOR(upper).bitwiseAND(F.lit(PAIRS))
    return F.shiftleft(both, 1).bitwiseOR(one)


def manhattan(a: Column, b: Column) -> Column:
    total = F.lit(0)
    for k in range(32):
        total = total + F.abs(F.shiftrightunsigned(a, 2 * k).bitwiseAND(F.lit(3)) - F.shiftrightunsigned(b, 2 * k).bitwiseAND(F.lit(3)))
    return total


def cell_masks(max_distance: int) -> list[int]:
    """A mask for each choice of ``max_distance`` blocks to leave out."""
    blocks = np.array_split(np.arange(32), max_distance + 3)
    bits = [sum(3 << (2 * int(k)) for k in block) for block in blocks]
    return [_signed(sum(bits) - sum(bits[k] for k in out)) for out in combinations(range(len(bits)), max_distance)]


def split_masks(max_distance: int) -> list[int]:
    """A mask of the bits left when ``max_distance`` of ``SPLIT`` blocks are taken out, for each choice of them."""
    size = 64 // SPLIT
    block = [((1 << size) - 1) << (size * k) for k in range(SPLIT)]
    return [_signed(sum(block) - sum(block[k] for k in out)) for out in combinations(range(SPLIT), max_distance)]


def first_mask(differ: Column, masks: list[int]) -> Column:
    """The first of the masks in which two values don't differ, so a pair that meets in several is taken once."""
    first = F.lit(len(masks))
    for k in reversed(range(len(masks))):
        first = F.when(differ.bitwiseAND(F.lit(masks[k])) == 0, F.lit(k)).otherwise(first)
    return first


def fingerprint_links(fps: DataFrame, max_distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links (a, b), each once: all pairs of distinct values of ``fps.fp`` within the distance.

    A cell of more than ``crowd`` members is split: its members that differ in ``max_distance`` blocks of bits at most
    meet, and such a part has a bounded number of fingerprints whatever the data."""
    masks, splits = cell_masks(max_distance), split_masks(max_distance)
    nodes = fps.select("fp", popcounts(F.col("fp")).alias("v"))
    cells = cut(nodes.select("fp", "v", F.posexplode(F.array(*[F.col("v").bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell")), "cells")
    sizes = cut(cells.groupBy("grid", "cell").count().where("count > 1"), "cellsizes")
    few = cells.join(sizes.where(F.col("count") <= crowd).select("grid", "cell"), ["grid", "cell"]).select("grid", "cell", F.lit(-1).alias("split"), F.lit(0).cast("long").alias("bits"), "fp", "v")
    many = cells.join(sizes.where(F.col("count") > crowd).select("grid", "cell"), ["grid", "cell"])
    many = many.select("grid", "cell", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in splits])).alias("split", "bits"), "fp", "v")
    keys = ["grid", "cell", "split", "bits"]
    shared = few.union(many)
    left = shared.select(*keys, F.col("fp").alias("a"), F.col("v").alias("va"))
    right = shared.select(*keys, F.col("fp").alias("b"), F.col("v").alias("vb"))
    met = left.join(right, keys).where(F.col("a") < F.col("b"))
    met = met.where((manhattan(F.col("va"), F.col("vb")) <= max_distance) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance))
    once = F.col("grid") == first_mask(F.col("va").bitwiseXOR(F.col("vb")), masks)
    return met.where(once).select("a", "b").distinct()


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, max_distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most ``max_distance`` bits.

    Every input row gives a row (repeated ids too); an empty table gives none.  Documents with equal fingerprints are
    linked; null, empty and word-less texts have fingerprint 0 and are linked like any other.  A row without an id is in
    the component of its fingerprint, whose id is null only if no row of it has one.  Texts of any length are read
    whole; other columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width, seed), "prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "fpnodes")
    comps = connected_components(fingerprint_links(nodes, max_distance, crowd))
    labelled = nodes.join(comps, nodes.fp == comps.node, "left").select("fp", "first_doc", "n", F.coalesce("component", "fp").alias("component"))
    firsts = labelled.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of_fp = cut(labelled.join(firsts, "component").select("fp", "n", "component_id"), "offp")
    return lookup(prints, of_fp, ["fp"], "n").select("doc_id", "fp", "component_id")


#: Bits in which fingerprints of texts of similarity 0.8 differ at most, but for one pair in fifty.
FAR = 16
#: Members of a candidate cell up to which all its pairs are looked at.
FEW = 32
_CELL = ["key", "row", "fp"]


def wide_masks(texts: int, agreement: float = 0.73, recall: float = 0.98) -> list[int]:
    """Masks of segments, drawn with a fixed seed, for cells with a few of ``texts`` members by chance.

    At similarity 0.8 a segment's count agrees with a chance of ``agreement``; there are enough masks for ``recall``."""
    width = int(np.clip(np.ceil((np.log2(max(2, texts)) - 2) / 1.5), 4, 24))
    draw = np.random.default_rng(8)
    number = int(np.ceil(np.log(1 - recall) / np.log(1 - agreement**width)))
    return [_signed(sum(3 << (2 * int(k)) for k in draw.choice(32, width, replace=False))) for _ in range(number)]


def cell_pairs(cells: DataFrame, far: int) -> DataFrame:
    """(key, row, fp, other) from cells (key, row, fp): pairs within ``far`` bits of cells with up to FEW members, and
    the rows of larger cells, and of cells at the ends of a partition, with a null ``other``.  One sort, streamed."""

    def told(rows: list[np.ndarray], open_left: bool, open_right: bool) -> pa.RecordBatch:
        key, row, fp = rows
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        starts = np.nonzero(first)[0]
        size = np.diff(np.concatenate([starts, [len(key)]]))
        crowd = size > FEW
        crowd[0] |= open_left
        crowd[-1] |= open_right
        of = np.cumsum(first) - 1
        pairs = []
        for step in range(1, FEW):
            i = np.nonzero((of[step:] == of[:-step]) & ~crowd[of[step:]])[0]
            near = np.bitwise_count((fp[i] ^ fp[i + step]).view(np.uint64)) <= far
            pairs.append((i[near], i[near] + step))
        alone = np.nonzero(crowd[of])[0]
        a, b = (np.concatenate([*[p[k] for p in pairs], alone]) for k in (0, 1))
        none = np.concatenate([np.zeros(len(a) - len(alone), bool), np.ones(len(alone), bool)])
        return pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(row[a]), pa.array(fp[a]), pa.array(row[b], mask=none)], [*_CELL, "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, open_left = [], 0, True
        for batch in batches:
            parts.append([batch.column(c).to_numpy() for c in _CELL])
            size += batch.num_rows
            if size < 1 << 18:
                continue
            rows = [np.concatenate(x) for x in zip(*parts)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            hot = last == 0  # one cell fills the block: its rows are let go as they are
            yield told(rows if hot else [x[:last] for x in rows], open_left, hot)
            parts, size, open_left = ([], 0, True) if hot else ([[x[last:] for x in rows]], size - last, False)
        if size:
            yield told([np.concatenate(x) for x in zip(*parts)], open_left, True)

    return cells.repartitionByRange(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(run, "key long, row long, fp long, other long")


def alike_pairs(texts: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows whose sets of word shingles have the similarity.  texts: row, text."""
    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    sets = cut(shingle_sets(texts.join(wanted, "row").select("row", "text"), width), "shingles")
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    good = cut(both.where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"), "alike")
    forget(sets)
    return good


def ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def each_set(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    """Slices of batches (row, text) with the distinct word shingles of each text, as sorted hashes; fewer words than ``width``
    are one shingle."""

    def sets(words: Words, n: int) -> Iterator[np.ndarray]:
        for k in range(n):
            own = words.hashes[words.first[k] : words.first[k + 1]]
            m = min(width, len(own))
            first = np.arange(len(own) - m + 1)
            yield np.unique(span_hashes(own, first, first + m))

    for part, chunk in text_chunks(batches):
        yield part, sets(Words(chunk), len(chunk))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(row, shingles) of texts (row, text), see ``each_set``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in each_set(batches, width):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["row", "shingles"])

    return texts.mapInArrow(run, "row long, shingles array<bigint>")


#: Slots by which shingles are counted, so the counts are of a fixed size whatever the input's.
SLOTS = 1 << 18


def slot_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many texts have a shingle of each slot: two megabytes, whatever is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for _, sets in each_set(batches, width):
            slots = [x & np.uint64(SLOTS - 1) for x in sets]
            total += np.bincount(np.concatenate(slots).astype(np.int64), minlength=SLOTS) if slots else 0
        slots = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for slot, n in texts.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[slot] = n
    return out


def rarest_shingles(texts: DataFrame, counts: np.ndarray, width: int, similarity: float) -> DataFrame:
    """(row, size, shingle): of each text the rarest shingles by their slots' counts, as many as are left when ``similarity``
    of all are taken away, and one more.  Two texts that are alike have one of these in common, as any order of all
    shingles would do for that; this one keeps those of common passages out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in each_set(batches, width):
            kept, size = [], []
            for x in sets:
                n = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1 if len(x) else 0
                order = np.lexsort((x, counts[(x & np.uint64(SLOTS - 1)).astype(np.int64)]))
                kept.append(x[order[:n]].view(np.int64))
                size.append(len(x))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int32()), pa.array(kept, pa.list_(pa.int64()))], ["row", "size", "shingles"])

    found = texts.mapInArrow(run, "row long, size int, shingles array<bigint>")
    return found.select("row", "size", F.explode("shingles").alias("shingle"))


def crowd_links(rows: DataFrame, crowd: DataFrame, found: DataFrame, far: int, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that join what ``found`` does and all texts of crowded cells that are alike; crowd: key, row, fp.

    Each text meets the first of its cell, which settles groups of near copies.  Then all pairs within ``far`` bits are found,
    whatever cells they share: two texts that are alike have one of their rarest shingles in common, those that are left
    when ``similarity`` of a text's shingles are taken away.  Texts meet by these, and only where they aren't joined yet, so
    a group that is one component costs nothing more however large it is."""
    heads = cut(crowd.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("row", "fp")).alias("head")).select("key", "n", F.col("head.row").alias("other"), F.col("head.fp").alias("o_fp")), "heads")
    pairs = lookup(crowd, heads, ["key"], "n").where((F.col("row") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("o_fp"))) <= far))
    good = alike_pairs(rows, pairs.select(*ordered(F.col("row"), F.col("other"))).distinct(), width, similarity)
    joined = connected_components(found.union(good))
    members = crowd.select("row", "fp").distinct()
    keys = rarest_shingles(rows.join(members, "row").select("row", "text"), slot_counts(rows, width), width, similarity)
    keys_of = cut(keys.join(members, "row").join(joined.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row")), "rare")
    several = keys_of.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    keys = keys_of.join(several, "shingle")
    theirs = keys.select("shingle", F.col("row").alias("other"), F.col("fp").alias("o_fp"), F.col("size").alias("o_size"), F.col("component").alias("o_component"))
    apart = (F.col("component") < F.col("o_component")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("o_fp"))) <= far)
    near = keys.join(theirs, "shingle").where(apart & (F.least("size", "o_size") >= F.lit(similarity) * F.greatest("size", "o_size") - 1e-9))
    more = alike_pairs(rows, near.select(*ordered(F.col("row"), F.col("other"))).distinct(), width, similarity)
    forget(heads, keys_of)
    return joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, seed: int = 42, far: int = FAR) -> DataFrame:
    """(doc_id, component_id): the smallest id reachable over links between texts whose word shingles have the similarity.

    Ids are unique and not null (see ``unique_ids``).  Equal texts are always linked, texts without words with equal ones
    only; texts of fewer words than ``width`` are one shingle.  Of a pair at the similarity itself, one in ten or so is not
    among the candidates; far fewer of more similar ones.  In cells of up to FEW texts all pairs are looked at; the texts of
    all larger cells are joined by ``crowd_links``, which misses none of them within ``far`` bits."""
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    prints = fingerprints(docs, id_col, text_col, width, seed).select(F.col("doc_id").alias("row"), "fp")
    copies = rows.select("row", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("copy"))
    classes = cut(copies.groupBy("copy").agg(F.min("row").alias("first"), F.count("*").alias("n")), "classes")
    nodes = cut(prints.where("fp <> 0").join(classes.select(F.col("first").alias("row")), "row"), "textnodes")
    texts = nodes.count()
    masks = wide_masks(texts)
    counts = popcounts(F.col("fp"))
    cells = nodes.withColumn("v", counts).select(F.posexplode(F.array(*[F.col("v").bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell"), "row", "fp").select(F.xxhash64("grid", "cell").alias("key"), "row", "fp")
    met = cut(cell_pairs(cells, far), "cellpairs")
    # cells that lie at the end of a partition are told as crowds too; which do depends on the layout, so the small ones of
    # them are treated as small ones elsewhere are
    apart = cut(met.where("other is null").select(*_CELL), "apart")
    sized = lookup(apart, cut(apart.groupBy("key").agg(F.count("*").alias("n")), "cellsizes"), ["key"], "n")
    small = sized.where(F.col("n") <= FEW)
    theirs = small.select("key", F.col("row").alias("other"), F.col("fp").alias("o_fp"))
    near = small.join(theirs, "key").where((F.col("row") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("o_fp"))) <= far))
    pairs = met.where("other is not null").select(*ordered(F.col("row"), F.col("other"))).union(near.select(F.col("row").alias("a"), F.col("other").alias("b")))
    found = alike_pairs(rows, pairs.distinct(), width, similarity)
    crowd = cut(sized.where(F.col("n") > FEW).select(*_CELL), "crowd")
    comps = connected_components(crowd_links(rows, crowd, found, far, width, similarity))
    of = classes.join(comps, classes["first"] == comps["node"], "left").select("copy", "n", F.coalesce("component", "first").alias("component_id"))
    return lookup(copies, cut(of, "ofcopy"), ["copy"], "n").select(F.col("row").alias("doc_id"), "component_id")


def first_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` of each component of similar texts, that with the smallest id, with all its columns.

    Rows are told apart even if they have no id or share one; those come after the others.  Repeated rows, null and empty
    texts are copies of each other; an empty table gives none."""
    rows = unique_ids(docs, id_col)
    kept = similar_components(rows, "__row", text_col, **options).where("doc_id = component_id").select(F.col("doc_id").alias("__row"))
    return rows.join(kept, "__row").select(*docs.columns)


def hex64(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicate_components`` of all documents: see there for nulls, repeats, empty and long texts and columns."""
    found = near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
