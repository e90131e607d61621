"""Operator 3, benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to k = m // 16 edits.  It is split into k + 1 pieces: an occurrence within
the budget holds at least one of them unchanged.  Items are written to the shared folder in blocks of bounded size, and
tasks read them from there; documents are scanned once, and around each hit of a piece Myers' bit-parallel distance
decides whether the item ends there within its budget.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 16
#: Characters of items in a block, and the blocks that a worker keeps ready; further ones are built anew for each CHUNK
#: bytes of text.
BLOCK_CHARS, READY, CHUNK = 1 << 20, 8, 1 << 25
_GAPS = re.compile(r"[\W_]+")
MATCHES = "doc_id long, item_id long, distance int, budget int, start long, stop long"


def normalize(text: str | None) -> str:
    """Lower case, with every run of other characters than letters and digits as one space."""
    return _GAPS.sub(" ", (text or "").lower()).strip()


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(smallest edit distance of the whole pattern to a substring of text, end of the first such substring).

    ``anchored``: only substrings from the start of the text on."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << k)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, at = full, 0, m, m, 0
    for k, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, at = score, k
        up, down = ((up << 1) | anchored) & full, (down << 1) & full
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
    return best, at


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 consecutive pieces of nearly equal length, with their offsets."""
    bounds = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


class Matcher:
    def __init__(self, items: tuple[tuple[int, str], ...], chars_per_edit: int):
        self.items = [(i, text, len(text) // chars_per_edit) for i, text in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                found.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.known: dict[tuple[int, str], tuple[int, int]] = {}

    def distance(self, k: int, window: str) -> tuple[int, int]:
        if (got := self.known.get((k, window))) is None:
            if len(self.known) > 20_000:
                self.known.clear()
            at = window.find(self.items[k][1])
            got = self.known[k, window] = (0, at + len(self.items[k][1])) if at >= 0 else myers(self.items[k][1], window)
        return got

    def start(self, k: int, text: str, distance: int, stop: int) -> int:
        """Where an occurrence that ends at ``stop`` begins: the last place from which it is ``distance`` away from the item."""
        _, item, budget = self.items[k]
        if not distance:
            return stop - len(item)
        before = text[max(0, stop - len(item) - budget) : stop]
        return stop - myers(item[::-1], before[::-1], anchored=True)[1]

    def matches(self, text: str) -> dict[int, tuple[int, int]]:
        """{item: (distance, stop)} of the best occurrence within budget of each item, in normalized text."""
        if not len(self.automaton):
            return {}
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                starts.setdefault(k, set()).add(end + 1 - size - offset)
        out = {}
        for k, at in starts.items():
            _, item, budget = self.items[k]
            best, low, high = None, None, None
            for start in [*sorted(at), None]:
                if start is not None and high is not None and start <= high + budget:
                    high = start
                    continue
                if low is not None:
                    a = max(0, low - budget)
                    distance, stop = self.distance(k, text[a : high + len(item) + budget])
                    if distance <= budget and (best is None or distance < best[0]):
                        best = (distance, a + stop)
                low = high = start
            if best:
                out[k] = best
        return out


def write_items(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> str:
    """A folder of Parquet files with normalized items, a block a row; items without an id or without letters are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if item is None or not (text := normalize(text)):
                    continue
                block.append({"item": item, "text": text})
                size += len(text)
                if size >= block_chars:
                    yield pa.RecordBatch.from_pylist([{"block": block}], BLOCKS)
                    block, size = [], 0
        if block:
            yield pa.RecordBatch.from_pylist([{"block": block}], BLOCKS)

    items = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return cut(items.mapInArrow(run, "block array<struct<item:long,text:string>>"), "items")._chronopanel_path


BLOCKS = pa.schema([("block", pa.list_(pa.struct([("item", pa.int64()), ("text", pa.string())])))])


@lru_cache(maxsize=1)
def block_places(folder: str) -> tuple[tuple[str, int], ...]:
    """(file, row group) of all blocks of a folder, in the order of names."""
    fs, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    names = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(base)) if x.base_name.endswith(".parquet"))
    return tuple((name, k) for name in names for k in range(pq.ParquetFile(fs.open_input_file(name)).num_row_groups))


@lru_cache(maxsize=READY)
def matchers(folder: str, place: tuple[str, int], chars_per_edit: int) -> tuple[Matcher, ...]:
    fs, _ = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    rows = pq.ParquetFile(fs.open_input_file(place[0])).read_row_group(place[1]).column("block").to_pylist()
    return tuple(Matcher(tuple((x["item"], x["text"]) for x in block), chars_per_edit) for block in rows)


def text_parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with about CHUNK bytes of normalized text each."""
    for batch in batches:
        texts, size, start = [], 0, 0
        for k, value in enumerate(batch.column(column)):
            texts.append(normalize(value.as_py()))
            size += len(texts[-1])
            if size >= CHUNK:
                yield batch.slice(start, k + 1 - start), texts
                texts, size, start = [], 0, k + 1
        if texts:
            yield batch.slice(start), texts


def contamination(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, budget, start, stop): the best occurrence of each item in each row of ``docs``.

    Offsets are in the normalized text.  Items are a stated query set, held against all rows.  Null and empty texts match
    nothing, nor do items without an id or without letters; repeated rows each give their matches, those without an id
    with a null one; very long texts are read whole; empty tables give no rows; extra columns are ignored.  Every
    occurrence within the budget is found: pieces are exact and nothing is capped.  An occurrence may begin and end inside
    words; items of fewer than ``chars_per_edit`` characters have no budget.
    """
    folder = write_items(benchmark, item_col, item_text, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_parts(batches, "text"):
            ids, rows = part.column(0).to_pylist(), []
            for place in block_places(folder):
                for engine in matchers(folder, place, chars_per_edit):
                    for doc, text in zip(ids, texts):
                        for k, (distance, stop) in engine.matches(text).items():
                            rows.append((doc, engine.items[k][0], distance, engine.items[k][2], engine.start(k, text, distance, stop), stop))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], ["doc_id", "item_id", "distance", "budget", "start", "stop"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, MATCHES)


def clean_documents(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without an occurrence of an item, with all their columns; a row is judged by its own text, so ids
    may be missing or repeated.  Null and empty texts are clean."""
    folder = write_items(benchmark, item_col, item_text, block_chars)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_parts(batches, "__text"):
            clean = np.ones(len(texts), bool)
            for place in block_places(folder):
                for engine in matchers(folder, place, chars_per_edit):
                    for k in np.nonzero(clean)[0]:
                        clean[k] = not engine.matches(texts[k])
            yield part.select(range(len(names))).filter(pa.array(clean))

    schema = docs.schema
    return docs.withColumn("__text", F.col(text_col).cast("string")).mapInArrow(run, schema)


KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contamination`` of all documents by all items: see there for nulls, repeats, empty and long texts and columns."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
