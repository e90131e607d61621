"""Words of many texts at once as numpy arrays, and streams of passages sorted by signature."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes or words that are hashed in one go, which bounds the memory that a very long text takes.
BLOCK = 1 << 20
#: Bits of a word's position: a string of Spark has fewer than 2**31 bytes, so fewer than 2**30 words.
PLACE_BITS = 30
PLACE = np.uint64((1 << PLACE_BITS) - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=2)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k for k < 2**bits, modulo 2**64."""
    up, down = np.full(1 << bits, BASE, np.uint64), np.full(1 << bits, BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(values: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of ``values[a:b]`` for each a in ``first`` (ascending) and b in ``stop``, block by block."""
    out = np.empty(len(first), np.uint64)
    done = 0
    while done < len(first):
        a = int(first[done])
        own = slice(done, max(done + 1, int(np.searchsorted(first, a + BLOCK))))
        b = int(stop[own].max(initial=a))
        up, down = powers(max(20, int(b - a + 1).bit_length()))
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[a:b] * up[: b - a], out=total[1:])
        low, high = first[own] - a, stop[own] - a
        out[own] = mix((total[high] - total[low]) * down[low] + (high - low).astype(np.uint64))
        done = own.stop
    return out


class Words:
    """Words (between white space, A-Z lowered) of a list of texts, concatenated.

    doc: index of each word's text; first: index of each text's first word, with the total at the end; hashes; starts and
    stops: byte offsets in the text's own UTF-8 form.  Texts of any length: only the words' own arrays grow with them.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        space = _SPACE[raw]
        starts, stops = np.nonzero(space[:-1] & ~space[1:])[0] + 1, np.nonzero(~space[:-1] & space[1:])[0] + 1
        offsets = np.cumsum([1, *[len(t) + 1 for t in texts]])
        self.first = np.searchsorted(starts, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = np.empty(len(starts), np.uint64)
        done = 0
        while done < len(starts):  # a block ends with a word, so a word longer than a block is a block of its own
            a = int(starts[done])
            upto = max(done + 1, int(np.searchsorted(stops, a + BLOCK)))
            b = int(stops[upto - 1])
            self.hashes[done:upto] = span_hashes(_LOWER[raw[a:b]].astype(np.uint64) + np.uint64(1), starts[done:upto] - a, stops[done:upto] - a)
            done = upto
        self.starts, self.stops = starts - offsets[self.doc], stops - offsets[self.doc]

    def runs(self, width: int) -> np.ndarray:
        """A hash of the ``width`` words from each word on (over text ends too, see ``whole``)."""
        first = np.arange(max(0, len(self.hashes) - width + 1))
        return span_hashes(self.hashes, first, first + width)

    def whole(self, width: int) -> np.ndarray:
        """Whether the ``width`` words from each word on lie in one text."""
        m = max(0, len(self.doc) - width + 1)
        return self.doc[:m] == self.doc[width - 1 : width - 1 + m]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    n = len(x) - width + 1
    return out[:n] if size == width else np.minimum(out[:n], out[width - size : width - size + n])


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches (text in column 1) with about ``limit`` bytes of text each; null texts are empty."""
    for batch in batches:
        texts, size, start = [], 0, 0
        for k, value in enumerate(batch.column(1)):
            texts.append((value.as_py() or "").encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= limit:
                yield batch.slice(start, k + 1 - start), texts
                texts, size, start = [], 0, k + 1
        if texts:
            yield batch.slice(start), texts


RUNS = "key long, low short, high short, words long, doc_id long, at int"
_ORDER = ["key", "low", "high", "words", "doc_id", "at"]
_KINDS = (np.int64, np.int16, np.int16, np.int64, np.int64, np.int32)


def run_batch(ids: pa.Array, doc: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray, words: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    columns = [key.view(np.int64), low.astype(np.int16), high.astype(np.int16), words.view(np.int64)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), ids.take(pa.array(doc)), pa.array(at.astype(np.int32))], _ORDER)


def link_equal_runs(runs: DataFrame, hold: int = 1 << 18) -> DataFrame:
    """What the sorted order of ``runs`` (RUNS) tells: equal runs as links, and the different ones of a shared key.

    A run stands for the passages that start from at + low to at + high of a document; ``words`` is a hash of all words
    it covers.  Runs are sorted by key and words over range partitions, which part a common key as often as needed, and
    neighbours are compared: a run with the words of runs before it gets a row with ``other`` and ``o_at``, a place of
    the first document with them there (of periodic text, the place with the same count within the document).  The first
    run of each words, where its key has several, is a row without ``other``; so are those next to the ends of a partition
    and, in a key of more than ``hold`` rows, one in so many.  Keys of one document are left out.  Needs ``hold`` rows of
    memory."""

    def told(rows: list[np.ndarray], open_left: bool, open_right: bool) -> pa.RecordBatch | None:
        key, low, high, words, doc, at = rows
        n = len(key)
        first = np.ones(n, bool)
        first[1:] = key[1:] != key[:-1]
        variant = first.copy()
        for x in (low, high, words):
            variant[1:] |= x[1:] != x[:-1]
        own = variant.copy()
        own[1:] |= doc[1:] != doc[:-1]
        starts = np.nonzero(first)[0]
        several = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
        many = np.add.reduceat(variant.astype(np.int64), starts) > 1
        several[0] |= open_left
        many[0] |= open_left
        several[-1] |= open_right
        many[-1] |= open_right
        group = np.cumsum(first) - 1
        # places of one document with the same words, and those of the first document with them: the nth against its nth
        heads = np.nonzero(own)[0]
        mine = np.cumsum(own) - 1
        size = np.diff(np.concatenate([heads, [n]]))
        lead = np.nonzero(variant[heads])[0][np.cumsum(variant[heads]) - 1]
        before = np.where(variant[heads], -1, heads[lead])
        partner = before[mine] + (np.arange(n) - heads[mine]) % size[lead][mine]
        linked = (before[mine] >= 0) & several[group]
        kept = np.nonzero(linked | (variant & several[group] & many[group]))[0]
        if not len(kept):
            return None
        other, o_at = pa.array(doc[partner[kept]], mask=~linked[kept]), pa.array(at[partner[kept]], mask=~linked[kept])
        return pa.RecordBatch.from_arrays([*[pa.array(x[kept]) for x in rows], other, o_at], [*_ORDER, "other", "o_at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        size, open_left = 0, True
        for batch in batches:
            parts.append([batch.column(c).to_numpy().astype(t, copy=False) for c, t in zip(_ORDER, _KINDS)])
            size += batch.num_rows
            if size < hold:
                continue
            rows = [np.concatenate(x) for x in zip(*parts)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on in the next batch
            hot = last == 0
            out = told([x[:last] for x in rows] if not hot else rows, open_left, hot)
            open_left = hot
            parts = [] if hot else [[x[last:] for x in rows]]
            size = 0 if hot else size - last
            if out is not None:
                yield out
        if size:
            out = told([np.concatenate(x) for x in zip(*parts)], open_left, True)
            if out is not None:
                yield out

    ordered = runs.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    return ordered.mapInArrow(run, RUNS + ", other long, o_at int")


def word_slices(docs: DataFrame, places: DataFrame, before: int, then: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None, schema: str = "", rows: int = 10_000) -> DataFrame:
    """``places`` (doc_id, at, n, tag) with ``slice``: packed 32-bit hashes of the words [at - before, at + n).

    Places outside the text are zeros.  Places go to their document in one join, and each comes back with its slice;
    rows of ``docs`` that share a doc_id each give one.  ``then`` makes rows of ``schema`` of up to ``rows`` of these at a
    time in the same worker, as a second function behind the first would hold a worker of its own in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for part, texts in text_chunks(batches):
            words = Words(texts)
            low = (words.hashes & np.uint64(0xFFFFFFFF)).astype("<u4")
            sizes = np.diff(part.column(2).offsets.to_numpy())
            flat = part.column(2).flatten()
            kind = kind or flat.type
            at, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            owner, slices = np.repeat(np.arange(len(texts)), sizes), []
            for k, a, m in zip(owner.tolist(), at.tolist(), n.tolist()):
                first, last = int(words.first[k]), int(words.first[k + 1])
                lo, hi = min(max(first, first + a - before), last), max(first, min(last, first + a + m))
                own = low[lo:hi].tobytes()
                lead = min(max(0, before - a), before + m) * 4
                slices.append((b"\0" * lead + own).ljust((before + m) * 4, b"\0"))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), *[flat.field(k) for k in range(3)], pa.array(slices, pa.binary())], ["doc_id", "at", "n", "tag", "slice"])

    tag = places.schema["tag"].dataType.simpleString()
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), F.col("n").cast("int").alias("n"), "tag")).alias("at"))  # within a document's length
    held = docs.join(wanted, "doc_id").select("doc_id", "text", "at")
    if then is not None:
        return held.mapInArrow(lambda batches: (out for b in run(batches) for k in range(0, b.num_rows, rows) for out in then(b.slice(k, rows))), schema)
    return held.mapInArrow(run, f"doc_id long, at int, n int, tag {tag}, slice binary")
