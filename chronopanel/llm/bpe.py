"""Operator 1, byte-level BPE encoding and decoding over length-bucketed padded matrices.

Texts are split by the pattern; the distinct pieces of a chunk of documents become rows of padded matrices, one per
length bucket.  In a round every row merges its leftmost pair of minimum rank: ranks come from a hashed pair table, the
row is closed up, and rows without a mergeable pair leave the matrix.  Token ids are kept packed (little-endian unsigned
32-bit), the form in which training shards store them.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NONE = np.int32(2**31 - 1)
#: Upper widths of the length buckets; a longer piece is a matrix of its own.
BUCKETS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512, 1024, 2048)
#: Distinct pieces a worker remembers, and text bytes that it takes in one go.
CACHE, CHUNK = 1 << 18, 1 << 20


class PairTable:
    """(left id, right id) -> merged id, by open addressing over a table that is a quarter full at most."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs) + 1).bit_length())
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64).reshape(-1)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        left, values, slots = keys, np.array(list(pairs.values()), np.int32), self._slots(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slots] == -1
            _, first = np.unique(slots, return_index=True)
            wins = np.zeros(len(left), bool)
            wins[first] = True
            wins &= free
            self.keys[slots[wins]], self.values[slots[wins]] = left[wins], values[wins]
            left, values, slots = left[~wins], values[~wins], (slots[~wins] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is no such pair or a side is padding (-1)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        out, slots = np.full(keys.shape, NONE, np.int32), self._slots(keys)
        at = self.keys[slots]
        hit = at == keys
        out[hit] = self.values[slots[hit]]
        open_ = np.nonzero(~hit & (at != -1))
        while len(open_[0]):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slots[open_]]
            hit = at == keys[open_]
            won = tuple(x[hit] for x in open_)
            out[won] = self.values[slots[won]]
            more = ~hit & (at != -1)
            open_ = tuple(x[more] for x in open_)
        return out


class ByteBPE:
    """An encoder for one rank file and split pattern; ``pattern`` uses the classes of the ``regex`` module."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    pairs[a, b] = rank
        self.pairs, self.ranked = PairTable(pairs), {(a << 32) | b: rank for (a, b), rank in pairs.items()}
        self.token_sizes = np.zeros(max(self.tokens) + 1, np.int64)
        for i, token in self.tokens.items():
            self.token_sizes[i] = len(token)
        self.known: dict[str, int] = {}
        self.flat, self.ends = [np.zeros(0, np.int32)], [0]

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def merge_rows(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of each byte string; all are at most ``width`` long."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width)[None, :] < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        out: list[np.ndarray] = [None] * len(rows)
        own = np.arange(len(rows))
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(own):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(own)), at]
            done = best == NONE
            if done.any():
                for k in np.nonzero(done)[0]:
                    out[own[k]] = ids[k, : lengths[k]].copy()
                keep = ~done
                ids, ranks, own, lengths, at, best = ids[keep], ranks[keep], own[keep], lengths[keep], at[keep], best[keep]
                if not len(own):
                    break
            each = np.arange(len(own))
            ids[each, at] = best
            tail = np.arange(ids.shape[1] - 1)[None, :] > at[:, None]  # columns right of the merged one close up
            ids[:, :-1][tail] = ids[:, 1:][tail]
            ids[:, -1] = -1
            lengths -= 1
            move = np.arange(ranks.shape[1] - 1)[None, :] > at[:, None]
            ranks[:, :-1][move] = ranks[:, 1:][move]
            ranks[:, -1] = NONE
            if (most := int(lengths.max())) < ids.shape[1] // 2:
                ids, ranks = ids[:, : max(2, most)].copy(), ranks[:, : max(1, most - 1)].copy()
            right = np.minimum(at, ranks.shape[1] - 1)
            has = at < ranks.shape[1]
            ranks[each[has], right[has]] = self.pairs.find(ids[each[has], right[has]], ids[each[has], right[has] + 1])
            before = at > 0
            ranks[each[before], at[before] - 1] = self.pairs.find(ids[each[before], at[before] - 1], ids[each[before], at[before]])
        return out

    def merge_long(self, row: bytes) -> np.ndarray:
        """The same merges of one long piece: its leftmost pair of minimum rank each time, from a heap of places by rank.

        Places are linked to their neighbours, and a merge looks up two new pairs, so n bytes take about n log n steps; an
        entry of the heap whose pair is gone is passed over."""
        ids = self.byte_ids[np.frombuffer(row, np.uint8)]
        found = self.pairs.find(ids[:-1], ids[1:])
        at = np.nonzero(found != NONE)[0]
        heap = ((found[at].astype(np.int64) << 32) | at).tolist()
        heapq.heapify(heap)
        n, token, rank = len(ids), ids.tolist(), [*found.tolist(), NONE]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            best, k = divmod(heapq.heappop(heap), 1 << 32)
            if rank[k] != best:
                continue
            gone = after[k]
            token[k], token[gone], rank[gone] = best, -1, NONE
            after[k] = follower = after[gone]
            if follower < n:
                before[follower] = k
            for left, right in ((before[k], k), (k, follower)):
                if left >= 0 and right < n:
                    rank[left] = new = self.ranked.get((token[left] << 32) | token[right], NONE)
                    if new != NONE:
                        heapq.heappush(heap, (new << 32) | left)
                elif left >= 0:
                    rank[left] = NONE
        merged = np.array(token, np.int32)
        return merged[merged >= 0]

    def merge_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        where = np.searchsorted(np.array(BUCKETS), lengths)
        for k in np.unique(where):
            own = np.nonzero(where == k)[0]
            if k == len(BUCKETS):
                for i in own:
                    out[i] = self.merge_long(pieces[i])
                continue
            step = max(1, (1 << 21) // BUCKETS[k])
            for s in range(0, len(own), step):
                for i, ids in zip(own[s : s + step], self.merge_rows([pieces[i] for i in own[s : s + step]], BUCKETS[k])):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, as int32 arrays."""
        split = [self.split.findall(t) for t in texts]
        new = list(dict.fromkeys(p for pieces in split for p in pieces if p not in self.known))
        if len(self.known) + len(new) > CACHE:
            self.known, self.flat, self.ends = {}, [np.zeros(0, np.int32)], [0]
            new = list(dict.fromkeys(p for pieces in split for p in pieces))
        if new:
            merged = self.merge_pieces([p.encode("utf-8") for p in new])
            self.known.update(zip(new, range(len(self.ends) - 1, len(self.ends) - 1 + len(new))))
            self.ends += (self.ends[-1] + np.cumsum([len(x) for x in merged])).tolist()
            self.flat = [np.concatenate([*self.flat, *merged])]
            self._ends = np.array(self.ends, np.int64)
        out, flat = [], self.flat[0]
        for pieces in split:
            if not pieces:
                out.append(np.zeros(0, np.int32))
                continue
            at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
            starts, lengths = self._ends[at], self._ends[at + 1] - self._ends[at]
            shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
            out.append(flat[np.arange(len(shift)) + shift])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder a worker process and rank file."""
    return ByteBPE.from_file(path, pattern)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of values each."""
    start, size = 0, 0
    for k in range(len(column)):
        size += len(column[k].as_buffer() or b"") if column[k].is_valid else 0
        if size >= limit:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(column):
        yield start, len(column)


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): whole texts, ids packed as little-endian unsigned 32-bit.

    One row per input row in no order, repeated ones and those without an id too; null and empty texts have no tokens;
    texts and pieces of any length are encoded whole; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_path, pattern)
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                found = bpe.encode([x or "" for x in batch.column(1)[a:b].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (bytes) to (doc_id, n_tokens, ids); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_path, pattern)
        for batch in batches:
            for a, b in chunks(batch.column("ids")):
                part = batch.slice(a, b - a)
                texts = [None if x is None else bpe.decode(np.frombuffer(x, "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    rows = tokens.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ``encode`` and ``decode`` of all documents: see ``encode`` for nulls, repeats, long texts and columns."""
    path, pattern = default_vocabulary()
    done = decode(encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
