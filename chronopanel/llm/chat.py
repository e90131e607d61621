"""Operator 10, chat formatting by token-level assembly.

A conversation becomes ``<turn>role<says>text</turn>`` per turn.  Role and text are escaped and encoded as segments of
their own; the three markers are reserved ids above the vocabulary, spliced between segments, so no content can produce
them.  In the written form, backslashes are doubled and a backslash goes before each marker that occurs in content,
which reads back unambiguously.  The loss mask marks the text tokens of the chosen role: +1 and -1 at the bounds of
those segments, summed up along the tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ByteBPE, default_vocabulary, encoder
from .common import table

OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>"
MARKERS = (OPEN, SAYS, CLOSE)
_TO_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *MARKERS))))
_ESCAPED = re.compile("|".join("\\\\" + re.escape(x) for x in ("\\", *MARKERS)))
SHAPE = "conv_id long, ids array<int>, loss array<boolean>"
TURNS = "array<struct<role:string,text:string>>"
#: Text characters that a worker takes in one go.
CHUNK = 1 << 20


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][1:], text)


def slices_of(sizes: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` of the summed sizes each."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield start, stop
        start = stop


def assemble(roles: list[str], texts: list[str], turns: np.ndarray, bpe: ByteBPE, loss_role: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, loss, bounds) of many conversations laid end to end; ``turns``: the number of turns of each.

    Every turn is five segments: marker, role, marker, text, marker.  The bounds of segments are a prefix sum of their
    lengths, and the loss mask a prefix sum of steps at the bounds of the learned ones."""
    first, n = len(bpe.tokens), len(roles)
    coded = bpe.encode([*map(escape, roles), *map(escape, texts)])
    lengths = np.ones((n, 5), np.int64)
    lengths[:, 1], lengths[:, 3] = ([len(x) for x in part] for part in (coded[:n], coded[n:]))
    bounds = np.concatenate([[0], np.cumsum(lengths.ravel())])
    ids = np.empty(bounds[-1], np.int32)
    for k in (0, 2, 4):
        ids[bounds[k:-1:5]] = first + k // 2
    for k, part in ((1, coded[:n]), (3, coded[n:])):
        size = lengths[:, k]
        shift = np.repeat(bounds[k:-1:5] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        ids[np.arange(len(shift)) + shift] = np.concatenate([*part, np.zeros(0, np.int32)])
    steps = np.zeros(len(ids) + 1, np.int64)
    learned = 5 * np.nonzero(np.array(roles, object) == loss_role)[0] + 3
    np.add.at(steps, bounds[learned], 1)
    np.add.at(steps, bounds[learned + 1], -1)
    return ids, np.cumsum(steps)[:-1] > 0, bounds[5 * np.concatenate([[0], np.cumsum(turns)])]


def format_conversations(rows: DataFrame, rank_path: str, pattern: str, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, ids, loss): one row per conversation, turns in the order of turn, role, text.

    Null roles and texts are empty; a row without conv_id is a conversation of its own, with a null id; equal turns stay,
    each as a row of its own; texts of any length are whole; an empty table gives no rows; other columns are ignored.
    A conversation is one row of the result, so it has to fit in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_path, pattern)
        for batch in batches:
            lists = batch.column("turns")
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            roles, texts = (flat.field(c).fill_null("").to_pylist() for c in ("role", "text"))
            ends = np.concatenate([[0], np.cumsum(counts)])
            chars = np.add.reduceat(np.array([*map(len, texts), 0]), ends[:-1]) if len(counts) else counts
            for a, b in slices_of(chars + 16 * counts):
                own = slice(ends[a], ends[b])
                ids, loss, bounds = assemble(roles[own], texts[own], counts[a:b], bpe, loss_role)
                at = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").slice(a, b - a), pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(loss))], ["conv_id", "ids", "loss"])

    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("row"))
    grouped = named.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    return grouped.union(named.where("conv_id is null").select("conv_id", F.array("row"))).mapInArrow(run, SHAPE)


def read_segments(ids: np.ndarray, loss: np.ndarray, bpe: ByteBPE) -> tuple[list[str], list[str], list[bool]]:
    """(roles, texts, learned): escaped segments of the turns, in order, and whether the text is under the mask."""
    first = len(bpe.tokens)
    inner = ids < first
    raw = bpe.decode(ids[inner])
    sizes = np.zeros(len(ids) + 1, np.int64)
    sizes[1:][inner] = bpe.token_sizes[ids[inner]]
    at = np.cumsum(sizes)
    marks = np.nonzero(~inner)[0]
    parts = [raw[a:b].decode("utf-8") for a, b in zip(at[marks[:-1] + 1].tolist(), at[marks[1:]].tolist())]
    learned = (np.concatenate([[0], np.cumsum(loss)])[marks[2::3]] - np.concatenate([[0], np.cumsum(loss)])[marks[1::3]]) > 0
    return parts[::3], parts[1::3], learned.tolist()


def read_back(formatted: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(conv_id, turns, loss_text, written) of the rows of ``format_conversations``, from their tokens and masks alone."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_path, pattern)
        close = len(bpe.tokens) + 2
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            all_ids, all_loss = lists.flatten().to_numpy(), batch.column("loss").flatten().to_numpy(zero_copy_only=False)
            for a, b in slices_of(np.diff(ends), CHUNK // 4):
                own = slice(ends[a], ends[b])
                ids = all_ids[own]
                roles, texts, learned = read_segments(ids, all_loss[own], bpe)
                turns = np.concatenate([[0], np.cumsum(ids == close)])[ends[a : b + 1] - ends[a]]
                plain_roles, plain_texts = [unescape(x) for x in roles], [unescape(x) for x in texts]
                shown = [f"{OPEN}{r}{SAYS}{t}{CLOSE}" for r, t in zip(roles, texts)]
                said = [t if m else "" for t, m in zip(plain_texts, learned)]
                spans = list(zip(turns.tolist(), turns[1:].tolist()))
                structs = pa.StructArray.from_arrays([pa.array(plain_roles, pa.string()), pa.array(plain_texts, pa.string())], ["role", "text"])
                yield pa.RecordBatch.from_arrays([
                    batch.column("conv_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(turns.astype(np.int32)), structs).cast(kind),
                    pa.array(["".join(said[x:y]) for x, y in spans], pa.string()), pa.array(["".join(shown[x:y]) for x, y in spans], pa.string()),
                ], ["conv_id", "turns", "loss_text", "written"])

    return formatted.select("conv_id", "ids", "loss").mapInArrow(run, f"conv_id long, turns {TURNS}, loss_text string, written string")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``read_back`` finds in all formatted conversations: see ``format_conversations`` for nulls, repeats and columns."""
    path, pattern = default_vocabulary()
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    back = read_back(format_conversations(rows, path, pattern), path, pattern)
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("written").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '<says>', '\<says>'), '</turn>', '\</turn>') AS shown FROM all_rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length(role) + length(shown) + 19) AS BIGINT) AS formatted_chars
FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM escaped) GROUP BY conv_id, alone
"""
