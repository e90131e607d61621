"""Byte-level BPE and chat formatting against the public library, DuckDB and exact round trips."""

import base64
import hashlib
import random
import time

import duckdb
import numpy as np
import pytest
import tiktoken
from helpers import SF, documents, empty
from pyspark.sql import functions as F

from chronopanel.llm import bpe, chat, decontaminate

PATH, PATTERN = bpe.default_vocabulary()
TEXTS = [
    None, "", " ", "\n\n  x\t", "Hello, world! it's 12345", "ñandú öäü 中文字符 текст 🙂🙂", "a" * 5000, "a" * 100001, "ab" * 3000, "QmFzZTY0" * 2000 + "x", "é" * 700, "  x　", "A" * 2047 + " " + "b" * 2049,
    "x" * 3 + "\r\n" * 40 + "don't WE'LL", "<|endoftext|>", "same", "same",
]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_equals_library_and_decode_round_trips(spark, library):
    docs = documents(spark, list(enumerate(TEXTS)))
    rows = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        text = TEXTS[row["doc_id"]] or ""
        expected = library.encode_ordinary(text)
        assert np.frombuffer(row["ids"], "<u4").tolist() == expected and row["n_tokens"] == len(expected)
        assert bytes(row["decoded"]) == text.encode()


def test_query_equals_library_on_the_whole_table(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op1_byte_level_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = np.array(library.encode_ordinary(texts[row["doc_id"]]), "<u4")
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest())


def test_no_rows_and_null_ids(spark):
    assert bpe.encode(empty(spark), PATH, PATTERN).count() == 0
    made = spark.createDataFrame([(1, 0, None)], "doc_id long, n_tokens long, ids binary")
    assert bpe.decode(made, PATH, PATTERN).first()["decoded"] is None


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_escapes_content_and_masks_only_the_loss_role(spark):
    nasty = "\\ \\\\<turn> <says>\\</turn> </turn> ok\\"
    rows = turns(spark, [(1, 1, "assistant", nasty), (1, 0, "user", nasty), (1, 2, "assistant", "<turn>"), (2, 0, None, None), (None, 0, "assistant", "é🙂"), (None, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "user", "x")])
    made = chat.format_conversations(rows, PATH, PATTERN)
    read = chat.read_back(made, PATH, PATTERN).collect()
    alone = [r for r in read if r["conv_id"] is None]
    assert sorted(r["loss_text"] for r in alone) == ["", "é🙂"] and all(len(r["turns"]) == 1 for r in alone)
    back = {r["conv_id"]: r for r in read if r["conv_id"] is not None}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", nasty), ("assistant", nasty), ("assistant", "<turn>")]
    assert back[1]["loss_text"] == nasty + "<turn>"
    assert [tuple(t) for t in back[2]["turns"]] == [("", "")] and back[2]["loss_text"] == ""
    assert len(back[3]["turns"]) == 2
    first = len(bpe.encoder(PATH, PATTERN).tokens)
    assert all(sum(i == first for i in r["ids"]) == len(back[r["conv_id"]]["turns"]) for r in made.where("conv_id is not null").collect())
    clashing = chat.format_conversations(rows.withColumns({c: F.lit(1) for c in ("row", "turns", "ids", "loss")}), PATH, PATTERN)
    assert clashing.count() == made.count()


def test_chat_without_rows(spark):
    assert chat.read_back(chat.format_conversations(turns(spark, []), PATH, PATTERN), PATH, PATTERN).count() == 0


def test_chat_query_equals_duckdb(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    found = db.execute(chat.OP10_SQL)
    names = [x[0] for x in found.description]
    df = chat.op10_chat_formatting(spark, SF)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_very_long_pieces_take_seconds_and_are_those_of_the_library(library):
    own = bpe.encoder(PATH, PATTERN)
    r = random.Random(11)
    pieces = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20)), "a" * 300_000, "the" * 70_000, "é中" * 20_000]
    for piece in pieces:
        began = time.time()
        got = own.merge_long(piece.encode())
        assert time.time() - began < 60
        assert got.tolist() == library.encode_ordinary(piece) or len(own.split.findall(piece)) > 1
    for n in (2, 3, 2049, 5000):
        piece = "".join(r.choice("theanou") for _ in range(n))
        assert own.merge_long(piece.encode()).tolist() == own.merge_rows([piece.encode()], n)[0].tolist() == library.encode_ordinary(piece)


def test_occurrences_begin_where_they_begin():
    item = "the quick brown fox jumps over a dog"
    engine = decontaminate.Matcher(((1, item),), 16)
    for text, start, stop, distance in (
        (f"hello {item} there", 6, 42, 0), (f"hello {item[:9]}xy{item[9:]} there", 6, 44, 2), (f"hello {item[:9]}{item[11:]} there", 6, 40, 2), (f"hello {item[:9]}z{item[10:]} there", 6, 42, 1), (item[1:], 0, 35, 1),
    ):
        (found,) = engine.matches(text).items()
        assert found[1] == (distance, stop) and engine.start(0, text, *found[1]) == start, text
    r = random.Random(12)
    for _ in range(200):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(2))
        rows = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        best = min(rows[-1])
        assert decontaminate.myers(a, b, anchored=True) == (best, rows[-1].index(best))
