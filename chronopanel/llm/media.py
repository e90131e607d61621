"""Operator 5, media columns: payload archives and a Spark data source that reads them by byte range.

Writing: each task packs encoded members into zip archives of bounded size in the shared folder and reports them in a
manifest that Spark's own writer commits, so archives of failed attempts are never read.  Reading: the data source plans
byte ranges over the archives; a task reads its archive's directory, takes the members whose offset lies in its range,
and fetches each by offset with retries of its own, streaming payloads as Arrow batches.  A member that stays unreadable
becomes a row with an error instead of failing the task.  Files are opened through pyarrow's file systems by URI.
"""

from __future__ import annotations

import io
import struct
import time
import uuid
import wave
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import scratch, table

FRAME = 192
MEMBERS = "name string, archive string, header_offset long, media binary, error string"
_PNG = b"\x89PNG\r\n\x1a\n"


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """An 8-bit grey image, ``FRAME`` samples wide; the length before padding is a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    lines = np.zeros((len(rows), FRAME + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", FRAME, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[bytes, int]:
    """(samples, length before padding) of an image written by ``encode_png``; ValueError for any other or a damaged one."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at, shape, n_bytes, packed = 8, None, None, []
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + body)) != data[at + 8 + size : at + 12 + size]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not supported")
    payload = lines[:, 1:].tobytes()
    return payload, len(payload) if n_bytes is None else n_bytes


def encode_wav(payload: bytes, n_bytes: int, rate: int = 8000) -> bytes:
    """8-bit mono PCM, uncompressed; the length before padding is kept in a trailing ``note`` chunk."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setparams((1, 1, rate, len(payload), "NONE", ""))
        f.writeframes(payload)
    return out.getvalue() + b"note" + struct.pack("<IQ", 8, n_bytes)


def decode_wav(data: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(data)) as f:
        payload = f.readframes(f.getnframes())
    return payload, struct.unpack("<Q", data[-8:])[0] if data[-16:-12] == b"note" else len(payload)


FORMATS = {"png": (encode_png, decode_png), "wav": (encode_wav, decode_wav)}


def pack_texts(docs: DataFrame, folder: str, form: str = "png", archive_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store each text's padded bytes as a member of archives under ``folder``, and ``folder``/manifest.

    A null text is empty; a payload is padded with spaces to a positive multiple of 192.  Members are named by the id
    (``null`` without one), repeated ids give repeated names; texts of any length are stored whole; an empty table gives
    an empty manifest; other columns are ignored.
    """
    encode = FORMATS[form][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_uri(folder)
        out = name = sink = None
        members = 0

        def close() -> pa.RecordBatch:
            out.close()
            size = sink.tell()
            sink.close()
            return pa.RecordBatch.from_pylist([{"archive": name, "size": size, "members": members}])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if out is None:
                    name, members = f"media-{uuid.uuid4().hex}.zip", 0
                    sink = fs.open_output_stream(f"{base}/{name}")
                    out = zipfile.ZipFile(_Counted(sink), "w", zipfile.ZIP_STORED)
                raw = (text.as_py() or "").encode("utf-8")
                payload = raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b" ")
                out.writestr(zipfile.ZipInfo(f"{doc.as_py() if doc.is_valid else 'null'}.{form}", (1980, 1, 1, 0, 0, 0)), encode(payload, len(raw)))
                members += 1
                if sink.tell() >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    fs, base = open_uri(folder)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(run, "archive string, size long, members long").write.parquet(f"{folder}/manifest")


class _Counted(io.RawIOBase):
    """A write-only stream for zipfile over a file system that can't seek."""

    def __init__(self, sink: pa.NativeFile):
        self.sink = sink

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        return self.sink.write(bytes(data))


class ByteRange(InputPartition):
    def __init__(self, archive: str, size: int, start: int, stop: int):
        self.archive, self.size, self.start, self.stop = archive, size, start, stop


def directory(f: pa.NativeFile, size: int, start: int, stop: int) -> list[tuple[str, int, int, int]]:
    """(name, header offset, stored bytes, crc) of the members whose header lies in [start, stop)."""
    f.seek(max(0, size - 22 - 65535))
    tail = f.read()
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise OSError("no archive directory")
    length, offset = struct.unpack("<II", tail[at + 12 : at + 20])
    f.seek(offset)
    body, found, k = f.read(length), [], 0
    while k + 46 <= len(body):
        crc, stored, _, n, extra, comment = struct.unpack("<IIIHHH", body[k + 16 : k + 34])
        header = struct.unpack("<I", body[k + 42 : k + 46])[0]
        if start <= header < stop:
            found.append((body[k + 46 : k + 46 + n].decode("utf-8"), header, stored, crc))
        k += 46 + n + extra + comment
    return found


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", 32 << 20))
        self.retries = int(options.get("retries", 3))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))

    def partitions(self) -> list[ByteRange]:
        """Ranges of archives in the manifest, or of all zip files where there is none; archives, not members, are listed."""
        fs, base = open_uri(self.folder)
        if fs.get_file_info(f"{base}/manifest").type == pafs.FileType.Directory:
            listed = pq.read_table(f"{base}/manifest", filesystem=fs, columns=["archive", "size"]).to_pylist()
        else:
            listed = [{"archive": x.base_name, "size": x.size} for x in fs.get_file_info(pafs.FileSelector(base)) if x.base_name.endswith(".zip")]
        return [
            ByteRange(x["archive"], x["size"], a, min(a + self.range_bytes, x["size"]))
            for x in listed for a in range(0, x["size"], self.range_bytes)
        ] or [ByteRange("", 0, 0, 0)]

    def retried(self, read):
        """``read()``, tried again after a failure of the file system or of what it read; the last failure is raised."""
        for left in reversed(range(self.retries + 1)):
            try:
                return read()
            except (OSError, ValueError, struct.error, EOFError):
                if not left:
                    raise
                time.sleep(0.05 * (self.retries - left + 1))
        raise AssertionError

    def members(self, fs: pafs.FileSystem, path: str, part: ByteRange) -> list[tuple[str, int, int, int]]:
        with fs.open_input_file(path) as f:
            return directory(f, part.size, part.start, part.stop)

    def fetch(self, fs: pafs.FileSystem, path: str, header: int, stored: int, crc: int) -> bytes:
        """One member's bytes by its own offset, opened anew for each try."""
        with fs.open_input_file(path) as f:
            f.seek(header + 26)
            n, extra = struct.unpack("<HH", f.read(4))
            f.seek(header + 30 + n + extra)
            data = f.read(stored)
        if len(data) != stored or zlib.crc32(data) != crc:
            raise OSError("damaged member")
        return data

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        """The members of a range; one that stays unreadable is a row with an error, and so is an archive whose directory
        does, once, at its first range."""
        if not part.archive:
            return
        fs, base = open_uri(self.folder)
        path, rows, size = f"{base}/{part.archive}", [], 0
        try:
            members = self.retried(lambda: self.members(fs, path, part))
        except (OSError, ValueError, struct.error, EOFError) as failure:
            members = []
            if part.start == 0:
                rows.append({"name": None, "archive": part.archive, "header_offset": None, "media": None, "error": f"archive: {failure}"[:200]})
        for name, header, stored, crc in members:
            row = {"name": name, "archive": part.archive, "header_offset": header, "media": None, "error": None}
            try:
                row["media"] = self.retried(lambda: self.fetch(fs, path, header, stored, crc))
            except (OSError, ValueError, struct.error, EOFError) as failure:
                row["error"] = str(failure)[:200]
            rows.append(row)
            size += stored
            if size >= self.batch_bytes:
                yield pa.RecordBatch.from_pylist(rows, ARROW_MEMBERS)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW_MEMBERS)


ARROW_MEMBERS = pa.schema([("name", pa.string()), ("archive", pa.string()), ("header_offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


class MediaSource(DataSource):
    """``spark.read.format("media_archives").load(folder)``; options range_bytes, batch_bytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def features(payload: bytes) -> str:
    """Mean, deviation, byte entropy and mean step between neighbours of the samples."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    step = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    return f"mean={x.mean():.4f};sd={x.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};step={step:.4f}"


def read_media(spark: SparkSession, folder: str, form: str = "png", **options: str) -> DataFrame:
    """One row per stored member: doc_id, n_bytes, payload, media, feature, error (null where all is well).

    A member that can't be read or decoded, one whose name is no id, and an archive without a readable directory are rows
    with an error; the rest of the folder is not touched by them.  An empty folder gives no rows."""
    spark.dataSource.register(MediaSource)
    decode = FORMATS[form][1]
    shape = "doc_id long, n_bytes long, payload binary, media binary, feature string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = []
                for name, media, error in zip(*(batch.slice(k, 256).column(c).to_pylist() for c in ("name", "media", "error"))):
                    row = {"doc_id": None, "n_bytes": None, "payload": None, "media": media, "feature": None, "error": error}
                    if name is not None:
                        try:
                            stem = name.rsplit(".", 1)[0]
                            row["doc_id"] = None if stem == "null" else int(stem)
                            if media is None:
                                rows.append(row)
                                continue
                            row["payload"], row["n_bytes"] = decode(media)
                            row["feature"] = features(row["payload"])
                        except (ValueError, OverflowError, EOFError, struct.error, zlib.error, wave.Error) as failure:
                            row["error"] = str(failure)[:200]
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, ARROW_DECODED)

    members = spark.read.format("media_archives").options(**options).load(folder)
    return members.select("name", "media", "error").mapInArrow(run, shape)


ARROW_DECODED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("feature", pa.string()), ("error", pa.string())])


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed by ``pack_texts`` and read by ``read_media``: see there for nulls, repeats, damage and columns."""
    folder = scratch(spark, "media")
    pack_texts(table(spark, sf_dir, "documents"), folder)
    got = read_media(spark, folder)
    return got.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 15, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "error",
    )
