"""Media columns: payloads as PNG images in ZIP archives, written and read by a Spark data source of our own.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the rows of a grey image 64 samples wide,
8 bits each; a text chunk holds the unpadded length. The writer makes one archive for each task and lists those that
were committed, so an attempt that was lost or repeated leaves nothing that is read. The reader plans byte ranges over
the archives; a range owns the members whose header starts in it. A member is read by its offset through the range's open file, checked, and on
failure tried again on a newly opened one; one that can't be read at last gives a row with its error.

Paths are URIs of any file system that pyarrow.fs opens; the folder must be one that all executors share. Null text
counts as empty (64 zero bytes). Repeated rows each give a member. A null id stays null. Empty tables give archives
without members. A task holds at most BATCH_BYTES of payloads beside one member. Equal texts give equal bytes.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from seqweft.llm.common import body, small_batches, table
from seqweft.session import shared_path

UNIT, LEVEL, RANGE_BYTES, BATCH_BYTES, TRIES, LISTED = 64, 3, 8 << 20, 8 << 20, 4, "_committed.json"
HEAD_BYTES = 1 << 14
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, archive string, offset long, media binary, error string"


def pad(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of UNIT."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(raw: bytes) -> bytes:
    rows = np.frombuffer(pad(raw), np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The padded payload and the unpadded length of an image that to_png() made."""
    if not media.startswith(SIGNATURE):
        raise ValueError("no PNG signature")
    at, data, length, shape = len(SIGNATURE), b"", -1, (0, 0)
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        part = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + part):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", part)
        elif kind == b"tEXt" and part.startswith(b"n_bytes\0"):
            length = int(part[8:])
        elif kind == b"IDAT":
            data += part
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("lines have filters")
    return lines[:, 1:].tobytes(), length


def features(payload: bytes) -> str:
    """Height, mean, deviation, entropy in bits and a difference hash of the samples."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    levels = np.arange(256)
    mean = float(share @ levels)
    deviation = float(np.sqrt(max(0.0, share @ levels**2 - mean * mean)))
    used = share[share > 0]
    image = x.reshape(-1, UNIT)
    bands = np.add.reduceat(image, np.arange(8) * len(image) // 8 if len(image) >= 8 else np.arange(len(image)), axis=0, dtype=np.int64)
    cells = bands[:, : UNIT - 1].reshape(len(bands), 9, 7).sum(2)
    bits = (cells[:, 1:] > cells[:, :-1]).ravel()
    return f"h={len(image)};mean={mean:.4f};std={deviation:.4f};entropy={-(used @ np.log2(used)) + 0.0:.4f};dhash={np.packbits(bits).tobytes().hex()}"


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@dataclass
class Written(WriterCommitMessage):
    name: str
    members: int


class ArchiveWriter(DataSourceArrowWriter):
    """Writes rows (doc_id, media) as members of one archive for each task."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path = path
        fs, root = _fs(path)
        if overwrite:
            fs.create_dir(root)
            fs.delete_dir_contents(root)
        fs.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _fs(self.path)
        name, n = f"part-{uuid.uuid4().hex}.zip", 0
        with fs.open_output_stream(f"{root}/{name}") as stream, zipfile.ZipFile(io.BufferedWriter(_Raw(stream), 1 << 20), "w", zipfile.ZIP_STORED) as archive:
            for batch in iterator:
                for doc_id, media in zip(batch.column("doc_id"), batch.column("media"), strict=True):
                    archive.writestr(zipfile.ZipInfo(f"{n:08d}/{'' if doc_id.as_py() is None else doc_id.as_py()}.png"), media.as_py())
                    n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        known = _listed(fs, root) or []
        with fs.open_output_stream(f"{root}/{LISTED}") as stream:
            stream.write(json.dumps(sorted([*known, *(m.name for m in messages if m and m.members)])).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.name}")


class _Raw(io.RawIOBase):
    """A pyarrow stream as a raw one that can't seek."""

    def __init__(self, stream) -> None:
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)


def _listed(fs, root: str) -> list[str] | None:
    from pyarrow.fs import FileType

    if fs.get_file_info(f"{root}/{LISTED}").type == FileType.NotFound:
        return None
    with fs.open_input_file(f"{root}/{LISTED}") as f:
        return json.loads(f.read())


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


def read_member(opened: Callable, offset: int, size: int, crc: int, tries: int = TRIES, wait: float = 0.05, first=None) -> bytes:
    """The member whose header is at offset; read through the open file `first`, if one is given, and then each try opens the archive anew."""
    for n in range(tries):
        try:
            with nullcontext(first) if first is not None and not n else opened() as f:
                f.seek(offset)
                head = f.read(min(HEAD_BYTES, size + 512))
                if head[:4] != b"PK\3\4":
                    raise ValueError(f"no member at {offset}")
                at = 30 + sum(struct.unpack_from("<HH", head, 26))
                data = head[at : at + size]
                if len(data) < size:
                    f.seek(offset + at + len(data))
                    data += f.read(size - len(data))
            if len(data) != size or zlib.crc32(data) != crc:
                raise ValueError(f"the member at {offset} is damaged")
            return data
        except (OSError, ValueError):
            if n == tries - 1:
                raise
            time.sleep(wait * 2**n)
    raise ValueError("no tries")


class ArchiveReader(DataSourceReader):
    """Byte ranges over the committed archives of a folder, or over all archives where nothing was listed."""

    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRange]:
        from pyarrow.fs import FileSelector

        fs, root = _fs(self.path)
        known = _listed(fs, root)
        found = {f.base_name: f.size for f in fs.get_file_info(FileSelector(root)) if f.base_name.endswith(".zip")}
        names = sorted(found) if known is None else known
        planned = [ByteRange(n, at, at + self.range_bytes) for n in names for at in range(0, found[n], self.range_bytes)]
        return planned or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, root = _fs(self.path)
        path = f"{root}/{partition.archive}"
        opened = lambda: fs.open_input_file(path)
        rows: list[tuple] = []
        held = 0
        with opened() as f:
            members = [m for m in zipfile.ZipFile(f).infolist() if partition.start <= m.header_offset < partition.end]
            for m in members:
                key = m.filename.rpartition("/")[2].removesuffix(".png")
                try:
                    media, error = read_member(opened, m.header_offset, m.file_size, m.CRC, first=f), None
                except (OSError, ValueError) as e:
                    media, error = None, str(e)
                rows.append((int(key) if key else None, partition.archive, m.header_offset, media, error))
                held += len(media or b"")
                if held >= BATCH_BYTES or len(rows) >= 1024:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("doc_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(uri); rows doc_id and media can be written to it."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def store(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes each row's image to archives in the folder path."""
    spark = docs.sparkSession
    small_batches(spark)
    spark.dataSource.register(MediaArchive)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [to_png(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body(text).alias("text"))
    rows.mapInArrow(encode, "doc_id long, media binary").write.format("media_archive").mode("append").save(path)


def load(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).load(path)


DIGESTS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DIGESTS of media that were read back; a member with an error ends the job rather than going missing."""
    for batch in batches:
        rows = []
        for doc_id, media, error in zip(*(batch.column(c) for c in ("doc_id", "media", "error")), strict=True):
            if error.as_py():
                raise OSError(error.as_py())
            raw = media.as_py()
            payload, length = from_png(raw)
            rows.append((doc_id.as_py(), length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), features(payload)))
        columns = zip(*rows, strict=True) if rows else [[]] * len(DIGESTS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, DIGESTS, strict=True)], schema=pa.schema(DIGESTS))


def op8_media(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "media")
    store(table(spark, sf_dir, "documents"), path)
    return load(spark, path).select("doc_id", "media", "error").mapInArrow(
        digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
