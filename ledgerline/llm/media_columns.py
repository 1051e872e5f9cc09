"""Media columns: payloads stored losslessly in archives, read back by a custom data source.

The source ``media_archive`` writes ZIP archives of grey 8-bit PNG images (64 samples a row) into a folder, and
reads a folder of such archives. A read is planned as byte ranges of archives: a task opens its archive, takes the
members of the archive's directory that begin in its range, and streams them as Arrow batches. A member whose bytes
don't come or don't match its checksum is read again by its offset; the others aren't.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..sources.folders import shared_folder
from .arrays import chunks

ROW = 64
MANIFEST = "_archives.json"
ARCHIVE_BYTES = 64 << 20  # an archive is closed beyond this, which bounds its directory
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LOCAL_HEADER = 30


def padded(text: bytes) -> bytes:
    """The bytes, and zeros up to a positive multiple of a row."""
    return text + bytes(max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def _section(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey image of one sample a byte. Equal payloads give equal images."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)  # a row begins with its filter, 0
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _section(b"IHDR", head) + _section(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _section(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png() made."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, packed = 8, []
    while at < len(image):
        size = int.from_bytes(image[at : at + 4], "big")
        if image[at + 4 : at + 8] == b"IDAT":
            packed.append(image[at + 8 : at + 8 + size])
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, ROW + 1)[:, 1:].tobytes()


@dataclass
class _Written(WriterCommitMessage):
    archives: list[list]


@dataclass
class _Range(InputPartition):
    archive: str
    begin: int
    end: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """A task's archives have names of their own: what a lost attempt leaves is in no manifest."""
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        done: list[list] = []
        stream = archive = None
        number = 0
        for batch in iterator:
            for doc_id, n_bytes, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = files.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{number}/{'' if doc_id is None else doc_id}/{n_bytes}.png"), media)
                number += 1
                if stream.tell() > ARCHIVE_BYTES:
                    archive.close()
                    done.append([name, stream.tell()])
                    stream.close()
                    archive = None
        if archive is not None:
            archive.close()
            done.append([name, stream.tell()])
            stream.close()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _ in m.archives if m else []:
                files.delete_file(f"{root}/{name}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[_Range]:
        files, root = fs.FileSystem.from_uri(self.path)
        with files.open_input_stream(f"{root}/{MANIFEST}") as manifest:
            archives = json.loads(manifest.read())
        return [_Range(name, at, at + self.range_bytes) for name, size in archives for at in range(0, size, self.range_bytes)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, root = fs.FileSystem.from_uri(self.path)
        place = f"{root}/{partition.archive}"
        with files.open_input_file(place) as file:
            members = [m for m in zipfile.ZipFile(file).infolist() if partition.begin <= m.header_offset < partition.end]
        rows: list[tuple] = []
        size = 0
        for member, media in self._stream(files, place, sorted(members, key=lambda m: m.header_offset)):
            _, doc_id, n_bytes = member.filename.removesuffix(".png").split("/")
            rows.append((int(doc_id) if doc_id else None, int(n_bytes), media))
            size += len(media)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    @staticmethod
    def _stream(files: fs.FileSystem, place: str, members: list[zipfile.ZipInfo]) -> Iterator[tuple[zipfile.ZipInfo, bytes]]:
        file = files.open_input_file(place)
        for member in members:
            for attempt in range(ATTEMPTS):
                try:
                    file.seek(member.header_offset)
                    head = file.read(LOCAL_HEADER)
                    name, extra = struct.unpack("<HH", head[26:30])
                    file.seek(member.header_offset + LOCAL_HEADER + name + extra)
                    media = file.read(member.compress_size)
                    if zlib.crc32(media) != member.CRC:
                        raise OSError(f"{place} at {member.header_offset}: bytes don't match their checksum")
                    break
                except (OSError, struct.error):
                    if attempt == ATTEMPTS - 1:
                        raise
                    time.sleep(0.1 * 4**attempt)
                    file = files.open_input_file(place)
            yield member, media
        file.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, n_bytes, media = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


class MediaArchive(DataSource):
    """Options: path (a folder, as a URI), range_bytes (of a read's partitions)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            texts = pc.fill_null(part.column("text").cast(pa.binary()), b"").to_pylist()
            media = [to_png(padded(x)) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy (bits) of the samples, and the mean step between neighbours in a row."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    step = np.abs(np.diff(samples.reshape(-1, ROW).astype(np.int16), axis=1)).mean()
    return f"mean={samples.mean():.6f};std={samples.std():.6f};entropy={-(share * np.log2(share)).sum():.6f};step={step:.6f}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        media = batch.column("media").to_pylist()
        payloads = [from_png(x) for x in media]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array(map(len, payloads), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in payloads], pa.string()), pa.array([zlib.crc32(x[-ROW:]) for x in payloads], pa.int64()),
                pa.array(map(len, media), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()), pa.array([feature(x) for x in payloads], pa.string()),
            ],
            names,
        )


def store(docs: DataFrame, path: str) -> None:
    """Stores the texts (null: empty) of doc_id and text as images in archives under a new folder ``path``.

    Repeated rows are stored as often as they come, a null doc_id comes back null; an empty table gives an empty
    folder. Other columns aren't stored.
    """
    docs.sparkSession.dataSource.register(MediaArchive)
    media = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")
    media.write.format("media_archive").option("path", path).mode("append").save()


def load(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_bytes (of the text) and media of every stored row."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("path", path).load()


def media_columns(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Stores every text, reads it back and computes: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 and feature. ``path``: a new folder, by default in the shared one."""
    path = path or shared_folder(docs.sparkSession, "media")
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    elif path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    store(docs, path)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return load(docs.sparkSession, path).mapInArrow(_features, schema)


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
