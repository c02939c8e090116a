"""Media payloads in archives, and a Spark data source that reads them by byte range.

Writing: every task stores its rows' payloads as members of ZIP archives (stored, not compressed
again) in a shared folder; the table of archives that tasks have finished is the folder's manifest,
so files of failed attempts are never read. Reading: ``media_archive`` plans partitions of a byte range
each over the archives that a file of the manifest lists; a task reads its ranges in large pieces, cuts the
members that begin there from them, and hands them to Spark in Arrow batches. Only a member that comes out
damaged or cut off is read anew, by its own offset and with its own retries.
"""

from __future__ import annotations

import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafspark.llm.arrow_text import sized_slices
from leafspark.llm.scratch import bounded_batches, remove

WIDTH = 64
MANIFEST = "_archives"
#: So many archives (of some 64 MB) are listed in one file of the manifest.
ARCHIVES_A_FILE = 200_000
MEDIA_SCHEMA = "archive string, offset long, member string, media binary, error string"
_MEDIA_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("member", pa.string()), ("media", pa.binary()), ("error", pa.string())])
_PNG = b"\x89PNG\r\n\x1a\n"


def file_system(uri: str):
    """The store of a folder and its path there; any store that Arrow knows (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def padded(text: bytes) -> bytes:
    """The bytes with zeros appended up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey image, WIDTH samples wide, whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an image that encode_png made; every chunk's checksum is verified."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG file")
    at, body, height = 8, [], 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", data)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("unexpected image layout")
        elif kind == b"IDAT":
            body.append(data)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected row filter")
    return lines[:, 1:].reshape(-1)


def feature_of(samples: np.ndarray) -> str:
    """Mean and deviation in hundredths, steps of over 32 between neighbours, and an 8-bin histogram."""
    total, squares, n = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum()), len(samples)
    deviation = (max(squares * n - total * total, 0)) ** 0.5 / n
    steps = int((np.abs(np.diff(samples.astype(np.int16))) > 32).sum())
    bins = np.bincount(samples >> 5, minlength=8)
    return f"mean={100 * total // n};deviation={int(100 * deviation)};steps={steps};bins={'/'.join(map(str, bins))}"


def store_media(docs: DataFrame, folder: str, archive_bytes: int = 64_000_000) -> int:
    """Store every row's text (null: empty) as an image in archives in ``folder``; returns the number of archives.

    Members are named ordinal/doc_id/bytes. The folder must be one that all executors share.
    """
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(folder)
        store.create_dir(top, recursive=True)
        archive = raw = None
        name, ordinal, members = "", 0, 0

        def closed() -> pa.RecordBatch:
            archive.close()
            size = raw.tell()
            raw.close()
            return pa.record_batch([pa.array([name]), pa.array([size], type=pa.int64()), pa.array([members], type=pa.int64())], names=["archive", "bytes", "members"])

        for batch in batches:
            for part in sized_slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if archive is None:
                        name = f"{run}-{uuid.uuid4().hex}.zip"
                        raw, members = store.open_output_stream(f"{top}/{name}"), 0
                        archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED)
                    data = (text or "").encode()
                    archive.writestr(zipfile.ZipInfo(f"{ordinal}/{'' if doc_id is None else doc_id}/{len(data)}.png"), encode_png(padded(data)))
                    ordinal, members = ordinal + 1, members + 1
                    if raw.tell() >= archive_bytes:
                        yield closed()
                        archive = None
        if archive is not None:
            yield closed()

    spark, parts = docs.sparkSession, f"{folder}/{MANIFEST}-parts"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(write, "archive string, bytes long, members long")
    with bounded_batches(spark):
        rows.write.parquet(parts)
    listed = spark.read.parquet(parts)
    n = listed.count()
    # a file for each writing task becomes a file for many archives, so that planning opens few of them
    listed.repartition(-(-n // ARCHIVES_A_FILE) or 1).write.parquet(f"{folder}/{MANIFEST}")
    remove(spark, parts)
    return n


@dataclass
class ByteRange(InputPartition):
    """``size`` bytes from byte ``low`` of archive ``row`` in a file of the manifest on, over the archives behind it if need be."""

    listed_in: str
    row: int
    low: int
    size: int


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 16_000_000))
        self.most_partitions = int(options.get("mostPartitions", 100_000))
        self.attempts = max(1, int(options.get("attempts", 3)))
        self.wait = float(options.get("waitSeconds", 0.2))
        self.batch_bytes = int(options.get("batchBytes", 4_000_000))
        self.piece_bytes = int(options.get("pieceBytes", 4_000_000))
        self.keep_errors = options.get("onError", "fail") == "row"

    def retried(self, work: Callable):
        """The result of ``work``, tried again after a wait that doubles when the store fails."""
        for k in range(self.attempts):
            try:
                return work()
            except OSError:
                if k + 1 == self.attempts:
                    raise
                time.sleep(self.wait * 2**k)

    def partitions(self) -> list[ByteRange]:
        """Each file of the manifest is opened once, for its sizes alone. What comes out is bounded: ``mostPartitions``, and one more for each file."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, top = file_system(self.folder)
        files = sorted(x.path for x in store.get_file_info(fs.FileSelector(f"{top}/{MANIFEST}", allow_not_found=True)) if x.path.endswith(".parquet"))

        def ends(path: str) -> np.ndarray:
            """Where each archive ends, in bytes of all archives that the file lists."""
            with store.open_input_file(path) as f:
                return np.cumsum(pq.read_table(f, columns=["bytes"]).column(0).to_numpy())

        listed = {path: ends(path) for path in files}
        total = sum(int(e[-1]) for e in listed.values() if len(e))
        size = max(self.range_bytes, -(-total // self.most_partitions))
        found = []
        for path, end in listed.items():
            at = np.arange(0, int(end[-1]) if len(end) else 0, size)
            row = np.searchsorted(end, at, side="right")
            low = at - np.concatenate([[0], end])[row]
            found += [ByteRange(path, int(r), int(b), size) for r, b in zip(row, low, strict=True)]
        return found or [ByteRange("", 0, 0, 0)]

    def member(self, store, path: str, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """A member's bytes, read by its own offset; each attempt opens the archive anew."""

        def work() -> bytes:
            with store.open_input_file(path) as f:
                f.seek(info.header_offset)
                head = f.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise OSError("no member begins here")
                f.seek(info.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
                return self.checked(f.read(info.compress_size), info)

        try:
            return self.retried(work), None
        except OSError as e:
            return None, str(e)

    @staticmethod
    def checked(data: bytes, info: zipfile.ZipInfo) -> bytes:
        if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            raise OSError("the member is damaged or cut off")
        return data

    def members(self, store, path: str, low: int, high: int) -> Iterator[tuple[zipfile.ZipInfo, bytes | None]]:
        """The members that begin in a range, cut from pieces read one after the other; None for one that comes out damaged."""

        def directory() -> tuple[list[zipfile.ZipInfo], int]:
            with store.open_input_file(path) as f, zipfile.ZipFile(io.BufferedReader(f, 1 << 20)) as z:
                return sorted(z.infolist(), key=lambda i: i.header_offset), z.start_dir

        infos, after = self.retried(directory)
        ends = [*(i.header_offset for i in infos[1:]), after]
        mine = [(i, end) for i, end in zip(infos, ends, strict=True) if low <= i.header_offset < high]
        if not mine:
            return
        held, at = b"", mine[0][0].header_offset  # bytes of the archive from ``at`` on

        def more(need: int) -> bytes:
            with store.open_input_file(path) as f:
                f.seek(at + len(held))
                return f.read(need)

        for info, end in mine:
            held, at = held[info.header_offset - at :], info.header_offset
            if len(held) < end - at:
                want = min(max(end - at - len(held), self.piece_bytes), mine[-1][1] - at - len(held))
                try:
                    held += self.retried(lambda: more(want))  # noqa: B023
                except OSError:
                    pass
            try:
                body = 30 + sum(struct.unpack_from("<HH", held, 26)) if held[:4] == b"PK\x03\x04" and len(held) >= 30 else len(held)
                yield info, self.checked(held[body : body + info.compress_size], info)
            except OSError:
                yield info, None

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if not partition.listed_in:
            return
        store, top = file_system(self.folder)
        with pq.ParquetFile(store.open_input_file(partition.listed_in)) as listed:
            archives = (a for batch in listed.iter_batches(columns=["archive", "bytes"]) for a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            rows: list[tuple] = []
            held, low, left = 0, partition.low, partition.size
            for archive, size in islice(archives, partition.row, None):
                high = min(size, low + left)
                path = f"{top}/{archive}"
                for info, data in self.members(store, path, low, high):
                    error = None
                    if data is None:
                        data, error = self.member(store, path, info)
                    if error and not self.keep_errors:
                        raise OSError(f"{archive}, {info.filename} at {info.header_offset}: {error}")
                    rows.append((archive, info.header_offset, info.filename, data, error))
                    held += len(data or b"")
                    if held >= self.batch_bytes:
                        yield self._batch(rows)
                        rows, held = [], 0
                left -= high - low
                low = 0
                if left <= 0:
                    break
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), _MEDIA_ARROW, strict=True)], schema=_MEDIA_ARROW)


class MediaArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: a row per member of the folder's archives.

    Options: rangeBytes (of a partition; more if there would be over mostPartitions), pieceBytes (read at
    once), batchBytes, attempts and waitSeconds (of each reading), and onError: ``fail``, or ``row`` for a
    row with the error and no media.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEDIA_SCHEMA

    def reader(self, schema) -> MediaArchiveReader:
        return MediaArchiveReader(dict(self.options))


def decode_media(members: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the media, its payload read back, and a feature of its samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, media in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist(), strict=True):
                _, doc_id, n = member.removesuffix(".png").split("/")
                samples = decode_png(media) if media is not None else None
                rows.append((int(doc_id) if doc_id else None, int(n), media, None if samples is None else samples.tobytes(), None if samples is None else feature_of(samples)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
            yield pa.record_batch([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "media", "payload", "feature"])

    return members.select("member", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def media_columns(docs: DataFrame, folder: str) -> DataFrame:
    """Store the texts of ``docs`` (doc_id, text) in archives and return what reading them back gives.

    A row per input row: doc_id (null stays null), n_bytes, media, payload and feature. A null text is
    an empty one, whose payload is WIDTH zero bytes; repeated rows are members of their own; long
    texts are one member each; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    store_media(docs, folder)
    spark.dataSource.register(MediaArchiveSource)
    return decode_media(spark.read.format("media_archive").load(folder))
