"""A data source that reads containers by byte range: entry tables first, and then only the records that are asked for.

    spark.dataSource.register(ContainerRecords)
    spark.read.format("container_records").load(folder).where("idx = 0")

``binaryFile`` reads whole files. This source lists a folder, drops files by filters on path, and plans partitions of about
``rangeBytes``; a large container is shared out among several by the places its records begin at. A task reads a
container's header and entry table, drops records by filters on idx and attr, and reads the others in one range where they lie together.
"""

from __future__ import annotations

import fnmatch
import struct
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from leafspark.sources.files import CONTAINER_GLOB
from leafspark.sources.palm import CORRUPT, ENTRY_BYTES, HEADER_BYTES, NO_RECORD, SHORT_READ

SCHEMA = "path string, name string, type string, record_count int, idx int, offset long, size long, attr int, data binary, code int, message string"
_ARROW = pa.schema(
    [("path", pa.string()), ("name", pa.string()), ("type", pa.string()), ("record_count", pa.int32()), ("idx", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("attr", pa.int32()), ("data", pa.binary()), ("code", pa.int32()), ("message", pa.string())]
)
_TESTS: dict[type, Callable] = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}
#: Records that lie so near each other are read together with what is between them.
GAP = 4096


@dataclass(frozen=True)
class Piece:
    """The records of a container that begin from byte ``low`` up to ``high``."""

    path: str
    shown: str
    size: int
    low: int
    high: int


@dataclass
class Pieces(InputPartition):
    pieces: tuple[Piece, ...]


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.glob = options.get("glob", CONTAINER_GLOB)
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 64_000_000)))
        self.attempts = max(1, int(options.get("attempts", 3)))
        self.asked = tuple(int(x) for x in options.get("records", "").split(",") if x.strip())
        self.tests: dict[str, list[tuple[Callable, object]]] = {"path": [], "idx": [], "attr": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on path, idx and attr are kept for reading; Spark applies those on idx and attr that don't hold for rows without a record as well."""
        for f in filters:
            test, column = _TESTS.get(type(f)), getattr(f, "attribute", ())
            if test is not None and len(column) == 1 and column[0] in self.tests:
                self.tests[column[0]].append((test, f.value))
            yield f

    def passes(self, column: str, value: object) -> bool:
        return all(value is not None and test(value, v) for test, v in self.tests[column])

    def partitions(self) -> list[Pieces]:
        """Files are listed by the driver, not read; small ones share a partition, a large one is cut by bytes."""
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        prefix = self.folder.rstrip("/")
        listed = sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(top)) if x.is_file and fnmatch.fnmatchcase(x.base_name, self.glob))
        out, held, bytes_held = [], [], 0
        for path, size in listed:
            shown = f"{prefix}/{path.rsplit('/', 1)[-1]}"
            if not self.passes("path", shown):
                continue
            for low in range(0, max(size, 1), self.range_bytes):
                piece = Piece(path, shown, size, low, low + self.range_bytes)
                if held and bytes_held + min(size - low, self.range_bytes) > self.range_bytes:
                    out.append(Pieces(tuple(held)))
                    held, bytes_held = [], 0
                held.append(piece)
                bytes_held += min(size - low, self.range_bytes)
        return [*out, Pieces(tuple(held))]

    def retried(self, work: Callable[[], bytes]) -> bytes:
        for k in range(self.attempts):
            try:
                return work()
            except OSError:
                if k + 1 == self.attempts:
                    raise
                time.sleep(0.1 * 2**k)
        raise AssertionError

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder or self.folder.startswith("file:") else fs.LocalFileSystem()
        rows: list[tuple] = []
        held = 0
        for piece in partition.pieces:
            with store.open_input_file(piece.path) as f:
                for row in self.rows(f, piece):
                    rows.append(row)
                    held += len(row[8] or b"")
                    if held > 4_000_000 or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def at(self, f, offset: int, size: int) -> bytes:
        def work() -> bytes:
            f.seek(offset)
            return f.read(size)

        return self.retried(work)

    def rows(self, f, piece: Piece) -> Iterator[tuple]:
        """The rows of a container's records that begin in the piece, and rows with a code for what can't be read or isn't there."""
        head = self.at(f, 0, HEADER_BYTES)
        first = piece.low == 0
        if len(head) < HEADER_BYTES:
            if first:
                yield (piece.shown, *[None] * 8, CORRUPT, "header cut off")
            return
        (count,) = struct.unpack_from(">H", head, 76)
        about = (piece.shown, head[:32].split(b"\0")[0].decode("latin-1"), head[60:64].decode("latin-1"), count)
        table = self.at(f, HEADER_BYTES, ENTRY_BYTES * count)
        if len(table) < ENTRY_BYTES * count or not count:
            if first:
                yield (*about, *[None] * 5, CORRUPT, "header cut off" if count else "no records")
            return
        entries = np.frombuffer(table, dtype=np.dtype([("offset", ">u4"), ("attr", "u1"), ("id", "V3")]))
        begin, attr = entries["offset"].astype(np.int64), entries["attr"].tolist()
        size = np.append(begin[1:], piece.size) - begin
        if first:
            yield from ((*about, i, None, None, None, None, NO_RECORD, f"no record {i}") for i in self.asked if not 0 <= i < count and self.passes("idx", i))
        mine = np.flatnonzero((begin >= piece.low) & ((begin < piece.high) | (piece.high >= piece.size)))
        wanted = [i for i in mine.tolist() if (not self.asked or i in self.asked) and self.passes("idx", i) and self.passes("attr", attr[i])]
        good = [i for i in wanted if size[i] >= 0 and begin[i] + size[i] <= piece.size]
        for i in set(wanted) - set(good):
            yield (*about, i, int(begin[i]), int(size[i]), attr[i], None, SHORT_READ, f"record {i} is cut off")
        good.sort(key=lambda i: begin[i])
        k = 0
        while k < len(good):
            upto, low, high = k + 1, int(begin[good[k]]), int(begin[good[k]] + size[good[k]])
            while upto < len(good) and begin[good[upto]] <= high + GAP and begin[good[upto]] + size[good[upto]] - low <= self.range_bytes:
                high = max(high, int(begin[good[upto]] + size[good[upto]]))
                upto += 1
            body = self.at(f, low, high - low)
            for i in good[k:upto]:
                a = int(begin[i]) - low
                data = body[a : a + int(size[i])]
                short = len(data) != size[i]
                yield (*about, i, int(begin[i]), int(size[i]), attr[i], None if short else data, SHORT_READ if short else 0, f"record {i} is cut off" if short else None)
            k = upto


def read_records(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """The records of a folder's containers by this source; filters on path, idx and attr are pushed to it, which needs a session option that this sets."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContainerRecords)
    return spark.read.format(ContainerRecords.name()).options(**options).load(folder)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), type=t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class ContainerRecords(DataSource):
    """``spark.read.format("container_records").load(folder)``: a row for each record, with code 0; data is null where the code is below 0.

    Options: glob, rangeBytes (of a partition), attempts (of each reading), and records, a list of indices such as ``0,7``: only these are
    read, and a container that lacks one has a row with NO_RECORD for it. A container that can't be opened has one row, without idx.
    """

    @classmethod
    def name(cls) -> str:
        return "container_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))
