"""A sink for containers: rows of records become files, which show only when the whole write has been committed.

    spark.dataSource.register(ContainerFiles)
    in_order(records).write.format("container_files").mode("append").save(folder)
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from leafspark.sources.palm import ENTRY_BYTES, HEADER_BYTES

#: What the written rows have: the file's name without ending, container fields, and one record.
SCHEMA = "file string, name string, type string, creator string, idx int, attr int, data binary"
MOST_RECORDS, PENDING = 65_535, "_pending"


def in_order(records: DataFrame) -> DataFrame:
    """Rows of SCHEMA with each file's records together and in order, as the sink asks for them."""
    rows = records.select("file", "name", "type", "creator", "idx", "attr", "data")
    return rows.repartition("file").sortWithinPartitions("file", "idx")


def container_bytes(name: str, kind: str, creator: str, records: list[tuple[int, bytes]]) -> bytes:
    """A container of records (attr, data)."""
    if len(records) > MOST_RECORDS:
        raise ValueError(f"a container holds {MOST_RECORDS} records at most")
    title = name.encode("latin-1", "replace")[:31].ljust(32, b"\0")
    fixed = lambda s: s.encode("latin-1", "replace")[:4].ljust(4, b"\0")
    head = title + bytes(28) + fixed(kind) + fixed(creator) + bytes(8) + struct.pack(">H", len(records))
    at, entries = HEADER_BYTES + ENTRY_BYTES * len(records), []
    for i, (attr, data) in enumerate(records):
        entries.append(struct.pack(">IB", at, attr & 0xFF) + (i & 0xFFFFFF).to_bytes(3, "big"))
        at += len(data)
    return b"".join([head, *entries, *(data for _, data in records)])


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has written under the job's pending folder, by name."""

    files: tuple[str, ...]
    attempt: str


class ContainerWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.job, self.overwrite = options["path"].rstrip("/"), uuid.uuid4().hex, overwrite

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if ":" in self.folder.split("/")[0] else (fs.LocalFileSystem(), self.folder)

    def write(self, iterator: Iterator[Row]) -> Written:
        """Each file is written whole under a folder of this attempt; one file's records are held at a time."""
        store, top = self.store()
        attempt, done = uuid.uuid4().hex, []
        place = f"{top}/{PENDING}-{self.job}/{attempt}"
        store.create_dir(place, recursive=True)
        current, about, records, last = None, None, [], -1

        def close() -> None:
            if current is not None:
                with store.open_output_stream(f"{place}/{current}.pdb") as f:
                    f.write(container_bytes(*about, records))
                done.append(current)

        for r in iterator:
            if r["file"] != current:
                close()
                if r["file"] in done:
                    raise ValueError("records of a file must come together; see in_order")
                current, about, records, last = r["file"], (r["name"] or "", r["type"] or "", r["creator"] or ""), [], -1
            if r["idx"] <= last:
                raise ValueError("records of a file must come in order; see in_order")
            last = r["idx"]
            records.append((r["attr"] or 0, bytes(r["data"] or b"")))
        close()
        return Written(tuple(done), attempt)

    def commit(self, messages: list[Written | None]) -> None:
        """Files of the attempts that count are moved to their names; all else of the job goes."""
        from pyarrow import fs

        store, top = self.store()
        names = [n for m in messages if m for n in m.files]
        try:
            if len(set(names)) < len(names):
                raise ValueError("a file was written by two tasks; see in_order")
            if self.overwrite:
                for info in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                    if info.is_file and info.base_name.lower().endswith(".pdb"):
                        store.delete_file(info.path)
            for m in messages:
                for name in m.files if m else ():
                    store.move(f"{top}/{PENDING}-{self.job}/{m.attempt}/{name}.pdb", f"{top}/{name}.pdb")
        finally:
            self.clear(store, top)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*self.store())

    def clear(self, store, top: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{top}/{PENDING}-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{PENDING}-{self.job}")


class ContainerFiles(DataSource):
    """``df.write.format("container_files").mode("append" or "overwrite").save(folder)``: a container for each value of ``file``."""

    @classmethod
    def name(cls) -> str:
        return "container_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(dict(self.options), overwrite)


def write_containers(records: DataFrame, folder: str) -> None:
    """Write rows of SCHEMA as containers of ``folder``; they show when all have been written."""
    records.sparkSession.dataSource.register(ContainerFiles)
    in_order(records).write.format(ContainerFiles.name()).mode("append").save(folder)
