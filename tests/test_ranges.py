"""The range-reading source: what is read, filters, several ranges of one container, codes."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from leafspark.sources import palm, ranges
from leafspark.sources.files import read_files
from tests.test_containers import container


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ranges.ContainerRecords)
    top, rng = tmp_path_factory.mktemp("ranges"), random.Random(1)
    for k in range(6):
        (top / f"c{k}.pdb").write_bytes(container(b"TEXt", [rng.randbytes(rng.randint(0, 20_000)) for _ in range(3 + 5 * k)], b"Name %d" % k))
    (top / "cut.PDB").write_bytes(container(b"TEXt", [b"abc", b"defgh"])[:-6])
    (top / "short.pdb").write_bytes(b"x" * 20)
    (top / "none.pdb").write_bytes(container(b"TEXt", []))
    (top / "notes.txt").write_bytes(b"no container")
    return str(top)


def load(spark, folder, **options):
    return spark.read.format("container_records").options(**options).load(folder)


@pytest.mark.parametrize("size", [3_000, 100_000, 64_000_000])
def test_records_equal_those_of_whole_files(spark, folder, size):
    got = load(spark, folder, rangeBytes=size).where("idx IS NOT NULL")
    want = palm.records(palm.headers(read_files(spark, [folder])))
    key = lambda d: sorted((r["path"].rsplit("/", 1)[1], r["idx"], r["offset"], r["size"], r["attr"], r["data"] and bytes(r["data"])) for r in d.collect())
    assert key(got) == key(want)


def test_codes(spark, folder):
    rows = {(r["path"].rsplit("/", 1)[1], r["idx"]): (r["code"], r["message"]) for r in load(spark, folder).where("code < 0").collect()}
    assert rows == {("cut.PDB", 0): (palm.SHORT_READ, "record 0 is cut off"), ("cut.PDB", 1): (palm.SHORT_READ, "record 1 is cut off"), ("short.pdb", None): (palm.CORRUPT, "header cut off"), ("none.pdb", None): (palm.CORRUPT, "no records")}
    asked = load(spark, folder, records="0, 7").where("path LIKE '%c%.%'")
    assert sorted((r["path"].rsplit("/", 1)[1], r["idx"], r["code"]) for r in asked.collect() if r["idx"] == 7) == sorted([(f"c{k}.pdb", 7, 0 if 3 + 5 * k > 7 else ranges.NO_RECORD) for k in range(6)] + [("cut.PDB", 7, ranges.NO_RECORD)])
    assert {r["idx"] for r in asked.collect()} == {0, 7}


def test_filters_reach_the_reader(spark, folder):
    found = load(spark, folder).where("idx = 2 AND attr > 1").select("path", "idx").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found) == [f"c{k}.pdb" for k in range(6)]
    reader = ranges.RecordReader({"path": folder})
    assert len(list(reader.pushFilters([EqualTo(("path",), f"{folder}/c1.pdb"), In(("idx",), (0, 1)), GreaterThan(("attr",), 0), EqualTo(("size",), 5)]))) == 4
    (partition,) = reader.partitions()
    assert [p.shown.rsplit("/", 1)[1] for p in partition.pieces] == ["c1.pdb"]
    assert [r for b in reader.read(partition) for r in b.column("idx").to_pylist()] == [1]


class Counted:
    """A file that counts the bytes that are read of it."""

    def __init__(self, data):
        self.data, self.place, self.read_bytes = data, 0, 0

    def seek(self, at):
        self.place = at

    def read(self, n):
        part = self.data[self.place : self.place + n]
        self.read_bytes += len(part)
        return part


def test_record_0_alone_reads_its_own_bytes():
    data = container(b"TEXt", [b"h" * 30] + [b"x" * 60_000] * 50)
    reader = ranges.RecordReader({"path": "/nowhere"})
    list(reader.pushFilters([EqualTo(("idx",), 0)]))
    f = Counted(data)
    (row,) = reader.rows(f, ranges.Piece("p", "p", len(data), 0, 64_000_000))
    assert row[8] == b"h" * 30 and f.read_bytes == 78 + 8 * 51 + 30


def test_entries_out_of_order_are_read_once_each():
    raw = bytearray(container(b"TEXt", [b"aaa", b"bb", b"c"]))
    at = 78 + 24
    for i, offset in enumerate((at + 3, at, at + 5)):
        raw[78 + 8 * i : 82 + 8 * i] = struct.pack(">I", offset)
    reader = ranges.RecordReader({"path": "/nowhere"})
    rows = {r[4]: (r[8], r[9]) for r in reader.rows(Counted(bytes(raw)), ranges.Piece("p", "p", len(raw), 0, 10))}
    assert set(rows) <= {0, 1, 2}
    whole = {r[4]: (r[8], r[9]) for r in reader.rows(Counted(bytes(raw)), ranges.Piece("p", "p", len(raw), 0, 1000))}
    assert whole == {0: (None, palm.SHORT_READ), 1: (b"aaabb", 0), 2: (b"c", 0)}


def test_an_aggregate_over_it(spark, folder):
    n = load(spark, folder, rangeBytes=5_000).where("code = 0").agg(F.sum("size")).first()[0]
    assert n == palm.records(palm.headers(read_files(spark, [folder]))).where("data IS NOT NULL").agg(F.sum("size")).first()[0]
