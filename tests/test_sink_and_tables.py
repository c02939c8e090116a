"""The container sink, counts on the way, style entries and theme tables."""

from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafspark.functions import tables
from leafspark.operators import documents
from leafspark.sources import palm, writing
from leafspark.sources.files import read_files
from tests.test_containers import container


def rows_of(spark, files, per_file=4):
    rows = [(f"f{k}", f"Name {k}", "TEXt", "Test", i, i + k, bytes([k]) * (10 * i)) for k in range(files) for i in range(per_file)]
    return spark.createDataFrame(rows, writing.SCHEMA).repartition(5)


def test_files_are_written_and_read_back(spark, tmp_path):
    spark.dataSource.register(writing.ContainerFiles)
    folder = str(tmp_path / "out")
    rows = rows_of(spark, 7)
    writing.in_order(rows).write.format("container_files").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == sorted(f"f{k}.pdb" for k in range(7))
    heads = palm.headers(read_files(spark, [folder]))
    got = {(r["path"].rsplit("/", 1)[1][:-4], r["idx"], r["attr"], bytes(r["data"])) for r in palm.records(heads).collect()}
    assert got == {(r["file"], r["idx"], r["attr"], bytes(r["data"])) for r in rows.collect()}
    assert {(r["name"], r["type"], r["creator"]) for r in heads.collect()} == {(f"Name {k}", "TEXt", "Test") for k in range(7)}
    writing.in_order(rows_of(spark, 2)).write.format("container_files").mode("overwrite").save(folder)
    assert sorted(os.listdir(folder)) == ["f0.pdb", "f1.pdb"]


def test_nothing_shows_of_a_write_that_fails(spark, tmp_path):
    spark.dataSource.register(writing.ContainerFiles)
    folder = str(tmp_path / "out")
    bad = rows_of(spark, 6).withColumn("idx", F.when(F.col("file") == "f5", 0).otherwise(F.col("idx")))
    with pytest.raises(Exception, match="in order"):
        writing.in_order(bad).write.format("container_files").mode("append").save(folder)
    assert not os.path.isdir(folder) or os.listdir(folder) == []


def test_attempts_that_are_not_committed_never_show(tmp_path):
    from pyspark.sql import Row

    writer = writing.ContainerWriter({"path": str(tmp_path)}, False)
    row = lambda data: Row(file="a", name="A", type="TEXt", creator="x", idx=0, attr=0, data=data)
    writer.write(iter([row(b"lost attempt")]))
    counted = writer.write(iter([row(b"counted")]))
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".pdb")]
    writer.commit([counted, None])
    assert os.listdir(tmp_path) == ["a.pdb"] and (tmp_path / "a.pdb").read_bytes().endswith(b"counted")
    again = writing.ContainerWriter({"path": str(tmp_path)}, False)
    with pytest.raises(ValueError):
        again.commit([again.write(iter([row(b"1")])), again.write(iter([row(b"2")]))])
    assert os.listdir(tmp_path) == ["a.pdb"]
    third = writing.ContainerWriter({"path": str(tmp_path)}, False)
    third.write(iter([row(b"3")]))
    third.abort([])
    assert os.listdir(tmp_path) == ["a.pdb"]


def test_counts_on_the_way_equal_the_table(spark):
    raw = container(b"TEXt", [b"\0\1\0\0\0\0\0\0\0\1\x10\0\0\0\0\0", b"text"])
    rows = [("a", raw), ("b", raw[:60]), ("c", container(b"TEXt", [])), ("d", container(b"Else", [b"x"])), ("e", container(b"Else", [])), ("f", raw)]
    heads = palm.headers(spark.createDataFrame(rows, "path string, content binary"))
    counted, seen = palm.observed(heads)
    assert documents.documents(counted).count() == 2
    failures = palm.open_failures(palm.identified(heads)).groupBy("message").count().collect()
    assert {r["message"]: r["count"] for r in failures} == {"header cut off": seen.get["cut_off"], "no records": seen.get["no_records"], "unknown format": seen.get["unknown_format"]}
    assert seen.get["containers"] == 6


def test_style_entries_and_what_is_dropped(spark):
    good = b"\x05\0\0\0\0\x04\0\x02\x00" + b"\x07\x00\0\1\0\2\0\3" + b"\x08\x05\1\0\2\0\3\0"
    rows = [("good", good), ("cut", good[:20]), ("short", b"\1\2"), ("odd", b"\x03" + bytes(9)), ("far", b"\x90" + bytes(9)), ("none", None), ("empty", good[:7] + b"\0\0")]
    recs = spark.createDataFrame(rows, "k string, data binary")
    got = {}
    for r in recs.lateralJoin(tables.StyleEntries(F.col("data").outer())).collect():
        got.setdefault(r["k"], []).append(tuple(r)[2:])
    assert got == {
        "good": [(0, 7, 0, 1, 2, 3, None), (1, 8, 5, 256, 512, 768, None)], "cut": [(0, 7, 0, 1, 2, 3, None), (1, None, None, None, None, None, "1 entries cut off")],
        "short": [(0, *[None] * 5, "record too short")], "odd": [(0, *[None] * 5, "no description")], "far": [(0, *[None] * 5, "no description")], "none": [(0, *[None] * 5, "record too short")],
    }


THEMES = st.lists(st.fixed_dictionaries({"id": st.integers(0, 65535), "name": st.text(max_size=12), "colours": st.lists(st.fixed_dictionaries({c: st.integers(0, 255) for c in "rgb"} | {"idx": st.integers(0, 255)}), max_size=4)}), max_size=5)


@given(THEMES, st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_theme_tables_round_trip(themes, cut):
    table = {"bytes": 5, "next_id": 9, "flags": 1, "themes": themes}
    data = tables.packed(table, tables.TABLE)
    assert tables.unpacked(data, tables.TABLE) == (table, len(data))
    assert len(data) == 8 + sum(4 + 2 * (len(x["name"].encode("utf-16-be")) // 2) + 4 * len(x["colours"]) for x in themes)
    if cut < len(data):
        assert tables.unpacked(data[:cut], tables.TABLE) is None


def test_theme_bytes_are_those_of_the_layout():
    table = {"bytes": 14, "next_id": 2, "flags": 0, "themes": [{"id": 258, "name": "é", "colours": [{"idx": 1, "r": 2, "g": 3, "b": 4}]}]}
    assert tables.packed(table, tables.TABLE) == bytes((0, 14, 0, 1, 0, 2, 0, 0, 1, 2, 1, 1, 0, 0xE9, 1, 2, 3, 4))
