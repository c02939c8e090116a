"""Containers are read in one pass: scans and shuffles of the opened tables, and long turns of several records."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from leafspark.functions import codecs
from leafspark.operators import documents
from leafspark.sources import palm
from tests.test_containers import container, current_head, text_record


def plan_of(frame):
    return frame._jdf.queryExecution().sparkPlan().toString()


def counts(frame):
    return len(re.findall(r"FileScan binaryFile", plan_of(frame))), len(re.findall(r"Join", plan_of(frame)))


@pytest.fixture(scope="module")
def opened(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("one-pass")
    (top / "a.pdb").write_bytes(container(b"SDoc", [current_head(), text_record(b"some text"), b"\x04\x08" + b"\0\7\5\0Start"]))
    return documents.open_folder(spark, str(top))


@pytest.mark.parametrize("name", ["headers", "records", "documents", "contents", "page_offsets", "text_runs"])
def test_each_table_is_one_scan_without_joins(opened, name):
    assert counts(opened[name]) == (1, 0)


def test_diagnostics_are_two_scans(opened):
    assert counts(opened["diagnostics"]) == (2, 0)


@pytest.mark.parametrize("name", ["documents", "contents", "page_offsets", "text_runs"])
def test_each_table_has_one_shuffle(opened, name):
    assert len(re.findall(r"Exchange hashpartitioning", opened[name]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])) == 1


def test_every_format_in_one_table(spark):
    doc = container(b"TEXt", [b"\0\2\0\0\0\0\0\0\0\1\x10\0\0\0\0\0Doc\0", codecs.pack_palmdoc(b"one one one"), b"not text"])
    raw = container(b"TEXt", [b"\0\1\0\0\0\0\0\0\0\2\x10\0\0\0\0\0", b"as it is", b""], b"Raw")
    early = container(b"SDoc", [b"\0\1\0\0\3Old\2Me", codecs.pack_palmdoc(b"early")])
    second = container(b"ToGo", [b"\0\2\x80\0\0\0", b"second"], b"Two")
    current = container(b"SDoc", [current_head(encoding=0), text_record(b"caf\xe9 one "), b"\x04\x01other", text_record(b"two")], b"Now")
    broken = container(b"SDoc", [current_head(), b"\x04\0" + b"\xff" * 60], b"Broken")
    bare = container(b"SDoc", [b"\0\3short"], b"Bare")
    rows = [(k, v) for k, v in {"doc": doc, "raw": raw, "early": early, "second": second, "current": current, "broken": broken, "bare": bare, "none": container(b"TEXt", []), "cut": doc[:60]}.items()]
    found = documents.documents(palm.headers(spark.createDataFrame(rows, "path string, content binary")))
    assert {r["path"]: (r["format"], r["title"], r["text"], r["text_bytes"]) for r in found.collect()} == {
        "doc": (5, "Doc", "one one one", 11), "raw": (5, "Raw", "as it is", 8), "early": (1, "Old", "early", 5), "second": (2, "Two", "second", 6),
        "current": (3, "Now", "café one two", 12), "broken": (3, "Broken", "", 0), "bare": (3, "Bare", "", 0),
    }


def test_runs_over_records(spark):
    parts = [b"a" * 100, b"b" * 30, b"c" * 70]
    raw = container(b"SDoc", [current_head(), text_record(parts[0], b"\x10\x20"), text_record(parts[1], b"\x40"), text_record(parts[2], b"")])
    runs = documents.text_runs(palm.headers(spark.createDataFrame([("x", raw)], "path string, content binary")))
    # blocks of 64 bytes, and eight flag bytes of which those not given are 0
    assert [tuple(r)[1:] for r in runs.orderBy("run_idx").collect()] == [(0, 0, 64, 1), (1, 64, 36, 2), (2, 100, 30, 3), (3, 130, 64, 0), (4, 194, 6, 0)]


def test_a_turn_of_several_records_keeps_its_style(spark, tmp_path):
    from leafspark.plans import catalogue

    turns = [(1, 0, "user", "x" * 100_000), (1, 1, "assistant", "y" * 10), (2, 0, "user", "")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    runs = catalogue.w5_styled_runs(spark, str(tmp_path)).groupBy("path", "style_id").agg(F.sum("length")).collect()
    assert {tuple(r) for r in runs} == {("1", 1, 100_000), ("1", 2, 10)}
    assert [r["title"] for r in catalogue.f12_contents(spark, str(tmp_path)).where("path = '1'").collect()] == ["turn 0", "turn 1"]
    assert catalogue.w2_page_trees(spark, str(tmp_path)).where("path = '1'").count() == 2
