"""Queries on tables of odd rows against their SQL, and what a task of Python holds at once."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafspark import session
from leafspark.functions import codecs, tables
from leafspark.operators import layout, nav, styles
from leafspark.plans import catalogue


def differs(spark, folder, name, documents):
    """Rows that only one of query and SQL gives on a table of documents (doc_id, text)."""
    spark.createDataFrame(documents, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    frame = catalogue.QUERIES[name](spark, str(folder))
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        found = duck.execute(catalogue.ORACLE_SQL[name])
        at = [[c[0] for c in found.description].index(c) for c in frame.columns]
        want = {tuple(row[i] for i in at) for row in found.fetchall()}
    return {tuple(r) for r in frame.collect()} ^ want


@pytest.mark.parametrize("size", [0, 1, 2, 3, 4, 5, 7, 8, 9])
def test_wide_pairs_of_short_records(spark, tmp_path, size):
    tail = "abéd.fghi"[:size]
    assert not differs(spark, tmp_path, "x3_wide_pairs", [(1, tail), (2, "word " * 800 + tail), (3, None)])


def test_fallback_finds_text_that_is_hardly_ascii(spark, tmp_path):
    texts = ["Üä " * 30, "日本" * 2000, "Привет " * 900, "\t" * 60, "é" * 24, "é" * 25, "Some plain text. " * 9, "", None]
    assert not differs(spark, tmp_path, "x4_record_fallback", list(enumerate(texts)))


def test_texts_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id AS doc_id", "repeat(sha2(string(id), 256), 400) AS text").coalesce(1)
    rows.write.option("compression", "none").option("parquet.block.size", 1 << 30).parquet(f"{tmp_path}/documents.parquet")
    dealt = catalogue._texts(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(dealt) > spark.sparkContext.defaultParallelism and max(r["count"] for r in dealt) < 2000 / spark.sparkContext.defaultParallelism


def test_a_tasks_rows_do_not_grow_with_the_table(spark):
    dealt = session.spread(spark.range(60_000).selectExpr("id AS doc_id"), "doc_id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in dealt) == 60_000 and max(r["count"] for r in dealt) < 1.2 * session.ROWS_OF_A_TASK


def test_pages_need_no_shuffle_of_lines(spark):
    docs = spark.createDataFrame([(i, "word " * (40 * i), [(0, 0)]) for i in range(12)] + [(12, None, None), (13, "", None)], "k long, text string, runs array<struct<start:long,style_id:int>>")
    m = layout.Measures(np.array([32]), np.array([3]), np.array([7]), np.array([10]), np.array([8]))
    whole = layout.mixed_pages(layout.measured_lines(docs, "k", 150, m), "k", 90, 300)
    at_once = layout.measured_lines(docs, "k", 150, m, pages=(90, 300))
    index = layout.page_index(docs, "k", 150, m, 90, 300, every=3)
    assert sorted(map(tuple, at_once.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(repr, index.collect())) == sorted(map(repr, layout.page_anchors(whole, "k", every=3).collect()))
    assert "Exchange" not in at_once._jdf.queryExecution().toString() + index._jdf.queryExecution().toString()


def test_results_are_handed_on_in_parts():
    batch = pa.array([b"x" * 100_000] * 100, pa.binary())
    parts = list(codecs.handed_on((batch,), len, pa.int64()))
    assert len(parts) >= 9 and pa.concat_arrays(parts).to_pylist() == [100_000] * 100
    assert list(codecs.handed_on((batch.slice(0, 0),), len, pa.int64())) == []
    short = pa.array([b"", None, b"a"] * 3, pa.binary())
    assert [len(x) for x in codecs.handed_on((short,), lambda x: x, pa.binary())] == [9]


def test_one_texts_lines_are_held_at_a_time():
    m = layout.Measures(np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([1]), np.array([10]), np.array([8]))
    batch = pa.record_batch({"k": pa.array([1, 2, 3]), "_text": ["a\n" * 60] * 3, "_runs": pa.array([None] * 3, pa.list_(pa.struct([("start", pa.int64()), ("style_id", pa.int32())]))), "_base": pa.array([0] * 3), "_end": pa.array([None] * 3, pa.int64())})
    assert [(row, lines.shape) for row, lines in layout._layouts(batch, 9, m)] == [(i, (5, 60)) for i in range(3)]


def test_tables_are_made_and_read_in_few():
    sizes = [len(x) for x in tables._in_few(iter([pa.array([b"ab"] * 100, pa.binary())]), len, pa.int64())]
    assert sum(sizes) == 100 and max(sizes) <= tables.HELD_TABLES


def test_titles_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(nav, "HELD_CHARS", 10)
    batch = pa.record_batch({"k": pa.array([1, 2, 3]), "t": pa.array([["ab", "zz"]] * 3), "x": ["xxxxxxab"] * 3})
    parts = list(nav._first_places(iter([batch])))
    assert len(parts) > 1 and [r for p in parts for r in p.to_pylist()] == [{"_key": i, "_title": "ab", "_at": 6} for i in (1, 2, 3)]


def test_a_documents_styles_are_worked_out_behind_the_join(spark):
    rows = spark.createDataFrame([(k, s) for k in (1, 2, 3) for s in range(-2, 40)], "k long, style_id int")
    bases = spark.createDataFrame([(1, 5, 0x31), (2, 30, 0xF0)], "k long, b long, a int")
    own = styles.font_table(bases, "b", "a")
    found = styles.style_of(rows, bases, styles.default_styles(spark), "k", "b", "a")
    mine = {(r["k"], r["style_id"]): (r["font_size"], r["bold"], r["italic"]) for r in own.collect()}
    given = {r["style_id"]: (r["font_size"], r["bold"], r["italic"]) for r in styles.default_styles(spark).collect()}
    put = lambda s: s if 0 <= s < 32 else 0
    assert {tuple(r) for r in found.collect()} == {(k, s, *mine.get((k, put(s)), given[put(s)])) for k in (1, 2, 3) for s in range(-2, 40)}
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_title_at_head_and_tail_is_linked_once(spark, tmp_path):
    rows = [(i, "Ö " * 40 if i % 3 else f"Line {i} of it\nÖ Ö Ö Ö Ö Ö Ö Ö") for i in range(300)]
    assert not differs(spark, tmp_path, "j1_toc_links", rows)
    frame = catalogue.QUERIES["j1_toc_links"](spark, str(tmp_path))
    assert frame.count() == frame.distinct().count()
