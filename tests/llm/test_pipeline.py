"""The pipeline: each stage's decisions against brute force on a small table, and odd rows."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import corpus_pipeline
from leafspark.llm import toxicity

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_stages_in_order(spark, docs, tmp_path_factory):
    kept, top = docs, tmp_path_factory.mktemp("stages")
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, kept, SF_DIR).write.parquet(f"{top}/{i}")
        out = spark.read.parquet(f"{top}/{i}")
        if i < 4:
            assert out.columns == docs.columns and 0 < out.count() <= kept.count(), name
            kept = out
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    pieces = out.toPandas()
    assert set(pieces["doc_id"]) == ids
    assert (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()
    whole = corpus_pipeline.run(spark, SF_DIR).toPandas()
    columns = ["doc_id", "start", "length", "doc_tokens"]
    assert whole["length"].sum() == pieces["length"].sum() and set(whole["doc_id"]) == ids
    assert sorted(whole[columns].groupby("doc_id")["length"].sum()) == sorted(pieces[columns].groupby("doc_id")["length"].sum())


def test_near_copies_keep_one(spark, docs):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(10, text), (11, text), (12, text.replace("word40", "other")), (13, "quite another text of a few words only"), (14, None)]
    frame = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in stage("near_dedup")(spark, frame, SF_DIR).collect()) == [10, 13, 14]


def test_passages_are_cut(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"Start here\n{passage}\nend"), (2, f"Other\n{passage}\nlast line"), (3, passage), (4, None)]
    frame = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in stage("substring_dedup")(spark, frame, SF_DIR).collect()}
    assert set(got) == {1, 2, 4} and got[1]["text"] == rows[0][1] and got[2]["text"] == "Other\nlast line"
    assert got[2]["n_chars"] == len("Other\nlast line") and got[2]["lang"] == "en"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, docs, name):
    odd = [(None, "no id but some words", None, None, None), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "word " * 30_000, "en", "s", 1), (9004, "twice the same row", "en", "s", 1), (9004, "twice the same row", "en", "s", 1)]
    frame = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    out = stage(name)(spark, frame, SF_DIR)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert None in ids
    if name == "packing":
        totals = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
        assert totals[9001] == 1 and totals[9002] == 1 and np.isclose(totals[9003], 30_001)
    if name != "language":
        assert ids.count(9004) >= 2


def test_language_decides_on_each_row(spark, docs):
    clean = docs.where("lang = 'en'").orderBy(F.length("text").desc()).first()["text"]
    odd = [(None, "1234 5678", "en", "s", 9), (9101, "1234 5678", "en", "s", 9), (9101, clean, "en", "s", len(clean)), (None, clean, "en", "s", len(clean))]
    out = stage("language")(spark, docs.unionByName(spark.createDataFrame(odd, SCHEMA)), SF_DIR)
    got = [(r["doc_id"], r["text"]) for r in out.where("doc_id IS NULL OR doc_id = 9101").collect()]
    assert out.columns == docs.columns and sorted(got, key=str) == sorted([(9101, clean), (None, clean)], key=str)


def test_language_drops_what_is_in_none(spark, docs):
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(chr(97 + c) if c < 26 else " " for c in rng.integers(0, 31, n))
    junk = ["1234 5678 " * 20, letters(400), "Это другой язык, которого нет среди известных. " * 5, "これは知らない言語の文章です。" * 8, "||| --- ### ==="]
    frame = docs.unionByName(spark.createDataFrame([(9200 + i, t, None, "s", len(t)) for i, t in enumerate(junk)], SCHEMA))
    left = {r["doc_id"] for r in stage("language")(spark, frame, SF_DIR).select("doc_id").collect()}
    assert left == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_columns_of_any_name_go_through(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    names = ["n_removed", "removed", "recurring", "label", "held_out", "row_id", "language", "kept", "host", "carried", "n_words", "score", "component_id"]
    rows = [(1, f"the and of {passage}", "en", "s", 9, *range(13)), (2, f"other of that {passage} and the", "en", "s", 9, *range(13)), (None, "the of and", "en", "s", 9, *range(13))]
    frame = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} int" for n in names))
    for name, f in corpus_pipeline.STAGES[:4]:
        out = f(spark, frame, SF_DIR)
        assert out.columns == frame.columns, name
        assert all([r[n] for n in names] == list(range(13)) for r in out.collect()), name


def test_session_options_and_folders_are_left_as_they_were(spark, tmp_path):
    from leafspark.llm import scratch

    keys = scratch._BATCH_OPTIONS
    before = [spark.conf.get(k) for k in keys]
    with scratch.released(spark):
        frame = scratch.saved(spark.range(5), "numbers")
        assert [spark.conf.get(k) for k in keys] == before and frame.count() == 5
        (folder,) = {f.rsplit("/", 1)[0].removeprefix("file:") for f in frame.inputFiles()}
        assert os.path.isdir(folder)
    assert not os.path.isdir(folder)


def test_toxicity_decides_on_each_row(spark, docs):
    net = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, net).join(docs, "doc_id").where("text <> ''").orderBy("score").collect()
    clean, toxic = scored[0]["text"], scored[-1]["text"]
    assert scored[0]["predicted"] == 0 and scored[-1]["predicted"] == 1
    odd = [(None, toxic, "en", "s", 9), (9101, toxic, "en", "s", 9), (9101, clean, "en", "s", 9), (None, clean, "en", "s", 9)]
    out = stage("toxicity")(spark, docs.unionByName(spark.createDataFrame(odd, SCHEMA)), SF_DIR)
    got = [(r["doc_id"], r["text"]) for r in out.where("doc_id IS NULL OR doc_id = 9101").collect()]
    assert out.columns == docs.columns and sorted(got, key=str) == sorted([(9101, clean), (None, clean)], key=str)


@pytest.mark.parametrize("name", ["near_dedup", "substring_dedup", "packing", "toxicity", "language"])
def test_empty_table(spark, docs, name):
    assert stage(name)(spark, docs.limit(0), SF_DIR).count() == 0


def test_broadcast_is_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "MOST_BROADCAST_IDS", 0)
    out = corpus_pipeline.without(docs, docs.where("doc_id % 2 = 0"))
    assert "broadcast" not in out._jdf.queryExecution().logical().toString().lower()
    assert out.count() == docs.where("doc_id % 2 = 1").count()


@pytest.mark.parametrize("name", ["language", "toxicity"])
def test_text_goes_through_python_once(spark, docs, name):
    def fields(kind):
        return sum((fields(f.dataType) if f.dataType.typeName() == "struct" else [f.name] for f in kind), [])

    def given(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        own = [fields(StructType.fromJson(json.loads(below[0].schema().json())))] if node.nodeName() == "MapInArrow" else []
        return sum((given(x) for x in below), own)

    every = given(stage(name)(spark, docs, SF_DIR)._jdf.queryExecution().optimizedPlan())
    assert every and all(f.count("text") == 1 for f in every)
