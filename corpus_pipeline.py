"""A training corpus from ``documents`` in five stages.

Each stage takes what its predecessor kept and returns a DataFrame, which is written as Parquet in the
cluster's shared folder and read again. All but the last return the columns of ``documents``. Language and
toxicity decide on each row, whatever its doc_id. Near copies are found among doc_ids: there, rows without one
stay and rows that share one share their fate.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.llm import language, near_dedup, packing, substring_dedup, toxicity
from leafspark.llm.scratch import released, remove, saved, shared_dir
from leafspark.session import table

#: So many ids, of 16 bytes each at most, are broadcast; more are joined by a shuffle.
MOST_BROADCAST_IDS = 500_000


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``rejected``; a row without a doc_id stays."""
    ids = saved(rejected.select("doc_id").dropna().distinct(), "rejected")
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST_IDS else ids, "doc_id", "left_anti")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language. The text model is fitted on a bounded sample of ``docs``."""
    rows = docs.select("doc_id", "text", F.col("source").alias("host"), F.struct(*[c for c in docs.columns if c != "text"]).alias("others"))
    found = language.identify(rows, language.fit_languages(docs), ["doc_id"], carry=("others", "text"))
    return found.where("kept").select(*[F.col("carried.text") if c == "text" else F.col("carried.others").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the network, fitted on a bounded sample of labelled ones, finds toxic."""
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")), carry=tuple(docs.columns))
    return scored.where("predicted = 0").select("carried.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of near copies: five-word shingles, similarity 0.8."""
    return without(docs, near_dedup.near_duplicates(docs, size=5, percent=80).where(~F.col("kept"))).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of twenty words and more that also stand earlier; a document of nothing else goes."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = substring_dedup.deduplicate(docs, window=20, keep_layout=True, carry=others)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[own.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens into sequences of 4096: a row per piece, with its ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_languages),
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``. A stage's intermediate tables and its input are deleted when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = shared_dir(spark, f"stage-{name}")
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(at), at
    return docs
