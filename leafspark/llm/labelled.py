"""Bounded samples of labelled documents, for fitting small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of a doc_id's text, modulo ``modulus``; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def at_most(rows: DataFrame, most_rows: int) -> DataFrame:
    """All rows, or if there are more than ``most_rows`` about nine tenths of so many, by a hash of doc_id.

    A share of the hash's range is taken, so no task sends more than its part of the sample; the limit
    only cuts where one doc_id repeats very often.
    """
    n = rows.count()
    if n <= most_rows:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < int(900_000_000 * most_rows / n)).limit(most_rows)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most_rows: int) -> DataFrame:
    """At most ``most_rows`` labelled documents, of any length, that aren't held out: doc_id, text, label.

    The sample is of labels, so only ``most_rows`` short rows are broadcast to the documents; null labels
    aren't taken for fitting. Of rows that share a doc_id, the one of the least text is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(at_most(known, most_rows)), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
