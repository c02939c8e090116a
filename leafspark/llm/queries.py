"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.llm import best_fit, chat, fill_in_middle, hard_negatives, language, media, near_dedup, packing, pieces, quality_model, quality_rules, substring_dedup, toxicity
from leafspark.llm.oracles import OP1, OP3, OP4, OP9, OP11, OP12
from leafspark.llm.scratch import shared_dir
from leafspark.session import table


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.media_columns(table(spark, sf_dir, "documents"), shared_dir(spark, "media"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    read = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return read.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.length("text").cast("long").alias("decoded_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs.select("doc_id", "text", F.col("source").alias("host")), language.fit_languages(docs), ["doc_id"])


def op7_language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on web pages, which have all hints; the text model is fitted on ``documents``."""
    pages = table(spark, sf_dir, "pages").withColumn("host", language.address_host(F.col("url")))
    rows = pages.select("page_id", language.visible_text(F.col("html")).alias("text"), language.markup_language(F.col("html")).alias("declared"), language.suffix_language(F.col("host")).alias("suffix"), "host")
    return language.identify(rows, language.fit_languages(table(spark, sf_dir, "documents")), ["page_id"])


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score_quality(docs, quality_model.fit_quality(docs, table(spark, sf_dir, "labels")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    columns = ["conv_id", "turn", "role", "text"]
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(*columns).unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("host"), "text"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.restore(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.col("vec_id") % 50 == 0)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = best_fit.pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_chat": op3_chat,
    "op4_quality_rules": op4_quality_rules,
    "op5_media_columns": op5_media_columns,
    "op6_pieces": op6_pieces,
    "op7_language": op7_language,
    "op7_language_of_pages": op7_language_of_pages,
    "op8_quality_model": op8_quality_model,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_best_fit": op13_best_fit,
}
ORACLE_SQL: dict[str, str] = {"op1_near_dedup": OP1, "op3_chat": OP3, "op4_quality_rules": OP4, "op9_substring_dedup": OP9, "op11_fill_in_middle": OP11, "op12_hard_negatives": OP12}
