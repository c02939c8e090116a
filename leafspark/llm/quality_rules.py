"""Quality rules: statistics of each text, and lines that too many documents of a host share.

Only DataFrame functions run here. One pass over the texts writes a small table (statistics, and for
every line a 64-bit hash of its normal form with its word count) to the cluster's shared folder; line
frequencies and removals are computed from that table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspark.llm.scratch import saved

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    A line is removed when it stands in more than ``line_documents`` different texts of its host and in
    more than ``line_share`` of them. A document is depleted when fewer than ``kept_share`` of its
    words are left.
    """

    window: int = 8
    least_words: int = 20
    repeat_percent: int = 30
    line_documents: int = 10
    line_share: float = 0.02
    kept_share: float = 0.5


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def line_normal_form(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), BLANKS, " "))


def with_statistics(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, host, a hash of the text and its statistics, with ``lines``: (hash, words) of every line that has a word."""
    w = rules.window
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("host").cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    listed = base.withColumns(
        {
            "words": word_list(F.col("text")),
            "full_lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)),
            "n_symbols": F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long"),
        }
    )
    hashed = listed.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform("full_lines", lambda x: F.struct(F.xxhash64(line_normal_form(x)).alias("hash"), F.size(word_list(x)).alias("words"))).alias("lines"),
    )
    windows = hashed.withColumn(
        "windows",
        F.when(
            F.col("n_words") >= w,
            F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - w), lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(w)])),
        ),
    )
    ordered = windows.withColumn(
        "ordered",
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    starts = ordered.withColumn(
        "starts",
        F.sort_array(
            F.transform(
                F.filter("ordered", lambda x, j: F.coalesce(F.get("ordered", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("ordered", j + 1)["h"] == x["h"], F.lit(False))),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("total"), F.lit(-w).alias("last")),
        lambda acc, p: F.struct((acc["total"] + F.least(F.lit(w), p - acc["last"])).alias("total"), p.alias("last")),
        lambda acc: acc["total"],
    )
    return starts.select("doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "lines")


def apply_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Statistics and verdict for every row of ``docs`` (doc_id, host, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    n_removed_words (words on lines above the limits). A row whose base rules fail isn't kept; another
    isn't kept when its removed lines leave fewer than ``kept_share`` of its words.

    Copies of a text are one document of their host, whatever their doc_ids: a line is frequent by what
    different texts share, and copies are the business of the dedup operators. So repeated rows change
    nothing and all come back, and a null doc_id is like any other. A null text has no words and fails; a
    null host is a host of its own; other columns are ignored; an empty table gives no rows. Documents are
    made distinct by (host, line, text) before they are counted, so a line in every document of a host is
    spread over the tasks.
    """
    stats = saved(with_statistics(docs, rules).withColumn("row_id", F.monotonically_increasing_id()), "line-statistics")
    counts = (
        stats.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash"))
        .groupBy("host", "hash")
        .agg(F.countDistinct("text_hash").alias("documents"))
    )
    hosts = stats.groupBy("host").agg(F.countDistinct("text_hash").alias("host_documents"))
    frequent = (
        counts.where(F.col("documents") > rules.line_documents)
        .alias("c")
        .join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
        .where(F.col("documents") > rules.line_share * F.col("host_documents"))
        .select("c.host", "hash")
    )
    lines = stats.select("row_id", "host", F.explode("lines").alias("line")).select("row_id", "host", "line.hash", "line.words").alias("l")
    removed = (
        lines.join(frequent.alias("f"), F.col("l.host").eqNullSafe(F.col("f.host")) & (F.col("l.hash") == F.col("f.hash")), "left_semi")
        .groupBy("row_id")
        .agg(F.sum("words").alias("n_removed_words"))
    )
    base_failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    return (
        stats.drop("host", "text_hash", "lines")
        .join(removed, "row_id", "left")
        .withColumns({"base_failed": base_failed, "n_removed_words": F.coalesce("n_removed_words", F.lit(0)).cast("long")})
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= rules.kept_share * F.col("n_words")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")
    )
